"""Bounded networks around many centres at once.

A round takes two steps over all centres: the nodes at a distance, each with what its entity says of it and with its centre's state (stop, pruned, nodes so far),
and the links that they have. Each step's rows are kept before the next one, so no plan grows with the rounds: those of a few centres, which the
limits bound, on the driver, and others in a folder that driver and executors share; a lost executor costs one step. Edges and entities
may be given as stores, which are not moved: what is asked goes to them.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import ARTIST, LABEL, LABEL_OFFSET, entity_key, external_id, link_key
from .aggregates import expected_links, in_years, node_size, relation_volume
from .stores import BROADCAST, LITERAL, Store, delete, drop_kept, kept, matched, new_path, write

# Fixed values of the network's rules.
STRUCTURAL = ("Alias", "Member Of", "Sublabel Of")
PRUNED_ROLES = ("Released On", "Compiled On", "Producer", "Remix", "DJ Mix", "Written-By")
EXCLUDED_NAMES = ("Various", "Not On Label", "Self Released", "Self-Released")
EXCLUDED_PREFIX = "Various Artists"
ALIAS_CUTOFF, PRUNE_DIVISOR, STOP_MULTIPLIER = 3, 4, 3
PROFILES = {"large": {"degree": 5, "max_nodes": 400, "link_ratio": 10}, "small": {"degree": 3, "max_nodes": 25, "link_ratio": 10}}
FEW = 8  # centres whose steps are kept on the driver,
FEW_ROWS = 100_000  # if one has no more rows than this


class Steps:
    """Where the steps of networks are kept."""

    def __init__(self, few: bool):
        self.few, self.paths = few, []

    def keep(self, df: DataFrame, name: str) -> tuple[DataFrame, pa.Table | None]:
        """df, without its lineage; also as a table, if that is on the driver."""
        spark = df.sparkSession
        if self.few:
            table = df.limit(FEW_ROWS + 1).toArrow()
            if table.num_rows <= FEW_ROWS:
                return spark.createDataFrame(table, df.schema), table
        self.paths.append(new_path(spark, name))
        return write(df, self.paths[-1]), None

    def drop(self, *steps: DataFrame) -> None:
        """Deletes what was written of steps that nothing reads any more."""
        for df in steps if self.paths else ():
            drop_kept(df)

    def clear(self, spark: SparkSession) -> None:
        """Deletes what was written."""
        for path in self.paths:
            delete(spark, path)
        self.paths = []


def is_excluded(entity_id: Column, name: Column) -> Column:
    return F.coalesce(entity_id, F.lit(0)).eqNullSafe(F.lit(0)) | F.coalesce(name, F.lit("")).isin("", *EXCLUDED_NAMES) | F.coalesce(F.startswith(name, F.lit(EXCLUDED_PREFIX)), F.lit(False))


def stated_links(roles: tuple[str, ...], columns: list[str]) -> Column:
    """array<struct<role, one, two>>: links that an entity's own maps state. An alias has the smaller external id first."""

    def of(c: str) -> Column:
        return F.coalesce(F.filter(F.map_values(c), lambda x: x.isNotNull() & (x != 0)), F.array().cast("array<bigint>"))

    def alias(other: Column) -> tuple[Column, Column]:
        low = external_id(other)["entity_id"] <= F.col("entity_id")
        return F.when(low, other).otherwise(me), F.when(low, me).otherwise(other)

    me = F.col("id")
    kinds = [
        ("Alias", ARTIST, "aliases", alias),
        ("Member Of", ARTIST, "groups", lambda x: (me, x)),
        ("Member Of", ARTIST, "members", lambda x: (x, me)),
        ("Sublabel Of", LABEL, "parent_label", lambda x: (me, x)),
        ("Sublabel Of", LABEL, "sublabels", lambda x: (x, me)),
    ]
    none = F.array().cast("array<struct<role:string,one:bigint,two:bigint>>")

    def links(role: str, c: str, ends) -> Column:
        def link(x: Column) -> Column:
            one, two = ends(x)
            return F.struct(F.lit(role).alias("role"), one.cast("bigint").alias("one"), two.cast("bigint").alias("two"))

        return F.transform(of(c), link)

    return F.array_distinct(F.concat(none, *(F.when(F.col("entity_type") == t, links(role, c, ends)).otherwise(none) for role, t, c, ends in kinds if role in roles and c in columns)))


def structural_edges(serving: DataFrame, roles: tuple[str, ...] = STRUCTURAL) -> DataFrame:
    """(id, role, one, two): links that an entity's own maps state, with the id of the entity that states them."""
    return serving.select("id", F.explode(stated_links(roles, serving.columns)).alias("x")).select("id", "x.*").distinct()


def expand_frontier(edges: DataFrame | Store, frontier: DataFrame, roles: DataFrame, cap: int, lo: int | None = None, hi: int | None = None, names: list[str] | None = None, ids: list[int] | None = None) -> DataFrame:
    """(center_id, subject, role, object, release_id, year): edges that touch a centre's frontier (center_id, id) in that centre's
    roles (center_id, role); of each centre the first cap x (ids asked) by role, subject, object, release.

    Two equi joins and a distinct union; an OR condition would be a nested loop. names: all roles that any centre asks for; ids: the frontier's, if few.
    """
    size = frontier.count() if isinstance(edges, Store) and ids is None else None
    sides = [matched(edges, side, frontier, "id", size, ids) for side in ("subject", "object")]
    columns = ["center_id", "subject", "role", "object", "release_id", "year"]
    wanted = in_years(F.col("year"), lo, hi) & (F.col("role").isin(names) if names is not None else F.lit(True))
    # dealt by centre once: edges are made distinct, chosen and cut where they are
    touch = sides[0].where(wanted).select(*columns).unionByName(sides[1].where(wanted).select(*columns)).repartition("center_id").distinct()
    asked = frontier.groupBy("center_id").agg((F.count("*") * cap).alias("most")).join(roles.groupBy("center_id").agg(F.collect_set("role").alias("mine")), "center_id")
    w = Window.partitionBy("center_id").orderBy("role", "subject", "object", "release_id")
    met = touch.join(asked, "center_id").where(F.array_contains("mine", F.col("role"))).drop("mine")
    return met.withColumn("r", F.row_number().over(w)).where("r <= most").drop("r", "most")


def links_inside(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """links with both ends among their centre's nodes, which are bounded and meet them as one set, so links are dealt by centre once."""
    ids = nodes.groupBy("center_id").agg(F.collect_set("id").alias("_ids"))
    return links.join(ids, "center_id").where(F.array_contains("_ids", F.col("one")) & F.array_contains("_ids", F.col("two"))).drop("_ids")


def layer(nodes: DataFrame, links: DataFrame, degree: int = 5) -> tuple[DataFrame, DataFrame]:
    """Nodes that the centre reaches by links from a distance to a greater one, and the links between them. A network has a bounded number of both."""

    def reached(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        at, down = dict(zip(n["id"], n["distance"], strict=True)), {}
        for a, b in zip(e["one"], e["two"], strict=True):
            if at[a] != at[b]:
                far, near = (a, b) if at[a] > at[b] else (b, a)
                down.setdefault(near, []).append(far)
        seen = front = {i for i, d in at.items() if d == 0}
        for _ in range(degree + 1):
            front = {x for i in front for x in down.get(i, ())} - seen
            seen = seen | front
        return pd.DataFrame({"center_id": pd.Series([n["center_id"].iloc[0]] * len(seen) if len(n) else [], dtype="int64"), "id": pd.Series([*seen], dtype="int64")})

    inside = links_inside(links, nodes)
    own = nodes.select(F.col("center_id").alias("of"), F.col("center_id"), "id", "distance").groupBy("of")
    found = own.cogroup(inside.select(F.col("center_id").alias("at"), "one", "two").groupBy("at")).applyInPandas(reached, "center_id long, id long")
    kept_ = nodes.join(found, ["center_id", "id"], "left_semi")
    return kept_, links_inside(links, kept_)


def merged_years(a: Column, b: Column) -> Column:
    """The union of two maps from releases to years; the second decides on releases of both."""
    none = F.map_from_entries(F.array().cast("array<struct<key: bigint, value: int>>"))
    x, y = F.coalesce(a, none), F.coalesce(b, none)
    return F.map_concat(F.map_filter(x, lambda k, _: ~F.map_contains_key(y, k)), y)


def folded(edges: DataFrame) -> DataFrame:
    once = edges.groupBy("center_id", "subject", "role", "object", "release_id").agg(F.max("year").alias("year"))
    return once.groupBy("center_id", "subject", "role", "object").agg(F.map_from_entries(F.collect_list(F.struct("release_id", "year"))).alias("releases"))


def unordered(one: Column, two: Column) -> list[Column]:
    return [F.least(one, two).alias("low"), F.greatest(one, two).alias("high")]


def same_ends_years(links: DataFrame, found: DataFrame) -> DataFrame:
    """Releases of folded edges of the same role and ends, either way round, added to links."""
    flat = found.select("center_id", "role", *unordered(F.col("subject"), F.col("object")), F.explode("releases").alias("release_id", "year"))
    once = flat.groupBy("center_id", "role", "low", "high", "release_id").agg(F.max("year").alias("year"))
    by = once.groupBy("center_id", "role", "low", "high").agg(F.map_from_entries(F.collect_list(F.struct("release_id", "year"))).alias("more"))
    own = links.select("*", *unordered(F.col("one"), F.col("two"))).join(by, ["center_id", "role", "low", "high"], "left")
    return own.withColumn("releases", F.when(F.col("more").isNotNull(), merged_years(F.col("releases"), F.col("more"))).otherwise(F.col("releases"))).drop("low", "high", "more")


def cross_role_years(links: DataFrame, nodes: DataFrame, edges: DataFrame | Store, lo: int | None = None, hi: int | None = None, few: list[int] | None = None) -> DataFrame:
    """Undated links at the centre take the dated releases of any role between the same two entities, unless neither of them (nodes: id, volume) has any.

    few: the centres, if they are few.
    """
    at_center = (F.col("one") == F.col("center_id")) | (F.col("two") == F.col("center_id"))
    volume = nodes.groupBy("id").agg(F.max("volume").alias("volume"))
    asked = links.where(F.col("releases").isNull() & at_center & (F.col("one") != F.col("two"))).select("center_id", F.when(F.col("one") == F.col("center_id"), F.col("two")).otherwise(F.col("one")).alias("other")).distinct()
    live = asked.join(volume.select(F.col("id").alias("center_id"), F.col("volume").alias("v1")), "center_id").join(volume.select(F.col("id").alias("other"), F.col("volume").alias("v2")), "other").where("v1 > 0 or v2 > 0").select("center_id", "other")
    pairs = live.unionByName(live.select(F.col("other").alias("center_id"), F.col("center_id").alias("other"))) if few is None else live
    size = live.count() * 2 if isinstance(edges, Store) and few is None else None
    dated = None
    for side, end in (("subject", "object"), ("object", "subject")) if few is not None else (("subject", "object"),):
        met = matched(edges, side, pairs, "center_id", size, few).where(F.col("year").isNotNull() & in_years(F.col("year"), lo, hi) & (F.col(end) == F.col("other")))
        met = met.select(*unordered(F.col("subject"), F.col("object")), "release_id", "year")
        dated = met if dated is None else dated.unionByName(met)
    by = dated.groupBy("low", "high", "release_id").agg(F.max("year").alias("year")).groupBy("low", "high").agg(F.map_from_entries(F.collect_list(F.struct("release_id", "year"))).alias("more"))
    own = links.select("*", *unordered(F.col("one"), F.col("two"))).join(by, ["low", "high"], "left")
    return own.withColumn("releases", F.when(F.col("releases").isNull() & at_center, F.col("more")).otherwise(F.col("releases"))).drop("low", "high", "more")


def restrict_years(links: DataFrame, lo: int | None, hi: int | None) -> DataFrame:
    """Undated links stay; dated ones stay with their releases inside the bounds, or without a year, if any year is inside."""
    if lo is None and hi is None:
        return links
    years = F.filter(F.map_values("releases"), lambda y: y.isNotNull())
    inside = F.size(years).eqNullSafe(F.lit(0)) | F.col("releases").isNull() | F.exists(years, lambda y: in_years(y, lo, hi))
    return links.where(inside).withColumn("releases", F.map_filter("releases", lambda _, y: in_years(y, lo, hi)))


def drop_undated_members(links: DataFrame, lo: int | None, hi: int | None) -> DataFrame:
    """With bounds, memberships of the centre without a year are left out."""
    if lo is None and hi is None:
        return links
    undated = F.coalesce(F.size(F.filter(F.map_values("releases"), lambda y: y.isNotNull())), F.lit(0)) <= 0
    return links.where(~((F.col("role") == "Member Of") & ((F.col("one") == F.col("center_id")) | (F.col("two") == F.col("center_id"))) & undated))


def alias_ids() -> Column:
    return F.coalesce(F.filter(F.map_values("aliases"), lambda x: x.isNotNull()), F.array().cast("array<bigint>"))


def alias_clusters(nodes: DataFrame) -> DataFrame:
    """nodes (center_id, id, and aliases, a map, or alias_ids) with a cluster number: most aliases first, ties by id; a new cluster takes a node's aliases."""

    def number(g: pd.DataFrame) -> pd.DataFrame:
        known: dict[int, int] = {}
        out, n = [], 0
        g = g.assign(n=[len(a) for a in g["alias_ids"]]).sort_values(["n", "id"], ascending=[False, True])
        for i, aliases in zip(g["id"], g["alias_ids"], strict=True):
            if not len(aliases):
                out.append(None)
                continue
            if i not in known:
                n += 1
                known |= {i: n, **dict.fromkeys((int(a) for a in aliases), n)}
            out.append(known[i])
        return pd.DataFrame({"center_id": g["center_id"], "id": g["id"], "cluster": pd.array(out, dtype="Int32")})

    own = F.col("alias_ids") if "alias_ids" in nodes.columns else alias_ids()
    ids = nodes.select("center_id", "id", own.alias("alias_ids"))
    return nodes.join(ids.groupBy("center_id").applyInPandas(number, "center_id long, id long, cluster int"), ["center_id", "id"], "left")


def missing_links(nodes: DataFrame, links: DataFrame, roles: list[str]) -> DataFrame:
    """nodes with `links` (sorted keys) and `missing`, the expected number of links (in column expected, or from the maps) less those."""
    ends = links.select("center_id", F.explode(F.array_distinct(F.array("one", "two"))).alias("id"), "key")
    own = ends.groupBy("center_id", "id").agg(F.array_sort(F.collect_set("key")).alias("links"))
    out = nodes.join(own, ["center_id", "id"], "left").withColumn("links", F.coalesce("links", F.array().cast("array<string>")))
    expected = F.col("expected") if "expected" in nodes.columns else expected_links(roles)
    return out.withColumn("missing", expected - F.size("links"))


def unknown_roles(roles: list[str], known: DataFrame) -> list[str]:
    """Those of roles that are neither structural nor a role_name of known."""
    found = {r["role_name"] for r in known.where(F.col("role_name").isin(roles)).select("role_name").distinct().collect()}
    return [r for r in roles if r not in found and r not in STRUCTURAL]


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nodes_at(frontier: DataFrame, serving: DataFrame | Store, roles: list[str], distance: int, max_nodes: int, ids: list[int] | None) -> DataFrame:
    """The first max_nodes of each centre's frontier (center_id, id, stop, pruned, n_nodes), with what is known of them, whether they are accepted, and the centre's state.

    ids: those of the frontier, if few.
    """
    capped = first_ids(frontier, max_nodes)
    if isinstance(serving, Store):
        own = about_nodes(serving.of("id", capped.select("id").distinct(), "id", keys=ids), roles)
    else:
        own = about_nodes(serving, roles)
    met = capped.join(own, "id", "left").withColumn("accepted", F.col("entity_id").isNotNull() & ~F.coalesce("excluded", F.lit(True)))
    center = Window.partitionBy("center_id")
    total = F.col("n_nodes") + F.sum(F.col("accepted").cast("bigint")).over(center)
    alive = F.max(F.col("entity_id").isNull() | ~F.coalesce("excluded", F.lit(True))).over(center)
    met = met.withColumn("n_nodes", total).withColumn("stop", F.col("stop") | ~alive | (F.col("n_nodes") == 0) | ((F.lit(distance) > 0) & (F.col("n_nodes") >= max_nodes)))
    return met.withColumn("pruned", F.col("pruned") | ((F.lit(distance) > 0) & (F.col("n_nodes") > max_nodes / PRUNE_DIVISOR))).withColumn("distance", F.lit(distance)).drop("entity_id", "excluded")


def next_frontier(now: DataFrame, state: DataFrame, nodes: list[DataFrame], distance: int, max_nodes: int, max_links: int) -> DataFrame:
    """(center_id, id, stop, pruned, n_nodes): the first max_nodes ends of a round's links that are no nodes yet, and their centres' state (center_id, pruned, n_nodes)."""
    n = F.col("n")
    state = now.groupBy("center_id").agg(F.count("*").alias("n")).join(state.groupBy("center_id").agg(F.max("pruned").alias("pruned"), F.max("n_nodes").alias("n_nodes")), "center_id")
    state = state.select("center_id", ((n >= max_links * STOP_MULTIPLIER) | ((F.lit(distance) > 1) & (n >= max_links))).alias("stop"), "pruned", "n_nodes")
    ends = now.where(named_ends()).select("center_id", F.explode(F.array("one", "two")).alias("id"), F.lit(False).alias("known"))
    known = union([x.where("accepted").select("center_id", "id", F.lit(True).alias("known")) for x in nodes])
    # dealt by centre once, and cut there, before anything else meets them
    new = ends.unionByName(known).repartition("center_id").groupBy("center_id", "id").agg(F.max("known").alias("known")).where("not known").drop("known")
    return first_ids(new, max_nodes).join(state, "center_id")


def first_ids(frontier: DataFrame, most: int) -> DataFrame:
    """The first rows of each centre by id."""
    return frontier.withColumn("r", F.row_number().over(Window.partitionBy("center_id").orderBy("id"))).where(F.col("r") <= most).drop("r")


def named_ends() -> Column:
    return (F.col("one") % LABEL_OFFSET != 0) & (F.col("two") % LABEL_OFFSET != 0)


def within_reach(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """links without those that end beyond the greatest ids of their centre's nodes, which are neither grouped nor moved then; most are, as a frontier is cut by id."""
    of_artist = F.col("id") < LABEL_OFFSET
    greatest = nodes.groupBy("center_id").agg(F.max(F.when(of_artist, F.col("id"))).alias("artist"), F.max(F.when(~of_artist, F.col("id"))).alias("label"))
    near = [F.col(end) <= F.when(F.col(end) < LABEL_OFFSET, F.col("artist")).otherwise(F.col("label")) for end in ("one", "two")]
    few = nodes.where("distance = 0").limit(BROADCAST + 1).count() <= BROADCAST
    return links.join(F.broadcast(greatest) if few else greatest, "center_id").where(near[0] & near[1]).drop("artist", "label")


def merged_links(rounds: DataFrame | None, spark: SparkSession) -> DataFrame:
    """One link for each key: of those with dates the last, else the last of all."""
    if rounds is None:
        return spark.createDataFrame([], "center_id long, key string, role string, one long, two long, releases map<bigint,int>")
    good = rounds.where(named_ends() & (F.col("one") != F.col("two"))).withColumn("key", link_key(F.col("one"), F.col("role"), F.col("two")))
    best = good.groupBy("center_id", "key").agg(F.max_by(F.struct("role", "one", "two", "releases"), F.struct(F.col("releases").isNotNull(), F.col("round"))).alias("x"))
    return best.select("center_id", "key", "x.*")


def about_nodes(serving: DataFrame, roles: list[str]) -> DataFrame:
    """What a network needs to know of each entity: a few numbers, its aliases and the links that it states."""
    structural, relational = [r for r in roles if r in STRUCTURAL], [r for r in roles if r not in STRUCTURAL]
    narrow = [r for r in relational if r not in PRUNED_ROLES]
    excluded = is_excluded(F.col("entity_id"), F.col("entity_name"))
    return serving.select(
        "id", "entity_id", "entity_type", F.col("entity_name").alias("name"), excluded.alias("excluded"), expected_links(relational).alias("wide"), expected_links(narrow).alias("narrow"), expected_links(roles).alias("expected"),
        node_size(F.col("entity_type")).alias("size"), relation_volume(F.col("relation_counts")).alias("volume"), alias_ids().alias("alias_ids"), stated_links(tuple(structural), serving.columns).alias("stated"),
    )


def network(
    centers: DataFrame, serving: DataFrame | Store, edges: DataFrame | Store, roles: list[str], degree: int = 5, max_nodes: int = 400, link_ratio: int = 10, lo: int | None = None, hi: int | None = None, known_roles: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Nodes (center_id, id, key, name, type, size, distance, cluster, links, missing) and links (center_id, key, role, one, two,
    releases) around each of centers (center_id).

    Stores are by id (serving) and by subject and object (edges). known_roles (role_name): a role of neither it nor the structural ones is an error.
    """
    if known_roles is not None and (unknown := unknown_roles(roles, known_roles)):
        raise ValueError(f"unknown roles: {', '.join(unknown)}")
    spark, max_links = centers.sparkSession, max_nodes * link_ratio
    structural, relational = [r for r in roles if r in STRUCTURAL], [r for r in roles if r not in STRUCTURAL]
    narrow = [r for r in relational if r not in PRUNED_ROLES]
    some = [r["center_id"] for r in centers.select("center_id").distinct().limit(FEW + 1).collect()]
    steps, few = Steps(len(some) <= FEW), some if len(some) <= FEW else None
    frontier = centers.select("center_id", F.col("center_id").alias("id"), F.lit(False).alias("stop"), F.lit(False).alias("pruned"), F.lit(0).cast("bigint").alias("n_nodes")).distinct()
    asked_ids, all_nodes, all_links = few, [], []
    for distance in range(degree + 1):
        here, table = steps.keep(nodes_at(frontier, serving, roles, distance, max_nodes, asked_ids), "nodes")
        all_nodes.append(here)
        active = here.where("accepted and not stop")
        if (not any(a and not s for a, s in zip(table["accepted"].to_pylist(), table["stop"].to_pylist(), strict=True))) if table is not None else active.isEmpty():
            break
        visible = [r for r in structural if r != "Alias" or distance < ALIAS_CUTOFF]
        stated = active.select("center_id", F.explode(F.filter("stated", lambda x: x["role"].isin(visible))).alias("x")).select("center_id", "x.*").distinct().withColumn("releases", F.lit(None).cast("map<bigint,int>"))
        if distance < degree and roles:
            # hubs past the centre are not asked for
            size = F.when(F.col("pruned"), F.col("narrow")).otherwise(F.col("wide"))
            asked = active.where((F.lit(distance) == 0) | (size <= max_links)).select("center_id", "id")
            all_, less = (F.array(*(F.lit(r) for r in [*x, *structural])) for x in (relational, narrow))
            by_center = active.select("center_id", "pruned").distinct().select("center_id", F.explode(F.when(F.col("pruned"), less).otherwise(all_)).alias("role"))
            ids = None
            if table is not None:
                rows = zip(*(table[c].to_pylist() for c in ("id", "accepted", "stop", "pruned", "narrow", "wide")), strict=True)
                ids = [*{i for i, ok, stop, less_, n, w in rows if ok and not stop and (distance == 0 or (n if less_ else w) <= max_links)}]
            found = folded(expand_frontier(edges, asked, by_center, max_links, lo, hi, [*relational, *structural], ids if ids is None or len(ids) <= LITERAL else None))
            credits = found.where(~F.col("role").isin([*structural, ""])).select("center_id", "role", F.col("subject").alias("one"), F.col("object").alias("two"), "releases")
            now = same_ends_years(stated, found.where(F.col("role").isin([*structural]))).select(*stated.columns).unionByName(credits) if structural else credits
        else:
            now = stated
        state = active.select("center_id", "pruned", "n_nodes").distinct()
        now, _ = steps.keep(now, "links")
        all_links.append(now.withColumn("round", F.lit(distance)))
        frontier, asked_ids = next_frontier(now, state, all_nodes, distance, max_nodes, max_links), None
        if few is not None and isinstance(serving, Store):
            frontier, table = steps.keep(frontier, "frontier")
            asked_ids = table["id"].unique().to_pylist() if table is not None else None
    nodes = union(all_nodes).where("accepted").drop("stop", "pruned", "n_nodes", "accepted", "stated")
    inside = near = None
    if all_links:
        near, _ = steps.keep(within_reach(union(all_links), nodes), "near")  # written, or Spark would put the joins below before it
        steps.drop(*all_links)
        inside = links_inside(near, nodes)
    links, _ = steps.keep(merged_links(inside, spark), "merged")
    nodes, _ = steps.keep(layer(nodes, links, degree)[0], "layered")
    steps.drop(*all_nodes, *([near] if all_links else []))
    dated = drop_undated_members(restrict_years(cross_role_years(links_inside(links, nodes), nodes, edges, lo, hi, few), lo, hi), lo, hi)
    dated, _ = steps.keep(dated, "dated")
    steps.drop(links)
    nodes, _ = steps.keep(layer(nodes, dated, degree)[0], "layered")
    links = links_inside(dated, nodes).select("center_id", "key", "role", "one", "two", "releases")
    nodes = missing_links(alias_clusters(nodes), links, roles).select("center_id", "id", entity_key(F.col("id")).alias("key"), "name", "entity_type", "size", "distance", "cluster", "links", "missing")
    if steps.paths:
        nodes, links = kept(nodes, "network"), kept(links, "network-links")
        steps.clear(spark)
    return nodes, links



def network_json(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(center_id, json): the centre, nodes and links of each network, sorted by key. A network has a bounded number of both."""
    n = nodes.groupBy("center_id").agg(F.array_sort(F.collect_list(F.struct("key", "id", "name", "entity_type", "size", "distance", "links", "missing", "cluster"))).alias("nodes"), F.max(F.when(F.col("distance") == 0, F.struct("key", "name"))).alias("center"))
    years = F.array_sort(F.array_distinct(F.filter(F.coalesce(F.map_values("releases"), F.array().cast("array<int>")), lambda y: y.isNotNull())))
    e = links.groupBy("center_id").agg(F.array_sort(F.collect_list(F.struct("key", "role", entity_key(F.col("one")).alias("source"), entity_key(F.col("two")).alias("target"), years.alias("years")))).alias("links"))
    return n.join(e, "center_id", "left").select("center_id", F.to_json(F.struct("center", "nodes", F.coalesce("links", F.array().cast(e.schema["links"].dataType)).alias("links"))).alias("json"))


def tree_edges(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(center_id, id, other, up): linked nodes of each network; up tells whether other is nearer to the centre (1), as near (0) or farther (-1)."""
    at = nodes.select("center_id", "id", "distance")
    ends = links.select("center_id", F.col("one").alias("id"), F.col("two").alias("other")).unionByName(links.select("center_id", F.col("two").alias("id"), F.col("one").alias("other"))).where("id != other").distinct()
    both = ends.join(at, ["center_id", "id"]).join(at.select("center_id", F.col("id").alias("other"), F.col("distance").alias("d")), ["center_id", "other"])
    return both.select("center_id", "id", "other", F.signum(F.col("distance") - F.col("d")).cast("int").alias("up"))


def neighbours(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(center_id, id, neighbour): parents, children and siblings of each node."""
    return tree_edges(nodes, links).select("center_id", "id", F.col("other").alias("neighbour"))


def walked(nodes: DataFrame, links: DataFrame, degree: int, up: bool, schema: str, rows) -> DataFrame:
    """rows(id, reached) for each node: what it reaches by links to smaller (up) or greater distances, itself included. A network has a bounded number of nodes and links, and is dealt once."""
    columns = [c.split(" ")[0] for c in schema.split(", ")]

    def walk(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        at, step, out = dict(zip(n["id"], n["distance"], strict=True)), {}, []
        for a, b in zip(e["one"], e["two"], strict=True):
            if a in at and b in at and at[a] != at[b]:
                near, far = (a, b) if at[a] < at[b] else (b, a)
                step.setdefault(far if up else near, set()).add(near if up else far)
        for i in at:
            seen = front = {i}
            for _ in range(degree + 1):
                front = {x for f in front for x in step.get(f, ())} - seen
                if not front:
                    break
                seen = seen | front
            out += [(key[0], *row) for row in rows(i, seen)]
        return pd.DataFrame(out, columns=columns)

    return nodes.select("center_id", "id", "distance").groupBy("center_id").cogroup(links.select("center_id", "one", "two").groupBy("center_id")).applyInPandas(walk, schema)


def ancestors(nodes: DataFrame, links: DataFrame, degree: int = 5) -> DataFrame:
    """(center_id, id, ancestor): each node, its parents, theirs, and so on up to the centre."""
    return walked(nodes, links, degree, True, "center_id long, id long, ancestor long", lambda i, seen: [(i, x) for x in seen])


def pick_depth(sizes: DataFrame, threshold: float) -> DataFrame:
    """(center_id, depth) from sizes (center_id, distance, n; null n: not measured).

    Of the distances whose nth root of the sum of n sizes is under threshold, the one where it is greatest (ties: the greater distance), 0 if there is
    none; one more, if that is still in the first half of the distances.
    """
    mean = sizes.where("n is not null").groupBy("center_id", "distance").agg(F.pow(F.sum("n").cast("double"), 1.0 / F.count("*")).alias("mean"))
    levels = mean.groupBy("center_id").agg(F.count("*").alias("levels"), F.max(F.when(F.col("mean") < threshold, F.struct("mean", "distance")))["distance"].alias("best"))
    depth = F.coalesce("best", F.lit(0))
    every = sizes.select("center_id").distinct().join(levels, "center_id", "left")
    return every.select("center_id", (depth + F.when(depth + 1 < F.coalesce("levels", F.lit(0)) / 2, 1).otherwise(0)).cast("int").alias("depth"))


def subgraph_sizes(nodes: DataFrame, links: DataFrame, degree: int = 5) -> DataFrame:
    """(center_id, id, n): distinct nodes that a node reaches by links to greater distances, itself included."""
    return walked(nodes, links, degree, False, "center_id long, id long, n long", lambda i, seen: [(i, len(seen))])


def reduce_network(nodes: DataFrame, links: DataFrame, max_nodes: int = 600, max_links: int = 1800) -> tuple[DataFrame, DataFrame]:
    """Networks over the limits lose outer nodes with few links: distances 3, 2, 1, each with rising numbers of links, until they fit."""

    def shrink(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        alive, ends = dict(zip(n["id"], n["distance"], strict=True)), list(zip(e["key"], e["one"], e["two"], strict=True))
        for d in (3, 2, 1):
            for k in (1, 2, 3, 4, 5, 10, 100, 1_000_000):
                if len(alive) <= max_nodes and len(ends) <= max_links:
                    break
                count = pd.Series([x for _, a, b in ends for x in {a, b}], dtype="int64").value_counts()
                out = {i for i, at in alive.items() if at >= d and count.get(i, 0) <= k}
                if out and all(alive[i] == 1 for i in out):
                    continue
                alive = {i: at for i, at in alive.items() if i not in out}
                ends = [x for x in ends if x[1] in alive and x[2] in alive]
        keys = {x[0] for x in ends}
        lost = pd.Series([x for q, a, b in zip(e["key"], e["one"], e["two"], strict=True) if q not in keys for x in (a, b)], dtype="int64").value_counts()
        rows = [(key[0], "", int(i), int(lost.get(i, 0))) for i in sorted(alive)] + [(key[0], q, 0, 0) for q in sorted(keys)]
        return pd.DataFrame(rows, columns=["center_id", "key", "id", "lost"])

    picked = nodes.select("center_id", "id", "distance").groupBy("center_id").cogroup(links.select("center_id", "key", "one", "two").groupBy("center_id")).applyInPandas(shrink, "center_id long, key string, id long, lost int")
    picked = kept(picked, "reduced")
    left = picked.where("key = ''").select("center_id", "id", "lost")
    return nodes.join(left, ["center_id", "id"]).withColumn("missing", F.col("missing") + F.col("lost")).drop("lost"), links.join(picked.where("key != ''").select("center_id", "key"), ["center_id", "key"], "left_semi")


def alias_components(serving: DataFrame) -> DataFrame:
    """(id, component): the smallest id among all that aliases connect.

    Every round each node joins the node of least hash among itself and its neighbours, and the edges shrink to those between the joined ones, so
    the number of rounds grows with the logarithm of the longest path.
    """
    pairs = serving.select(F.col("id").alias("a"), F.explode(F.map_values("aliases")).alias("b")).where("b is not null and a != b")
    edges = kept(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "aliases")
    labels, seed = None, 0
    while not edges.isEmpty():
        seed += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy(F.col("a").alias("id")).agg(F.min(F.struct(F.xxhash64(F.lit(seed), "b"), "b")).alias("near"))
        own = F.struct(F.xxhash64(F.lit(seed), "id"), F.col("id").alias("b"))
        joined = kept(best.select("id", F.least("near", own)["b"].alias("to")), "joined")
        moved = joined.select(F.col("id").alias("component"), "to")
        labels = joined.select("id", F.col("to").alias("component")) if labels is None else labels.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        labels = kept(labels, "labels")
        a, b = (joined.select(F.col("id").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab")
        edges = kept(edges.join(a, "a").join(b, "b").where("to_a != to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "aliases")
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels.join(labels.groupBy("component").agg(F.min("id").alias("least")), "component").select("id", F.col("least").alias("component"))
