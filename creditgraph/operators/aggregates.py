"""Aggregates over credit edges (subject, role, object, release_id, year) and over releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_country, split_names
from .stores import kept


MOST_NAMES = 1_000_000  # a dictionary of countries, genres or styles has some thousands


def table_counts(df: DataFrame, by: str | None = None) -> DataFrame:
    return df.groupBy(*([by] if by else [])).agg(F.count("*").alias("rows"))


def role_pairs(edges: DataFrame) -> DataFrame:
    """(id, role, n): for each entity and role the distinct (subject, object) pairs that touch it; an edge to itself counts once.

    Edges are made distinct first, so that hub entities are counted from partial sums.
    """
    pairs = edges.select("subject", "role", "object").distinct()
    return pairs.select(F.explode(F.array_distinct(F.array("subject", "object"))).alias("id"), "role").groupBy("id", "role").agg(F.count("*").alias("n"))


def role_counts(edges: DataFrame) -> DataFrame:
    """(id, relation_counts map<role, n>)."""
    return role_pairs(edges).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("relation_counts"))


def fold_edges(edges: DataFrame) -> DataFrame:
    """(subject, role, object, releases map<release_id, year>); of several years of one release the latest, null last."""
    once = edges.groupBy("subject", "role", "object", "release_id").agg(F.max("year").alias("year"))
    return once.groupBy("subject", "role", "object").agg(F.map_from_entries(F.collect_list(F.struct("release_id", "year"))).alias("releases"))


def edges_of(edges: DataFrame, wanted: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """Edges that touch an id of wanted (id), with that id as `id`, once for each; roles (role) limits them."""
    if roles is not None:
        edges = edges.join(roles, "role", "left_semi")
    w = wanted.select("id").distinct()
    return edges.join(w.withColumnRenamed("id", "subject").withColumn("id", F.col("subject")), "subject").unionByName(edges.join(w.withColumnRenamed("id", "object").withColumn("id", F.col("object")), "object")).distinct()


def edges_by_key(edges: DataFrame, keys: DataFrame, role: DataFrame | None = None) -> DataFrame:
    """Edges with the keys (subject, role, object); with role (role_id, role_name), a key's role may be a name or an id."""
    if role is not None:
        names = role.select(F.col("role_id").cast("string").alias("role"), "role_name").unionByName(role.select(F.col("role_name").alias("role"), "role_name"))
        keys = keys.withColumn("role", F.col("role").cast("string")).join(names, "role").withColumn("role", F.col("role_name"))
    return edges.join(keys.select("subject", "role", "object").distinct(), ["subject", "role", "object"]).select(*edges.columns)


def releases_by_role(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, role, release_id, year) over edges on either side, a row for each release, however many an entity has."""
    ends = edges.select(F.explode(F.array_distinct(F.array("subject", "object"))).alias("id"), "role", "release_id", "year")
    return ends.join(wanted.select("id"), "id", "left_semi").groupBy("id", "role", "release_id").agg(F.max("year").alias("year"))


def relations_by_role(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, role, releases map<release_id, year>): releases_by_role() as maps, for entities whose releases fit into a row."""
    return releases_by_role(edges, wanted).groupBy("id", "role").agg(F.map_from_entries(F.collect_list(F.struct("release_id", "year"))).alias("releases"))


def relations_by_year(edges: DataFrame, wanted: DataFrame, role: DataFrame) -> DataFrame:
    """(id, year, category, role, n): releases of each entity by year, role category and role."""
    got = releases_by_role(edges, wanted)
    cats = role.select(F.col("role_name").alias("role"), F.col("role_category").alias("category"))
    return got.join(cats, "role", "left").groupBy("id", "year", "category", "role").agg(F.count("*").alias("n"))


def roles_by_category(role: DataFrame) -> DataFrame:
    return role.groupBy("role_category").agg(F.array_sort(F.collect_list("role_name")).alias("roles"))


def in_years(year: Column, lo: int | None, hi: int | None) -> Column:
    """Undated, or within the bounds that are given."""
    inside = F.lit(True)
    if lo is not None:
        inside &= year >= lo
    if hi is not None:
        inside &= year <= hi
    return year.isNull() | inside


def dated_in_years(year: Column, lo: int | None, hi: int | None) -> Column:
    return year.isNotNull() & in_years(year, lo, hi)


def release_years(releases: Column) -> Column:
    """The sorted distinct years of a map from releases to years."""
    return F.array_sort(F.array_distinct(F.filter(F.map_values(releases), lambda y: y.isNotNull())))


def entity_attributes(release: DataFrame, columns: tuple[str, ...] = ("countries", "genres", "styles")) -> DataFrame:
    """(id, countries, genres, styles), or those of columns: for every artist and label of each release the sorted distinct names, joined by commas. Entities without any of the names are left out."""
    ids = F.array_distinct(F.concat(*(F.coalesce(F.transform(c, lambda x: x["id"]), F.array().cast("array<bigint>")) for c in ("artists", "labels"))))
    kinds = {c: split_country(F.col("country")) if c == "countries" else F.flatten(F.transform(c, split_names)) for c in columns}
    pair = "array<struct<kind: int, name: string>>"

    def of_kind(k: int, names: Column) -> Column:
        return F.coalesce(F.transform(F.array_distinct(names), lambda x: F.struct(F.lit(k).alias("kind"), x.alias("name"))).cast(pair), F.array().cast(pair))

    whole = release.select(ids.alias("ids"), F.concat(*(of_kind(k, names) for k, names in enumerate(kinds.values()))).alias("names"))
    each = whole.select("ids", F.explode("names").alias("e"))  # names are split once a release, not once for each of its ids
    named = each.select(F.explode("ids").alias("id"), "e.kind", "e.name").distinct()
    return named.groupBy("id").agg(*(F.nullif(F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("name")))), ","), F.lit("")).alias(c) for k, c in enumerate(kinds)))


def attribute_dictionary(attributes: DataFrame, name: str) -> DataFrame:
    """(id, name): sorted distinct names with dense ids from 0. They are numbered in one task, so of more than MOST_NAMES ValueError is raised."""
    names = kept(attributes.select(F.explode(F.split(name, ",")).alias("name")).distinct(), "names")  # made once, to be counted and numbered
    if names.limit(MOST_NAMES + 1).count() > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} {name}")
    return names.select((F.row_number().over(Window.orderBy("name")) - 1).alias("id"), "name")


def expected_links(roles: list[str]) -> Column:
    """Links that an entity's row promises for roles: sizes of its maps for structural roles, counts for others."""

    def size(c: str) -> Column:
        return F.coalesce(F.size(c), F.lit(0))

    sizes = {"Alias": size("aliases"), "Member Of": size("groups") + size("members"), "Sublabel Of": size("parent_label") + size("sublabels")}
    total = F.lit(0).cast("bigint")
    for r in roles:
        total = total + (F.greatest(sizes[r], F.lit(0)) if r in sizes else F.coalesce(F.try_element_at("relation_counts", F.lit(r)), F.lit(0)))
    return total


def relation_volume(counts: Column) -> Column:
    return F.aggregate(F.coalesce(F.map_values(counts), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, x: a + x)


def node_size(entity_type: Column) -> Column:
    """Members of an artist, sublabels of a label."""
    return F.when(entity_type == 1, F.coalesce(F.size("members"), F.lit(0))).otherwise(F.coalesce(F.size("sublabels"), F.lit(0)))
