"""Names to ids: exact joins, tiered matches over search tokens, profile links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import LABEL, MISSING, label_internal_id
from ..functions.text import drop_stop_words, profile_refs, search_normalise, without_stop_words
from .search import division, posting_lists
from .stores import Store


def ids_by_name(entity: DataFrame) -> DataFrame:
    """(entity_type, name, found): of several entities with a name the smallest id."""
    return entity.groupBy("entity_type", F.col("entity_name").alias("name")).agg(F.min("id").alias("found"))


def match_names(names: DataFrame, entity: DataFrame, tokens: DataFrame | Store) -> DataFrame:
    """(entity_type, name, found, tier) of distinct names (entity_type, name).

    Exact names first (tier 0); the rest meet the entities that have all their tokens, and the lowest tier wins: 1 normalised
    equal, 2 equal but for case, 3 both, 4 one contains the other, 5 equal without stop words; then the nearer length, then the smaller id.
    """
    names = names.select("entity_type", "name").where("name is not null and name != ''").distinct()
    exact = names.join(ids_by_name(entity), ["entity_type", "name"]).withColumn("tier", F.lit(0))
    rest = names.join(exact.select("entity_type", "name"), ["entity_type", "name"], "left_anti")
    words = F.array_distinct(without_stop_words(F.split(search_normalise(F.col("name")), r"\s+")))
    asked = rest.select("name").distinct().select(F.col("name").alias("query"), F.explode(words).alias("token"), F.size(words).alias("n"))
    found = division(asked, tokens if isinstance(tokens, Store) else posting_lists(tokens)).withColumnRenamed("query", "name").join(rest.select("entity_type", "name"), "name")
    c = found.join(entity.select("id", F.col("entity_type").alias("own_type"), F.col("entity_name").alias("other")), "id").where("own_type = entity_type")
    a, b = F.col("name"), F.col("other")
    na, nb = search_normalise(a), search_normalise(b)
    plain = [F.trim(F.regexp_replace(x, r"\(\d+\)", "")) for x in (a, b)]
    tier = (
        F.when(plain[0] == plain[1], 1).when(F.lower(a) == F.lower(b), 2).when(na == nb, 3)
        .when(F.contains(na, nb) | F.contains(nb, na), 4).when(drop_stop_words(na) == drop_stop_words(nb), 5)
    )
    tiered = c.withColumn("tier", tier).where("tier is not null").withColumn("far", F.abs(F.length(b) - F.length(a)))
    best = tiered.groupBy("entity_type", "name").agg(F.min(F.struct("tier", "far", "id")).alias("x")).select("entity_type", "name", F.col("x.id").alias("found"), F.col("x.tier").alias("tier"))
    return exact.unionByName(best)


def resolve_release_labels(release: DataFrame, entity: DataFrame, field: str = "labels") -> DataFrame:
    """release with an internal id in each element of field: by exact label name where it has none, MISSING where no label has it."""
    if "id" not in release.schema[field].dataType.elementType.names:
        release = release.withColumn(field, F.transform(field, lambda x: x.withField("id", F.lit(None).cast("bigint"))))
    flat = release.select("release_id", F.posexplode(field).alias("pos", "e"))
    known = ids_by_name(entity.where(F.col("entity_type") == LABEL)).select("name", "found")
    none = F.col("e.id").isNull() | (F.col("e.id") == 0)
    got = flat.join(known, F.col("e.name") == F.col("name"), "left")
    id_ = F.when(none, F.coalesce("found", F.lit(MISSING))).otherwise(label_internal_id(F.col("e.id")))
    back = got.groupBy("release_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("e").withField("id", id_).alias("e")))).alias("s"))
    return release.drop(field).join(back.select("release_id", F.transform("s", lambda x: x["e"]).alias(field)), "release_id", "left")


def resolve_entity_refs(entity: DataFrame, tokens: DataFrame, maps: tuple[str, ...] = ("aliases", "groups", "members", "parent_label", "sublabels")) -> DataFrame:
    """entity (with map columns name -> id) with ids filled in where they are null, 0 or -1; names without a match keep null."""
    each = None
    for m in (m for m in maps if m in entity.columns):
        part = entity.select("id", "entity_type", F.lit(m).alias("kind"), F.explode(m).alias("name", "value"))
        each = part if each is None else each.unionByName(part)
    if each is None:
        return entity
    open_ = F.col("value").isNull() | F.col("value").isin(0, -1)
    found = match_names(each.where(open_).select("entity_type", "name"), entity, tokens).select("entity_type", "name", "found")
    full = each.join(found, ["entity_type", "name"], "left").withColumn("value", F.when(open_, F.col("found")).otherwise(F.col("value")))
    entry = F.struct("name", "value")
    new = full.groupBy("id").agg(*(F.map_from_entries(F.collect_list(F.when(F.col("kind") == m, entry))).alias(f"_{m}") for m in maps if m in entity.columns))
    out = entity.join(new, "id", "left")
    return out.select(*(F.when(F.size(c) > 0, F.col(f"_{c}")).alias(c) if c in maps else F.col(c) for c in entity.columns))


def fill_profile_links(profiles: DataFrame, entity: DataFrame, release: DataFrame, master: DataFrame, tokens: DataFrame) -> DataFrame:
    """profiles (id, profile) with the missing id or name put into each link [a1], [l=Name], [r2], [m3]; links with both, and
    links that nothing is found for, stay. Each distinct link is looked up once.

    release (release_id, title), master (master_id, title).
    """
    refs = profiles.select(F.explode(profile_refs(F.col("profile"))).alias("r")).select("r.*").distinct()
    kind = F.when(F.col("kind") == "a", 1).when(F.col("kind") == "l", 2)
    by_name = refs.where("kind in ('a', 'l') and id = '' and name != ''").select("ref", "kind", "name", kind.alias("entity_type"))
    named = by_name.join(match_names(by_name, entity, tokens), ["entity_type", "name"]).join(entity.select(F.col("id").alias("found"), "entity_id"), "found")
    by_id = refs.where("id != '' and name = ''").withColumn("n", F.expr("try_cast(id AS BIGINT)"))
    names = entity.select(F.when(F.col("entity_type") == 1, "a").otherwise("l").alias("kind"), F.col("entity_id").alias("n"), F.col("entity_name").alias("text"))
    names = names.unionByName(release.select(F.lit("r").alias("kind"), F.col("release_id").alias("n"), F.col("title").alias("text"))).unionByName(master.select(F.lit("m").alias("kind"), F.col("master_id").alias("n"), F.col("title").alias("text")))

    def link(k, n, t):
        return F.concat(F.lit("["), k, n.cast("string"), F.lit("="), t, F.lit("]"))

    filled = named.select("ref", link(F.col("kind"), F.col("entity_id"), F.col("name")).alias("full")).unionByName(by_id.join(names.where("text is not null"), ["kind", "n"]).select("ref", link(F.col("kind"), F.col("n"), F.col("text")).alias("full")))
    filled = filled.groupBy("ref").agg(F.min("full").alias("full"))
    own = profiles.select("id", F.explode(F.array_distinct(F.transform(profile_refs(F.col("profile")), lambda r: r["ref"]))).alias("ref")).join(filled, "ref")
    by = own.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ref", "full"))).alias("subs"))
    out = profiles.join(by, "id", "left")
    return out.select("id", F.when(F.col("subs").isNull(), F.col("profile")).otherwise(F.aggregate("subs", F.col("profile"), lambda p, s: F.replace(p, s["ref"], s["full"]))).alias("profile"))
