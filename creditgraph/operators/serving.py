"""The serving copy: projections, attribute dictionaries, samples, exports, and table writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import MISSING, entity_url
from .aggregates import attribute_dictionary
from .stores import file_exists, write


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def write_table(df: DataFrame, root: str, name: str, mode: str = "errorifexists") -> None:
    write(df, f"{root}/{name}", mode)


def write_tokens(tokens: DataFrame, root: str, buckets: int = 64) -> None:
    """Distinct (token, id) in folders by token hash, sorted by token: a lookup reads one folder's matching row groups."""
    out = tokens.select("token", "id").distinct().withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
    out.repartition("bucket").sortWithinPartitions("token").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/token")


def write_edges(edges: DataFrame, root: str) -> None:
    """Two copies, sorted by subject and by object, for lookups from either side."""
    for side in ("subject", "object"):
        edges.repartitionByRange(side).sortWithinPartitions(side, "role").write.mode("overwrite").parquet(f"{root}/relation_by_{side}")


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which no listed column is null, empty or 0."""
    for c in columns:
        kind = df.schema[c].dataType.simpleString()
        df = df.where(F.col(c).isNotNull() & (F.col(c) != ("" if kind == "string" else 0)))
    return df


def by_type(df: DataFrame, entity_type: int) -> DataFrame:
    return df.where(F.col("entity_type") == entity_type)


def lookup(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_semi").select(*df.columns)


def serving_entities(entity: DataFrame, attributes: DataFrame, keep_sublabels: bool = False) -> DataFrame:
    """entities' map struct as columns, empty maps null, with countries, genres and styles."""
    maps = ["aliases", "groups", "members", "parent_label", *(["sublabels"] if keep_sublabels else [])]
    flat = entity.select("id", "entity_id", "entity_type", "entity_name", "relation_counts", "entity_metadata", *(F.when(F.size(f"entities.{m}") > 0, F.col(f"entities.{m}")).alias(m) for m in maps))
    return flat.join(attributes, "id", "left")


def write_attributes(attributes: DataFrame, root: str) -> None:
    """(id, countries, genres, styles) for lookups by id."""
    attributes.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{root}/entity_attributes")


def serving_tables(entity: DataFrame, edges: DataFrame, role: DataFrame, tokens: DataFrame, attributes: DataFrame, keep_sublabels: bool = False) -> dict[str, DataFrame]:
    """The build tables as the serving copy has them: entities with flat maps and attributes, edges with role ids, the role list, tokens."""
    numbered = edges.join(role.select("role_id", F.col("role_name").alias("role")), "role").select("subject", "role_id", "object", "release_id", "year")
    return {"entity": serving_entities(entity, attributes, keep_sublabels), "relation": numbered, "role": role_list(role), "token": tokens.select("token", "id").distinct()}


def entity_details(serving: DataFrame, keys: DataFrame) -> DataFrame:
    return lookup(serving, keys, ["entity_id", "entity_type"])


def role_list(role: DataFrame) -> DataFrame:
    return role.select("role_id", "role_name", "role_category")


def committed(spark: SparkSession, path: str) -> bool:
    """Whether path holds a whole table: Spark's _SUCCESS is written last."""
    return file_exists(spark, f"{path}/_SUCCESS")


def build_serving(tables: dict[str, DataFrame], root: str) -> None:
    """Writes each table that is not there yet, or whose write was killed; country, genre and style dictionaries come from the entities as they are written."""
    spark = tables["entity"].sparkSession
    for name, df in tables.items():
        if not committed(spark, f"{root}/{name}"):
            write_table(df, root, name, "overwrite")
    entity = read_table(spark, root, "entity")
    for name, column in (("country", "countries"), ("genre", "genres"), ("style", "styles")):
        if not committed(spark, f"{root}/{name}"):
            write_table(attribute_dictionary(entity.where(F.col(column).isNotNull()), column), root, name, "overwrite")


def first_row(df: DataFrame, by: str) -> DataFrame:
    return df.orderBy(F.col(by).asc_nulls_last()).limit(1)


def last_row(df: DataFrame, by: str) -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_last()).limit(1)


def is_connected(serving: DataFrame) -> Column:
    """An artist with a membership or alias in its counts, or with members or groups."""
    counts = [F.coalesce(F.map_contains_key("relation_counts", r), F.lit(False)) for r in ("Member Of", "Alias")]
    maps = [F.coalesce(F.size(c), F.lit(0)) > 0 for c in ("members", "groups") if c in serving.columns]
    any_ = counts[0] | counts[1]
    for m in maps:
        any_ |= m
    return (F.col("entity_type") == 1) & any_


def random_connected(serving: DataFrame, k: int = 1, seed: int = 0) -> DataFrame:
    """k connected artists in an order by hash of id and seed."""
    return serving.where(is_connected(serving)).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k)


def random_rows(df: DataFrame, k: int, seed: int = 0, key: str = "id") -> DataFrame:
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(k)


def url_parts(entity: DataFrame, base_url: str, per_file: int = 50_000) -> DataFrame:
    """(part, place, id, url) of entities that have a URL, by id: place counts from 0 over all, part has per_file of them; parts grow in number with the rows.

    Counts of id ranges give each range its offset, so no task numbers all rows.
    """
    spark = entity.sparkSession
    ids = entity.select("id", entity_url(F.col("id"), base_url).alias("url")).where((F.col("id") != MISSING) & F.col("url").isNotNull()).distinct()
    total = ids.count()
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = ids.approxQuantile("id", [i / n for i in range(1, n)], 0.01) if total else []
    ranged = ids.withColumn("range", F.size(F.filter(F.array(*(F.lit(int(b)) for b in sorted(set(bounds)))) if bounds else F.array().cast("array<bigint>"), lambda b: b < F.col("id"))))
    sizes = sorted((r["range"], r["count"]) for r in ranged.groupBy("range").count().collect())
    offsets, at = [], 0
    for r, c in sizes:
        offsets.append((r, at))
        at += c
    before = spark.createDataFrame(offsets, "range int, before long")
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("id")) - 1
    placed = ranged.join(F.broadcast(before), "range").withColumn("place", place)
    return placed.select(F.floor(F.col("place") / per_file).cast("int").alias("part"), "place", "id", "url")


def write_url_lists(entity: DataFrame, path: str, base_url: str, per_file: int = 50_000, max_files: int = 500) -> int:
    """Writes gzip text, a folder for each part, and indexes of max_files parts each with the day, by number in folders; returns the number of URLs."""
    spark = entity.sparkSession
    parts = url_parts(entity, base_url, per_file)
    parts.repartition("part").sortWithinPartitions("place").select("part", F.col("url").alias("value")).write.partitionBy("part").option("compression", "gzip").text(f"{path}/parts")
    index = parts.groupBy("part").agg(F.count("*").alias("urls")).withColumn("lastmod", F.current_date()).withColumn("index", F.floor(F.col("part") / max_files).cast("int"))
    index.write.partitionBy("index").json(f"{path}/index")
    return spark.read.json(f"{path}/index").agg(F.coalesce(F.sum("urls"), F.lit(0))).first()[0]
