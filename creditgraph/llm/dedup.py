"""Exact dedup against a persistent digest index, with DataFrame operations only.

The index is a Parquet table (digest, keep_id, group_size, batch), bucketed and sorted by digest.
A batch is grouped by digest and written as groups; digests that the index holds are taken away from these by a sort-merge
anti join, and the rest is appended. To the index go only 32-byte digests, and a digest's rows are combined
where they lie before they are shuffled by digest, so a hot one is no large key. annotate() joins whole rows with the index.

Defined cases: a null text counts as empty. Of equal texts in one batch the largest id stays (null ids are
the smallest). A digest that an earlier batch brought keeps that batch's id. Rows that repeat both id and text
are one document: annotate() marks each of them kept, drop_copies() returns one. An empty batch adds nothing.
Columns of any name pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, exists, free_name, new_path, partitions

#: A digest with at least this share of a batch's rows is joined by broadcast; there can be no more than 1 / HOT of them.
HOT = 1e-4
FORMAT = 1
FORMAT_FOLDER = "_format"  # beside the index's files; readers of tables skip it


class DigestIndex:
    """A digest table at path. It outlives the session: open() registers the same files again."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets
        self.repeats: dict[str, bool] = {}

    @classmethod
    def open(cls, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> DigestIndex:
        """The index at path, new or not. An index keeps the bucket count that it was made with; asking for another is an error."""
        path = (path or new_path(spark, "digests")).rstrip("/")
        about = f"{path}/{FORMAT_FOLDER}"
        if exists(spark, about):
            made = spark.read.parquet(about).first()
            if made["format"] != FORMAT or (buckets or made["buckets"]) != made["buckets"]:
                raise ValueError(f"the index at {path} has format {made['format']} and {made['buckets']} buckets")
            buckets = made["buckets"]
        elif exists(spark, path):
            raise ValueError(f"{path} exists, but is no digest index")
        else:
            buckets = buckets or partitions(spark)
            spark.range(1).select(F.lit(FORMAT).alias("format"), F.lit(buckets).alias("buckets")).write.parquet(about)
        name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        return cls(spark, name, path, buckets)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        """Take the table out of the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def append(self, groups: DataFrame) -> None:
        groups.select("digest", "keep_id", "group_size", "batch").repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def add(self, batch: DataFrame, text: str = "text", doc_id: str = "doc_id") -> str:
        """Append the digests of batch that the index lacks; returns the name that they bear as a batch."""
        name = uuid.uuid4().hex
        with Scratch(self.spark) as s:
            groups = s.staged(grouped(batch, text, doc_id), "digest-groups")  # written, or the anti join would be moved below the grouping
            fresh = groups.join(self.table().hint("merge"), "digest", "left_anti")
            self.append(fresh.withColumn("batch", F.lit(name)))
            self.repeats[name] = not groups.where("twins > 1").isEmpty()
        return name

    def compact(self, path: str | None = None) -> DigestIndex:
        """A copy of the index in which each bucket is one sorted file again, however many batches there were."""
        new = DigestIndex.open(self.spark, path, self.buckets)
        new.append(self.spark.read.schema(self.table().schema).parquet(self.path))  # as plain files: of a bucketed table Spark would leave the repartition out
        new.repeats = dict(self.repeats)
        return new

    def annotate(self, batch: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """batch with columns digest, keep_id, group_size, batch (which brought the digest) and kept (clashing names get underscores before them).

        Digests of large groups of this batch, of which there are few by count, meet the index by broadcast; the others by sort-merge join.
        group_size counts the rows of the batch that brought the digest, not later copies.
        """
        names = {c: free_name(batch, c) for c in ("digest", "keep_id", "group_size", "batch", "kept")}
        hot_, of_hot, cold_, of_cold, key, of = (free_name(batch, c) for c in ("_hot", "_of_hot", "_cold", "_of_cold", "_key", "_of"))
        index, most = self.table(), max(2.0, batch.count() * HOT)
        own_groups = batch.select(digest(text).alias("digest")).groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") >= most).select("digest")
        hot = index.join(F.broadcast(own_groups), "digest", "left_semi").select(F.col("digest").alias(hot_), F.struct("keep_id", "group_size", "batch").alias(of_hot))
        cold = index.select(F.col("digest").alias(cold_), F.struct("keep_id", "group_size", "batch").alias(of_cold))
        own = batch.withColumn(names["digest"], digest(text))
        mine = F.col(names["digest"])
        # a hot row needs nothing from the sort-merge join: it gets a key of its own there, so that no key is large
        lone = F.encode(F.concat_ws(":", F.lit("hot"), F.col(doc_id).cast("string"), F.monotonically_increasing_id()), "UTF-8")
        own = own.join(F.broadcast(hot), mine == F.col(hot_), "left").withColumn(key, F.when(F.col(hot_).isNull(), mine).otherwise(lone))
        own = own.join(cold.hint("merge"), F.col(key) == F.col(cold_), "left").withColumn(of, F.coalesce(of_hot, of_cold))
        for c in ("keep_id", "group_size", "batch"):
            own = own.withColumn(names[c], F.col(f"{of}.{c}"))
        return own.withColumn(names["kept"], F.col(doc_id).cast("long").eqNullSafe(F.col(names["keep_id"]))).drop(hot_, of_hot, key, cold_, of_cold, of)


def digest(text: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def grouped(batch: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """digest, keep_id, group_size and twins, the number of rows that have keep_id.

    Rows are first combined by digest and id, which spreads a hot digest; what is left of it in each partition is combined again before it moves.
    """
    rows = batch.select(digest(text).alias("digest"), F.col(doc_id).cast("long").alias("id"))
    each = rows.groupBy("digest", "id").agg(F.count("*").alias("n"))
    return each.groupBy("digest").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"), F.coalesce(F.max_by("n", "id"), F.sum("n")).alias("twins"))


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", index: DigestIndex | None = None) -> DataFrame:
    """docs with one row of each text, columns as they were; with an index, only rows whose text it did not hold before."""
    index = index or DigestIndex.open(docs.sparkSession)
    name = index.add(docs, text, doc_id)
    marked = index.annotate(docs, text, doc_id)
    digest_, _, _, batch, kept = marked.columns[len(docs.columns) :]
    stay = marked.where(F.col(kept) & (F.col(batch) == name))
    if index.repeats[name]:  # some rows repeat id and text
        stay = stay.dropDuplicates([digest_])
    return stay.select(*[f"`{c}`" for c in docs.columns])
