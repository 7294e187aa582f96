"""Sharding by sampled splitters, so that all shards hold nearly the same number of bytes.

Records are ordered by (hash of the text, id, checksum): equal texts lie together, and a group of them that lies across
a boundary of shards is cut there, by id. Size-weighted samples of these keys give the boundaries of many small ranges;
ranges that come out overfull are sampled again and subdivided. Within its range each record gets a running sum,
the exact sums of the ranges before are added, and the byte position found so decides the shard. Samples thus
decide only how the work is split, never which shard a record goes to.

Defined cases: a null text has no bytes and checksum 0; null ids come first among equal texts, in any order. Records alike in
text and id are interchangeable, and take neighbouring places in any order. No rows give no rows. Other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, staged

RANGE_ROWS = 500_000  # rows that a range is aimed at, at scale
MOST_RANGES = 16_384  # what the driver holds: so many boundaries, and SAMPLES samples for each
SAMPLES = 32
NULL_ID = -(2**63)
NULLS = 1 << 40  # rows without an id get keys of their own, so that many of them are no single key


@dataclass
class Splitters:
    """Upper boundaries of all ranges but the last, as sorted (hash, id) pairs."""

    h: np.ndarray
    i: np.ndarray

    def find(self, h: np.ndarray, i: np.ndarray) -> np.ndarray:
        """For each key the number of boundaries not above it."""
        lo, hi = np.searchsorted(self.h, h, "left"), np.searchsorted(self.h, h, "right")
        tie = np.flatnonzero(lo < hi)
        for a, b in {(a, b) for a, b in zip(lo[tie], hi[tie], strict=True)}:
            at = tie[(lo[tie] == a) & (hi[tie] == b)]
            hi[at] = a + np.searchsorted(self.i[a:b], i[at], "right")
        return hi.astype(np.int32)


def keys(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32 and the key (h, i) of each record."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("h"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID) + F.monotonically_increasing_id() % NULLS).alias("i"))


def draw(rows: DataFrame, chance) -> np.ndarray:
    """Keys of the rows that chance takes, which is bounded by its sum; the draw depends on the row alone."""
    u = (F.xxhash64(F.lit(7), "h", "i") % (1 << 52)) / float(1 << 53) + 0.5
    got = rows.where(u < chance).select("h", "i").toPandas()
    return got.sort_values(["h", "i"]).to_numpy(dtype=np.int64).reshape(-1, 2)


def quantiles(sample: np.ndarray, ranges: int) -> np.ndarray:
    """ranges - 1 of the sorted keys, evenly far apart, each once."""
    if not len(sample) or ranges < 2:
        return sample[:0]
    return np.unique(sample[np.arange(1, ranges) * len(sample) // ranges], axis=0)


def ranged(rows: DataFrame, s: Splitters) -> DataFrame:
    @F.pandas_udf("int")
    def find(h: pd.Series, i: pd.Series) -> pd.Series:
        return pd.Series(s.find(h.to_numpy(), i.to_numpy()))

    return rows.withColumn("range", find("h", "i"))


def range_totals(rows: DataFrame) -> pd.DataFrame:
    return rows.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), (F.min(F.struct("h", "i")) == F.max(F.struct("h", "i"))).alias("single")).toPandas().sort_values("range", ignore_index=True)


def split(rows: DataFrame, ranges: int, total: int, n: int) -> tuple[Splitters, pd.DataFrame]:
    """Boundaries for about so many ranges, with overfull ones subdivided, and what each range holds."""
    found = quantiles(draw(rows, F.col("size") * (float(ranges) * SAMPLES / max(total, 1))), ranges)
    for _ in range(8):
        s = Splitters(found[:, 0], found[:, 1])
        totals = range_totals(ranged(rows, s))
        over = totals[((totals.bytes > 3 * total / ranges) | (totals.rows > 3 * n / ranges + 64)) & ~totals.single & (totals.rows > 8)]
        if over.empty or len(found) >= MOST_RANGES:
            break
        parts = np.maximum(2, np.ceil(np.maximum(over.bytes * ranges / max(total, 1), over.rows * ranges / max(n, 1)))).astype(int)
        chance = {int(r): float(p) * SAMPLES / float(k) for r, p, k in zip(over.range, parts, over.rows, strict=True)}
        of_range = rows.sparkSession.createDataFrame([(r, c) for r, c in chance.items()], "range int, chance double")
        more = ranged(rows, s).join(F.broadcast(of_range), "range")
        got = draw(more, F.col("chance"))
        at = s.find(got[:, 0], got[:, 1]) if len(got) else np.zeros(0, int)
        new = [quantiles(got[at == r], p) for r, p in zip(over.range, parts, strict=True)]
        grown = np.unique(np.concatenate([found, *new]), axis=0)
        if len(grown) == len(found):
            break
        found = grown
    return s, totals


def assign_shards(docs: DataFrame, shards: int = 24, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to shards - 1) and slot (gapless from 0 in each shard) of every record.

    A shard's bytes differ from the mean by less than the largest record.
    """
    spark = docs.sparkSession
    rows = staged(keys(docs, text, doc_id), "shard-keys")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = min(MOST_RANGES // 4, max(4 * shards, 4 * partitions(spark), n // RANGE_ROWS))
    s, totals = split(rows, ranges, total, n)
    base = pd.DataFrame({"range": totals.range, "bytes_before": totals.bytes.cumsum() - totals.bytes, "rows_before": totals.rows.cumsum() - totals.rows})
    before = spark.createDataFrame([tuple(map(int, x)) for x in base.itertuples(index=False)], "range int, bytes_before long, rows_before long")
    w = Window.partitionBy("range").orderBy("h", "i", "text_crc32")
    placed = (
        ranged(rows, s)
        .withColumn("place", F.row_number().over(w) - 1)
        .withColumn("bytes_in", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(F.broadcast(before), "range")
        .select("doc_id", "size", "text_crc32", F.least(F.lit(shards - 1), F.expr(f"int((2 * (bytes_before + bytes_in) + size) * {shards} div {max(2 * total, 1)})")).alias("shard"), (F.col("rows_before") + F.col("place")).alias("place"))
    )
    placed = staged(placed, "shard-places")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # as many rows as shards
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, text: str = "text", doc_id: str = "doc_id") -> None:
    """Write docs, whose ids are unique, as Parquet below path, a folder for each shard, in slot order within each file."""
    at = assign_shards(docs, shards, text, doc_id).select(F.col("doc_id").alias("_id"), "shard", "slot")
    clash = [c for c in docs.columns if c.lower() in ("shard", "slot", "_id")]
    if clash:
        raise ValueError(f"rename these columns first: {clash}")
    out = docs.join(at, docs[doc_id].eqNullSafe(at["_id"])).drop("_id")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
