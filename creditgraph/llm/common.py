"""What the corpus operators share: the shared folder, written stages and table reads."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING, Self

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pyarrow as pa

BATCH = 1_000
BATCH_BYTES = 8 << 20
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master gets a folder of its own, and a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault("path", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, path: str | None = None, **options: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and a lost executor costs no recomputation. options: those of the write."""
    path = path or new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path object for path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


class Scratch:
    """Written stages of one piece of work. They are deleted when the with block ends, so its result is staged() before that."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def staged(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        self.paths.append(new_path(self.spark, name))
        return staged(df, name, self.paths[-1], **options)

    def __enter__(self) -> Self:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            delete(self.spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def short_batches(spark: SparkSession) -> None:
    """Send Python workers at most BATCH rows or about BATCH_BYTES at once, unless the session says otherwise: of Spark's default of 10,000 rows or 64 MB an executor and each of its workers hold several copies."""
    for key, usual, own in (("maxRecordsPerBatch", "10000", BATCH), ("maxBytesPerBatch", f"{64 << 20}b", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key) == usual:
            spark.conf.set(key, str(own))


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The rows of each value of key together, from batches that are sorted by it."""
    import numpy as np
    import pyarrow as pa

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1), len(values)]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[-1].column(key)[0].as_py() != values[begin]:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.concat_batches(held)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, which gives memory back to the machine when its task ends: Python workers live on, and would hold what the stages before them used."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return tidied


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column (compared as Spark does, without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def top_words(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent of counts(word, n): exactly `most`, or all if there are no more.

    Words are ordered by the leading twelve bits of their count, from the highest, and those alike by hash. Only histograms
    of bounded length come to the driver; counts is read a few times, so it should be written or cached.
    """
    bits = F.length(F.bin("n"))
    size = F.when(bits > 12, F.expr("shiftright(n, int(length(bin(n)) - 12)) * shiftleft(1L, int(length(bin(n)) - 12))")).otherwise(F.col("n"))
    part = F.pmod(F.xxhash64("word"), F.lit(4096))
    rows = counts.select("word", "n", size.alias("size"), part.alias("part"))
    whole, cut = fitting(rows.groupBy("size").count().collect(), most, highest=True)
    if cut is None:
        return counts.select("word", "n")
    taken = sum(n for _, n in whole)
    parts, last = fitting(rows.where(F.col("size") == cut).groupBy("part").count().collect(), most - taken, highest=False)
    taken += sum(n for _, n in parts)
    tied = rows.where(F.col("size") == cut)
    rest = tied.where(F.col("part") == last).orderBy(F.xxhash64("word"), "word").limit(most - taken)
    return rows.where(F.col("size") > cut).unionByName(tied.where(F.col("part") < last)).unionByName(rest).select("word", "n")


def fitting(sizes: list, most: int, highest: bool) -> tuple[list[tuple[int, int]], int | None]:
    """Of (key, count) in order of keys, those that fit into most together, and the first key that does not."""
    fits, total = [], 0
    for key, n in sorted(((int(k), int(n)) for k, n in sizes), reverse=highest):
        if total + n > most:
            return fits, key
        fits.append((key, n))
        total += n
    return fits, None
