"""Tables that are kept in one copy for each key, bucketed and sorted by it: a lookup moves what is asked, never the table.

A store lives in a folder with a copy for each key. What is asked meets a copy in one of three ways, by its checked size: few keys are written into the
filter, so that only their buckets and row groups are read; a set that fits is broadcast; a larger one is dealt by the copy's
buckets. None of them moves the copy. A copy counts as there once its commit mark is written, after its files.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LITERAL = 2_000  # different keys that go into a filter
BROADCAST = 500_000  # rows of two numbers that are broadcast
IDS = 1_000_000  # ids that are broadcast
FORMAT = 1
MARK = "_format"  # readers of tables skip it


def file_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_own: list[str] = []


def round_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master gets a folder of its own, and a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{round_dir(spark)}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes in the block delete their shuffle files as they end; else these stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Writes df to path without leaving shuffle files, and reads it."""
    spark = df.sparkSession
    with shuffles_freed(spark):
        df.write.mode(mode).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again."""
    return write(df, new_path(df.sparkSession, name))


def sent(ids: DataFrame) -> DataFrame:
    """ids (id), broadcast if they are no more than IDS: what they meet is then not moved. They are counted, so they should be written."""
    return F.broadcast(ids) if ids.limit(IDS + 1).count() <= IDS else ids


def drop_kept(df: DataFrame) -> None:
    """Deletes what kept() wrote, when nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, path)


class Store:
    """Copies of a table, by key."""

    def __init__(self, spark: SparkSession, root: str, names: dict[str, str], buckets: int):
        self.spark, self.root, self.names, self.buckets = spark, root, names, buckets

    @classmethod
    def write(cls, df: DataFrame, root: str, keys: list[str], buckets: int | None = None) -> Store:
        """Writes the copies that root lacks. One whose write was killed has no mark and is written again."""
        spark = df.sparkSession
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        for key in keys:
            path = f"{root}/by_{key}"
            if file_exists(spark, f"{path}/{MARK}"):
                continue
            delete(spark, path)
            name = f"store_{uuid.uuid4().hex}"
            with shuffles_freed(spark):
                df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
            spark.sql(f"DROP TABLE {name}")  # open() names the files
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
            spark.range(1).select(F.lit(FORMAT).alias("format"), F.lit(buckets).alias("buckets"), F.lit(columns).alias("columns")).write.parquet(f"{path}/{MARK}")
        return cls.open(spark, root, keys)

    @classmethod
    def open(cls, spark: SparkSession, root: str, keys: list[str]) -> Store:
        names, buckets = {}, 0
        for key in keys:
            path = f"{root}/by_{key}"
            if not file_exists(spark, f"{path}/{MARK}"):
                raise FileNotFoundError(f"{path} has no commit mark")
            made = spark.read.parquet(f"{path}/{MARK}").first()
            if made["format"] != FORMAT:
                raise ValueError(f"{path} has format {made['format']}")
            buckets, names[key] = made["buckets"], f"store_{uuid.uuid4().hex}"
            spark.sql(f"CREATE TABLE {names[key]} ({made['columns']}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
        return cls(spark, root, names, buckets)

    def table(self, key: str | None = None) -> DataFrame:
        return self.spark.table(self.names[key or next(iter(self.names))])

    def close(self) -> None:
        """Takes the tables out of the catalog; their files stay."""
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def of(self, key: str, asked: DataFrame, on: str, size: int | None = None, keys: list[int] | None = None) -> DataFrame:
        """The rows of asked with the table's rows whose key equals column `on` of asked, which the result lacks.

        size: how many rows asked has, if known; keys: the different keys that it has, if they are few.
        """
        own = self.table(key)
        if keys is not None and len(keys) <= LITERAL:
            own = own.where(F.col(key).isin(keys))
            size = 0 if size is None else size
        size = asked.count() if size is None else size
        asked = asked.withColumnRenamed(on, key)
        return own.join(F.broadcast(asked) if size <= BROADCAST else asked.hint("merge"), key)


def matched(table: DataFrame | Store, key: str, asked: DataFrame, on: str, size: int | None = None, keys: list[int] | None = None) -> DataFrame:
    """As Store.of(), of a plain table too, which is joined as Spark sees fit."""
    if isinstance(table, Store):
        return table.of(key, asked, on, size, keys)
    return table.join(asked.withColumnRenamed(on, key), key)
