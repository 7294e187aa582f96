"""Vector codes: each part of a vector is replaced by the number of the nearest entry of the part's codebook.

Components become integers, floor(scale * x), and all arithmetic on them is exact. Codebooks come from Lloyd's rounds over active entries: a part whose
entry stayed where it was in the last update compares that entry's stored distance with the entries that moved only; a part whose entry moved
compares all. Ties go to the lower index under both, so the codes are those of complete rounds.

Vectors are written once, in blocks of some thousands, bucketed by block. A round meets them with the codes and distances of the round before, which
are some tens of bytes a vector and all that is shuffled, and leaves new ones with each block's sums; the sums are added in Spark, and
only the codebooks (entries x dimension numbers) come to the driver.

Defined cases: vectors that are null or hold a null or non-finite component are dropped. The codebooks start as the parts of the vectors with the
smallest ids (null ids come last, equal ids in the order of their components); with fewer vectors than entries there are so many entries.
Equal vectors count each. Entries that nothing is assigned to stay. Null labels are one label. No vectors left: no rows. All
vectors need the same dimension, a multiple of the number of parts, and scaled components within 2**26; else ValueError (wrapped by Spark where a task finds it).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, new_path, partitions, staged

BLOCK = 4096  # vectors of a block, if they are of a few hundred components
NUMBERS = 1 << 20  # components of a block at most, but for one vector
LARGEST = 1 << 26
HOT = 1e-3  # a label with at least this share of the rows is joined by broadcast


def scaled(vectors: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, a row for each vector."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    made = np.floor(scale * flat)
    if len(made) and np.abs(made).max() > LARGEST:
        raise ValueError(f"scaled components must be within {LARGEST}")
    return made.astype(np.int64).reshape(len(vectors), -1)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of x (n, part) from entries (m, part)."""
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


def assign(x: np.ndarray, books: np.ndarray, moved: np.ndarray, code: np.ndarray | None, error: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances (n, parts) of x (n, dimension) for books (parts, entries, part); moved (parts, entries) since code and error were made."""
    parts, _, part = books.shape
    new_code, new_error = np.zeros((len(x), parts), np.uint8), np.zeros((len(x), parts), np.int64)
    for p in range(parts):
        own, live = x[:, p * part : (p + 1) * part], np.flatnonzero(moved[p])
        all_again = np.ones(len(x), bool) if code is None else moved[p][code[:, p]]
        d = distances(own[all_again], books[p])
        if len(d):
            new_code[all_again, p], new_error[all_again, p] = d.argmin(axis=1), d.min(axis=1)
        if all_again.all():
            continue
        rest = ~all_again
        c, e = code[rest, p].astype(np.int64), error[rest, p]
        if len(live):
            d = distances(own[rest], books[p][live])
            best = d.argmin(axis=1)
            nearest, which = d.min(axis=1), live[best]
            wins = (nearest < e) | ((nearest == e) & (which < c))
            c, e = np.where(wins, which, c), np.where(wins, nearest, e)
        new_code[rest, p], new_error[rest, p] = c, e
    return new_code, new_error


def sums(x: np.ndarray, code: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(parts, entries, part + 1): the sum of the parts of each entry, and their number."""
    parts, entries, part = books.shape
    out = np.zeros((parts, entries, part + 1), np.int64)
    for p in range(parts):
        of = (code[:, p] == np.arange(entries)[:, None]).astype(np.float64)  # sums of a block stay under 2**53
        out[p, :, :part] = (of @ x[:, p * part : (p + 1) * part].astype(np.float64)).astype(np.int64)
        out[p, :, part] = of.sum(axis=1)
    return out


def updated(books: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Each entry at the floor of its parts' mean."""
    n = total[:, :, -1:]
    return np.where(n > 0, total[:, :, :-1] // np.maximum(n, 1), books)


class Blocks:
    """The vectors of a table as integers, in blocks, in a table that is bucketed by block."""

    def __init__(self, vectors: DataFrame, parts: int, scale: int, vector: str, vec_id: str, label: str):
        spark = self.spark = vectors.sparkSession
        bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        rows = vectors.where(F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
        self.rows, self.parts, self.scale = rows, parts, scale
        self.id_type, self.label_type = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
        sizes = rows.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
        self.dimension = sizes[0]
        if sizes[0] is not None and (sizes[0] != sizes[1] or not sizes[0] or sizes[0] % parts):
            raise ValueError(f"vectors have dimensions {sizes[0]} to {sizes[1]}; all need the same one, a multiple of {parts}")
        self.name, self.path = f"vector_blocks_{uuid.uuid4().hex}", new_path(spark, "vector-blocks")
        if self.dimension:
            buckets = partitions(spark)
            self.blocks().repartition(buckets, "block").write.bucketBy(buckets, "block").option("path", self.path).saveAsTable(self.name)

    def blocks(self) -> DataFrame:
        size, scale = max(1, min(BLOCK, NUMBERS // self.dimension)), self.scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            task, no = TaskContext.get().partitionId(), 0
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    some = batch.slice(at, size)
                    x = scaled(some.column(2), scale).astype(np.int32)
                    ids, labels = (pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column(c)) for c in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array([f"{task}-{no}"]), ids, labels, pa.array([x.tobytes()], pa.binary())], names=["block", "ids", "labels", "x"])
                    no += 1

        return self.rows.mapInArrow(run, f"block string, ids array<{self.id_type}>, labels array<{self.label_type}>, x binary")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def first(self, entries: int) -> np.ndarray:
        """The codebooks (parts, entries, part) at the start."""
        found = self.rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()["vector"].combine_chunks()
        return scaled(found, self.scale).reshape(len(found), self.parts, -1).transpose(1, 0, 2)

    def assigned(self, books: np.ndarray, moved: np.ndarray, before: DataFrame | None) -> DataFrame:
        """block, code, error, sums of each block; before: those of the round before."""
        dimension = self.dimension
        own = self.table().select("block", "x")
        met = own.join(before.select("block", "code", "error").hint("shuffle_hash"), "block") if before is not None else own.withColumn("code", F.lit(None).cast("binary")).withColumn("error", F.lit(None).cast("binary"))
        shared = self.spark.sparkContext.broadcast((books, moved))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books, moved = shared.value
            parts = len(books)
            for batch in batches:
                for k in range(batch.num_rows):
                    name, x, code, error = (c[k].as_py() for c in batch.columns)
                    x = np.frombuffer(x, np.int32).reshape(-1, dimension).astype(np.int64)
                    old = (None, None) if code is None else (np.frombuffer(code, np.uint8).reshape(-1, parts), np.frombuffer(error, np.int64).reshape(-1, parts))
                    code, error = assign(x, books, moved, *old)
                    yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([a.tobytes()], pa.binary()) for a in (code, error, sums(x, code, books)))], names=["block", "code", "error", "sums"])

        return met.select("block", "x", "code", "error").mapInArrow(run, "block string, code binary, error binary, sums binary")

    def close(self) -> None:
        from .common import delete

        if self.dimension:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            delete(self.spark, self.path)


def total(made: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of all blocks' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = np.zeros(int(np.prod(shape)), np.int64)
        for batch in batches:
            for x in batch.column(0):
                all_ += np.frombuffer(x.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(all_)), pa.int32()), pa.array(all_)], names=["place", "n"])

    found = made.select("sums").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow().sort_by("place")
    return found["n"].to_numpy().reshape(shape)


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every vector that is kept, and the codebooks (parts, entries, part).

    code is a string of two hexadecimal digits a part; error the sum of squared distances of the parts from their entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    spark = vectors.sparkSession
    blocks = Blocks(vectors, parts, scale, vector, vec_id, label)
    schema = f"vec_id {blocks.id_type}, label {blocks.label_type}, code string, error long"
    if not blocks.dimension:
        return spark.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    books = blocks.first(entries)
    moved, shape = np.ones(books.shape[:2], bool), (*books.shape[:2], books.shape[2] + 1)
    with Scratch(spark) as s:
        made = None
        for _ in range(rounds):
            made = s.staged(blocks.assigned(books, moved, made), "codes")
            new = updated(books, total(made, shape))
            moved, books = (new != books).any(axis=2), new
        made = s.staged(blocks.assigned(books, moved, made), "codes")
        out = staged(blocks.table().select("block", "ids", "labels").join(made.select("block", "code", "error").hint("shuffle_hash"), "block").drop("block").mapInArrow(spelled(parts), schema), "coded")
    blocks.close()
    return out, books


def spelled(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels = (batch.column(c).slice(k, 1).flatten() for c in (0, 1))
                digits = batch.column(2)[k].as_py().hex()
                error = np.frombuffer(batch.column(3)[k].as_py(), np.int64).reshape(-1, parts).sum(axis=1)
                codes = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def books_digest(books: np.ndarray) -> str:
    """The SHA-256 of all components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error, the sum of error over equal labels. Labels of many rows, of which there are few, are joined by broadcast."""
    each = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    most = max(2.0, coded.count() * HOT)
    hot = each.where(F.col("n") >= most).select(F.col("label").alias("hot_label"), F.struct("label_error").alias("of_hot"))
    cold = each.where(F.col("n") < most).select(F.col("label").alias("cold_label"), "label_error")
    met = coded.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("hot_label")), "left").drop("hot_label")
    large = met.where("of_hot is not null").withColumn("label_error", F.col("of_hot.label_error")).drop("of_hot")
    small = met.where("of_hot is null").drop("of_hot")
    return large.unionByName(small.join(cold, F.col("label").eqNullSafe(F.col("cold_label"))).drop("cold_label"))
