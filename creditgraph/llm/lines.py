"""Line dedup: lines that many documents hold stay in one of them.

Every text is cut at line feeds; the digest of each line's normalised form (its key) is exploded, once for each document. Digests are
counted over documents, and those of at least `least_docs` documents lose their lines everywhere but in the document with the
largest id. What moves are digests of 16 bytes and document ids; a text is shuffled only if its document may lose a line, which a bitmap
of fixed size tells. The other lines of a document are put together again in their order.

Defined cases: a null text counts as empty, and an empty text has one empty line. Rows with the same id are one document, rows without an id
are each distinct text's own document, smaller than every other; all documents with the largest id hold on to their lines. A key that repeats within a document counts
once, and all its lines go or stay together. Texts, lines and the number of documents that hold a line have no bound. No rows give no rows. Columns
of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, free_name

WHITE = " \t\n\x0b\f\r"
#: A digest with at least this share of all (digest, document) rows is joined by broadcast; there can be no more than 1 / HOT of them.
HOT = 1e-4
BITS = 1 << 27  # of the bitmap of documents that may lose lines: 16 MB


def line_digests(text: str, least_chars: int) -> list[bytes | None]:
    """The digest of each line's key, None for keys under least_chars."""
    out = []
    for line in text.split("\n"):
        key = line.strip(WHITE)
        out.append(blake2b(key.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest() if len(key) >= least_chars else None)
    return out


def bit(*key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BITS))


def holders(docs: DataFrame, least_chars: int) -> DataFrame:
    """digest, id, text_hash: the documents (id, text_hash, text) that hold each digest, once each."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], []
            for k, t in enumerate(batch.column(2)):
                own = {d for d in line_digests(t.as_py(), least_chars) if d}
                found.extend(own)
                row.extend([k] * len(own))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(0).take(at), batch.column(1).take(at)], names=["digest", "id", "text_hash"])

    kind = T.StructType([T.StructField("digest", T.BinaryType()), schema["id"], schema["text_hash"]])
    return docs.mapInArrow(run, kind).distinct()


def losses(held: DataFrame, least_docs: int, s: Scratch) -> DataFrame:
    """id, text_hash, gone: the digests whose lines a document loses."""
    counted = held.groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("keep_id"))
    common = s.staged(counted.where(F.col("n") >= least_docs), "common-lines")
    most = max(float(least_docs), held.count() * HOT)
    hot, cold = common.where(F.col("n") >= most), common.where(F.col("n") < most)
    of_hot = F.struct("keep_id").alias("of_hot")
    met = held.join(F.broadcast(hot.select("digest", of_hot)), "digest", "left")
    lost = met.where("of_hot is not null").select("digest", "id", "text_hash", "of_hot.keep_id")
    lost = lost.unionByName(met.where("of_hot is null").drop("of_hot").join(cold.select("digest", "keep_id"), "digest"))
    lost = lost.where(~F.col("id").eqNullSafe(F.col("keep_id")))
    return lost.groupBy("id", "text_hash").agg(F.collect_list("digest").alias("gone"))


def drop_lines(docs: DataFrame, least_docs: int = 3, least_chars: int = 20, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with columns n_lines (before dropping), n_dropped and kept (the lines that stay, joined); clashing names get underscores before them."""
    names = [free_name(docs, c) for c in ("n_lines", "n_dropped", "kept")]
    id_, hash_, gone, lone = (free_name(docs, c) for c in ("_id", "_text_hash", "_gone", "_bitmap"))
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumn(id_, F.col(doc_id)).withColumn(hash_, F.when(F.col(doc_id).isNull(), F.xxhash64(whole)))
    with Scratch(docs.sparkSession) as s:
        held = s.staged(holders(keyed.select(F.col(id_).alias("id"), F.col(hash_).alias("text_hash"), whole.alias("text")), least_chars), "line-holders")
        lost = Scratch(docs.sparkSession).staged(losses(held, least_docs, s), "lost-lines")  # the result reads it
    at = bit("id", "text_hash")
    bitmap = lost.select(F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits"))
    own = bit(id_, hash_)
    maps = F.broadcast(bitmap.select(F.col("part").alias(f"{lone}_part"), F.col("bits").alias(lone)))
    place = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substring(F.col(lone), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    may_lose = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    marked = keyed.join(maps, F.bitmap_bucket_number(own) == F.col(f"{lone}_part"), "left").withColumn(lone, may_lose).drop(f"{lone}_part")
    lines = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    columns = [F.col(f"`{c}`") for c in docs.columns]
    still = marked.where(~F.col(lone)).select(*columns, lines.cast("long").alias(names[0]), F.lit(0).cast("long").alias(names[1]), whole.alias(names[2]))
    of = lost.select(F.col("id").alias(f"{gone}_id"), F.col("text_hash").alias(f"{gone}_hash"), F.col("gone").alias(gone))
    moved = marked.where(F.col(lone)).join(of, F.col(id_).eqNullSafe(F.col(f"{gone}_id")) & F.col(hash_).eqNullSafe(F.col(f"{gone}_hash")), "left")
    return still.unionByName(without(moved.select(*columns, gone), text, gone, names, least_chars))


def without(docs: DataFrame, text: str, gone: str, names: list[str], least_chars: int) -> DataFrame:
    """docs without the lines whose digests are in column gone, which is the last one."""
    kept, at = docs.columns[:-1], docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, dropped, left = [], [], []
            for t, lost in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                whole, lost = t.as_py() or "", {*(lost.as_py() or ())}
                stay = [x for x, d in zip(whole.split("\n"), line_digests(whole, least_chars), strict=True) if d not in lost]
                total.append(whole.count("\n") + 1)
                dropped.append(total[-1] - len(stay))
                left.append("\n".join(stay))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(left, pa.string())], names=[*kept, *names])

    new = [T.StructField(n, k) for n, k in zip(names, (T.LongType(), T.LongType(), T.StringType()), strict=True)]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields[:-1], *new]))
