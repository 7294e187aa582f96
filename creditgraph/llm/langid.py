"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of labelled rows in tasks, sums them by (language, bucket) and brings the counts, at most
languages x BUCKETS numbers, to the driver; of more than MOST_LANGS languages ValueError is raised. The log-probability matrix
is broadcast; texts are scored whole, in numpy, some together up to SLICE characters, longer ones slice by slice.

Defined cases: a text that is null or has no letter is `und` with score 0. With nothing to learn from, every text is
`und`. Texts shorter than an n-gram are decided by the shorter ones and the prior. Ties go to the first language by name.
Repeated rows are rows of their own, no rows give no rows, and columns that clash with new ones stay as they are: the new ones
take underscores before their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, short_batches, tidy

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
SLICE = 1 << 19  # characters in a piece of work
TRAIN_ROWS = 20_000  # a model is fitted on about so many labelled rows at most; large languages are thinned by hash
MOST_LANGS = 1000
SMOOTH = 0.5
UND = "und"


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of the n-grams of lower-cased texts, slice by slice; none spans two texts."""
    texts = [t.lower() for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    reach = max(ORDERS) - 1
    for a in range(0, len(codes), SLICE):
        c, o = codes[a : a + SLICE + reach].astype(np.uint64), owner[a : a + SLICE + reach]
        h = np.zeros(len(c), dtype=np.uint64)
        for n in range(1, max(ORDERS) + 1):
            m = min(SLICE, len(c) - n + 1)
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 : n - 1 + m] + np.uint64(n)
            if n in ORDERS:
                same = o[:m] == o[n - 1 : n - 1 + m]
                mixed = h ^ (h >> np.uint64(29))
                yield o[:m][same], ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(49)).astype(np.int64)[same]


def pieces(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """The texts in runs of about SLICE characters or one text; a null one is empty."""
    some, size = [], 0
    for t in texts:
        some.append(t or "")
        size += len(some[-1])
        if size >= SLICE:
            yield some
            some, size = [], 0
    if some:
        yield some


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # buckets x languages
    prior: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.tile(self.prior, (len(texts), 1))
        for o, h in grams(texts):
            for k in range(len(self.langs)):
                out[:, k] += np.bincount(o, weights=self.logp[h, k], minlength=len(texts))
        return out


def fair_share(seen: dict[str, int], most_rows: int) -> float:
    """Rows of a language at most, so that all languages together have most_rows: small ones keep all, large ones share the rest alike."""
    left = float(most_rows)
    for i, n in enumerate(sizes := sorted(seen.values())):
        if n * (len(sizes) - i) >= left:
            return left / (len(sizes) - i)
        left -= n
    return float("inf")


def train(rows: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", most_rows: int = TRAIN_ROWS) -> Model | None:
    """A model of rows with text and language; of more than most_rows, a sample of about most_rows: all rows of small languages, of large ones those chosen by hash of the id."""
    short_batches(rows.sparkSession)
    rows = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(doc_id).alias("id")).where("lang is not null and text is not null")
    seen = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(MOST_LANGS + 1).collect()}
    if len(seen) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not seen:
        return None
    langs, n = sorted(seen), sum(seen.values())
    if n > most_rows:
        share = fair_share(seen, most_rows)
        rates = [F.lit(x) for name, m in seen.items() for x in (name, int((1 << 30) * min(1.0, share / m)))]
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.create_map(*rates)[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            by_lang = defaultdict(list)
            for name, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                by_lang[name].append(t)
            for name, texts in by_lang.items():
                c = counts.setdefault(name, np.zeros(BUCKETS, dtype=np.int64))
                for some in pieces(texts):
                    for _, h in grams(some):
                        c += np.bincount(h, minlength=BUCKETS)
        for name, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(c[at], pa.int64())})

    sums = rows.select("lang", "text").mapInArrow(tidy(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # columns: as rows of objects they would take ten times as much of the driver
    m = np.full((BUCKETS, len(langs)), SMOOTH)
    m[sums["bucket"].to_numpy(), pc.index_in(sums["lang"], pa.array(langs, pa.string())).to_numpy()] += sums["n"].to_numpy()
    prior = np.log(np.array([seen[x] for x in langs], dtype=float) / n)
    return Model(langs, np.log(m / m.sum(axis=0)).astype(np.float32), prior)


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the posterior probability of lang_pred."""
    pred, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    if model is None:
        return docs.withColumn(pred, F.lit(UND)).withColumn(score, F.lit(0.0))
    shared, at, lettered = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text), free_name(docs, "lettered")
    names = [*docs.columns, pred, score]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            done = 0
            for some in pieces(batch.column(at).to_pylist()):
                s = m.scores(some)
                k = s.argmax(axis=1)
                p = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
                *own, told = batch.slice(done, len(some)).columns
                yield pa.RecordBatch.from_arrays([*own, pc.if_else(told, pa.array([m.langs[j] for j in k], pa.string()), UND), pc.if_else(told, pa.array(p, pa.float64()), 0.0)], names=names)
                done += len(some)

    rows = docs.withColumn(lettered, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    return rows.mapInArrow(tidy(best), T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())]))


def reject(docs: DataFrame, model: Model | None, text: str = "text", least: float = 0.5) -> DataFrame:
    """docs without those that have no language or one that is less likely than least; columns as they were."""
    out = predict(docs, model, text)
    pred, score = out.columns[-2:]
    return out.where((F.col(pred) != UND) & (F.col(score) >= least)).select(*docs.columns)
