"""A training corpus from raw documents: language ID, exact dedup, near-copy removal, mixing, tokens.

Each stage is written to the shared folder and read again before the next one runs; it is deleted once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditgraph.llm import bpe, dedup, langid, mixing, setjoin
from creditgraph.llm.common import delete, free_name, new_path, staged, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with probability 0.5 or more, by a model of the labelled ones."""
    return langid.reject(docs, langid.train(docs))


def one_of_each_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return dedup.drop_copies(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by similarities of 0.8 or more on five words, the one with the smallest id; empty texts stay."""
    return setjoin.drop_near_copies(docs, 80, 100, 5)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or more: weights as even as they can be while no source is passed more than twice."""
    out = mixing.mix(docs, max_repeats=2, min_passes=1)
    return out.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, with their count and a digest of the bytes that they decode to."""
    ranks, pattern = bpe.public_vocabulary()
    out = bpe.encode(docs, ranks, pattern)
    ids, n, sha = out.columns[-1], free_name(docs, "n_tokens"), free_name(docs, "decoded_sha256")
    return out.select("*", F.size(ids).cast("long").alias(n), F.sha2(bpe.decoded(F.col(ids), ranks), 256).alias(sha))


STAGES = [("language ID", known_language), ("exact dedup", one_of_each_text), ("near copies", one_of_each_group), ("mixing", mixed_sources), ("tokens", tokens)]

#: Model fitting, graph components and merges have no SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        before, path = path, new_path(spark, name.replace(" ", "-"))
        docs = staged(stage(spark, docs, sf_dir), name, path)
        if before:
            delete(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
