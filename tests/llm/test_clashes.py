"""Every operator over tables with clashing columns, nulls, repeated rows and no rows."""

import pytest
from pyspark.sql import functions as F

from creditgraph.llm import ann, bpe, chat, dedup, langid, mixing, secret_scan, setjoin, sharding, token_counts

CLASHES = ("_source", "_found", "_key", "ids", "_block", "_lettered", "source_", "kept", "DIGEST", "at", "Block", "lang_pred", "shard", "n", "hashes", "label", "score")
ROWS = [(1, None, None, None), (2, "", "en", "a"), (3, "same text here", "en", "a"), (4, "same text here", None, "b"), (4, "same text here", None, "b"), (None, "same text here", "fr", None), (5, "word " * 3000, "en", "a"), (6, "!!! 123 token=abc123456789", "en", "a")]


def vectors(d):
    return d.select(F.col("doc_id").alias("vec_id"), F.when(F.col("text").isNotNull(), F.array(F.length("text").cast("double"), F.lit(1.0))).alias("embedding"), *[c for c in d.columns if c in CLASHES])


def nearest(d):
    index = ann.Index(vectors(d))
    return index.search(index.own_queries(F.lit(True)))


def tokens(d):
    import public_tokenizers

    return token_counts.count_sections(d, token_counts.read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def secrets(d):
    found = secret_scan.candidates(d)
    return secret_scan.Scanner(secret_scan.learn_language(d), secret_scan.planted(d)).score(found)


def chats(d):
    return chat.digests(chat.format_chats(d.withColumn("turn", F.col("doc_id")), conv_id="doc_id", role="lang"))


OPERATORS = {
    "mix": (lambda d: mixing.mix(d, min_passes=1, max_repeats=1), 8), "shard": (lambda d: sharding.assign_shards(d, 3), 8), "nearest": (nearest, 20), "join": (setjoin.join_sets, 8), "language": (lambda d: langid.predict(d, langid.train(d)), 8),
    "secrets": (secrets, 1), "bpe": (lambda d: bpe.encode(d, *bpe.public_vocabulary()), 8), "tokens": (tokens, 8), "dedup": (dedup.drop_copies, 4), "chat": (chats, 7),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(spark, name):
    run, n = OPERATORS[name]
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    out = run(docs)
    assert out.count() == n
    for c in set(docs.columns) & set(out.columns) & set(CLASHES):
        if name in ("mix", "language", "bpe", "dedup"):
            assert {r[0] for r in out.select(f"`{c}`").distinct().collect()} == {f"own {c}"}
    assert run(docs.where("false")).count() == 0
