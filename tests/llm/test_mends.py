"""Limits that can't be met, other patterns, long texts with open marks, digests that are hot in a later batch."""

import time

import pytest
import tiktoken
from pyspark.sql import functions as F

from creditgraph.llm import bpe, dedup, mixing, secret_scan


def test_infeasible_repeats_are_an_error():
    with pytest.raises(ValueError, match="10 times"):
        mixing.fit({"a": 10, "b": 10}, budget=200, max_repeats=4)
    with pytest.raises(ValueError, match="limit"):
        mixing.fit({"a": 1000, "b": 10}, budget=20_000, max_repeats=4)
    with pytest.raises(ValueError, match="limit"):
        mixing.fit({"a": 1000, "b": 100}, target_entropy=0.01, max_repeats=4)
    m = mixing.fit({"a": 1000, "b": 10}, budget=2_000, max_repeats=4)
    assert all(m.budgets[k] <= 4 * n * (1 + 1e-9) for k, n in (("a", 1000), ("b", 10)))


@pytest.mark.parametrize("pattern", [r"\w+|\s+|[^\w\s]+", r"(?:\p{L}|\p{N})+|.|\n", r"[a-z]+"])
def test_other_patterns(spark, pattern):
    ranks, _ = bpe.public_vocabulary()
    texts = ["It's 12 o'clock, isn't it?", " two  spaces\n\tand a tab ", "", None, "Wörter, größer als 3!", "abc" * 50]
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ranks, pattern).orderBy("doc_id").collect()
    assert [r["ids"] for r in got] == [own.encode_ordinary(t or "") for t in texts]


def test_long_texts_with_open_marks():
    begin, end = "-----BEGIN PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    began = time.time()
    text = (begin + "\nabc\n") * 80_000 + "password=" + "(" * 10 + ")" * 500_000 + " x"
    assert len(text) > 3_000_000
    found = secret_scan.spans(text)
    assert time.time() - began < 20
    assert any(text[a:b] == "(" * 10 + ")" * 10 for a, b in found)
    some = f"{end} {begin} a {begin} b {end} c {end} {begin} d {end} {begin}"
    blocks = secret_scan.key_blocks(some)
    first, second = some.index(begin), some.index(begin + " d")
    assert blocks == [(first, some.index(end, first) + len(end)), (second, some.index(end, second) + len(end))]
    many = secret_scan.spans(f"{begin} key12345678 {end} " * 2_000 + "token12345678")
    assert len(many) == 2_001


def test_hot_digest_of_a_later_batch(spark):
    index = dedup.DigestIndex.open(spark)
    index.add(spark.range(200).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")))
    later = spark.range(1000, 6000).select(F.col("id").alias("doc_id"), F.lit("7").alias("text")).unionByName(spark.range(6000, 6010).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")))
    index.add(later)
    out = index.annotate(later)
    got = {(r.text, r.keep_id, r.kept) for r in out.collect()}
    assert ("7", 7, False) in got and len(got) == 11 and out.count() == 5010
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan
    assert index.table().count() == 210
