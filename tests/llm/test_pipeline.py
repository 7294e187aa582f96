"""The pipeline's stages, each against a plain version on a small table."""

import random
from collections import Counter

import tiktoken

import corpus_pipeline
from creditgraph.llm import bpe

from .test_operators import brute_join


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    words = {g: ["".join(rng.choices(s, k=3)) for _ in range(200)] for g, s in {"en": ["th", "ing", "on"], "de": ["sch", "ung", "ei"]}.items()}
    texts = [(" ".join(rng.choices(words[g], k=60)), g) for _ in range(60) for g in words]
    near = texts[0][0].split()
    near[5] = "changed"
    texts += [texts[1], texts[1], (" ".join(near), "en"), ("123 !!!", "en")]
    rows = [(i, t, g, f"src{i % 3}", len(t)) for i, (t, g) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language ID"](spark, docs, str(tmp_path))
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == {r[0] for r in rows[:-1]}
    second = stages["exact dedup"](spark, first, str(tmp_path))
    last = {r[1]: r[0] for r in rows[:-1]}
    assert {r.doc_id for r in second.collect()} == set(last.values())
    third = stages["near copies"](spark, second, str(tmp_path))
    groups = brute_join([(i, t) for t, i in last.items()], 80, 100, 5)
    assert {r.doc_id for r in third.collect()} == {i for i, (_, c) in groups.items() if i == c}
    fourth = stages["mixing"](spark, third, str(tmp_path))
    times = Counter(r.doc_id for r in fourth.collect())
    assert set(times) == {r.doc_id for r in third.collect()} and max(times.values()) <= 2
    fifth = stages["tokens"](spark, fourth, str(tmp_path)).collect()
    ranks, pattern = bpe.public_vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    assert len(fifth) == sum(times.values()) and all(list(r.ids) == enc.encode_ordinary(r.text) for r in fifth)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == set(times)


def test_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, a null id, an extra column, a very long text; and no rows at all."""
    long_ = " ".join(f"word{i % 97}" for i in range(40_000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "same text here", "en", "a"), (4, "same text here", None, "b"), (4, "same text here", None, "b"), (None, "no id here", "en", None), (5, long_, "en", "a"), (6, "!!! 123", "en", "a"), (6, "!!! 123", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as ids", "'x' as _source")
    docs.write.parquet(str(tmp_path / "a/documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "a")).select("doc_id", "text").collect()
    assert {(r.doc_id, r.text) for r in out} == {(4, "same text here"), (None, "no id here"), (5, long_)} and max(Counter(r.text for r in out).values()) <= 2
    docs.where("false").write.parquet(str(tmp_path / "b/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
