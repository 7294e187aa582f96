"""Posting lists and relational division against plain sets."""

import random
from collections import Counter

import pytest

from creditgraph.operators import search


@pytest.fixture
def small_slices():
    search.SLICE, before = 5, search.SLICE
    yield
    search.SLICE = before


def test_division(spark, tmp_path, small_slices):
    r = random.Random(1)
    held = {i: {t for t, p in (("every", 1.0), ("half", 0.5), ("some", 0.2), ("rare", 0.03), ("other", 0.3)) if r.random() < p} for i in range(300)}
    tokens = spark.createDataFrame([(t, i) for i, ts in held.items() for t in ts], "token string, id long")
    lists = search.posting_lists(tokens)
    rows = lists.collect()
    assert {(t, i) for row in rows for t, i in [(row.token, i) for i in row.ids]} == {(t, i) for i, ts in held.items() for t in ts}
    assert all(row.df == sum(row.token in ts for ts in held.values()) for row in rows)
    assert max(len(row.ids) for row in rows) < 20 and sum(row.token == "every" for row in rows) > 30  # a frequent token is cut
    asked = [("every",), ("every", "half"), ("every", "rare", "some"), ("rare",), ("half", "nowhere"), ("other", "some", "half", "every")]
    df = spark.createDataFrame([(f"q{k}", t, len(ts)) for k, ts in enumerate(asked) for t in ts], "query string, token string, n int")
    want = {(f"q{k}", i) for k, ts in enumerate(asked) for i, own in held.items() if own >= set(ts)}
    store = search.write_postings(tokens, str(tmp_path), 3)
    for postings in (lists, store):
        got = [tuple(x) for x in search.division(df, postings).select("query", "id").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    plan = search.division(df, store)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") >= 2
    assert search.division(df.where("query = 'q4'"), store).count() == 0
    assert search.division(df.limit(0), lists).count() == 0


def test_the_list_is_not_moved(spark, tmp_path):
    tokens = spark.createDataFrame([(f"t{i % 50}", i) for i in range(1000)], "token string, id long")
    store = search.write_postings(tokens, str(tmp_path), 4)
    asked = spark.createDataFrame([("0:t3", 1), ("0:t4", 2)], "cell string, query int")
    plan = store.of("cell", asked, "cell")
    assert sum(len(x.ids) for x in plan.collect()) == 40
    assert "hashpartitioning" not in plan._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("min_df", [0, 1, 40, 400, 3_000, 20_000])
def test_frequent_tokens(spark, min_df):
    """Counts of a few hot tokens, some at the threshold and many rare ones, dealt over tasks that each see a part."""
    r = random.Random(3)
    seen = ["hot"] * 9_000 + ["warm"] * 400 + ["warmer"] * 401 + [f"r{r.randrange(4_000)}" for _ in range(8_000)] + [f"once{i}" for i in range(3_000)] + [None] * 50
    r.shuffle(seen)
    want = {t: n for t, n in Counter(seen).items() if n > min_df and t is not None}
    tokens = spark.createDataFrame([(t,) for t in seen], "token string").repartition(7)
    assert {x.token: x.df for x in search.frequent_tokens(tokens, min_df).collect()} == want
    assert search.frequent_tokens(tokens.limit(0), min_df).count() == 0
