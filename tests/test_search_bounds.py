"""Bounds of the name distance, and what a bounded search measures; tables whose write was killed."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from creditgraph.operators import changes, search, serving


def test_bounds_hold(spark):
    r = random.Random(5)
    alphabet = "abcé dA("
    pairs = [("".join(r.choices(alphabet, k=r.randint(0, 9))), "".join(r.choices(alphabet, k=r.randint(0, 12)))) for _ in range(3000)]
    pairs += [(a, a + b) for a, b in pairs[:500]] + [(a, a) for a, _ in pairs[:50]]
    low, high = search.distance_bounds(F.col("a"), F.col("b"))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", low.alias("low"), high.alias("high")).collect()
    for x in rows:
        d = 1 - search.jaro_winkler(x.a, x.b)
        assert x.low - 1e-9 <= d <= x.high + 1e-9, x
    assert sum(x.high - x.low < 0.5 for x in rows) > 1000


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_common_beginnings_match(p, x, y):
    """As many characters match as the names begin with alike: what the lower bound rests on."""
    a, b = p + x, p + y
    if p:
        jaro = (len(p) / len(a) + len(p) / len(b) + 0.5) / 3
        assert search.jaro_winkler(a, b) >= jaro - 1e-12


def test_top_search(spark):
    r = random.Random(7)
    words = ["red", "blue", "green", "deep", "purple", "band", "quartet", "trio", "orchestra", "singers"]
    names = [(i, f"{r.choice(words)} {r.choice(words)}" + (f" ({r.randint(2, 900)})" if r.random() < 0.3 else "")) for i in range(4000)]
    names += [(1_000_000_000 + i, f"red {r.choice(words)}") for i in range(50)]
    e = spark.createDataFrame(names, "id long, entity_name string")
    tokens = search.build_tokens(e.select("id", F.col("entity_name").alias("text")))
    queries = spark.createDataFrame([("red",), ("blue band",), ("trio quartet",), ("nobody",)], "query string")
    whole = search.search(queries, tokens, e)
    for k in (1, 7, 100_000):
        got = search.top_search(queries, tokens, e, k)
        want = whole.where(F.col("rank") <= k)
        as_rows = lambda df: sorted((x.query, x.rank, x.id, x.name, round(x.score, 9)) for x in df.collect())
        assert as_rows(got) == as_rows(want)
        if k == 7:
            assert sum(x.measured for x in got.select("query", "measured").distinct().collect()) < 0.1 * whole.count()


def test_killed_writes_are_done_again(spark, tmp_path):
    entity = spark.createDataFrame([(1, "US", "Rock", "Pop")], "id long, countries string, genres string, styles string")
    role = spark.createDataFrame([(1, "A")], "role_id int, role_name string")
    entity.write.parquet(str(tmp_path / "entity"))
    role.limit(0).write.parquet(str(tmp_path / "role"))
    (tmp_path / "role/_SUCCESS").unlink()  # a write that was killed
    serving.build_serving({"entity": entity.withColumn("id", F.lit(2)), "role": role}, str(tmp_path))
    assert serving.read_table(spark, str(tmp_path), "role").count() == 1
    assert serving.read_table(spark, str(tmp_path), "entity").first()["id"] == 1  # this one was whole


def test_ledger_grows_by_files(spark, tmp_path):
    path, stages = str(tmp_path / "ledger"), spark.sql("SELECT 1 AS stage, date'2024-01-01' AS date UNION ALL SELECT 2, date'2024-01-01'")
    assert changes.append_done(spark, path, stages.where("stage = 1")) == 1
    assert changes.append_done(spark, path, stages) == 1 and changes.append_done(spark, path, stages) == 0
    assert changes.pending_stages(spark.read.parquet(path), stages).count() == 0
    assert spark.read.parquet(path).count() == 2
