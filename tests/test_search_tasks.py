"""What one query finds is dealt to many tasks."""

import math

import pytest
from pyspark.sql import functions as F

from creditgraph.operators import search


@pytest.fixture
def own_tasks(spark):
    """Small tables keep their partitions apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("query", ["red", "red ring"])
def test_a_query_is_not_one_task(spark, tmp_path, own_tasks, query):
    names = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "red").otherwise("ring red").alias("text"))
    queries = spark.createDataFrame([(query,)], "query string")
    tokens = search.build_tokens(names)
    want = 3000 if query == "red" else 2000
    for found in (search.matches(queries, tokens), search.matches(queries, search.write_postings(tokens, str(tmp_path), 4)), search.tfidf_search(queries, tokens, names)):
        rows = [x["count"] for x in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(rows) == want and max(rows) < want * 0.6


def test_scores(spark):
    """Several names of one id, a token more than once in a name, one that only a hyphen hides, and a stop word."""
    texts = [(1, "Red red ring"), (1, "the ring (2)"), (2, "red-hot ring"), (3, "ring"), (4, "blue"), (5, "Red Ring")]
    names = spark.createDataFrame(texts, "id long, text string")
    queries = spark.createDataFrame([("red ring",), ("the Ring",), ("the",), ("red green",), ("ring red",), ("ring red",)], "query string")
    red, ring = math.log10(6 / 3), math.log10(6 / 4)  # six names; ids 1, 2, 5 and 1, 2, 3, 5
    both = {1: 2 * red + 2 * ring, 2: ring, 5: red + ring}
    want = {(q, i): s for q in ("red ring", "ring red") for i, s in both.items()} | {("the Ring", 1): 2 * ring, ("the Ring", 2): ring, ("the Ring", 3): ring, ("the Ring", 5): ring}
    got = search.tfidf_search(queries, search.build_tokens(names), names).collect()
    assert len(got) == len(want) and {(x.query, x.id): round(x.score, 9) for x in got} == {k: round(v, 9) for k, v in want.items()}
