"""Rows of posting lists stay short, and the words of texts are made once for them."""

from creditgraph import queries
from creditgraph.operators import search


def test_a_probe_meets_a_short_row(spark):
    tokens = spark.range(6000).selectExpr("'every' AS token", "id")
    sizes = [len(r.ids) for r in search.posting_lists(tokens).collect()]
    assert sum(sizes) == 6000 and max(sizes) < 512


def test_words_are_made_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"some words {i % 3}") for i in range(9)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "words 2"), (2, "no")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    whole, plans = search.write_postings, []

    def seen(tokens, root):
        plans.append(tokens._jdf.queryExecution().optimizedPlan().toString())
        return whole(tokens, root)

    monkeypatch.setattr(search, "write_postings", seen)
    assert sorted(map(tuple, queries.passage_search(spark, str(tmp_path)).collect())) == [(1, 2), (1, 5), (1, 8)]
    assert "Aggregate" not in plans[0] and "Generate" not in plans[0]
