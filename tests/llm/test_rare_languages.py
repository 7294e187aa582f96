"""A bounded training sample keeps the rows of rare languages."""

from creditgraph.llm import langid


def test_fair_share():
    assert langid.fair_share({"a": 1000, "b": 3, "c": 500}, 103) == 50
    assert langid.fair_share({"a": 10, "b": 10}, 10) == 5


def test_rare_language_is_learned(spark):
    rows = [(i, "the morning river runs long", "en") for i in range(2000)] + [(2000 + i, "xyzzy qwyx zyqx", "rare") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, most_rows=100)
    kept = [(r.doc_id, r.lang_pred) for r in langid.predict(docs.where("doc_id >= 1997"), model).select("doc_id", "lang_pred").collect()]
    assert sorted(kept) == [(i, "en" if i < 2000 else "rare") for i in range(1997, 2003)]
