"""What comes to the driver comes as columns, and large literals are in plans of one stage."""

import numpy as np
import pytest

from creditgraph.llm import bpe, langid


@pytest.fixture
def no_objects(spark, monkeypatch):
    def refused(df):
        raise AssertionError("rows as objects")

    monkeypatch.setattr(type(spark.range(1)), "toPandas", refused)


def test_the_fold_has_one_stage(spark, monkeypatch):
    kind, plans = type(spark.range(1)), []
    whole = kind.toArrow

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return whole(df)

    monkeypatch.setattr(kind, "toArrow", seen)
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256}
    docs = spark.createDataFrame([("ab abc",), ("ab",), (None,)], "text string")
    known = bpe.dictionary(docs, ranks, bpe.USUAL)
    assert np.frombuffer(known["ab"], np.int32).tolist() == [256]
    assert len(plans) == 1 and "Aggregate" not in plans[0] and "Repartition" not in plans[0]


def test_language_counts_come_as_columns(spark, no_objects):
    docs = spark.createDataFrame([(i, t, x) for i in range(20) for t, x in (("the cat and the dog", "en"), ("der Hund und die Katze", "de"))], "doc_id long, text string, lang string")
    told = {r.lang: r.lang_pred for r in langid.predict(docs, langid.train(docs)).collect()}
    assert told == {"en": "en", "de": "de"}
