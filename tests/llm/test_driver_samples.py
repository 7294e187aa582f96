"""Samples come to the driver as columns, and rounds tell their fresh neighbours themselves."""

import numpy as np

from creditgraph.llm import ann


def test_samples_come_as_columns(spark, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "toPandas", None)
    x = np.random.default_rng(1).normal(size=(50, 3))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").coalesce(1)
    assert np.array_equal(ann.matrix(nodes), x) and ann.matrix(nodes.limit(0)).shape == (0, 1)


def test_fresh_neighbours_are_counted(spark):
    x = np.random.default_rng(2).normal(size=(200, 4))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").cache()
    graph = ann.first_graph(nodes, ann.plant(nodes, len(x), 2, 16), 16, 6).cache()
    had = {r.id: set(r.nbrs) for r in graph.collect()}
    blocks = nodes.selectExpr("id", "CAST(v AS array<float>) AS v", "id % 3 AS block")
    rows = (new := ann.descend(graph, blocks, 6, 0).cache()).collect()
    assert len(rows) == 200 and all(r.fresh == len({*r.nbrs} - had[r.id]) for r in rows) and any(r.fresh for r in rows)
    assert ann.changed(new) == sum(r.fresh for r in rows) / sum(len(r.nbrs) for r in rows)
