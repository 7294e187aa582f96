"""Leaves that a sample's trees leave overfull, in tight clusters."""

import numpy as np

from creditgraph.llm import ann


def test_overfull_leaves_are_cut(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 64)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(10, 8))[rng.integers(0, 10, 3000)] + 0.001 * rng.normal(size=(3000, 8))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").cache()
    got = {r.id: set(r.nbrs) for r in ann.first_graph(nodes, ann.plant(nodes, len(x), 8, 16), 16, 10).collect()}
    d = ann.distances(x, x)
    np.fill_diagonal(d, np.inf)
    best = np.argsort(d, axis=1)[:, :10]
    recall = np.mean([len(got.get(i, set()) & set(best[i].tolist())) / 10 for i in range(len(x))])
    print("recall", recall)
    assert recall > 0.7
