"""What networks move and keep: links beyond the nodes are left out before links are merged, and steps go once nothing reads them."""

from pyspark.sql import functions as F

from creditgraph.operators import network, stores

from .test_networks import EDGES, ROLES, SERVING, graph


def run(spark, monkeypatch, seen):
    serving, edges = graph(1, n_edges=900)
    monkeypatch.setattr(network, "FEW", 0)
    keep = network.Steps.keep

    def kept(self, df, name):
        out = keep(self, df, name)
        seen.append((name, out[0], self.paths[-1]))
        if name == "merged":
            seen.append(("left", [p for n, _, p in seen if n == "links" and stores.file_exists(spark, p)], ""))
        return out

    monkeypatch.setattr(network.Steps, "keep", kept)
    made = []
    merged = network.merged_links
    monkeypatch.setattr(network, "merged_links", lambda rounds, spark: made.append(rounds) or merged(rounds, spark))
    nodes, links = network.network(spark.createDataFrame([(1,), (20,)], "center_id long"), spark.createDataFrame(serving, SERVING), spark.createDataFrame(edges, EDGES), ROLES, 5, 10, 20)
    return nodes, links, made


def test_links_are_merged_inside_networks_and_once(spark, monkeypatch):
    seen = []
    nodes, links, made = run(spark, monkeypatch, seen)
    assert len(made) == 1 and [n for n, *_ in seen].count("merged") == 1
    assert nodes.count() and links.count()
    assert dict((n, p) for n, p, _ in seen if n == "left")["left"] == []  # rounds' links are gone when links are merged
    assert not any(stores.file_exists(spark, p) for n, _, p in seen if n != "left")
    assert all("key" not in df.columns and "pruned" not in df.columns for n, df, _ in seen if n == "links")


def test_links_beyond_a_centre_s_nodes_are_left_out(spark):
    big = network.LABEL_OFFSET
    nodes = spark.createDataFrame([(1, 1, 0), (1, 5, 1), (1, big + 2, 1), (9, 9, 0)], "center_id long, id long, distance int")
    links = spark.createDataFrame([(1, 1, 5), (1, 1, 6), (1, 6, 1), (1, 4, big + 2), (1, 5, big + 3), (9, 9, 3), (9, 9, big + 1), (8, 8, 8)], "center_id long, one long, two long")
    assert {tuple(r) for r in network.within_reach(links, nodes).collect()} == {(1, 1, 5), (1, 4, big + 2), (9, 9, 3)}


def test_touched_edges_are_dealt_by_centre_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = stores.kept(spark.createDataFrame([(1, "a", 2, 10, 1990), (2, "b", 1, 11, None), (1, "a", 1, 12, 1991)], EDGES), "edges-dealt")
        asked = stores.kept(spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "center_id long, id long"), "asked-dealt")
        roles = stores.kept(spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "center_id long, role string"), "roles-dealt")
        got = network.expand_frontier(e, asked, roles, 10)
        assert {tuple(r) for r in got.select("center_id", "subject", "role", "object", "release_id").collect()} == {(1, 1, "a", 2, 10), (1, 1, "a", 1, 12), (2, 1, "a", 2, 10), (2, 2, "b", 1, 11)}
        plan = got._jdf.queryExecution().sparkPlan().toString() + network.expand_frontier(e, asked, roles, 10)._jdf.queryExecution().executedPlan().toString()
        assert not any("hashpartitioning" in x and "release_id" in x.split("hashpartitioning(")[1].split(")")[0] for x in plan.splitlines())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_frontier_is_cut_by_id(spark):
    now = spark.createDataFrame([(1, "a", 1, 7), (1, "a", 1, 4), (1, "a", 9, 1), (1, "a", 3, network.LABEL_OFFSET)], "center_id long, role string, one long, two long")
    nodes = spark.createDataFrame([(1, 1, True), (1, 4, False)], "center_id long, id long, accepted boolean")
    state = spark.createDataFrame([(1, False, 1)], "center_id long, pruned boolean, n_nodes long")
    got = network.next_frontier(now, state, [nodes], 0, 2, 100)
    assert {tuple(r) for r in got.select("center_id", "id", "stop", "pruned", "n_nodes").collect()} == {(1, 4, False, False, 1), (1, 7, False, False, 1)}
    assert network.first_ids(got, 1).agg(F.max("id")).first()[0] == 4
