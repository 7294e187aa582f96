"""What a query is made from is read and dealt once, and gives the rows that the view's SQL gives."""

from creditgraph import queries
from creditgraph.operators import aggregates, network, relations, serving
from creditgraph.plans.graph_view import GraphView

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def scans(df, name: str) -> int:
    return sum("Scan parquet" in x and name in x for x in plan(df).splitlines())


def test_edges_are_the_view_and_read_lines_once(spark):
    g = GraphView(spark, SF)
    edges, view = g["g_edge"], g.sql("SELECT * FROM g_edge")
    assert edges.columns == view.columns
    assert edges.exceptAll(view).isEmpty() and view.exceptAll(edges).isEmpty()
    assert sum("l_orderkey" in x and "Scan" in x for x in plan(edges).splitlines()) == 1


def test_nested_releases_read_lines_once(spark):
    assert sum("l_orderkey" in x and "Scan" in x for x in plan(GraphView(spark, SF).releases()).splitlines()) == 1


def test_extraction_reads_releases_once(spark):
    g = GraphView(spark, SF)
    release = network.kept(g.releases(), "releases-once")
    assert scans(relations.extract_relations(release, g["g_master"], g.role_map()), "tracklist") == 1
    assert sum("releases-once" in x for x in plan(relations.extract_relations(release, g["g_master"], g.role_map())).splitlines()) == 1


def test_releases_of_an_entity_read_edges_once(spark):
    edges = network.kept(spark.createDataFrame([(1, "a", 2, 10, 1990), (1, "a", 1, 11, None), (3, "a", 1, 10, 1991), (4, "b", 5, 12, 1992)], "subject long, role string, object long, release_id long, year int"), "edges-once")
    got = aggregates.releases_by_role(edges, spark.createDataFrame([(1,), (1,)], "id long"))
    assert {tuple(r) for r in got.collect()} == {(1, "a", 10, 1991), (1, "a", 11, None)}
    assert sum("edges-once" in x for x in plan(got).splitlines()) == 1


def test_walks_of_a_network_write_no_levels(spark, monkeypatch):
    nodes = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2), (1, 5, 2), (9, 9, 0)], "center_id long, id long, distance int")
    links = spark.createDataFrame([(1, 1, 2), (1, 3, 1), (1, 2, 3), (1, 2, 4), (1, 4, 3), (1, 7, 4)], "center_id long, one long, two long")

    def no_write(*_):
        raise AssertionError("a level was written")

    monkeypatch.setattr(network, "kept", no_write)
    assert {tuple(r) for r in network.subgraph_sizes(nodes, links).collect()} == {(1, 1, 4), (1, 2, 2), (1, 3, 2), (1, 4, 1), (1, 5, 1), (9, 9, 1)}
    assert {tuple(r) for r in network.ancestors(nodes, links).collect()} == {(1, 1, 1), (1, 2, 2), (1, 2, 1), (1, 3, 3), (1, 3, 1), (1, 4, 4), (1, 4, 2), (1, 4, 3), (1, 4, 1), (1, 5, 5), (9, 9, 9)}
    assert {tuple(r) for r in network.subgraph_sizes(nodes, links, 0).collect()} == {(1, 1, 3), (1, 2, 2), (1, 3, 2), (1, 4, 1), (1, 5, 1), (9, 9, 1)}


def counted_edges(monkeypatch) -> list[int]:
    """Grows with each time that the view's edges are made."""
    made, edges = [], GraphView.edges
    monkeypatch.setattr(GraphView, "edges", lambda self: made.append(1) or edges(self))
    return made


def test_serving_copy_makes_edges_and_entities_once(spark, tmp_path, monkeypatch):
    made, taken = counted_edges(monkeypatch), spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            taken.add(len(b))
            yield b

    assert queries.serving_relations(spark, SF).count() == 25 and len(made) == 1
    entity = spark.createDataFrame([(1, "US", "Rock", "Pop,Soul"), (2, None, "Jazz", None)], "id long, countries string, genres string, styles string")
    serving.build_serving({"entity": entity.mapInPandas(count, entity.schema)}, str(tmp_path))
    assert taken.value == 2
    assert [[tuple(r) for r in serving.read_table(spark, str(tmp_path), t).orderBy("id").collect()] for t in ("country", "genre", "style")] == [[(0, "US")], [(0, "Jazz"), (1, "Rock")], [(0, "Pop"), (1, "Soul")]]


def test_networks_and_stores_make_edges_once(spark, monkeypatch):
    made = counted_edges(monkeypatch)
    queries.network_tables(spark, SF)
    assert len(made) == 1
    queries.store_lookups(spark, SF)
    assert len(made) == 2


def test_names_of_attributes_are_split_once_a_release(spark):
    rows = [(1, "US & UK", [1, 2], [3], ["Rock, Pop", "Rock"], None), (2, None, [1], None, [None], ["Jazz"]), (3, None, [9], [], [], [])]
    release = spark.createDataFrame([(i, c, [(x,) for x in a], None if b is None else [(x,) for x in b], g, s) for i, c, a, b, g, s in rows], "release_id long, country string, artists array<struct<id: long>>, labels array<struct<id: long>>, genres array<string>, styles array<string>")
    got = aggregates.entity_attributes(release)
    assert {tuple(r) for r in got.collect()} == {(1, "UK,US", "Pop,Rock", "Jazz"), (2, "UK,US", "Pop,Rock", None), (3, "UK,US", "Pop,Rock", None)}
    lines = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert max(i for i, x in enumerate(lines) if "Generate explode" in x) < min(i for i, x in enumerate(lines) if "split(" in x and "Generate" not in x)


def test_edges_by_ends_are_dealt_by_numbers(spark):
    lines = queries.edge_ends(spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    assert "hashpartitioning(role#" in next(x for x in lines if "Exchange" in x)
