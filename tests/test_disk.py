"""What written steps leave on disk."""

import random
import time

from creditgraph import queries
from creditgraph.operators import aggregates, stores
from creditgraph.streaming.credit_view import CreditView

from .test_credit_view import ROLES, frames, snapshot

SF = "/root/testdata/sf0.001"


def shuffle_files(spark) -> set[str]:
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = {found.apply(i).getName() for i in range(found.size())}
    return {n for n in names if n.startswith("shuffle_")}


def test_written_steps_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    out = stores.kept(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "counted")
    until = time.time() + 20
    while time.time() < until and any(n.endswith(".data") for n in shuffle_files(spark) - before):
        time.sleep(0.2)
    assert not any(n.endswith(".data") for n in shuffle_files(spark) - before)
    assert spark.conf.get(stores.CLEANUP) == "false" and out.count() == 7
    stores.drop_kept(out)
    assert not stores.file_exists(spark, out.inputFiles()[0])


def test_loads_leave_what_later_ones_read(spark, tmp_path):
    r, taken = random.Random(5), []
    role_map = spark.createDataFrame(ROLES, "raw string, role_name string, is_aggregate boolean")
    view = CreditView(spark, str(tmp_path / "view"))
    for k in range(3):
        taken.append(snapshot(r, taken[-1] if taken else None))
        view.load(f"2024-0{k + 1}", *frames(spark, taken[-1]), role_map)
    left = {t: sorted(x.name for x in (tmp_path / "view" / t).iterdir()) for t in ("seen", "support", "entity_id", "relation", "dead", "counts", "moved", "added", "died", "revived", "delta")}
    every = ["2024-01", "2024-02", "2024-03"]
    assert left == {**dict.fromkeys(("seen", "support", "entity_id"), every[1:]), **dict.fromkeys(("relation", "dead", "counts"), every), **dict.fromkeys(("moved", "added", "died", "revived", "delta"), [])}
    assert view.edges("2024-01").count() and view.role_counts("2024-01").count()


def test_dictionary_makes_its_names_once(spark):
    taken = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            taken.add(len(b))
            yield b

    given = spark.createDataFrame([(1, "Pop,Soul"), (2, None), (3, "Pop")], "id long, styles string")
    got = aggregates.attribute_dictionary(given.mapInPandas(count, given.schema), "styles")
    assert [tuple(x) for x in got.orderBy("id").collect()] == [(0, "Pop"), (1, "Soul")] and taken.value == 3


def test_attributes_of_some_columns(spark):
    from creditgraph.plans.graph_view import GraphView

    r = GraphView(spark, SF).releases()
    some = aggregates.entity_attributes(r, ("styles",))
    assert some.columns == ["id", "styles"] and "AS genre#" not in some._jdf.queryExecution().optimizedPlan().toString()
    whole = aggregates.entity_attributes(r).select("id", "styles").where("styles is not null")
    assert some.count() and some.exceptAll(whole).isEmpty() and whole.exceptAll(some).isEmpty()


def test_serving_copy_drops_its_edges(spark, monkeypatch):
    made, kept = [], stores.kept

    def seen(df, name):
        made.append((name, kept(df, name)))
        return made[-1][1]

    monkeypatch.setattr(queries.network, "kept", seen)
    assert queries.serving_relations(spark, SF).count() == 25
    edges = next(df for name, df in made if name == "edges")
    assert not any(stores.file_exists(spark, f) for f in edges.inputFiles())
