"""The incremental view against full rebuilds, over random snapshots."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from creditgraph.operators import aggregates, changes, relations
from creditgraph.streaming.credit_view import CreditView, start_credit_stream

PERSON = "array<struct<id: bigint, roles: array<struct<name: string>>>>"
RELEASE = f"release_id bigint, release_date date, master_id bigint, artists array<struct<id: bigint, name: string>>, labels array<struct<id: bigint>>, extra_artists {PERSON}, companies array<struct<id: bigint, entity_type_name: string>>, tracklist array<struct<position: string, artists: array<struct<id: bigint, name: string>>, extra_artists: {PERSON}>>"
SCHEMAS = {"entity": "id bigint", "release": RELEASE, "master": "master_id bigint, year int"}
ROLES = [("Guitar", "Guitar", False), ("Mix", "Mixed By", True)]


def snapshot(r, before=None):
    """Releases, masters and entities, some of them as before."""
    import datetime

    def people():
        return [(r.randint(1, 12), [(r.choice(["Guitar", "Mix", "Nobody"]),)]) for _ in range(r.randint(0, 2))]

    def release(i):
        date = r.choice([None, datetime.date(r.randint(1990, 1993), 1, 1)])
        own = [(r.randint(1, 12), r.choice(["A", "Various"]))]
        return (i, date, r.randint(0, 3), own, [(1_000_000_000 + r.randint(1, 3),)], people(), [], [("1", [(r.randint(1, 12), "T")], people())])

    old = {x[0]: x for x in before[1]} if before else {}
    rows = [old[i] if i in old and r.random() < 0.6 else release(i) for i in range(1, 26) if r.random() < 0.8]
    ids = [i for i in [*range(1, 13), *(1_000_000_000 + k for k in (1, 2, 3))] if r.random() < 0.85]
    return [(i,) for i in ids], rows, [(m, r.choice([None, 1980, 1981])) for m in (1, 2, 3)]


def frames(spark, s):
    return [spark.createDataFrame(rows, SCHEMAS[t]) for t, rows in zip(("entity", "release", "master"), s, strict=True)]


def rebuilt(spark, snapshots, role_map):
    """Edges and counts of the last of snapshots from scratch, without entities that an earlier one had and the last one lacks."""
    entity, release, master = frames(spark, snapshots[-1])
    lost = {i for s in snapshots for (i,) in s[0]} - {i for (i,) in snapshots[-1][0]}
    edges = relations.extract_relations(release, master, role_map)
    edges = changes.cascade_delete(edges, spark.createDataFrame([(i,) for i in lost], "id bigint"))
    return sorted(map(str, edges.collect())), sorted(map(str, aggregates.role_pairs(edges).select("id", "role", "n").collect()))


def seen(view):
    return sorted(map(str, view.edges().select("subject", "role", "object", "release_id", "year").collect())), sorted(map(str, view.role_counts().select("id", "role", "n").collect()))


def test_view_follows_snapshots(spark, tmp_path):
    r, taken = random.Random(4), []
    role_map = spark.createDataFrame(ROLES, "raw string, role_name string, is_aggregate boolean")
    view = CreditView(spark, str(tmp_path / "view"))
    for k in range(3):
        taken.append(snapshot(r, taken[-1] if taken else None))
        view.load(f"2024-0{k + 1}", *frames(spark, taken[-1]), role_map)
        assert seen(view) == rebuilt(spark, taken, role_map)
    kinds = {(x.snapshot, x.change_type) for x in view.ledger().collect()}
    assert {("2024-03", c) for c in ("insert", "update", "delete", "unchanged", "triples")} <= kinds
    with pytest.raises(ValueError, match="comes after"):
        view.load("2024-02a", *frames(spark, taken[0]), role_map)
    # a load that was killed has no line in the ledger, and is done again
    want = seen(view)
    shutil.rmtree(tmp_path / "view/ledger/2024-03")
    shutil.rmtree(tmp_path / "view/counts/2024-03")
    view.load("2024-03", *frames(spark, taken[-1]), role_map)
    assert seen(view) == want
    view.load("2024-03", *frames(spark, taken[0]), role_map)  # is there already
    assert seen(view) == want
    # nothing left
    view.load("2024-04", *(x.where(F.lit(False)) for x in frames(spark, taken[-1])), role_map)
    assert seen(view) == ([], [])


def test_credit_stream(spark, tmp_path):
    r, taken = random.Random(9), []
    role_map = spark.createDataFrame(ROLES, "raw string, role_name string, is_aggregate boolean")
    view, into = CreditView(spark, str(tmp_path / "view")), tmp_path / "in"

    def arrive(name, s, done=True):
        for t, df in zip(("entity", "release", "master"), frames(spark, s), strict=True):
            df.write.parquet(str(into / name / t))
        if done:
            (into / name / "_SUCCESS").touch()

    def run():
        start_credit_stream(view, str(into), str(tmp_path / "checkpoint"), SCHEMAS, role_map).awaitTermination()

    taken.append(snapshot(r))
    arrive("2024-02", taken[0])
    run()
    taken.append(snapshot(r, taken[0]))
    arrive("2024-03", taken[1])
    arrive("2024-01", snapshot(r))  # late
    arrive("2024-04", snapshot(r), done=False)
    run()
    assert view.versions() == ["2024-02", "2024-03"] and view.refused() == ["2024-01"]
    assert seen(view) == rebuilt(spark, taken, role_map)
