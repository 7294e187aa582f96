"""Networks against a plain-Python model, in graphs and limits that reach every rule; lookups by stores."""

import random

import pytest
from pyspark.sql import functions as F

from creditgraph.operators import network, stores

LABELS = 1_000_000_000
SERVING = "id long, entity_id long, entity_type int, entity_name string, aliases map<string,bigint>, groups map<string,bigint>, members map<string,bigint>, parent_label map<string,bigint>, sublabels map<string,bigint>, relation_counts map<string,bigint>"
EDGES = "subject long, role string, object long, release_id long, year int"
ROLES = ["Alias", "Member Of", "Sublabel Of", "Released On", "Producer", "Guitar", "Drums"]


def graph(seed, n=60, n_labels=12, n_edges=420):
    """Artists in bands, alias pairs, sublabels, a hub, placeholders, and edges with and without years."""
    r = random.Random(seed)
    artists, labels = list(range(1, n + 1)), [LABELS + i for i in range(1, n_labels + 1)]
    maps = {i: {m: {} for m in ("aliases", "groups", "members", "parent_label", "sublabels")} for i in artists + labels}
    for _ in range(n // 3):
        a, b = r.sample(artists, 2)
        maps[a]["aliases"][f"n{b}"] = b
        maps[b]["aliases"][f"n{a}"] = a
        a, b = r.sample(artists, 2)
        maps[a]["groups"][f"n{b}"], maps[b]["members"][f"n{a}"] = b, a
    for a in labels[1:]:
        b = r.choice(labels[: labels.index(a)])
        maps[a]["parent_label"][f"n{b}"], maps[b]["sublabels"][f"n{a}"] = b, a
    maps[artists[0]]["aliases"]["nobody"] = None
    edges = set()
    for k in range(n_edges):
        subject = r.choice([artists[1], r.choice(artists)])  # the second one is a hub
        role = r.choice(["Released On", "Released On", "Producer", "Guitar", "Drums", "Member Of"])
        edges.add((subject, role, r.choice(labels) if role == "Released On" else r.choice(artists), k // 2, r.choice([None, 1990, 1991, 1995])))
    edges.add((artists[2], "Released On", LABELS, 9_000, 1991))  # the label without a number
    once = {}
    for e in sorted(edges, key=str):
        once.setdefault(e[:4], e)
    names = {artists[4]: "Various", artists[5]: "Various Artists 3", artists[6]: "", labels[3]: "Not On Label"}
    counts = {}
    for s, role, o in {e[:3] for e in once.values()}:
        for i in {s, o}:
            counts.setdefault(i, {}).setdefault(role, 0)
            counts[i][role] += 1
    serving = [(i, i % LABELS, 2 if i >= LABELS else 1, names.get(i, f"n{i}"), *(maps[i][m] or None for m in ("aliases", "groups", "members", "parent_label", "sublabels")), counts.get(i)) for i in artists + labels if i != artists[7]]
    return serving, list(once.values())


def model(center, serving, edges, roles, degree, max_nodes, ratio, lo, hi, reached):
    """The network of one centre, step by step; reached collects the names of the rules that took effect."""
    most = max_nodes * ratio
    about = {s[0]: dict(zip([c.split(" ")[0] for c in SERVING.split(", ")], s, strict=True)) for s in serving}
    structural, relational = [x for x in roles if x in network.STRUCTURAL], [x for x in roles if x not in network.STRUCTURAL]
    narrow = [x for x in relational if x not in network.PRUNED_ROLES]

    def inside(y):
        return y is None or ((lo is None or y >= lo) and (hi is None or y <= hi))

    def excluded(e):
        return e["entity_name"] in ("", "Various", "Not On Label", "Self Released", "Self-Released") or e["entity_name"].startswith("Various Artists")

    def promised(e, asked):
        sizes = {"Alias": ("aliases",), "Member Of": ("groups", "members"), "Sublabel Of": ("parent_label", "sublabels")}
        return sum(sum(len(e[m] or {}) for m in sizes[x]) if x in sizes else (e["relation_counts"] or {}).get(x, 0) for x in asked)

    def stated(e, names):
        out = set()
        for name, kind, m in (("Alias", 1, "aliases"), ("Member Of", 1, "groups"), ("Member Of", 1, "members"), ("Sublabel Of", 2, "parent_label"), ("Sublabel Of", 2, "sublabels")):
            for other in (e[m] or {}).values() if e["entity_type"] == kind and name in names else ():
                if other:
                    pair = (e["id"], other) if m in ("groups", "parent_label") else (other, e["id"])
                    out.add((name, *(sorted(pair) if name == "Alias" else pair)))
        return out

    nodes, links, front, stop, pruned = {}, {}, {center}, False, False
    for distance in range(degree + 1):
        capped = sorted(front)[:max_nodes]
        if len(front) > max_nodes:
            reached.add("node cap")
        accepted = [i for i in capped if i in about and not excluded(about[i])]
        if any(i in about and excluded(about[i]) for i in capped):
            reached.add("excluded")
        nodes |= {i: distance for i in accepted}
        if stop or not any(i not in about or not excluded(about[i]) for i in capped) or not nodes:
            break
        if distance and len(nodes) >= max_nodes:
            reached.add("stop at nodes")
            break
        if distance and len(nodes) > max_nodes / 4 and not pruned:
            pruned = True
            reached.add("pruned")
        names = [x for x in structural if x != "Alias" or distance < 3]
        now = {k: None for i in accepted for k in stated(about[i], names)}
        if distance < degree:
            asked = {i for i in accepted if not distance or promised(about[i], narrow if pruned else relational) <= most}
            if len(asked) < len(accepted):
                reached.add("hub skipped")
            mine = {*(narrow if pruned else relational), *structural}
            touch = sorted({e for e in edges if (e[0] in asked or e[2] in asked) and e[1] in mine and inside(e[4])}, key=lambda e: (e[1], e[0], e[2], e[3]))
            if len(touch) > most * len(asked):
                reached.add("edge cap")
            found = {}
            for s, role, o, release, year in touch[: most * len(asked)]:
                old = found.setdefault((role, s, o), {})
                old[release] = max(filter(None, (old.get(release), year)), default=None)
            for role, one, two in [*now]:
                for key, years in found.items():
                    if key[0] == role and {key[1], key[2]} == {one, two}:
                        mine_ = now[role, one, two] = now[role, one, two] or {}
                        for release, year in years.items():
                            mine_[release] = max(filter(None, (mine_.get(release), year)), default=None)
            now |= {k: y for k, y in found.items() if k[0] not in structural}
        n = len(now)
        stop = n == 0 or n >= most * 3 or (distance > 1 and n >= most)
        if n and stop:
            reached.add("stop at links")
        good = {k: y for k, y in now.items() if k[1] % LABELS and k[2] % LABELS}
        for k, y in good.items():
            if k[1] != k[2] and not (k in links and y is None and links[k] is not None):
                links[k] = y
        front = {i for k in good for i in k[1:]} - set(nodes)

    def layered(nodes, links):
        links = {k: y for k, y in links.items() if k[1] in nodes and k[2] in nodes}
        seen = {i for i, d in nodes.items() if d == 0}
        for _ in range(len(nodes)):
            seen |= {b for k in links for a, b in ((k[1], k[2]), (k[2], k[1])) if a in seen and nodes[a] < nodes[b]}
        if len(seen) < len(nodes):
            reached.add("layered")
        nodes = {i: d for i, d in nodes.items() if i in seen}
        return nodes, {k: y for k, y in links.items() if k[1] in nodes and k[2] in nodes}

    def volume(i):
        return sum((about[i]["relation_counts"] or {}).values())

    nodes, links = layered(nodes, links)
    for (role, one, two), years in list(links.items()):
        if years is None and center in (one, two) and (volume(one) or volume(two)):
            more = {}
            for s, _, o, release, year in edges:
                if {s, o} == {one, two} and year is not None and inside(year):
                    more[release] = max(more.get(release, 0), year)
            if more:
                links[role, one, two] = more
                reached.add("years of other roles")
    if lo is not None or hi is not None:
        for k, years in list(links.items()):
            dated = [y for y in (years or {}).values() if y is not None]
            if dated and not any(inside(y) for y in dated):
                del links[k]
                reached.add("years outside")
                continue
            if years is not None:
                links[k] = {r: y for r, y in years.items() if inside(y)}
            if k[0] == "Member Of" and center in k[1:] and not [y for y in (links[k] or {}).values() if y is not None]:
                del links[k]
                reached.add("undated membership")
    nodes, links = layered(nodes, links)
    return nodes, links, {i: promised(about[i], roles) - sum(i in k[1:] for k in links) for i in nodes}


LIMITS = {  # by seed: degree, max_nodes, ratio, lo, hi
    1: (5, 30, 1, 1990, 1992), 2: (3, 12, 2, None, None), 3: (4, 25, 1, None, 1994), 6: (5, 16, 3, None, None), 7: (4, 50, 1, None, None),
}


def rows_of(nodes, links):
    n = {(r.center_id, r.id): (r.distance, r.missing) for r in nodes.collect()}
    return n, {(r.center_id, r.role, r.one, r.two): r.releases for r in links.collect()}


def test_networks_follow_the_model(spark, tmp_path):
    reached = set()
    for k, limits in LIMITS.items():
        serving, edges = graph(k)
        s, e = spark.createDataFrame(serving, SERVING), spark.createDataFrame(edges, EDGES)
        centers = [1, 2, 5, 20, 33, LABELS + 2, 8][: 7 if k % 2 else 3]
        degree, max_nodes, ratio, lo, hi = limits
        network.FEW, few = (0 if k % 3 == 0 else network.FEW), network.FEW
        try:
            if k % 2:
                s, e = stores.Store.write(s, f"{tmp_path}/s{k}", ["id"], 3), stores.Store.write(e, f"{tmp_path}/e{k}", ["subject", "object"], 3)
            got = rows_of(*network.network(spark.createDataFrame([(c,) for c in centers], "center_id long"), s, e, ROLES, degree, max_nodes, ratio, lo, hi))
        finally:
            network.FEW = few
        nodes, links = {}, {}
        for c in centers:
            n, li, missing = model(c, serving, edges, ROLES, degree, max_nodes, ratio, lo, hi, reached)
            nodes |= {(c, i): (d, missing[i]) for i, d in n.items()}
            links |= {(c, *key): y for key, y in li.items()}
        assert got[0] == nodes, limits
        assert got[1] == links, limits
    assert reached == {"node cap", "excluded", "stop at nodes", "pruned", "hub skipped", "edge cap", "stop at links", "years of other roles", "undated membership", "layered"}


def test_unknown_roles_are_an_error(spark):
    serving, edges = graph(0)
    known = spark.createDataFrame([("Guitar",)], "role_name string")
    with pytest.raises(ValueError, match="Tuba"):
        network.network(spark.createDataFrame([(1,)], "center_id long"), spark.createDataFrame(serving, SERVING), spark.createDataFrame(edges, EDGES), ["Alias", "Guitar", "Tuba"], known_roles=known)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_store_is_not_moved(spark, tmp_path):
    _, edges = graph(1)
    e = spark.createDataFrame(edges, EDGES)
    store = stores.Store.write(e, str(tmp_path), ["subject", "object"], 4)
    asked = spark.createDataFrame([(1, 2), (1, 7), (2, 2)], "center_id long, id long")
    want = {(r.center_id, *r[1:]) for r in asked.join(e.withColumnRenamed("subject", "id"), "id").select("center_id", "id", "role", "object", "release_id").collect()}
    literal, broadcast = store.of("subject", asked, "id", keys=[2, 7]), store.of("subject", asked, "id")
    stores.BROADCAST, most = -1, stores.BROADCAST
    try:
        dealt = store.of("subject", asked, "id")
    finally:
        stores.BROADCAST = most
    for df in (literal, broadcast, dealt):
        assert {(r.center_id, r.subject, r.role, r.object, r.release_id) for r in df.collect()} == want
    assert "hashpartitioning" not in plan_of(literal) and "In(subject, [2,7])" in plan_of(literal)
    assert "hashpartitioning" not in plan_of(broadcast)
    assert plan_of(dealt).split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1  # of what is asked
    roles = spark.createDataFrame([(1, "Guitar"), (1, "Released On"), (2, "Guitar")], "center_id long, role string")
    plain, by_store = (network.expand_frontier(x, asked, roles, 10, 1990, 1994) for x in (e, store))
    assert sorted(map(str, plain.collect())) == sorted(map(str, by_store.collect()))


def test_store_outlives_sessions_and_killed_writes(spark, tmp_path):
    e = spark.createDataFrame([(1, "A", 2, 10, 1990), (None, "A", 2, 10, None)], EDGES)
    stores.Store.write(e, str(tmp_path), ["subject"], 2).close()
    again = stores.Store.open(spark, str(tmp_path), ["subject"])
    assert again.table().count() == 2 and again.of("subject", spark.createDataFrame([(1,), (None,)], "id long"), "id").count() == 1
    with pytest.raises(FileNotFoundError):
        stores.Store.open(spark, str(tmp_path), ["object"])
    e.limit(1).write.parquet(f"{tmp_path}/by_object")  # a copy whose write was killed has no mark
    assert stores.Store.write(e, str(tmp_path), ["subject", "object"], 2).table("object").count() == 2
    assert stores.Store.write(e.where(F.lit(False)), f"{tmp_path}/none", ["subject"], 2).table().count() == 0
