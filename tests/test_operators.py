import gzip
import itertools
import random
import shutil

import pytest
from pyspark.sql import functions as F

from creditgraph.operators import aggregates, changes, network, relations, resolve, role_sets, search, serving
from creditgraph.sources import dumps
from creditgraph.streaming.arrivals import complete, start_dump_stream, version_path

CREDIT = "array<struct<id: bigint, name: string, roles: array<struct<name: string>>>>"
RELEASE = f"release_id long, master_id long, release_date date, artists {CREDIT}, labels array<struct<id: bigint>>, extra_artists {CREDIT}, companies array<struct<id: bigint, entity_type_name: string>>, tracklist array<struct<artists: {CREDIT}, extra_artists: {CREDIT}>>"
AGGREGATE = {"DJ Mix"}


def brute(r):
    """The triples of one release, by plain loops."""
    rid, _, _, artists, labels, extra, firms, tracks = r
    own, lab = {a[0] for a in artists or [] if a[0] is not None}, {x[0] for x in labels or [] if x[0] is not None}
    on_tracks = {a[0] for t in tracks or [] for a in t[0] or [] if a[0] is not None}
    comp = len(own) == 1 and artists[0][1] in ("Various", "Various Artists")
    people = on_tracks if comp else own
    objects = lab if comp else people
    out = {(a, "Compiled On" if comp else "Released On", x, rid) for a in people for x in lab}
    for c in extra or []:
        for role in c[2] or []:
            if objects:
                out |= {(c[0], role[0], o, rid) for o in (on_tracks if role[0] in AGGREGATE else objects)}
    out |= {(o, f[1], f[0], rid) for f in firms or [] for o in objects}
    for ta, te in tracks or []:
        o_ = {a[0] for a in ta or [] if a[0] is not None} or people or lab
        out |= {(c[0], role[0], o, rid) for c in te or [] for role in c[2] or [] for o in o_}
    return out


def test_extract_relations(spark):
    rng = random.Random(5)

    def people(n, named=False):
        return [(rng.randrange(1, 9), rng.choice(["Various", "X"]) if named else "N", [(rng.choice(["Guitar", "DJ Mix"]),)]) for _ in range(rng.randrange(n))] or rng.choice([None, []])

    rows = [(i, 1, None, people(3, True), [(1_000_000_000 + rng.randrange(1, 4),) for _ in range(rng.randrange(3))], people(3), [(7, "Guitar")] * rng.randrange(2), [(people(3), people(3)) for _ in range(rng.randrange(3))]) for i in range(60)]
    release = spark.createDataFrame(rows, RELEASE)
    role_map = spark.createDataFrame([("Guitar", "Guitar", False), ("DJ Mix", "DJ Mix", True)], "raw string, role_name string, is_aggregate boolean")
    got = {(e.subject, e.role, e.object, e.release_id) for e in relations.extract_relations(release, spark.createDataFrame([(1, 1999)], "master_id long, year int"), role_map).collect()}
    assert got == set(itertools.chain.from_iterable(map(brute, rows)))


def test_fold_and_counts(spark):
    e = spark.createDataFrame([(1, "A", 2, 10, 1990), (1, "A", 2, 10, None), (1, "A", 2, 11, None), (2, "A", 2, 12, 1991)], "subject long, role string, object long, release_id long, year int")
    folded = {(r.subject, r.object): r.releases for r in aggregates.fold_edges(e).collect()}
    assert folded == {(1, 2): {10: 1990, 11: None}, (2, 2): {12: 1991}}
    assert {(r.id, r.n) for r in aggregates.role_pairs(e).collect()} == {(1, 1), (2, 2)}


def test_jaro_winkler():
    assert abs(search.jaro_winkler("MARTHA", "MARHTA") - 0.961111) < 1e-5
    assert abs(search.jaro_winkler("DIXON", "DICKSONX") - 0.813333) < 1e-5
    assert search.jaro_winkler("", "a") == 0 and search.jaro_winkler("", "") == 1


def serving_table(spark):
    rows = [(1, 1, 1, "One", {"Two": 2}, {"Band": 3}, None, {"Released On": 1}), (2, 2, 1, "Two", {"One": 1}, None, None, None), (3, 3, 1, "Band", None, None, {"One": 1}, None), (1_000_000_005, 5, 2, "Label", None, None, None, {"Released On": 1}), (9, 9, 1, "Various", None, None, None, None)]
    return spark.createDataFrame(rows, "id long, entity_id long, entity_type int, entity_name string, aliases map<string,bigint>, groups map<string,bigint>, members map<string,bigint>, relation_counts map<string,bigint>").withColumn("parent_label", F.lit(None).cast("map<string,bigint>")).withColumn("sublabels", F.col("parent_label"))


def test_network(spark):
    edges = spark.createDataFrame([(1, "Released On", 1_000_000_005, 10, 1990), (9, "Released On", 1_000_000_005, 11, 1990), (1, "Guitar", 3, 12, 1991)], "subject long, role string, object long, release_id long, year int")
    centers = spark.createDataFrame([(1,)], "center_id long")
    nodes, links = network.network(centers, serving_table(spark), edges, ["Alias", "Member Of", "Released On"], degree=2)
    got = {r.id: (r.distance, r.missing, r.cluster) for r in nodes.collect()}
    assert set(got) == {1, 2, 3, 1_000_000_005}  # the placeholder is no node
    assert {i: d for i, (d, _, _) in got.items()} == {1: 0, 2: 1, 3: 1, 1_000_000_005: 1}
    assert got[1][2] == got[2][2] == 1 and got[3][2] is None
    by_key = {r.key: r.releases for r in links.collect()}
    assert by_key == {"artist-1-alias-artist-2": None, "artist-1-member-of-artist-3": {12: 1991}, "artist-1-released-on-label-5": {10: 1990}}
    assert '"source":"artist-1"' in network.network_json(nodes, links).first()["json"]
    assert network.reduce_network(nodes, links, 600, 1800)[0].count() == 4
    assert {(r.id, r.n) for r in network.subgraph_sizes(nodes, links).collect()} == {(1, 4), (2, 1), (3, 1), (1_000_000_005, 1)}


def test_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, v string")
    new = spark.createDataFrame([(2, None), (3, "d"), (4, "e")], "id long, v string")
    diff = changes.diff_snapshots(old, new, "id", ["v"])
    assert {(r.id, r.change_type) for r in diff.collect()} == {(1, "delete"), (2, "unchanged"), (3, "update"), (4, "insert")}
    assert {(r.id, r.v) for r in changes.apply_changes(old, diff, "id").collect()} == {(2, None), (3, "d"), (4, "e")}
    ledger = spark.createDataFrame([], "key string, value string, ts timestamp")
    stages = spark.sql("SELECT 1 AS stage, date'2024-01-01' AS date UNION ALL SELECT 2, date'2024-01-01'")
    done = changes.mark_done(ledger, stages.where("stage = 1"))
    assert [r.stage for r in changes.pending_stages(done, stages).collect()] == [2]


def test_merge_roles(spark):
    a = spark.createDataFrame([("X", 1)], "role_name string, c int")
    b = spark.createDataFrame([("X", 2), ("Y", 3)], "role_name string, c int")
    assert {(r.role_name, r.c) for r in changes.merge_roles(a, b).collect()} == {("X", 1), ("Y", 3)}


def test_entity_refs_and_sublabels(spark):
    e = spark.createDataFrame([(1, 1, 1, "Ann", {"BOB": None, "Nobody": None}), (2, 2, 1, "Bob", {"Ann": 0})], "id long, entity_id long, entity_type int, entity_name string, aliases map<string,bigint>")
    tokens = search.build_tokens(e.select("id", F.col("entity_name").alias("text")))
    assert {r.id: r.aliases for r in resolve.resolve_entity_refs(e, tokens).collect()} == {1: {"BOB": 2, "Nobody": None}, 2: {"Ann": 1}}


def test_dumps(spark, tmp_path):
    xml = "<artists><artist><id>1</id><name>Ann</name><realname>A &amp; B</realname><profile>NULL</profile><members><name>No Id</name><id>4</id><name>Bo</name></members><aliases><name>Annie</name></aliases></artist><artist><id>2</id></artist></artists>"
    with gzip.open(tmp_path / "discogs_20240101_artists.xml.gz", "wt") as f:
        f.write(xml)
    assert dumps.resolve_dump(spark, str(tmp_path), "artist").endswith("discogs_20240101_artists.xml.gz")
    (a,) = dumps.read_artists(spark, str(tmp_path / "discogs_20240101_artists.xml.gz")).collect()
    assert (a.id, a.entity_metadata.profile, a.entities.members, a.entities.aliases) == (1, None, {"No Id": 0, "Bo": 4}, {"Annie": None})
    rel = '<releases><release id="7"><title>T</title><released>1999-00-00</released><artists><artist><id>1</id><name>Ann</name></artist></artists><labels><label name="L" catno="C1"/></labels><extraartists><artist><id>2</id><role>Guitar [Lead], Vocals</role></artist></extraartists></release><release id="8"/></releases>'
    with gzip.open(tmp_path / "discogs_20240101_releases.xml.gz", "wt") as f:
        f.write(rel)
    (r,) = dumps.read_releases(spark, str(tmp_path / "discogs_20240101_releases.xml.gz")).collect()
    assert (r.release_id, str(r.release_date), r.labels[0].name, r.extra_artists[0].roles[0].name) == (7, "1999-01-01", "L", "Guitar [Lead], Vocals")
    assert [str(x.date) for x in dumps.dump_dates(spark, "2024-01-01", "2024-03-01").collect()] == ["2024-01-01", "2024-02-01", "2024-03-01"]


def test_label_dump_keeps_outer_labels(spark, tmp_path):
    with gzip.open(tmp_path / "l.xml.gz", "wt") as f:
        f.write("<labels><label><id>1</id><name>Big</name><sublabels><label>Small</label></sublabels><parentLabel>Top</parentLabel></label></labels>")
    (x,) = dumps.read_labels(spark, str(tmp_path / "l.xml.gz")).collect()
    assert (x.id, x.entities.sublabels, x.entities.parent_label) == (1_000_000_001, {"Small": None}, {"Top": None})


def test_url_lists(spark, tmp_path):
    e = spark.range(1, 26).select(F.col("id"))
    assert serving.write_url_lists(e, str(tmp_path / "urls"), "https://example.org", per_file=10) == 25
    assert spark.read.text(str(tmp_path / "urls/parts")).groupBy("part").count().orderBy("part").collect()[2]["count"] == 5


def arrive(spark, tmp_path, name, rows, schema, checkpoint="ck", edges=None):
    if rows is not None:
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(str(tmp_path / "in" / name))
    q = start_dump_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / checkpoint), schema, "id", ["v"], edges=edges)
    assert q.awaitTermination(240)
    return {tuple(r) for r in spark.read.parquet(version_path(str(tmp_path / "out"), name)).collect()} if rows is not None else None


def test_arrivals(spark, tmp_path):
    """Snapshots of two files; edges lose deleted ends and their counts follow; a lost checkpoint loads nothing twice; a lost version is an error."""
    schema = spark.createDataFrame([], "id long, v string").schema
    edges = spark.createDataFrame([(1, "A", 2, 10, 1990), (2, "A", 3, 11, 1991)], "subject long, role string, object long, release_id long, year int")
    out = str(tmp_path / "out")
    first, second = [(1, "a"), (2, "b"), (3, "c")], [(2, "c"), (3, "c"), (4, "d")]
    assert arrive(spark, tmp_path, "20240101", first, schema, edges=edges) == set(first)
    assert arrive(spark, tmp_path, "20240201", second, schema, edges=edges) == set(second)
    assert {(r.change_type, r.rows) for r in spark.read.parquet(version_path(out, "20240201", "changes")).collect()} == {("insert", 1), ("update", 1), ("unchanged", 1), ("delete", 1)}
    assert [(r.subject, r.object) for r in spark.read.parquet(version_path(out, "20240201", "relation")).collect()] == [(2, 3)]
    assert {r.id: r.relation_counts for r in spark.read.parquet(version_path(out, "20240201", "role_counts")).collect()} == {2: {"A": 1}, 3: {"A": 1}}
    stamp = (tmp_path / "out/changes/20240201/_SUCCESS").stat().st_mtime_ns
    arrive(spark, tmp_path, "none", None, schema, checkpoint="other", edges=edges)
    assert (tmp_path / "out/changes/20240201/_SUCCESS").stat().st_mtime_ns == stamp and complete(spark, f"{out}/changes") == ["20240101", "20240201"]
    shutil.rmtree(tmp_path / "out/entity/20240201")
    with pytest.raises(Exception, match="lost"):
        arrive(spark, tmp_path, "20240301", first, schema, edges=edges)


def test_relations_of_dump(spark, tmp_path):
    """From XML to edges: a list of roles with details, a track's credit, a label by name, a company without a role."""
    rel = """<releases><release id="7"><title>T</title><released>1999-00-00</released><artists><artist><id>1</id><name>Ann</name></artist></artists><labels><label name="L" catno="C1"/></labels>
<extraartists><artist><id>2</id><role>Guitar [Lead], sax</role></artist><artist><id>3</id><role>Unknown Thing</role></artist></extraartists>
<companies><company><id>1000000009</id><entity_type_name>Pressed By</entity_type_name></company></companies>
<tracklist><track><position>1</position><extraartists><artist><id>4</id><role>Producer [Co, Add.], Mixed-by</role></artist></extraartists></track></tracklist></release></releases>"""
    with gzip.open(tmp_path / "r.xml.gz", "wt") as f:
        f.write(rel)
    entity = spark.createDataFrame([(1, 1, 1, "Ann"), (1_000_000_005, 5, 2, "L")], "id long, entity_id long, entity_type int, entity_name string")
    release = resolve.resolve_release_labels(dumps.read_releases(spark, str(tmp_path / "r.xml.gz")), entity)
    role = spark.createDataFrame([(x,) for x in ("Guitar", "Saxophone", "Producer", "Mixed By")], "role_name string")
    got = {tuple(r) for r in relations.relations_of_dump(release, spark.createDataFrame([], "master_id long, year int"), role).collect()}
    want = {(1, "Released On", 1_000_000_005), (2, "Guitar", 1), (2, "Saxophone", 1), (4, "Producer", 1), (4, "Mixed By", 1)}
    assert got == {(*w, 7, 1999) for w in want}


def test_role_sets(spark):
    role = spark.createDataFrame([("Guitar", "Instruments", "Strings"), ("Harp", "Instruments", "Strings"), ("Drums", "Instruments", None), ("Artwork, Design", "Visual", None), ("Alias", "Relation", None)], "role_name string, role_category string, role_subcategory string")
    asked = spark.createDataFrame([(1, 1, "Strings,Nobody"), (2, 1, "Artwork\\, Design,Drums"), (3, 1, "Nobody"), (4, 2, ""), (5, 2, None), (6, 1, "Instruments")], "request_id long, entity_type int, roles string")
    got = {}
    for r in role_sets.expand_roles(asked, role).collect():
        got.setdefault(r.request_id, set()).add(r.role_name)
    assert got == {1: {"Guitar", "Harp"}, 2: {"Artwork, Design", "Drums"}, 3: {"Alias", "Member Of"}, 4: {"Released On"}, 5: {"Released On"}, 6: {"Guitar", "Harp", "Drums"}}
    assert role_sets.partition_roles(["Guitar", "Alias", "Drums"], role) == (["Alias"], ["Guitar", "Drums"])
    with pytest.raises(ValueError, match="Tuba"):
        role_sets.partition_roles(["Guitar", "Tuba"], role)


def test_tree(spark):
    """0 above 1 and 2, which are siblings, both above 3; another network is apart."""
    nodes = spark.createDataFrame([(7, 0, 0), (7, 1, 1), (7, 2, 1), (7, 3, 2), (8, 0, 0), (8, 3, 1)], "center_id long, id long, distance int")
    links = spark.createDataFrame([(7, 0, 1), (7, 2, 0), (7, 1, 2), (7, 1, 3), (7, 3, 2), (8, 3, 0)], "center_id long, one long, two long")
    up, near = {}, {}
    for r in network.ancestors(nodes, links).collect():
        up.setdefault((r.center_id, r.id), set()).add(r.ancestor)
    for r in network.neighbours(nodes, links).collect():
        near.setdefault((r.center_id, r.id), set()).add(r.neighbour)
    assert up == {(7, 0): {0}, (7, 1): {0, 1}, (7, 2): {0, 2}, (7, 3): {0, 1, 2, 3}, (8, 0): {0}, (8, 3): {0, 3}}
    assert near == {(7, 0): {1, 2}, (7, 1): {0, 2, 3}, (7, 2): {0, 1, 3}, (7, 3): {1, 2}, (8, 0): {3}, (8, 3): {0}}


def test_pick_depth(spark):
    sizes = [(1, 0, 9), (1, 1, 4), (1, 1, 5), (1, 2, 1), (2, 0, 50), (3, 0, None), (4, 0, 2), (4, 1, 3), (4, 2, 3), (4, 3, 3), (4, 4, 90)]
    got = {r.center_id: r.depth for r in network.pick_depth(spark.createDataFrame(sizes, "center_id long, distance int, n int"), 5.0).collect()}
    # 1: means 9, 3, 1, so 1; 2: none under 5, and one level; 4: means 2, 3, 3, 3, 90, so 3
    assert got == {1: 1, 2: 0, 3: 0, 4: 3}
    few = spark.createDataFrame([(1, d, n) for d, n in ((0, 4), (1, 9), (2, 9), (3, 9))], "center_id long, distance int, n int")
    assert network.pick_depth(few, 5.0).first()["depth"] == 1  # promoted


def test_entity_names(spark):
    e = spark.createDataFrame([(1, "N", ("A &amp; B and C/D", ["V"]))], "id long, entity_name string, entity_metadata struct<real_name: string, name_variations: array<string>>")
    assert sorted(r.text for r in search.entity_names(e).collect()) == sorted(["N", "V", "A", "amp; B", "C", "D"])


def test_lookups(spark):
    e = spark.createDataFrame([(1, "A", 2, 10, 1990), (1, "B", 2, 10, 1990), (3, "A", 2, 11, None)], "subject long, role string, object long, release_id long, year int")
    role = spark.createDataFrame([(5, "A"), (6, "B")], "role_id int, role_name string")
    keys = spark.createDataFrame([(1, "A", 2), (3, "5", 2), (3, "6", 2), (9, "A", 9)], "subject long, role string, object long")
    assert {r.release_id for r in aggregates.edges_by_key(e, keys, role).collect()} == {10, 11}
    assert aggregates.edges_by_key(e, keys).count() == 1
    rows = spark.createDataFrame([(1, "a", 0), (2, "", 5), (3, None, 5), (4, "b", 5)], "id long, name string, n int")
    assert [r.id for r in serving.require(rows, ["name", "n"]).collect()] == [4]
    assert (serving.first_row(rows, "id").first()["id"], serving.last_row(rows, "id").first()["id"], serving.random_rows(rows, 2).count()) == (1, 4, 2)
    assert {(r.token, r.df) for r in search.frequent_tokens(spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "token string, id long"), 1).collect()} == {("x", 2)}


def test_tables_written(spark, tmp_path):
    root = str(tmp_path)
    serving.write_tokens(spark.createDataFrame([("x", 1), ("x", 1), ("y", 2)], "token string, id long"), root, 4)
    assert serving.read_table(spark, root, "token").where("token = 'x'").select("id").collect()[0]["id"] == 1
    serving.write_edges(spark.createDataFrame([(1, "A", 2, 10, 1990)], "subject long, role string, object long, release_id long, year int"), root)
    assert serving.read_table(spark, root, "relation_by_object").count() == 1
    serving.write_attributes(spark.createDataFrame([(1, "US", "Rock", None)], "id long, countries string, genres string, styles string"), root)
    assert serving.read_table(spark, root, "entity_attributes").first()["genres"] == "Rock"
    with pytest.raises(ValueError):
        aggregates.MOST_NAMES, kept = 1, aggregates.MOST_NAMES
        try:
            aggregates.attribute_dictionary(spark.createDataFrame([(1, "a,b")], "id long, styles string"), "styles")
        finally:
            aggregates.MOST_NAMES = kept


def test_role_sources(spark, tmp_path):
    (tmp_path / "roles").mkdir()
    (tmp_path / "roles/a.csv").write_text("name,category,subcategory\nGuitar,INSTRUMENTS,Strings\nCo-producer & Mixed-by,STUDIO,\n")
    (tmp_path / "chordophones.csv").write_text("Instrument,Classification\nHarp,x\n")
    (tmp_path / "h.json").write_text('{"3": {"Label": "Chordophones", "Instruments": [], "Description": ""}, "31": {"Label": "Simple", "Instruments": ["Zither"], "Description": ""}}')
    assert {(r.role_name, r.category, r.subcategory) for r in dumps.read_roles(spark, str(tmp_path / "roles")).collect()} == {("Guitar", "INSTRUMENTS", "Strings"), ("Co-Producer", "STUDIO", "NONE"), ("Mixed By", "STUDIO", "NONE")}
    assert [(r.role_name, r.subcategory) for r in dumps.read_instruments(spark, [str(tmp_path / "chordophones.csv")]).collect()] == [("Harp", "Stringed Instruments")]
    assert [(r.role_name, r.subcategory) for r in dumps.read_taxonomy(spark, str(tmp_path / "h.json")).collect()] == [("Zither", "Stringed Instruments")]


def test_masters(spark, tmp_path):
    with gzip.open(tmp_path / "m.xml.gz", "wt") as f:
        f.write('<masters><master id="3"><title>T</title><year>1980</year><videos><video src="s" duration="12" embed="true"><title>V</title></video></videos></master><master id="4"/></masters>')
    (m,) = dumps.read_masters(spark, str(tmp_path / "m.xml.gz")).collect()
    assert (m.master_id, m.year, m.videos[0].duration, m.videos[0].embed) == (3, 1980, 12, True)


def test_reduced_network(spark):
    """Over the limits, outer nodes with few links go first, and what a node loses is counted as missing."""
    nodes = spark.createDataFrame([(1, 0, 0, 0)] + [(1, i, 1, 0) for i in (1, 2)] + [(1, i, 2, 0) for i in range(3, 9)], "center_id long, id long, distance int, missing int")
    pairs = [(0, 1), (0, 2)] + [(1, i) for i in range(3, 9)] + [(2, 3), (2, 4)]
    links = spark.createDataFrame([(1, f"k{a}-{b}", a, b) for a, b in pairs], "center_id long, key string, one long, two long")
    n, e = network.reduce_network(nodes, links, 5, 100)
    assert {r.id: r.missing for r in n.collect()} == {0: 0, 1: 4, 2: 0, 3: 0, 4: 0}
    assert {(r.one, r.two) for r in e.collect()} == {(0, 1), (0, 2), (1, 3), (1, 4), (2, 3), (2, 4)}


def test_years(spark):
    links = spark.createDataFrame([("Alias", 1, 2, None), ("Guitar", 1, 3, {10: 1980, 11: 1990}), ("Guitar", 1, 4, {12: 1980}), ("Member Of", 1, 5, {13: None}), ("Member Of", 6, 5, {13: None})], "role string, one long, two long, releases map<bigint,int>").withColumn("center_id", F.lit(1))
    kept = network.restrict_years(links, 1985, 1995).collect()
    assert {(r.role, r.two): r.releases for r in kept if r.two < 5} == {("Alias", 2): None, ("Guitar", 3): {11: 1990}}
    assert [(r.one, r.two) for r in network.drop_undated_members(links, 1985, None).where("role = 'Member Of'").collect()] == [(6, 5)]
    assert network.restrict_years(links, None, None).count() == 5


def test_alias_components(spark):
    """A long path, a star and a pair."""
    pairs = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 20)] + [(301, 300)]
    s = spark.createDataFrame([(a, {str(b): b}) for a, b in pairs], "id long, aliases map<string,bigint>")
    got = {r.id: r.component for r in network.alias_components(s).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{100 + i: 100 for i in range(20)}, 300: 300, 301: 300}
    assert network.alias_components(s.where("false")).count() == 0
