import datetime

import pytest
from pyspark.sql import functions as F

from creditgraph.functions import ids, roles, text

from . import role_model


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("1999-00-00", datetime.date(1999, 1, 1)), ("2023-13-01", datetime.date(2023, 1, 13)), ("2023-02-30", datetime.date(2023, 3, 2)), ("20231225", datetime.date(2023, 12, 25)),
        ("2023", datetime.date(2023, 1, 1)), ("2023-13-13", None), ("0000", None), ("????", None), ("", None), (None, None),
    ],
)
def test_release_date(spark, given, want):
    assert one(spark, given, text.release_date) == want


def test_ids_and_keys(spark):
    df = spark.createDataFrame([(9, 1), (9, 2)], "e long, t int").select(ids.internal_id(F.col("e"), F.col("t")).alias("id"))
    rows = df.select("id", ids.entity_key(F.col("id")).alias("k"), ids.external_id(F.col("id")).alias("x"), ids.link_key(F.col("id"), F.lit("Member Of"), F.lit(3)).alias("l")).collect()
    assert [(r.id, r.k, r.x.entity_id, r.l) for r in rows] == [(9, "artist-9", 9, "artist-9-member-of-artist-3"), (1_000_000_009, "label-9", 9, "label-9-member-of-artist-3")]
    assert one(spark, None, ids.label_internal_id, "long") == ids.MISSING
    assert one(spark, ids.MISSING, lambda c: ids.external_id(c)["entity_id"], "long") == -1


def test_search_text(spark):
    assert one(spark, "The Rolling  Stones (2), Not On Label", text.search_normalise) == "the rolling stones"
    assert sorted(one(spark, "The Jean-Luc Music", text.tokenise)) == ["jean", "jean-luc", "luc"]
    assert one(spark, "Korea, Republic of", text.split_country) == ["Republic of Korea"]
    assert one(spark, "UK & Ireland/US0, 0", text.split_country) == ["UK", "Ireland", "US0", "0"]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Mastered-by", ["Mastered By"]), ("tam-tam", ["Tam-Tam"]), ("Oboe D'amore", ["Oboe d'Amore"]), ("MC", ["MC"]), ("Dj mix", ["DJ Mix"]), ("Tar (lute)", ["Tar"]), ("A&r", ["A&R"]),
        ("Artwork & Package Design By", ["Artwork", "Package Design By"]), ("Something and Something Else and More & more", ["Something", "Something Else", "More", "More"]),
        ("Written by & vibes", ["Written By", "Vibes"]), ("303", ["Roland TB-303"]), ("12 String Guitar", ["Twelve-String Guitar"]), ("6 String 12 String Bass", ["Six-String Twelve-String Bass"]), ("Arp String Machine", ["Arp String Machine"]), ("", []), (None, []),
    ],
)
def test_role_names(given, want):
    assert role_model.normalise_roles(given) == want


def test_parse_roles():
    assert role_model.parse_roles("Producer [Co, Add.], Mixed By") == [{"name": "Producer", "detail": "Co, Add."}, {"name": "Mixed By", "detail": None}]
    assert role_model.parse_roles(None) == []


def test_ratio():
    assert roles.lcs("kitten", "sitting") == 4
    assert roles.ratio("abc", "abc") == 100
    assert roles.role_ratio("Guitar Lead", "Lead Guitar") == 95


def test_resolve_roles(spark):
    role = spark.createDataFrame([("Guitar",), ("Vocals",), ("Mixed By",), ("Saxophone",)], "role_name string")
    raw = spark.createDataFrame([("guitar & sax",), ("Mixed-by",), ("Saxophones",), ("Nothing Like It",), (None,), ("Guitar [Lead], Vocals",), ("Producer [Co, Add.], Mixed By",)], "raw string")
    got = {(r.raw, r.pos, r.role_name) for r in roles.resolve_roles(raw, role).collect()}
    assert got == {("guitar & sax", 0, "Guitar"), ("guitar & sax", 1, "Saxophone"), ("Mixed-by", 0, "Mixed By"), ("Saxophones", 0, "Saxophone"), ("Guitar [Lead], Vocals", 0, "Guitar"), ("Guitar [Lead], Vocals", 1, "Vocals"), ("Producer [Co, Add.], Mixed By", 1, "Mixed By")}
