"""The role grammar's column expressions against the plain-Python model."""

import random

from pyspark.sql import functions as F

from creditgraph.functions import role_grammar, roles

from . import role_model

ATOMS = [
    "Guitar", "bass", "12-string", "6 String", "Producer", "prod. by", "Mixed-By", "co-producer", "A&R", "a & r", "DJ", "dj mix", "[Add.", "[lead, solo]", "]", "[", "(live)", "(1990-91)", '"quoted"', "'Nick'", "rock'n'roll", "d'Angelo", "O'Brien", " D'arc",
    "Roland", "TR-808", "808", "TB-303", "tr-909", "B.V.", "J.S.", "Feat.", "arr.", "1st", "2nd violin", "Track 3", "A1", "12 Tone Row", "12: Tone Row", "16 Track Recording", "© 1990", "vox", "written by", "WRITTEN-BY", "ANR", "FX", "Fx.", "misc", "8-Bit Sound",
    "作曲", "été", "Ünder_score", "...", "*", "Etc", "etc", "Strings", "Str", "Stringed-Thing", "Acoustic", "Six-String Acoustic", "Bass (Six-String)", "1999-2001", "-", "–", "x;", "y:", "to-Be", "at", "with", "ß",
]
BETWEEN = [" ", " & ", ",", " / ", "; ", " and ", " + ", "-", "", "'", " - ", ". ", ",", "\n"]


def test_columns_are_the_model(spark):
    r = random.Random(8)
    texts = ["".join(r.choice(ATOMS) + r.choice(BETWEEN) for _ in range(r.randint(1, 5))) for _ in range(6000)]
    texts += ["".join(r.choice("aB'-.[](),& 1D d'") for _ in range(r.randint(0, 14))) for _ in range(4000)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw string").repartition(4)
    for row in df.select("i", role_grammar.normalise_roles(F.col("raw")).alias("names"), role_grammar.parse_roles(F.col("raw")).alias("parts"), role_grammar.role_names(F.col("raw")).alias("all")).collect():
        t = texts[row.i]
        parts = role_model.parse_roles(t)
        assert row.names == role_model.normalise_roles(t), t
        assert [(p["name"], p["detail"]) for p in row.parts] == [(p["name"], p["detail"]) for p in parts], t
        assert row.all == [n for p in parts for n in role_model.normalise_roles(p["name"])], t


def test_no_python_worker(spark):
    df = roles.read_role_texts(spark.createDataFrame([("Guitar [Lead], mixed by",)], "raw string"))
    assert [(x.pos, x.name) for x in df.orderBy("pos").collect()] == [(0, "Guitar"), (1, "Mixed By")]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
