"""Operators that SQL cannot express, against plain loops over small tables."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditgraph.llm import ann, langid, mixing, secret_scan, sharding

DOCS = "doc_id long, text string, source string"


def test_mix_is_the_plan(spark):
    """Weights, and every row of every pass, from the blocks and their orders that the output states."""
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(9)) or None, rng.choice(["big"] * 8 + ["small", None, "empty"])) for i in range(3000)]
    rows = [(i, None if s == "empty" else t, s) for i, t, s in rows] + [rows[0]] * 3
    for least, budget in ((0, None), (1, None), (0, 5000)):
        docs = spark.createDataFrame(rows, DOCS)
        out = mixing.mix(docs, entropy_gain=0.6, max_repeats=3, min_passes=least, budget=budget).toPandas()
        out["source"] = out["source"].fillna("?")
        tokens = Counter()
        for _, t, s in rows:
            tokens[s or "?"] += len((t or "").split())
        live = {s: n for s, n in tokens.items() if n}
        total, best = sum(live.values()), None
        natural = {s: n / total for s, n in live.items()}

        def spread(w):
            return -sum(x * math.log(x) for x in w.values())

        def powered(e):
            z = sum(x**e for x in natural.values())
            return {s: x**e / z for s, x in natural.items()}

        target = spread(natural) + 0.6 * (math.log(len(live)) - spread(natural))
        for e in np.linspace(0, 1, 4001):  # the least exponent that meets both
            w = powered(e)
            b = budget or (max(max(least, 1) * live[s] / w[s] for s in live) if least else total)
            if spread(w) <= target and max(b * w[s] / live[s] for s in live) <= 3 + 1e-9:
                best = (w, b)
                break
        w, b = best
        assert {s: x for s, x in out.groupby("source")["weight"].first().items() if s != "empty"} == pytest.approx(w, abs=1e-3)
        assert ("empty" in set(out["source"])) == (least == 1)
        for s in live:
            own = out[out["source"] == s]
            want = float(own["weight"].iloc[0]) * b * (1 if least == 0 else float(own["weight"].iloc[0]) / w[s])
            passes = int(want / live[s] + 1e-6)
            size = own[own["epoch"] == 0].groupby("block")["n_tokens"].sum() if passes else None
            for epoch, g in own.groupby("epoch"):
                order = g.groupby("block")["block_rank"].first().sort_values()
                assert list(order) == list(range(len(order)))  # a prefix of a permutation
                if epoch < passes:
                    assert sorted(g["doc_id"]) == sorted(i for i, _, x in rows if (x or "?") == s)
                elif size is not None:
                    left, at = want - passes * live[s], 0
                    for block in order.index:
                        assert at + size[block] / 2 < left + 1e-3 * live[s]
                        at += size[block]
                    assert at > left - max(size) - 1e-3 * live[s]
            assert own["epoch"].max() in (passes, passes - 1)


def test_shards_are_byte_positions(spark):
    """The shard of a record is where the middle of its bytes falls, in the order of keys."""
    rng = random.Random(2)
    rows = [(rng.choice([None, i]), rng.choice([None, "", "x" * 700, "é" * rng.randrange(400)]), None) for i in range(2000)]
    docs = spark.createDataFrame(rows, DOCS)
    keys = sorted((r.h, r.i, r.text_crc32, r.size) for r in sharding.keys(docs).collect())
    total, at, want = sum(k[3] for k in keys), 0, Counter()
    for _, _, crc, size in keys:
        want[crc, size, min(8, (2 * at + size) * 9 // (2 * total))] += 1
        at += size
    got = sharding.assign_shards(docs, 9).collect()
    assert Counter((r.text_crc32, r.size, r.shard) for r in got) == want
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((i, zlib.crc32((t or "").encode())) for i, t, _ in rows)


def test_shards_written(spark, tmp_path):
    rows = [(i, "x" * (i % 50), "s") for i in range(300)] + [(None, "no id", None)]
    sharding.write_shards(spark.createDataFrame(rows, DOCS), str(tmp_path / "out"), 4)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text, r.source) for r in got.collect()) == Counter(rows) and got.select("shard").distinct().count() == 4
    with pytest.raises(ValueError):
        sharding.write_shards(spark.createDataFrame([(1, "x")], "doc_id long, text string").withColumn("Shard", F.lit(1)), str(tmp_path / "no"))


def test_language_is_naive_bayes(spark):
    rng = random.Random(3)
    syllables = {"en": "the ing on sh", "de": "sch ung ei ch", "fr": "eau ou ç on"}
    rows = [(i, " ".join("".join(rng.choices(syllables[g].split(), k=2)) for _ in range(rng.randrange(1, 6))).capitalize(), g) for i in range(150) for g in [rng.choice(list(syllables))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def bucket(gram):
        h, mask = 0, (1 << 64) - 1
        for n, c in enumerate(gram, 1):
            h = (h * 0x9E3779B97F4A7C15 + ord(c) + n) & mask
        return ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & mask) >> 49

    def grams(t):
        t = t.lower()
        return [bucket(t[i : i + n]) for n in langid.ORDERS for i in range(len(t) - n + 1)]

    seen, counts = Counter(g for _, _, g in rows[:100]), defaultdict(Counter)
    for _, t, g in rows[:100]:
        counts[g].update(grams(t))
    model = langid.train(df.where("doc_id < 100"))
    for r in langid.predict(df.where("doc_id >= 100"), model).collect():
        logs = {g: math.log(seen[g] / 100) + sum(math.log((counts[g][b] + langid.SMOOTH) / (sum(counts[g].values()) + langid.SMOOTH * langid.BUCKETS)) for b in grams(r.text)) for g in seen}
        best = max(sorted(logs), key=logs.get)
        assert r.lang_pred == best and r.score == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs.values()), abs=1e-3)


@pytest.fixture(scope="module")
def prose(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices(["ri", "ver", "sto", "ne", "gre", "en", "hou", "se"], k=rng.randrange(1, 4))) for _ in range(300)]
    return spark.createDataFrame([(i, " ".join(rng.choices(words, k=60))) for i in range(3000)], "doc_id long, text string").cache()


def told(scanner, findings):
    return {r.kind: r.right / r.findings for r in secret_scan.by_kind(scanner.score(findings)).collect()}


def test_planted_secrets_are_told(spark, prose):
    """On other documents, and for each kind with the whole kind left out of training."""
    lang = secret_scan.learn_language(prose)
    findings = secret_scan.planted(prose).cache()
    learn, rest = findings.where("doc_id % 2 = 0"), findings.where("doc_id % 2 = 1")
    right = told(secret_scan.Scanner(lang, learn), rest)
    print(right)
    assert set(right) == {*secret_scan.SECRETS, *secret_scan.LOOK_ALIKES} and np.mean(list(right.values())) > 0.93 and min(right.values()) > 0.6
    for kind in ("base64_key", "prefixed_key", "mail", "phone"):
        alone = told(secret_scan.Scanner(lang, learn.where(F.col("kind") != kind)), rest.where(F.col("kind") == kind))
        print("without", kind, alone)
        assert alone[kind] > 0.6
    texts = {r.doc_id for r in findings.collect()}
    assert len(texts) == findings.count() > 2000


@pytest.mark.parametrize("text", ["xKdjRtUvLmNqPzWsYbHcFgTd is letters", "a -----BEGIN RSA PRIVATE KEY-----\nabc1234567890\n-----END RSA PRIVATE KEY----- b"])
def test_letters_and_blocks_are_candidates(text):
    assert [text[a:b] for a, b in secret_scan.spans(text)] == [text.split(" is")[0] if "is letters" in text else text[2:-2]]


def test_descent_improves_the_graph(spark):
    """From two shallow trees, rounds of NN-descent raise recall; rows that repeat an id have its least vector."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(7, [9.0] * 12)], "vec_id long, embedding array<double>")
    x[7] = min(x[7].tolist(), [9.0] * 12)
    d = ann.distances(x, x)
    np.fill_diagonal(d, np.inf)
    best = np.argsort(d, axis=1)[:, :8]

    def recall(rounds):
        index = ann.Index(df, degree=12, rounds=rounds, trees=2, leaf=64)
        got = {r.id: set(r.nbrs or []) for r in index.nodes.collect()}
        assert len(got) == 2000 and index.rounds == min(rounds, index.rounds)
        return np.mean([len(got[i] & set(best[i].tolist())) / 8 for i in got])

    before, after = recall(0), recall(4)
    print(before, after)
    assert after > 0.85 and after > before + 0.1
