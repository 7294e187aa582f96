import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from creditgraph.llm import ann, bpe, chat, common, dedup, langid, mixing, secret_scan, setjoin, sharding, token_counts

DOCS = "doc_id long, text string, lang string, source string"


def documents(spark, rows):
    return spark.createDataFrame(rows, DOCS)


ODD = [(1, None, None, None), (2, "", "en", "a"), (3, "same text here", "en", "a"), (4, "same text here", None, "b"), (4, "same text here", None, "b"), (None, "no id", "fr", None), (5, "word " * 30_000, "en", "a"), (6, "!!! 123", "en", "a")]


def empty(spark):
    return documents(spark, [])


@pytest.fixture
def fixed_partitions(spark):
    """Sets the number of shuffle partitions, and holds Spark to it."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    for k, v in old.items():
        spark.conf.set(k, v)


# dedup


def test_dedup_marks(spark):
    docs = documents(spark, ODD)
    index = dedup.DigestIndex.open(spark)
    index.add(docs)
    got = index.annotate(docs).collect()
    by = defaultdict(list)
    for i, t, _, _ in ODD:
        by[t or ""].append(i)
    for r in got:
        ids = by[r.text or ""]
        best = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (best, len(ids), r.doc_id == best)
        assert bytes(r.digest) == hashlib.sha256((r.text or "").encode()).digest()


def test_dedup_drops_and_grows(spark):
    docs = documents(spark, ODD).withColumn("KEPT", F.lit(1)).withColumn("digest", F.lit(2))
    left = dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert Counter(r.text or "" for r in left.collect()) == Counter({t or "": 1 for _, t, _, _ in ODD})
    index = dedup.DigestIndex.open(spark)
    assert dedup.drop_copies(documents(spark, [(1, "x", None, None)]), index=index).count() == 1
    assert [r.text for r in dedup.drop_copies(documents(spark, [(2, "x", None, None), (3, "y", None, None)]), index=index).collect()] == ["y"]
    assert dedup.drop_copies(empty(spark)).count() == 0


def test_index_opens_again(spark, tmp_path, fixed_partitions):
    docs = documents(spark, [(i, f"text {i}", None, None) for i in range(100)])
    path = str(tmp_path / "index")
    assert dedup.drop_copies(docs, index=dedup.DigestIndex.open(spark, path, 8)).count() == 100
    fixed_partitions(4)
    for session in (spark, spark.newSession()):
        index = dedup.DigestIndex.open(session, path)
        assert index.buckets == 8
        assert dedup.drop_copies(session.createDataFrame(docs.collect(), DOCS), index=index).count() == 0 and index.table().count() == 100
        index.close()
    with pytest.raises(ValueError):
        dedup.DigestIndex.open(spark, path, 4)
    (tmp_path / "other").mkdir()
    with pytest.raises(ValueError):
        dedup.DigestIndex.open(spark, str(tmp_path / "other"))


def test_index_compacts(spark):
    index = dedup.DigestIndex.open(spark, buckets=2)
    for k in range(3):
        index.add(documents(spark, [(i, f"text {i}", None, None) for i in range(10 * k, 10 * k + 20)]))
    small = index.compact()
    assert sorted(map(tuple, small.table().collect())) == sorted(map(tuple, index.table().collect())) and len(small.table().inputFiles()) == 2
    assert dedup.drop_copies(documents(spark, [(1, "text 5", None, None), (2, "new", None, None)]), index=small).count() == 1


def test_hot_digest_is_combined_before_it_moves(spark, fixed_partitions):
    """The plan of grouped() aggregates by digest and id, then by digest, each time before its exchange."""
    fixed_partitions(4)
    plan = dedup.grouped(documents(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    steps = [line.split("(")[0].strip(" +-:*0123456789()") if "Exchange" in line else "Aggregate" for line in plan.splitlines() if "Exchange" in line or "Aggregate" in line]
    assert steps == ["Aggregate", "Exchange hashpartitioning", "Aggregate", "Aggregate", "Exchange hashpartitioning", "Aggregate"]


# sharding


def test_shards(spark):
    rng = random.Random(1)
    rows = [(i, "x" * 500 if i % 3 == 0 else "y" * rng.randrange(300) + str(i % 50), None, None) for i in range(3000)]
    rows += ODD
    got = sharding.assign_shards(documents(spark, rows), 7).collect()
    assert len(got) == len(rows)
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    most = max(r.size for r in got)
    assert all(abs(size[s] - sum(size.values()) / 7) <= most for s in range(7))
    assert sharding.assign_shards(empty(spark), 7).count() == 0


def test_splitters_ties():
    s = sharding.Splitters(np.array([1, 5, 5, 9]), np.array([0, 3, 7, 0]))
    assert list(s.find(np.array([0, 1, 5, 5, 5, 9, 10]), np.array([0, 0, 1, 3, 9, 0, 0]))) == [0, 1, 1, 2, 3, 4, 4]


# mixing


def test_fit():
    m = mixing.fit({"a": 900, "b": 90, "c": 10, "z": 0}, budget=1000, target_entropy=0.7)
    w = np.array([m.weights[x] for x in "abc"])
    assert abs(mixing.entropy(w) - 0.7) < 1e-6 and abs(w.sum() - 1) < 1e-9 and m.weights["z"] == 0
    assert np.allclose(np.log(w[0] / w[1]), m.exponent * np.log(10))
    m = mixing.fit({"a": 900, "b": 90, "c": 10}, budget=1000, max_repeats=3)
    assert max(m.budgets[k] / n for k, n in (("a", 900), ("b", 90), ("c", 10))) == pytest.approx(3, rel=1e-6)


def test_mix_budgets(spark):
    rows = [(i, "w " * (1 + i % 7), None, None if i % 10 == 9 else "big" if i % 10 < 7 else "small") for i in range(4000)]
    docs = documents(spark, rows).withColumn("at", F.lit(0))
    out = mixing.mix(docs, entropy_gain=0.5, max_repeats=4).toPandas()
    tokens = Counter()
    for _, t, _, s in rows:
        tokens[s] += len(t.split())
    total = sum(tokens.values())
    for s, w in out.groupby(out["source"].fillna("\0"))["weight"].first().items():
        own = out[out["source"].fillna("\0") == s]
        assert abs(own["n_tokens"].sum() - w * total) < 0.02 * total
    assert out["_at"].between(0, 1).all()
    half = out[out["_at"] < 0.5].groupby(out["source"].fillna("\0"))["n_tokens"].sum()
    assert np.allclose(half / half.sum(), out.groupby(out["source"].fillna("\0"))["weight"].first(), atol=0.03)
    every = mixing.mix(docs, min_passes=1, max_repeats=2)
    assert set(every.toPandas()["doc_id"]) == {r[0] for r in rows}
    assert mixing.mix(documents(spark, ODD), min_passes=1, max_repeats=2).select("doc_id").distinct().count() == 7
    assert mixing.mix(empty(spark), entropy_gain=0.5).count() == 0


# nearest neighbours


def test_ann(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] * 16), (9005, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    index = ann.Index(df, leaf=128, trees=4, degree=12, rounds=2)
    got = index.search(index.own_queries(F.col("vec_id") % 50 == 0)).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(3000), d))[:10]
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 11)) and np.allclose(g["score"], d[g["vec_id"]], rtol=1e-12)
        assert list(zip(g["score"], g["vec_id"], strict=True)) == sorted(zip(g["score"], g["vec_id"], strict=True))
        hit += len(set(best) & set(g["vec_id"]))
    assert hit >= 0.9 * len(got) and got["query_id"].nunique() == 60
    few = ann.Index(df.where("vec_id in (1, 2, 9001)"))
    assert few.search(few.own_queries(F.lit(True))).count() == 2
    none = ann.Index(df.where("false"))
    assert none.search(none.own_queries(F.lit(True))).count() == 0


# set join


def brute_join(rows, num, den, k):
    s = {}
    for i, t in rows:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        s[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in s}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and den * len(s[a] & s[b]) >= num * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in s}


@pytest.mark.parametrize(("num", "k", "light"), [(90, 3, 16), (80, 5, 1), (50, 2, 3), (90, 3, 1)])
def test_join_sets(spark, fixed_partitions, num, k, light):
    """Families of near copies, some short of links with their least one, that share passages; with short lists and with long ones, cut over tasks."""
    rng = random.Random(num + light)
    words = [f"w{i}" for i in range(500)]
    passage = [rng.choice(words) for _ in range(30)]
    texts = ["", None, "a", "A", "A b", "a b", "x y z", "X  Y\tz", " \n", "É x y", "é x y"]
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([12, 40, 90, 250]))] + passage * (rng.random() < 0.5)
        for _ in range(40):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    fixed_partitions(rng.choice([2, 5]))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.join_sets(df, num, 100, k, light=light).collect()}
    assert got == brute_join(rows, num, 100, k)


def test_join_sets_odd(spark):
    got = setjoin.join_sets(documents(spark, ODD), 90, 100, 3).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 3), (4, 3), (5, 5), (6, 6)]
    assert setjoin.join_sets(empty(spark)).count() == 0


def test_join_sets_many_copies(spark, fixed_partitions):
    rng = random.Random(10)
    base = [f"w{i}" for i in range(60)]
    near = list(base)
    near[rng.randrange(60)] = "x"
    rows = list(enumerate([" ".join(base)] * 300 + [" ".join(near)]))
    fixed_partitions(32)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.join_sets(spark.createDataFrame(rows, "doc_id long, text string"), 90, 100, 3).collect()}
    assert got == brute_join(rows, 90, 100, 3)


@pytest.mark.parametrize("n", [2, 3])
def test_cut_list_is_settled(spark, fixed_partitions, n):
    """Of a chain 1-2-4-3 in one list, 2 and 4 are in different tasks and not linked with the leader."""
    rows = [(i, " ".join(f"w{j}" for j in range(at, at + 20))) for i, at in ((1, 0), (2, 2), (3, 6), (4, 4))]
    fixed_partitions(n)
    got = setjoin.join_sets(spark.createDataFrame(rows, "doc_id long, text string"), 80, 100, 1, light=1).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, 1) for i in range(1, 5)}


@pytest.mark.parametrize("few", [0, 30, 5000])
def test_components(spark, monkeypatch, few):
    """A long path, a star and a pair, by rounds, by both, and in one task."""
    monkeypatch.setattr(setjoin, "FEW", few)
    pairs = [(i + 1, i) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 20)] + [(301, 300)]
    with common.Scratch(spark) as s:
        got = {r.id: r.component for r in setjoin.components(spark.createDataFrame(pairs, "a long, b long"), s).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{100 + i: 100 for i in range(20)}, 300: 300, 301: 300}


def test_rank_counts_all(spark):
    """Counters of all tasks are added up."""
    df = spark.range(0, 64, 1, 4).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    rank = setjoin.ranks(setjoin.described(df, 3))
    assert rank.sum() == rank.max() == int(np.ceil(np.log(65) / np.log(setjoin.GRADE)))


def test_counts_bound_what_sets_differ_in():
    rng = np.random.default_rng(3)
    for n, m in ((0, 5), (30, 30), (400, 380), (400, 4000), (9000, 9000)):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([x[: n // 2], rng.integers(0, 1 << 63, m).astype(np.uint64)]))
        apart = len(np.setxor1d(x, y))
        assert setjoin.apart_at_least(setjoin.counted(x), setjoin.counted(x)) == 0 <= setjoin.apart_at_least(setjoin.counted(x), setjoin.counted(y)) <= apart
    assert setjoin.apart_at_least(setjoin.counted(np.arange(1000, dtype=np.uint64)), setjoin.counted(x)) == 0


def test_short_sets_in_bounded_blocks(spark):
    """10,000 short near copies: no block has more than ROWS sets."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(10)]
    rows = [(i, " ".join(base[:j] + [f"x{rng.randrange(4000)}"] + base[j + 1 :])) for i in range(10_000) for j in [rng.randrange(10)]]
    got = {r.doc_id: r.component_id for r in setjoin.join_sets(spark.createDataFrame(rows, "doc_id long, text string"), 90, 100, 1).collect()}
    same = {}
    for i, t in rows:
        same.setdefault(frozenset(t.split()), i)
    assert got == {i: same[frozenset(t.split())] for i, t in rows}


def test_open_blocks():
    rng = np.random.default_rng(2)
    x = [np.unique(rng.integers(0, 300, 60)) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in x] for a in x]
    assert setjoin.common(x, x, width=64).tolist() == want


# language


def test_language(spark):
    rng = random.Random(3)
    syllables = {"en": ["the", "ing", "on"], "de": ["sch", "ung", "ei"], "fr": ["eau", "ou", "ç"]}
    rows = [(i, " ".join("".join(rng.choices(syllables[g], k=3)) for _ in range(20)), g, None) for i in range(300) for g in [rng.choice(list(syllables))]]
    model = langid.train(documents(spark, rows[:200]))
    out = langid.predict(documents(spark, rows[200:] + ODD).withColumn("score", F.lit(1)), model).toPandas()
    held = out.iloc[:100]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.98 and out["_score"].between(0, 1).all()
    assert list(out.iloc[100:]["lang_pred"] == "und") == [t is None or not any(c.isalpha() for c in t) for _, t, _, _ in ODD]
    assert langid.train(empty(spark)) is None
    assert {r.lang_pred for r in langid.predict(documents(spark, ODD), None).collect()} == {"und"}
    assert langid.predict(empty(spark), model).count() == 0


def test_slices_change_nothing(monkeypatch):
    texts = ["abc déf ghi", "", "x", "zzzz" * 50]
    whole = Counter((int(a), int(b)) for o, h in langid.grams(texts) for a, b in zip(o, h, strict=True))
    monkeypatch.setattr(langid, "SLICE", 7)
    assert Counter((int(a), int(b)) for o, h in langid.grams(texts) for a, b in zip(o, h, strict=True)) == whole


# secrets


def test_secrets(spark):
    rng = random.Random(4)
    words = ["stone", "river", "green", "house", "under", "light"]
    hexes = "0123456789abcdef"
    rows, truth = [], set()
    for i in range(400):
        kind = i % 4
        secret = "".join(rng.choices(hexes, k=20))
        inside = {0: f"password={secret}", 1: f'token = "{secret}"', 2: f"1{rng.randrange(10**9)}234", 3: f"ann.{i}@mail{i}.example.com"}[kind]
        rows.append((i, " ".join(rng.choices(words, k=12)) + f" {inside} " + " ".join(rng.choices(words, k=5)), None, None))
        if kind < 2:
            truth.add(i)
    docs = documents(spark, rows)
    found = secret_scan.candidates(docs)
    labelled = found.withColumn("label", (F.col("doc_id") % 4 < 2).cast("int"))
    lang = secret_scan.learn_language(docs)
    assert "stone" in lang.words and lang.covered("stoneriver") == 1 and lang.covered("zz9") == 0
    scanner = secret_scan.Scanner(lang, labelled.where("doc_id < 200"))
    out = scanner.score(found.where("doc_id >= 200")).toPandas()
    assert {int(d) for d in out[out["is_secret"]]["doc_id"]} == {d for d in truth if d >= 200}
    assert all(rows[int(r.doc_id)][1][r.start : r.end] == r.candidate for r in out.itertuples())
    none = secret_scan.Scanner(lang, labelled.where("false"))
    assert none.score(found).where("is_secret").count() == found.count()
    assert secret_scan.candidates(documents(spark, ODD)).count() == 0 and secret_scan.candidates(empty(spark)).count() == 0


# tokens


@pytest.fixture(scope="module")
def vocabulary():
    ranks, pattern = bpe.public_vocabulary()
    return ranks, pattern, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_exact(spark, vocabulary):
    ranks, pattern, enc = vocabulary
    rng = random.Random(6)
    parts = ["a", "b", "'s", "'", " ", "  ", "\n", "\t", "\x1c", "\xa0", "é", "1", "!", "日", "😀", "\r\n", "th", "ing", "̀", "Hello", " world", ".", ","]
    texts = ["", None, "a" * 3000, " ", "x \x85 y"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = bpe.encode(df.withColumn("_rare", F.lit(1)), ranks, pattern).withColumn("bytes", bpe.decoded(F.col("ids"), ranks)).collect()
    for r in out:
        assert list(r.ids) == enc.encode_ordinary(r.text or "") and bytes(r.bytes) == (r.text or "").encode()
    assert bpe.op_digests(empty(spark), ranks, pattern).count() == 0


def test_rare_words_merge_alike(vocabulary):
    ranks, _, enc = vocabulary
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeéß日thing") for _ in range(rng.randrange(1, 90))).encode() for _ in range(300)] + [bytes([i]) for i in range(256)]
    short = [w if len(w) <= bpe.LONGEST else b"" for w in words]
    for w, made in zip(words, bpe.fold_words(short, bpe.Pairs(ranks)), strict=True):
        want = enc._encode_single_piece(w)
        assert np.frombuffer(bpe.fold_long_word(w, ranks), dtype=np.int32).tolist() == want
        assert np.frombuffer(made, dtype=np.int32).tolist() == (want if len(w) <= bpe.LONGEST else [])


def test_rare_and_frequent_words_alike(spark, vocabulary, monkeypatch):
    """The same ids with hardly any word in the dictionary, a small cache and small pieces."""
    ranks, pattern, enc = vocabulary
    for name, n in (("MOST_WORDS", 3), ("CACHED", 5), ("PIECE", 50)):
        monkeypatch.setattr(bpe, name, n)
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["stone", "river", "x1!", "don't", "(a)", "b\nc", "日本", "y" * 80]) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    assert len(bpe.dictionary(spark.createDataFrame([(t,) for t in texts], "text string"), ranks, pattern, 3)) == 3
    d = bpe.Dictionary({}, ranks, bpe.Pairs(ranks), pattern)
    ids, sizes = d.ids(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [enc.encode_ordinary(t) for t in texts]
    out = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ranks, pattern)
    assert all(list(r.ids) == enc.encode_ordinary(r.text) for r in out.collect())


@pytest.mark.parametrize("most", [0, 1, 4, 5, 6, 7, 100, 5000])
def test_top_words(spark, most):
    """Ties at the top and at the cut: always as many words as asked for, and none before one with a clearly lower count."""
    rows = [(f"top{i}", 1_000_000) for i in range(6)] + [(f"w{i}", 1 + i % 9) for i in range(300)]
    got = {r.word: r.n for r in common.top_words(spark.createDataFrame(rows, "word string, n long"), most).collect()}
    assert len(got) == min(most, len(rows)) and sorted(got.values(), reverse=True) == sorted((n for _, n in rows), reverse=True)[:most]
    assert got.items() <= dict(rows).items()


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, vocabulary, rule):
    _, pattern, enc = vocabulary
    texts = ["one\ntwo lines\n\n  three", "", None, "日本語 😀\nテスト", "no end\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    content = token_counts.read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    got = defaultdict(list)
    for r in token_counts.count_sections(df, content, pattern, rule).orderBy("doc_id", "section").collect():
        got[r.doc_id].append((r.start, r.end, r.n_tokens))
    for i, t in enumerate(texts):
        t = t or ""
        lines = t.splitlines(keepends=True) or [""]
        assert [t[a:b] for a, b, _ in got[i]] == lines
        want, data, at = Counter(), t.encode(), 0
        section = [k for k, line in enumerate(lines) for _ in line]
        for tok in enc.encode_ordinary(t):
            n = len(enc.decode_single_token_bytes(tok))
            a, b = len(data[:at].decode(errors="ignore")), len(data[: at + n].decode(errors="ignore"))
            b = max(b, a + 1)
            own = section[a:b]
            at += n
            if rule == "split":
                for s in own:
                    want[s] += 1 / len(own)
            else:
                want[own[0] if rule == "first" else own[-1] if rule == "last" else max(own, key=lambda s: (own.count(s), -own.index(s)))] += 1
        assert np.allclose([n for _, _, n in got[i]], [want[k] for k in range(len(lines))]), (rule, t)


def test_given_sections(spark, vocabulary):
    """Unsorted, overlapping, null and too long sections; the counts add up to the document's tokens."""
    _, pattern, enc = vocabulary
    content = token_counts.read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    text = "alpha beta gamma delta epsilon"
    cases = {
        1: ([(11, 16), (0, 5)], None), 2: ([(0, 16), (6, 22)], [(0, 16), (16, 22)]), 3: ([None, (None, 4), (5, 2), (23, 99)], [(0, 0), (0, 0), (0, 0), (23, 30)]), 4: (None, []), 5: ([(0, 30), (0, 30)], [(0, 30), (0, 0)]),
    }
    df = spark.createDataFrame([(i, text, given) for i, (given, _) in cases.items()], "doc_id long, text string, spans array<struct<start: int, end: int>>")
    got = defaultdict(dict)
    for r in token_counts.count_sections(df, content, pattern, "first", sections=F.col("spans")).collect():
        got[r.doc_id][r.section] = r.n_tokens
    starts, at = [], 0
    for tok in enc.encode_ordinary(text):
        starts.append(at)
        at += len(enc.decode([tok]))
    for i, (given, plain) in cases.items():
        want = [sum(a <= s < b for s in starts) for a, b in (given if plain is None else plain)]
        assert [got[i][k] for k in range(len(want))] == want and sum(got[i].values()) == len(starts)


def test_field_counts(spark, vocabulary):
    _, pattern, enc = vocabulary
    content = token_counts.read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    df = spark.createDataFrame([(1, "A title", "A body"), (2, None, "x")], "doc_id long, title string, body string")
    sums = {r.doc_id: r.n for r in token_counts.count_fields(df, ["title", "body"], content, pattern, "first").groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert sums == {1: len(enc.encode_ordinary("A title\n\nA body")), 2: len(enc.encode_ordinary("\n\nx"))}


# chats


def test_template_reads_back():
    rng = random.Random(8)
    parts = ["a", " ", "\\", "<", "[", "/INST]", "[INST] ", "</s>", "<s>", "|>", "\\|>", "<|end|>", "\n", "é", "<<SYS>>\n", "AB"]
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "a\\", "", "x\\|>"]), "".join(rng.choice(parts) for _ in range(rng.randrange(8)))) for _ in range(rng.randrange(6))]
        out, spans, rewrites, _ = chat.locate(turns)
        assert chat.read_back(out) == turns and not rewrites
        assert [chat.unescape(out[s["text_start"] : s["text_end"]]) for s in spans] == [t for _, t in turns]


def test_rewriting_template_is_found():
    def last_marked(turns):
        return "".join(f"{r}:{x}\n" for r, x in turns[:-1]) + "".join(f"<last>{x}</last>" for _, x in turns[-1:])

    out, spans, rewrites, at = chat.locate([("user", "hi"), ("assistant", "there"), ("user", "bye")], last_marked)
    assert rewrites and at == 1 and [out[s["text_start"] : s["text_end"]] for s in spans] == ["hi", "there", "bye"]


def test_chat_odd_rows(spark):
    rows = [(1, None, "user", None), (1, 0, None, "x"), (1, 0, "assistant", "y"), (None, 1, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(b"user\n\n\nx\nassistant\ny\n").hexdigest() and got[1].loss_chars == 1
    assert got[None].n_turns == 1
    assert chat.format_chats(df.where("false")).count() == 0
