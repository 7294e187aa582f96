"""Line dedup, vector codes and token alignment against plain-Python forms of what they promise."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from creditgraph.llm import alignment, codes, lines

# ---- lines


def plain_lines(docs, least_docs, least_chars):
    def key(line):
        k = line.strip(" \t\n\x0b\f\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)

    named = [((0, i, t or "") if i is None else (1, i, ""), i, t or "") for i, t in docs]
    held, top = defaultdict(set), {}
    for name, i, t in named:
        for k in {key(x) for x in t.split("\n")}:
            held[k].add(name)
            top[k] = max(top.get(k, -(10**9)), -(10**9) if i is None else i)
    out = []
    for _, i, t in named:
        own = t.split("\n")
        stay = [x for x in own if len(key(x)) < least_chars or len(held[key(x)]) < least_docs or (-(10**9) if i is None else i) == top[key(x)]]
        out.append((i, t, len(own), len(own) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


LINE = "The same licence line stands here"
LINES = [
    (1, LINE + "\nown"), (2, "\t" + LINE.upper() + " \r\nmine\n"), (3, f"{LINE}\n{LINE}\nx"), (4, None), (5, ""), (6, "short\nshort"), (7, "short"), (8, "short\n" + "é" * 20), (9, "é" * 20), (10, "É" * 20), (11, "x\n" + "é" * 20),
    (None, LINE), (None, "another text\n" + LINE), (12, "repeated row " + LINE), (12, "repeated row " + LINE), (13, " " * 50_000 + "x\n" * 5_000 + LINE),
]


def test_lines_plain(spark):
    docs = spark.createDataFrame(LINES, "doc_id long, text string")
    got = lines.drop_lines(docs).select("doc_id", "text", "n_lines", "n_dropped", "kept").collect()
    want = plain_lines(LINES, 3, 20)
    assert sorted(((r[0], r[1] or "", *r[2:]) for r in got), key=str) == want
    assert sum(r[3] for r in want) >= 5


def test_lines_of_the_largest_id_stay_and_keys_repeat(spark):
    rows = [(i, f"{LINE}\nown {i}\n{LINE}") for i in range(200)]
    got = {r["doc_id"]: r for r in lines.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[199]["n_dropped"] == 0 and got[199]["kept"].count(LINE) == 2
    assert all(got[i]["n_dropped"] == 2 and got[i]["kept"] == f"own {i}" for i in range(199))


def test_lines_nothing_and_clashes(spark):
    none = lines.drop_lines(spark.createDataFrame([], "doc_id long, text string"))
    assert none.columns == ["doc_id", "text", "n_lines", "n_dropped", "kept"] and none.count() == 0
    odd = spark.createDataFrame([(i, LINE, "a", 5, b"x") for i in range(4)], "doc_id long, text string, kept string, n_lines int, _gone binary")
    got = lines.drop_lines(odd)
    assert got.columns == ["doc_id", "text", "kept", "n_lines", "_gone", "_n_lines", "n_dropped", "_kept"]
    assert sorted((r["doc_id"], r["kept"], r["n_lines"], r["_kept"]) for r in got.collect()) == [(0, "a", 5, ""), (1, "a", 5, ""), (2, "a", 5, ""), (3, "a", 5, LINE)]
    named = spark.createDataFrame([(f"d{i}", LINE) for i in range(3)], "name string, body string")
    assert sum(r["n_dropped"] for r in lines.drop_lines(named, text="body", doc_id="name").collect()) == 2


# ---- vector codes


def plain_codes(rows, parts, entries, rounds, scale=4096):
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ints = [(i, [int(np.floor(scale * np.float64(np.float32(x)))) for x in v]) for i, v in kept]
    w = len(ints[0][1]) // parts
    order = sorted(ints, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * w : (p + 1) * w] for r in order] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = defaultdict(list)
            for _, v in ints:
                x = v[p * w : (p + 1) * w]
                of[nearest(x, books[p])[1]].append(x)
            books[p] = [[sum(c) // len(c) for c in zip(*of[k], strict=True)] if of[k] else e for k, e in enumerate(books[p])]
    out = []
    for i, v in ints:
        best = [nearest(v[p * w : (p + 1) * w], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    return out, books


def vectors(seed, n, wide, spread=3):
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(wide)] for _ in range(spread)]
    return [[c + r.choice([0.0, 0.0, r.uniform(-0.2, 0.2)]) for c in r.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize(("n", "wide", "parts", "entries"), [(300, 16, 8, 16), (9, 8, 4, 16), (120, 6, 2, 3)])
def test_codes_plain(spark, n, wide, parts, entries):
    rows = [(i % (n - 3) if i != 5 else None, v) for i, v in enumerate(vectors(n, n, wide))]
    rows += [(1000, None), (1001, [float("nan")] * wide), (1002, [float("inf")] + [0.0] * (wide - 1)), (1003, [None] + [0.0] * (wide - 1)), (-5, [0.0] * wide), (1004, [0.0] * wide)]
    data = spark.createDataFrame([(i, v, None if k % 7 == 0 else k % 2) for k, (i, v) in enumerate(rows)], "vec_id long, embedding array<float>, label int").repartition(3)
    coded, books = codes.compress(data, parts, entries)
    want, plain = plain_codes(rows, parts, entries, 6)
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in coded.collect()), key=str) == sorted(want, key=str)
    assert books.tolist() == plain
    assert codes.books_digest(books) == hashlib.sha256(",".join(str(c) for b in plain for e in b for c in e).encode()).hexdigest()
    total = defaultdict(int)
    for r in coded.collect():
        total[r["label"]] += r["error"]
    assert all(r["label_error"] == total[r["label"]] for r in codes.with_label_error(coded).collect())
    assert codes.with_label_error(coded).count() == len(want)


def test_codes_of_active_entries_are_those_of_all():
    r = np.random.default_rng(3)
    x = r.integers(-3, 3, (500, 8))  # many ties
    books, code, error, moved = x[:5].reshape(5, 2, 4).transpose(1, 0, 2), None, None, np.ones((2, 5), bool)
    for step in range(8):
        code, error = codes.assign(x, books, moved, code, error)
        whole = codes.assign(x, books, np.ones((2, 5), bool), None, None)
        assert (code == whole[0]).all() and (error == whole[1]).all()
        new = books.copy()
        for p, k in [(0, step % 5), (1, (step * 3) % 5)][: step % 3]:  # sometimes none moves
            new[p, k] = r.integers(-3, 3, 4)
        moved, books = (new != books).any(axis=2), new


def test_codes_of_nothing_and_of_wrong_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    coded, books = codes.compress(spark.createDataFrame([(1, None, 1)], schema))
    assert coded.count() == 0 and books.size == 0 and codes.with_label_error(coded).count() == 0
    with pytest.raises(ValueError, match="multiple of 8"):
        codes.compress(spark.createDataFrame([(1, [1.0] * 7, 1)], schema))
    with pytest.raises(ValueError, match="dimensions 8 to 16"):
        codes.compress(spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], schema))
    with pytest.raises(Exception, match="must be within"):
        codes.compress(spark.createDataFrame([(1, [1e30] * 8, 1)], schema))


# ---- alignment


@pytest.fixture(scope="module")
def both():
    return alignment.Tokenizers(*alignment.public_tokenizers())


def plain_alignment(t, docs):
    found = []
    for i, text in docs:
        data = b" " + (text or "").encode()
        a = t.a_ids(" " + (text or "")) if text else []
        b = t.b.encode(text) if text else []
        if b"".join(t.a_bytes[x] for x in a) != data or b"".join(t.b_bytes[x] for x in b) != data:
            a = b = []
        ends = [[sum(len(table[x]) for x in ids[: k + 1]) for k in range(len(ids))] if len(ids) < 2000 else np.cumsum([len(table[x]) for x in ids]).tolist() for ids, table in ((a, t.a_bytes), (b, t.b_bytes))]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, p, q = [], 0, 0
        for c in common:
            r, s = ends[0].index(c, p) + 1, ends[1].index(c, q) + 1
            groups.append((a[p:r], b[q:s]))
            p, q = r, s
        found.append((i, a, b, groups))
    counts = Counter(k for _, _, _, groups in found for k in {(x, y) for g, h in groups for x in g for y in h})
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for i, a, b, groups in found:
        links = [(x, y) for g, h in groups for x in g for y in h]
        spelled = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[k] == best[k[0]] for k in links), sum(counts[k] for k in links), hashlib.sha256(spelled.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def texts():
    r = random.Random(11)
    words = ["hello", "wörld", "it's", "naïve", "1234567", "0xdeadbeef", "日本語テキスト", "don't.", "a_b", "x=1;", "…", "🙂🙂", "Straße", "<|endoftext|>", "</s>", "<0x41>", "tab\there", "line\nbreak", "cr\r\nlf", "nb sp", "　wide", "\x1c"]
    made = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(40)]
    made += [None, "", " ", "   ", "\n", " lead", "trail ", "two  spaces", "tab \t mix", "a \n b", "with ▁ mark", "▁", "x" * 3000, "日本" * 500, "ab" * 40 + " " + "%%" * 300, "é \x00 ﻿", made[0], made[0]]
    return [(k if k % 9 else None, t) for k, t in enumerate(made)]


@pytest.mark.parametrize("wide", [alignment.RANGE, 40, 7])
def test_alignment_plain(spark, both, wide):
    docs = texts()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows_of(alignment.align(df, *alignment.public_tokenizers(), wide=wide)) == plain_alignment(both, docs)


def test_alignment_of_long_texts_and_names(spark, both):
    r = random.Random(5)
    long = "".join(r.choice("abcdefgh01234567/+") for _ in range(30_000))
    docs = [(1, long), (2, "word " * 30_000 + long[:50]), (3, long[:9000] + "\n" + "ſ" * 2000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "name long, body string, n_a int")
    assert rows_of(alignment.align(df, *alignment.public_tokenizers(), text="body", doc_id="name", wide=1000)) == plain_alignment(both, docs)
    assert rows_of(alignment.align(spark.createDataFrame([], "doc_id string, text string"), *alignment.public_tokenizers())) == []


def test_ranks_stand_for_merges(both):
    """The faster library is taken only where it gives the same."""
    a, b = alignment.public_tokenizers()
    fast = alignment.Tokenizers(a, b, alignment.as_ranks(a))
    r = random.Random(2)
    words = ["".join(chr(r.choice([r.randint(32, 126), r.randint(160, 1200), r.randint(0x4E00, 0x4F00)])) for _ in range(r.randint(1, 12))) for _ in range(20_000)]
    for text in [t for _, t in texts() if t] + [" ".join(words)]:
        assert fast.a_ids(" " + text) == both.a_ids(" " + text)
    assert fast.a_bytes[:50256] == both.a_bytes[:50256]
    other = json.loads(a)
    other["model"]["merges"][0], other["model"]["merges"][1] = other["model"]["merges"][1], other["model"]["merges"][0]
    assert alignment.as_ranks(json.dumps(other)) is None
    other = json.loads(a)
    other["pre_tokenizer"]["add_prefix_space"] = True
    assert alignment.as_ranks(json.dumps(other)) is None


def test_large_groups_pair_distinct_ids():
    a, b = np.arange(100) % 5, np.arange(200) % 3
    _, keys, times = alignment.pairs_of(a, b, np.array([0, 100]), np.array([0, 200]))
    assert len(keys) == 15 and times.sum() == 100 * 200 > alignment.LARGE


def same(x, y):
    return all(np.array_equal(getattr(x, c), getattr(y, c)) for c in ("cut", "pa", "pb", "sa", "sb", "n_a", "n_b", "n_groups", "n_links", "spelled", "keys", "times"))


tokens = st.lists(st.integers(1, 4), min_size=1, max_size=30)


@settings(max_examples=150, deadline=None)
@given(tokens, tokens, st.lists(st.integers(1, 80), max_size=6), st.integers(0, 6), st.integers(0, 6))
def test_fragments_are_a_monoid(sizes_a, sizes_b, cuts, i, j):
    """However byte ranges are cut and composed, the fragment is that of the whole."""
    a_end, b_end = np.cumsum(sizes_a), np.cumsum(sizes_b)
    a, b = np.arange(len(a_end)), np.arange(len(b_end)) % 7
    bounds = [0, *sorted(set(cuts)), 10_000]
    parts = []
    for lo, hi in zip(bounds, bounds[1:]):
        x, y = (a_end > lo) & (a_end <= hi), (b_end > lo) & (b_end <= hi)
        parts.append(alignment.fragment(a[x], b[y], a_end[x], b_end[y]))
    whole = alignment.fragment(a, b, a_end, b_end)
    i, j = sorted((min(i, len(parts)), min(j, len(parts))))
    tree = alignment.compose([alignment.compose(parts[:i]), alignment.compose(parts[i:j]), alignment.Fragment(), alignment.compose(parts[j:])])
    assert same(alignment.compose(parts), whole) and same(tree, whole)
