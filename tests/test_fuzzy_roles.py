"""The gram join against the scan of the whole dictionary."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from creditgraph.functions import roles


def scan(names, known):
    """The best role of each name, by every variant against every role."""
    out = {}
    for name in names:
        top = (roles.CUTOFF, None)
        for v in roles.variants(name):
            for r in sorted(known):
                top = max(top, (roles.role_ratio(v, r), r), key=lambda x: x[0])
        if top[1] is not None:
            out[name] = (top[1], round(top[0], 9))
    return out


def test_gram_join_is_the_scan(spark):
    r = random.Random(3)
    words = ["Guitar", "Bass", "Drum", "Drums", "Electric", "Acoustic", "Lead", "Vocals", "Mixed", "By", "Recorded", "Written", "A", "B&B", "é", "Été", "Of", "Twelve-String", "ab", "ba"]
    known = {" ".join(r.choices(words, k=r.randint(1, 4))) for _ in range(150)}

    def typo(s):
        k = r.randrange(len(s) + 1)
        return r.choice([s[:k] + s[k + 1 :], s[:k] + r.choice("abé ") + s[k:], s, " ".join(r.sample(s.split(" "), len(s.split(" ")))), s + " " + r.choice(words), s[:k] + s[k:][:2][::-1] + s[k + 2 :]])

    names = {typo(typo(r.choice(sorted(known)))) for _ in range(250)} | {"x", "", " ", "zz top", "a b c d e f g"}
    got = roles.fuzzy_roles(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(k,) for k in known], "role_name string"))
    want = scan(names, known)
    assert {x.name: (x.role_name, round(x.score, 9)) for x in got.collect()} == want and len(want) > 150
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "PythonUDTF" in plan
    none = roles.fuzzy_roles(spark.createDataFrame([], "name string"), spark.createDataFrame([], "role_name string"))
    assert none.count() == 0


short = st.text(alphabet="abAB é-", min_size=1, max_size=14)


@settings(max_examples=400, deadline=None)
@given(short, short)
def test_what_is_over_the_cutoff_is_a_candidate(a, b):
    """The filters of near_roles(), in Python."""
    if roles.role_ratio(a, b) <= roles.CUTOFF:
        return

    def texts(s):
        w = s.split()
        return [s, " ".join(sorted(w)), " ".join(sorted(set(w)))]

    def grams(s):
        out = {}
        for i in range(len(s) - 1):
            out[s[i : i + 2]] = out.get(s[i : i + 2], 0) + 1
        return out

    by_grams = any(200 * min(len(x), len(y)) > roles.CUTOFF * (len(x) + len(y)) and sum(min(n, grams(y).get(g, 0)) for g, n in grams(x).items()) > 0.35 * (len(x) + len(y)) - 1.001 for x, y in zip(texts(a), texts(b), strict=True) if min(len(x), len(y)) > 1)
    by_words = bool({*a.split()} & {*b.split()}) and max(len(a), len(b)) < 1.5 * min(len(a), len(b))
    assert by_grams or by_words or a == b
