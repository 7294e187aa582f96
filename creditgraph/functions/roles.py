"""Role texts: parse, normalise, match. Everything runs on distinct strings; credits meet the result by join."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .role_grammar import role_names
from .role_rules import ALTERNATIVES, CUTOFF, INSTRUMENT_CLASSES, OTHER_INSTRUMENTS

def variants(name: str) -> list[str]:
    """A name and its shortened forms, breadth first: without one word of fewer than five, else its halves."""
    seen, todo = [], [name]
    while todo:
        n = todo.pop(0)
        if n in seen or not n:
            continue
        seen.append(n)
        words = n.split(" ")
        if 1 < len(words) < 5:
            todo += [" ".join(words[:i] + words[i + 1 :]) for i in range(len(words))]
        elif len(words) >= 5:
            half = len(words) // 2
            todo += [" ".join(words[:half]), " ".join(words[half:])]
    return seen


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    for c in b:
        x = row & at.get(c, 0)
        row = (row + x) | (row - x)
    return bin(~row & ((1 << len(a)) - 1)).count("1")


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def role_ratio(a: str, b: str) -> float:
    """The best of the plain ratio and 0.95 times those of sorted words and of common words; other measures stay under the cutoff."""
    best = ratio(a, b)
    if best == 100.0:
        return best
    if min(len(a), len(b)) and max(len(a), len(b)) / min(len(a), len(b)) < 1.5:
        x, y = a.split(), b.split()
        both = " ".join(sorted(set(x) & set(y)))
        ra, rb = (" ".join(z for z in [both, " ".join(sorted(set(p) - set(q)))] if z) for p, q in ((x, y), (y, x)))
        sets = max(ratio(ra, rb), ratio(both, ra) if both else 0, ratio(both, rb) if both else 0)
        best = max(best, 0.95 * ratio(" ".join(sorted(x)), " ".join(sorted(y))), 0.95 * sets)
    return best


def read_role_texts(credits: DataFrame, column: str = "raw") -> DataFrame:
    """(raw, pos, name): the normalised names in each distinct raw text, which may list several roles with details in brackets."""
    return credits.select(F.col(column).alias("raw")).where("raw is not null").distinct().select("raw", F.posexplode(role_names(F.col("raw"))).alias("pos", "name"))


MOST_ROLES = 50_000  # a dictionary of roles that is broadcast; a larger one is joined as Spark sees fit


@F.udtf(returnType=T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("variant", T.StringType())]), useArrow=False)
class RoleVariants:
    """variants(name), numbered."""

    def eval(self, name: str):
        yield from enumerate(variants(name))


def forms(name: Column) -> Column:
    """array<struct<form, text>>: a name as it is, with its words in order, and with its different words in order."""
    words = F.filter(F.split(name, r"(?U)\s+"), lambda w: w != "")
    texts = [name, F.array_join(F.array_sort(words), " "), F.array_join(F.array_sort(F.array_distinct(words)), " ")]
    return F.array(*(F.struct(F.lit(k).alias("form"), t.alias("text")) for k, t in enumerate(texts)))


def gram_rows(names: DataFrame, column: str) -> DataFrame:
    """(column, form, size, gram, time): the pairs of neighbouring characters of each form of names; time numbers those that repeat."""
    each = names.select(column, F.explode(forms(F.col(column))).alias("f")).select(column, "f.form", "f.text", F.length("f.text").alias("size")).where("size > 1")
    grams = each.select(column, "form", "size", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda i: F.substring(F.col("text"), i, F.lit(2)))).alias("gram"))
    counted = grams.groupBy(column, "form", "size", "gram").agg(F.count("*").alias("times"))
    return counted.select(column, "form", "size", "gram", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("time"))


def near_roles(asked: DataFrame, role: DataFrame) -> DataFrame:
    """(variant, role_name): the pairs of asked (variant) and role (role_name) whose role_ratio() can be over CUTOFF.

    A ratio over CUTOFF leaves more than 0.35 x (both lengths) - 1 pairs of characters in common, each deletion taking away two and each insertion
    one, in one of the three forms that the measure compares; or else the names share a whole word, and their lengths are within 1.5 of each other.
    """
    few = role.limit(MOST_ROLES + 1).count() <= MOST_ROLES
    index = gram_rows(role, "role_name").withColumnRenamed("size", "other")
    met = gram_rows(asked, "variant").join(F.broadcast(index) if few else index, ["form", "gram", "time"])
    both = F.col("size") + F.col("other")
    alike = 200.0 * F.least("size", "other") > CUTOFF * both
    by_grams = met.where(alike).groupBy("variant", "role_name", "form", "size", "other").agg(F.count("*").alias("n")).where(F.col("n") > 0.35 * both - 1.001).select("variant", "role_name")

    def words(df: DataFrame, column: str) -> DataFrame:
        return df.select(column, F.explode(F.array_distinct(F.filter(F.split(column, r"(?U)\s+"), lambda w: w != ""))).alias("word"))

    of = words(role, "role_name")
    shared = words(asked, "variant").join(F.broadcast(of) if few else of, "word").select("variant", "role_name").distinct()
    size, other = F.length("variant"), F.length("role_name")
    by_words = shared.where((F.greatest(size, other) < 1.5 * F.least(size, other)) & (F.greatest(size, other) > 0))
    return by_grams.unionByName(by_words).distinct()


@F.pandas_udf(T.DoubleType())
def role_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([role_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def fuzzy_roles(names: DataFrame, role: DataFrame) -> DataFrame:
    """(name, role_name, score): the best role of each distinct name (name) and its variants over CUTOFF, the first variant with the best score, of several roles the smallest."""
    asked = names.lateralJoin(RoleVariants(F.col("name").outer())).select("name", "pos", "variant")
    pairs = near_roles(asked.select("variant").distinct(), role.select("role_name").distinct())
    pairs = pairs.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), "variant", "role_name")  # few bytes, but much to compute
    measured = role_score.asNondeterministic()  # or a filter on it would be moved below the joins, and measure every common pair of characters
    near = pairs.withColumn("score", measured("variant", "role_name")).where(F.col("score") > CUTOFF)
    best = asked.join(near, "variant").groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("low"), "pos", "role_name")).alias("x"))
    return best.select("name", "x.role_name", (-F.col("x.low")).alias("score"))


def resolve_roles(credits: DataFrame, role: DataFrame, column: str = "raw") -> DataFrame:
    """(raw, pos, role_name, score) for distinct raw role texts of credits; pos is where a text names the role first.

    Each name is looked up exactly, in any case, as an alternative spelling, then as fuzzy_roles() does.
    """
    found = read_role_texts(credits, column)
    names = found.select("name").distinct()
    exact = role.select(F.col("role_name").alias("name"), "role_name")
    lower = role.groupBy(F.lower("role_name").alias("low")).agg(F.min("role_name").alias("of_lower"))
    spelled = F.create_map(*(F.lit(x) for kv in ALTERNATIVES.items() for x in kv))
    step = names.join(exact, "name", "left").withColumn("low", F.lower("name")).join(lower, "low", "left")
    step = step.withColumn("hit", F.coalesce("role_name", "of_lower", F.try_element_at(spelled, F.col("low"))))
    sure = step.where("hit is not null").select("name", F.col("hit").alias("role_name"), F.lit(100.0).alias("score"))
    near = fuzzy_roles(step.where("hit is null").select("name"), role)
    return found.join(sure.unionByName(near), "name").groupBy("raw", "role_name").agg(F.min("pos").alias("pos"), F.max("score").alias("score")).select("raw", "pos", "role_name", "score")


def instrument_subcategory(kind):
    pairs = F.create_map(*(F.lit(x) for kv in INSTRUMENT_CLASSES.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, F.lower(kind)), F.lit(OTHER_INSTRUMENTS))
