"""Name search: tokens, postings, relational division, ranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import LABEL_OFFSET, entity_key
from ..functions.text import search_normalise, tokenise, without_stop_words
from .stores import Store, matched

# What real names are cut at.
NAME_SEPARATORS = ",|&|&amp;|and|/"


def entity_names(entity: DataFrame) -> DataFrame:
    """(id, text): the name, each name variation, and each piece of the real name."""
    real = F.transform(F.split("entity_metadata.real_name", NAME_SEPARATORS), lambda x: F.trim(x))
    empty = F.array().cast("array<string>")
    names = F.concat(F.array("entity_name"), F.coalesce("entity_metadata.name_variations", empty), F.coalesce(real, empty))
    return entity.select("id", F.explode(names).alias("text")).where("text is not null and text != ''")


def build_tokens(names: DataFrame) -> DataFrame:
    """Distinct (token, id) of names (id, text)."""
    return names.select("id", F.explode(tokenise(F.col("text"))).alias("token")).select("token", "id").distinct()


def token_stats(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """(token, df, idf): idf = log10(entries / df), where a name's variations are entries of their own."""
    n = names.agg(F.count("*").alias("entries"))
    df = tokens.groupBy("token").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("token", "df", F.log10(F.col("entries") / F.col("df")).alias("idf"))


MOST_TRACKED = 1_000_000  # items that Spark's sketch of frequent items may track


def frequent_tokens(tokens: DataFrame, min_df: int = 10_000) -> DataFrame:
    """(token, df) of the tokens in more than min_df rows of tokens, exactly. Null tokens don't count; no rows give no rows.

    One pass sketches the frequent items of each task, in so many counters that an estimate is off by less than half of min_df. So the
    sketch has every token over min_df, and at most twice rows / min_df tokens in all. These candidates are broadcast, and a second
    pass counts them only: rare tokens are never shuffled. Where min_df is so low that the sketch would need more than MOST_TRACKED
    counters, most tokens are candidates, and all are counted.
    """
    known = tokens.where("token is not null").select("token")
    tracked = 8 * known.count() // max(min_df, 1) + 8  # an estimate is off by 3.5 rows / counters at most
    if min_df > 0 and tracked <= MOST_TRACKED:
        top = known.agg(F.expr(f"approx_top_k(token, {tracked // 4 + 1}, {tracked})").alias("top"))
        known = known.join(F.broadcast(top.select(F.explode("top.item").alias("token"))), "token", "left_semi")
    return known.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") > min_df)


def query_words(query: Column) -> Column:
    """Distinct tokens of a query: stop words and hyphens as in the index, unsplit."""
    return F.array_distinct(without_stop_words(F.split(search_normalise(query), r"\s+")))


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query, token, n): distinct tokens of each query and how many it has."""
    words = query_words(F.col("query"))
    return queries.select("query").distinct().select("query", F.explode(words).alias("token"), F.size(words).alias("n"))


SLICE = 256  # about as many ids does a row of a posting list hold: a probe of one id meets a whole row
HOT_TOKENS = 100_000  # tokens with more than one slice that are broadcast


def posting_lists(tokens: DataFrame) -> DataFrame:
    """(cell, token, df, slices, ids): the sorted ids of each token, of a frequent one in slices by hash of id; df is their number over all slices.

    cell names a token's slice. tokens: distinct (token, id). Frequent tokens are dealt to their slices before they are grouped, so that none is one task's work.
    """
    df = tokens.groupBy("token").agg(F.count("*").alias("df"))
    stats = df.select("token", "df", F.ceil(F.col("df") / SLICE).cast("int").alias("slices"))
    hot = stats.where("slices > 1")
    some = hot.limit(HOT_TOKENS + 1).count() <= HOT_TOKENS
    sliced = tokens.join(F.broadcast(hot.select("token", "slices")) if some else hot.select("token", "slices"), "token", "left").select("token", "id", F.coalesce("slices", F.lit(1)).alias("slices"))
    lists = sliced.groupBy("token", "slices", slice_of(F.col("id"), F.col("slices")).alias("slice")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    large = lists.where("slices > 1").join(hot.select("token", "df"), "token").select("token", "df", "slices", "slice", "ids")
    small = lists.where("slices = 1").select("token", F.size("ids").cast("long").alias("df"), "slices", "slice", "ids")
    return small.unionByName(large).select(cell_of(F.col("token"), F.col("slice")).alias("cell"), "token", "df", "slices", "ids")


def slice_of(id_: Column, slices: Column) -> Column:
    return F.pmod(F.xxhash64(id_), slices).cast("int")


def cell_of(token: Column, slice_: Column) -> Column:
    return F.concat_ws(":", slice_.cast("string"), token)


def write_postings(tokens: DataFrame, root: str, buckets: int | None = None) -> Store:
    """The posting lists of tokens as a store by cell; what is asked of it goes to its buckets."""
    return Store.write(posting_lists(tokens), root, ["cell"], buckets)


def matches(queries: DataFrame, tokens: DataFrame | Store) -> DataFrame:
    """(query, id) of entities that have every token of a query. tokens: (token, id), distinct, or a store of posting lists."""
    postings = tokens if isinstance(tokens, Store) else posting_lists(tokens)
    return division(query_tokens(queries), postings)


def division(asked: DataFrame, postings: DataFrame | Store) -> DataFrame:
    """(query, id) of ids that have every one of a query's tokens: asked (query, token, n), of n tokens each.

    The ids of a query's rarest token are its candidates; its other tokens' lists only take some away. Each of these meets the candidates that can be in the
    same slice, so no list is met as a whole unless it is a query's rarest. A query's other tokens go with the cells of its rarest, which are dealt before their
    ids are listed: a join by query, or its ranks, would leave all ids of a query, and of few queries all ids, to one task.
    """
    lists = postings.table() if isinstance(postings, Store) else postings
    known = asked.join(lists.select("token", "df", "slices").distinct(), "token")
    of_query = Window.partitionBy("query")
    ranked = known.withColumn("known", F.count("*").over(of_query)).withColumn("rank", F.row_number().over(of_query.orderBy("df", "token"))).where("known = n")
    others = F.collect_list(F.when(F.col("rank") > 1, F.struct("token", "slices"))).over(of_query)
    cells = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda k: cell_of(F.col("token"), k))
    first = ranked.withColumn("others", others).where("rank = 1").select("query", "n", "others", F.explode(cells).alias("cell"))
    first = first.repartition(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell")
    size = first.agg(F.coalesce(F.sum(F.size("others") + 1), F.lit(0))).first()[0] if isinstance(postings, Store) else None  # others make rows longer
    candidates = matched(postings, "cell", first, "cell", size)
    spread = candidates.where("n > 1").select("query", "n", "ids", F.explode("others").alias("other")).select("query", "n", "other.*", F.explode("ids").alias("id"))
    probes = spread.groupBy("query", "n", "token", slice_of(F.col("id"), F.col("slices")).alias("slice")).agg(F.collect_list("id").alias("asked"))
    probes = probes.select("query", "n", cell_of(F.col("token"), F.col("slice")).alias("cell"), "asked")
    hits = matched(postings, "cell", probes, "cell").select("query", "n", F.explode(F.array_intersect("asked", "ids")).alias("id"))
    left = hits.groupBy("query", "n", "id").agg(F.count("*").alias("found")).where("found = n - 1")
    return candidates.where("n = 1").select("query", F.explode("ids").alias("id")).unionByName(left.select("query", "id"))


def jaro_winkler(a: str, b: str) -> float:
    """Similarity with a prefix weight of 0.1 over four characters, given when Jaro's is over 0.7."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    reach = max(n, m) // 2 - 1
    if not n or not m or reach < 0:
        return 0.0
    taken, first = [False] * m, []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                first.append(c)
                break
    k = len(first)
    if not k:
        return 0.0
    swaps = sum(x != y for x, y in zip(first, (c for c, t in zip(b, taken, strict=True) if t), strict=True)) // 2
    jaro = (k / n + k / m + (k - swaps) / k) / 3
    prefix = 0
    while prefix < min(4, n, m) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(T.DoubleType())
def jaro_winkler_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.array([1 - jaro_winkler(x, y) for x, y in zip(a, b, strict=True)]), dtype=float)


PREFIX = 24  # characters of a common beginning that the bounds look at


def distance_bounds(a: Column, b: Column) -> tuple[Column, Column]:
    """Bounds of the names' Jaro-Winkler distance, from lengths, letter counts and the common beginning; of equal names both are 0.

    No more characters match than the names have in common, and no fewer than they begin with alike: of those, each takes a place up to its own. At most half of the matching ones
    are out of order.
    """
    n, m = F.length(a), F.length(b)
    letters = F.array_distinct(F.split(a, ""))
    common = F.aggregate(F.transform(letters, lambda c: F.least(n - F.length(F.replace(a, c, F.lit(""))), m - F.length(F.replace(b, c, F.lit(""))))), F.lit(0), lambda x, y: x + y)
    begin = F.size(F.filter(F.sequence(F.lit(1), F.least(n, m, F.lit(PREFIX))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))

    def similar(jaro: Column) -> Column:
        return F.when(jaro > 0.7, jaro + F.least(begin, F.lit(4)) * 0.1 * (1 - jaro)).otherwise(jaro)

    most = F.when(common > 0, similar((common / n + common / m + 1) / 3)).otherwise(0.0)
    least = F.when(begin > 0, similar((begin / n + begin / m + 0.5) / 3)).otherwise(0.0)
    blank = (n == 0) | (m == 0)
    low = F.when(a == b, 0.0).when(blank, 1.0).otherwise(1 - most)
    return low, F.when(a == b, 0.0).when(blank, 1.0).otherwise(1 - least)


def score(query, name, id_):
    """Distance of the names, with what bonus() adds."""
    return jaro_winkler_distance(query, name) + bonus(query, name, id_)


def bonus(query: Column, name: Column, id_: Column) -> Column:
    """A bonus for low numbers in brackets, for beginning alike and for equality, and
    deductions for other lengths and for labels."""
    suffix = F.regexp_extract(name, r"^(.*) \((\d+)\)", 2)
    stem = F.regexp_extract(name, r"^(.*) \((\d+)\)", 1)
    numbered = F.when(suffix != "", F.when(stem == query, 1.0).otherwise(0.0) + (1000.0 - suffix.cast("double")) / 1000.0).otherwise(0.0)
    begins = F.when(F.startswith(F.lower(name), F.lower(query)), 1.0).otherwise(0.0)
    equal = F.when(F.lower(name) == F.lower(query), 100.0).otherwise(0.0)
    return numbered + begins + equal - F.abs(F.length(name) - F.length(query)) / 100.0 - F.when(id_ >= LABEL_OFFSET, 10.0).otherwise(0.0)


def search(queries: DataFrame, tokens: DataFrame, entity: DataFrame) -> DataFrame:
    """(query, rank, id, key, name, score): every entity that has all tokens of a query, best first, ties by id."""
    found = matches(queries, tokens).join(entity.select("id", F.col("entity_name").alias("name")), "id")
    scored = found.withColumn("score", score(F.col("query"), F.col("name"), F.col("id")))
    ranked = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.select("query", F.row_number().over(ranked).alias("rank"), "id", entity_key(F.col("id")).alias("key"), "name", "score")


def top_search(queries: DataFrame, tokens: DataFrame | Store, entity: DataFrame, k: int) -> DataFrame:
    """The first k of search() for each query, with `measured` names (those of a query whose exact distance was needed).

    Names are bounded first, each distinct one of a query once; the exact distance is measured only for those whose upper bound reaches the kth best lower bound.
    """
    found = matches(queries, tokens).join(entity.select("id", F.col("entity_name").alias("name")), "id").withColumn("label", F.col("id") >= LABEL_OFFSET)
    names = found.groupBy("query", "name", "label").agg(F.count("*").alias("n"))
    low, high = distance_bounds(F.col("query"), F.col("name"))
    rest = bonus(F.col("query"), F.col("name"), F.when(F.col("label"), LABEL_OFFSET).otherwise(0))
    bounded = names.withColumn("rest", rest).withColumn("low", F.col("rest") + low).withColumn("high", F.col("rest") + high)
    best = Window.partitionBy("query").orderBy(F.desc("low"))
    sure = bounded.withColumn("upto", F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    kth = F.max(F.when(F.col("upto") >= k, F.col("low"))).over(Window.partitionBy("query"))
    alive = sure.withColumn("kth", kth).where(F.col("kth").isNull() | (F.col("high") >= F.col("kth") - 1e-6))
    known = alive.where("query = name").select("query", "name", "label", F.col("rest").alias("score"), F.lit(0).alias("exact"))
    measured = jaro_winkler_distance.asNondeterministic()
    open_ = alive.where("query != name").select("query", "name", "label", (measured("query", "name") + F.col("rest")).alias("score"), F.lit(1).alias("exact"))
    scored = known.unionByName(open_)
    scored = scored.withColumn("measured", F.sum("exact").over(Window.partitionBy("query")))
    ranked = found.join(scored.drop("exact"), ["query", "name", "label"]).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id")))
    return ranked.where(F.col("rank") <= k).select("query", "rank", "id", entity_key(F.col("id")).alias("key"), "name", "score", "measured")


def tfidf_search(queries: DataFrame, tokens: DataFrame, names: DataFrame) -> DataFrame:
    """(query, id, score): for entities with every token, the sum over its names of how often a token is in them, times idf.

    Matches meet names by id, and a query's tokens are made from it again: a join by query would leave a frequent query to one task.
    """
    asked = query_tokens(queries).select("token").distinct()
    some = asked.limit(HOT_TOKENS + 1).count() <= HOT_TOKENS
    stats = token_stats(tokens, names).join(F.broadcast(asked) if some else asked, "token", "left_semi").select("token", "idf")
    words = names.select("id", F.split(search_normalise(F.col("text")), r"\s+").alias("words"))
    own = matches(queries, tokens).join(words, "id", "left").select("query", "id", "words", F.explode(query_words(F.col("query"))).alias("token"))
    counts = own.select("query", "id", "token", F.when(F.col("words").isNotNull(), F.size(F.filter("words", lambda w: w == F.col("token")))).otherwise(0).alias("tf"))
    return counts.join(F.broadcast(stats) if some else stats, "token").groupBy("query", "id").agg(F.sum(F.col("tf") * F.col("idf")).alias("score"))
