"""The grammar of role texts as column expressions: a text is split into roles with details, and each role's name is normalised by chains of rules.

Patterns are the rule tables' own, with Unicode classes and line feeds as the only line ends. A value that a step needs more than once is bound by let(), so
that expressions grow with the rules and no faster.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import role_rules as R

FLAGS = "(?Ud)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sub(s: Column, pattern: str, to: str) -> Column:
    for k in "123":
        to = to.replace(f"\\{k}", f"${k}")
    return F.regexp_replace(s, FLAGS + pattern, to)


def has(s: Column, pattern: str) -> Column:
    return F.rlike(s, F.lit(FLAGS + pattern))


def apply(rules: list[tuple[str, str]], s: Column) -> Column:
    for pattern, to in rules:
        s = sub(s, pattern, to)
    return s


def strip(s: Column) -> Column:
    return F.regexp_replace(s, FLAGS + r"^\s+|\s+\z", "")


def rest(s: Column, begin: int = 2) -> Column:
    return F.substring(s, F.lit(begin), F.length(s))


def first(s: Column, case: Callable[[Column], Column]) -> Column:
    """s with another case of its first character."""
    return F.concat(case(F.substring(s, 1, 1)), rest(s))


def capitalised(s: Column) -> Column:
    """A capital of two letters has one of them small."""
    return let(F.upper(F.substring(s, 1, 1)), lambda u: F.concat(F.substring(u, 1, 1), F.lower(rest(u)), F.lower(rest(s))))


def count(s: Column, char: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(char), F.lit("")))


def parse_roles(text: Column) -> Column:
    """array<struct<name, detail>>: roles between commas outside square brackets, with what their outermost brackets hold."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("open"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, piece: Column) -> Column:
        depth = s["depth"] + count(piece, "[") - count(piece, "]")
        whole = F.when(s["open"].isNull(), piece).otherwise(F.concat(s["open"], F.lit(","), piece))
        return let(F.struct(depth.alias("depth"), whole.alias("whole")), lambda x: F.struct(
            x["depth"].alias("depth"), F.when(x["depth"] != 0, x["whole"]).alias("open"), F.when(x["depth"] == 0, F.concat(s["parts"], F.array(x["whole"]))).otherwise(s["parts"]).alias("parts")))

    ended = F.aggregate(F.split(F.coalesce(text, F.lit("")), ",", -1), start, step, lambda s: F.when(s["open"].isNull(), s["parts"]).otherwise(F.concat(s["parts"], F.array(s["open"]))))
    parts = F.filter(F.transform(ended, strip), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(strip(F.regexp_extract(p, r"^[^\[]*", 0)).alias("name"), details(p).alias("detail")))


def details(part: Column) -> Column:
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("inside"), F.array().cast("array<string>").alias("found"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "[", 1).when(c == "]", -1).otherwise(0)
        inside = F.when((c == "[") & (s["depth"] == 0), "").otherwise(F.concat(s["inside"], c))
        found = F.when((c == "]") & (s["depth"] == 1), F.concat(s["found"], F.array(strip(s["inside"])))).otherwise(s["found"])
        return F.struct(depth.alias("depth"), inside.alias("inside"), found.alias("found"))

    return F.aggregate(F.split(part, ""), start, step, lambda s: F.nullif(F.array_join(s["found"], ", "), F.lit("")))


def string_wording(s: Column) -> Column:
    """Strings are joined to their number by a hyphen, unless the text names one of the machines."""
    joined = let(apply(R.STRING_SHORT_FORMS, s), lambda x: F.when(has(x, R.STRING_MACHINES), x).otherwise(sub(x, *R.STRING_HYPHEN)))
    return apply(R.STRING_ENDINGS, joined)


def words_for_numbers(s: Column) -> Column:
    named = let(s, lambda x: F.when(F.contains(x, F.lit("String")), apply([(rf"{n}[- ]String", f"{w}-String") for n, w in R.STRING_NUMBERS.items()], x)).otherwise(x))
    return apply([(rf"{n}[- ]Bit ", f"{w}-Bit ") for n, w in R.BIT_NUMBERS.items()], sub(named, *R.STRINGS_LAST))


def cased(s: Column) -> Column:
    """Words begin with a capital, unless they are all capitals; so do parts after a hyphen, and after an apostrophe that opens a word or
    follows a single d."""
    words = F.transform(F.split(s, " ", -1), lambda w: F.when((F.upper(w) == w) & (F.lower(w) != w), w).otherwise(capitalised(w)))
    hyphens = F.transform(F.split(F.array_join(words, " "), "-", -1), lambda x, i: F.when((i > 0) & F.rlike(x, F.lit("^[a-z]")), first(x, F.upper)).otherwise(x))
    letter = F.lit("^[a-zA-Z]")

    def opened(p: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.get(p, i - 1)
            return F.when((i > 0) & (F.endswith(before, F.lit(" ")) | ((i == 1) & (before == ""))) & F.rlike(x, letter), first(x, F.upper)).otherwise(x)

        return F.transform(p, one)

    def inner(p: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("before"), F.lit(False).alias("taken"))

        def step(s: Column, x: Column) -> Column:
            # a letter that the rule has just taken is not the one before the next apostrophe
            hit = s["before"].isNotNull() & has(s["before"], r"\w\z") & F.rlike(x, letter) & ~(s["taken"] & (F.length(s["before"]) == 1))
            return let(hit, lambda h: F.struct(F.concat(s["out"], F.array(F.when(h, first(x, F.lower)).otherwise(x))).alias("out"), x.alias("before"), h.alias("taken")))

        return F.aggregate(p, start, step, lambda s: s["out"])

    def of_d(p: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before, after, d = F.get(p, i - 1), F.get(p, i + 1), F.lit(r" [dD]\z")
            begun = F.when((i > 0) & F.rlike(before, d) & F.rlike(x, letter), first(x, F.upper)).otherwise(x)
            lowered = F.coalesce(F.rlike(x, d) & F.rlike(after, letter), F.lit(False))
            return let(begun, lambda y: F.when(lowered, F.concat(F.substring(y, F.lit(1), F.length(y) - 1), F.lit("d"))).otherwise(y))

        return F.transform(p, one)

    def parts(x: Column) -> Column:
        return F.split(x, "'", -1)

    return F.array_join(let(let(let(parts(F.array_join(hyphens, "-")), opened), inner), of_d), "'")


def machine(s: Column) -> Column:
    named = F.when(F.lit(False), "")
    for n, m in R.MACHINES.items():
        named = named.when((s == n) | (F.lower(s) == f"{m.lower()}-{n}"), f"Roland {m}-{n}")
    return named.otherwise(s)


def without_number(s: Column) -> Column:
    """A leading number goes, but for the terms in which it is a word."""
    named = F.regexp_extract(s, FLAGS + R.LEADING_NUMBER, 1)
    out = F.when(~has(s, R.LEADING_NUMBER), s)
    for term, rule in R.NUMBERED_TERMS.items():
        out = out.when(named == term, sub(s, *rule))
    return out.otherwise(named)


def initials(s: Column) -> Column:
    return F.when(has(s, R.INITIALS), F.upper(F.replace(F.regexp_extract(s, FLAGS + R.INITIALS, 1), F.lit("."), F.lit("")))).otherwise(s)


def normalise_role(text: Column) -> Column:
    def known(s: Column) -> Column:
        worded = words_for_numbers(string_wording(sub(s, *R.COUNTED)))
        plain = apply(R.ABBREVIATIONS, apply(R.NUMBERS_AND_DATES, let(worded, without_number)))
        return strip(apply(R.ENDINGS, let(plain, initials)))

    def other(x: Column) -> Column:
        s = sub(x, R.BRACKETS, "")
        for small in R.SMALL_WORDS:
            s = sub(s, rf"(?i)-{small}\b", f" {small}")
        s = F.replace(cased(let(s, machine)), F.lit("_"), F.lit(" "))
        for short in R.SHORT_WORDS:
            s = sub(s, rf"(?i)\b{short}\b", short)
        return let(apply(R.FIRST_CLEANUP, s), lambda y: F.when(has(y, R.NO_NAME), "").otherwise(known(y)))

    return let(text, lambda x: F.when(F.rlike(x, F.lit(rf"^{R.CAPITALS}\z")) & ~x.isin(*R.NOT_CAPITALS), x).otherwise(other(x)))


def normalise_roles(text: Column) -> Column:
    """array<string>: the names in a role text, cut at separators, normalised, cut at full stops, normalised again."""
    s = F.coalesce(text, F.lit(""))
    for pattern in (R.BRACKETS, R.QUOTES, R.OPEN_BRACKET):
        s = sub(s, pattern, "")
    once = F.transform(F.filter(F.split(sub(s, R.A_AND_R, "ANR"), FLAGS + R.SEPARATORS, -1), lambda p: p != ""), normalise_role)
    parts = F.filter(F.flatten(F.transform(once, lambda o: F.split(o, r"\. ", -1))), lambda p: p != "")
    return F.filter(F.transform(parts, normalise_role), lambda n: n != "")


def role_names(text: Column) -> Column:
    """array<string>: the normalised names of all roles in a text."""
    return F.flatten(F.transform(parse_roles(text), lambda r: normalise_roles(r["name"])))
