"""Dates, search text, countries and genres, profile links: pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that search ignores.
STOP_WORDS = ["the", "and", "a", "of", "studio", "studios", "productions", "music", "records", "recordings", "entertainment"]
# Fixed pattern: numbers in brackets and placeholder label names that search strips.
STRIPPED = r"\(\d+\)|[(]?not on label[)]?|[(]?self[\s\- ]+released[)]?"
# What may follow the comma of an inverted country name.
INVERTED = r"^(.*),\s*(Democratic Republic of the|Republic of the|Republic of|Isle of|The)$"
# Fixed pattern: [a1], [l=Name], [r2], [m3=Title] in profiles.
PROFILE_LINK = r"\[([alrm])(\d*)(?:=([^\]]+))?\]"


def release_date(text: Column) -> Column:
    """A date of YYYY-MM-DD, YYYYMMDD or YYYY: zero months and days are 1, a month over 12 changes place with a day that is not,
    days past the month's end run on, anything else is null."""
    full = F.regexp_extract(text, r"^(\d{4})-(\d{2})-(\d{2})$", 0) != ""
    tight = F.regexp_extract(text, r"^\d{8}$", 0) != ""
    year_only = F.regexp_extract(text, r"^\d{4}$", 0) != ""
    digits = F.regexp_replace(text, "-", "")
    y = F.when(full | tight | year_only, F.substring(digits, 1, 4).cast("int"))
    m = F.when(year_only, F.lit(1)).when(full | tight, F.greatest(F.substring(digits, 5, 2).cast("int"), F.lit(1)))
    d = F.when(year_only, F.lit(1)).when(full | tight, F.greatest(F.substring(digits, 7, 2).cast("int"), F.lit(1)))
    swap = (m > 12) & (d <= 12)
    month, day = F.when(swap, d).otherwise(m), F.when(swap, m).otherwise(d)
    ok = (month <= 12) & (y >= 1)
    first = F.make_date(F.when(ok, y), F.when(ok, month), F.when(ok, F.lit(1)))
    return F.when(ok, F.date_add(first, day - 1))


def search_normalise(text: Column) -> Column:
    t = F.regexp_replace(F.lower(text), STRIPPED, "")
    t = F.regexp_replace(F.regexp_replace(t, ", ", " "), r",\s*$", "")
    return F.trim(F.regexp_replace(t, " +", " "))


def without_stop_words(words: Column) -> Column:
    return F.filter(words, lambda w: (w != "") & ~w.isin(STOP_WORDS))


def drop_stop_words(text: Column) -> Column:
    return F.array_join(without_stop_words(F.split(text, r"\s+")), " ")


def tokenise(text: Column) -> Column:
    """Distinct search tokens: words of the normalised text, and those of the same text with its hyphens as spaces."""
    t = search_normalise(text)
    return F.array_distinct(without_stop_words(F.concat(F.split(t, r"\s+"), F.split(F.replace(t, F.lit("-"), F.lit(" ")), r"\s+"))))


def split_names(text: Column) -> Column:
    """Distinct trimmed parts between &, comma and slash."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "[&,/]"), lambda x: F.trim(x)), lambda x: x != ""))


def split_country(text: Column) -> Column:
    """split_names() of a country, with "X, Republic of" turned to "Republic of X" first."""
    return split_names(F.when(text.rlike(INVERTED), F.concat_ws(" ", F.regexp_extract(text, INVERTED, 2), F.trim(F.regexp_extract(text, INVERTED, 1)))).otherwise(text))


def profile_refs(text: Column) -> Column:
    """array<struct<ref, kind, id, name>> of a profile's links; a part that is not there is empty."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(PROFILE_LINK), F.lit(0)),
        lambda r: F.struct(r.alias("ref"), F.regexp_extract(r, PROFILE_LINK, 1).alias("kind"), F.regexp_extract(r, PROFILE_LINK, 2).alias("id"), F.regexp_extract(r, PROFILE_LINK, 3).alias("name")),
    )


def clean_text(text: Column) -> Column:
    return F.nullif(F.nullif(text, F.lit("NULL")), F.lit(""))
