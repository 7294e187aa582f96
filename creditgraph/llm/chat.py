"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. Successive prefixes of a conversation are rendered;
where each output begins with the one before, the rest is the new turn's span. Rendering the last turn with two different
one-letter texts shows where its text begins and ends. An output that does not begin with the one before rewrites history:
that is recorded with the turn where it happens, and all spans are then located in the whole conversation's output.

The template given here marks turns with control strings, and escapes in texts and roles the characters that those begin
with, so every output can be read back.

Defined cases: rows are ordered by turn (null first), then role and text; a null text or role is empty; repeated rows
are turns of their own. No rows give no rows. Other columns play no part. A conversation is rendered as one string in one task, 3 n
times for n turns, as a black box tells of a prefix only when it renders it; so its time grows with n squared, and its memory with its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name

Turns = list[tuple[str, str]]
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n")}
OUTPUT = "formatted string, spans array<struct<role: string, start: int, end: int, text_start: int, text_end: int>>, rewrites boolean, rewritten_at int"


def escape(text: str) -> str:
    """Every control string begins with < or [, so none is left in the result."""
    return re.sub(r"([\\<\[])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def template(turns: Turns) -> str:
    out = []
    for role, text in turns:
        a, b = MARKS.get(role) or (f"<|{escape(role)}\\|>", "<|end|>")
        out.append(a + escape(text) + b)
    return "".join(out)


def read_back(formatted: str) -> Turns:
    """The turns of template()'s output."""
    turns, at = [], 0
    while at < len(formatted):
        for role, (a, b) in MARKS.items():  # noqa: B007
            if formatted.startswith(a, at):
                break
        else:
            stop = formatted.index("\\|>", at)
            while unescaped_before(formatted, stop):
                stop = formatted.index("\\|>", stop + 1)
            role, a, b = unescape(formatted[at + 2 : stop]), formatted[at : stop + 3], "<|end|>"
        start = at + len(a)
        end = start
        while not formatted.startswith(b, end):
            end += 2 if formatted[end] == "\\" else 1
        turns.append((role, unescape(formatted[start:end])))
        at = end + len(b)
    return turns


def unescaped_before(s: str, at: int) -> bool:
    """Whether the backslash at s[at] is itself escaped: an odd run of backslashes before it."""
    n = 0
    while at - n > 0 and s[at - n - 1] == "\\":
        n += 1
    return n % 2 == 1


def common_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix, by bisection."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def text_span(render: Callable[[Turns], str], turns: Turns, k: int, out: str) -> tuple[int, int]:
    """Where the text of turn k lies in out, the rendering of turns."""
    a, b = (render([*turns[:k], (turns[k][0], x), *turns[k + 1 :]]) for x in "AB")
    head = common_prefix(a, b)
    tail = common_prefix(a[head:][::-1], b[head:][::-1])
    return head, max(head, len(out) - tail)


def locate(turns: Turns, render: Callable[[Turns], str] = template) -> tuple[str, list[dict], bool, int | None]:
    """The output, a span for each turn, whether the template rewrites history and at which turn first."""
    before, spans, rewritten = "", [], None
    for k, (role, _) in enumerate(turns):
        out = render(turns[: k + 1])
        if not out.startswith(before):
            rewritten = k
            break
        a, b = text_span(render, turns[: k + 1], k, out)
        spans.append({"role": role, "start": len(before), "end": len(out), "text_start": a, "text_end": b})
        before = out
    if rewritten is None:
        return before, spans, False, None
    out, spans = render(turns), []
    for k, (role, _) in enumerate(turns):
        a, b = text_span(render, turns, k, out)
        spans.append({"role": role, "start": a, "end": b, "text_start": a, "text_end": b})
    return out, spans, True, rewritten


def format_chats(rows: DataFrame, render: Callable[[Turns], str] = template, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """For each conversation its output, the spans of its turns (characters of the output) and whether history was rewritten."""
    turns = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x"))))
    grouped = rows.groupBy(F.col(conv_id).alias("conv_id")).agg(turns.alias("turns"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [locate([(t["r"], t["x"]) for t in x], render) for x in b["turns"]]
            yield pd.DataFrame({"conv_id": b["conv_id"], "formatted": [m[0] for m in made], "spans": [m[1] for m in made], "rewrites": [m[2] for m in made], "rewritten_at": pd.array([m[3] for m in made], dtype="Int32")})

    return grouped.select("conv_id", "turns").mapInPandas(run, f"conv_id {grouped.schema['conv_id'].dataType.simpleString()}, {OUTPUT}")


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests, read back from format_chats()'s output with template()."""

    @F.pandas_udf("struct<n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long>")
    def digest(out: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for s, marks in zip(out, spans, strict=True):
            turns = read_back(s)
            loss = "".join(unescape(s[m["text_start"] : m["text_end"]]) for m in marks if m["role"] == "assistant")
            rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(s)))
        return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    name = free_name(formatted, "_d")
    return formatted.withColumn(name, digest("formatted", "spans")).select("conv_id", f"{name}.*")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
