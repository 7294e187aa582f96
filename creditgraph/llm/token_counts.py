"""Token counts of fields or sections, by the offsets of the whole document's tokens.

A document is encoded once, whole. Its token spans (characters) are interval-joined with the spans of its sections, both
sorted, and a token that crosses a boundary is allocated by rule:

- first: to the section with its first character
- last: to the section with its last character
- most: to the section with most of its characters, of several the first
- split: to each section in proportion to its characters

A token of part of a character has that character. Characters outside all sections belong to none; their tokens are counted
under section -1, where there are any. Over all sections and -1, the counts add up to the document's tokens under every rule.

Sections may be given in any order, and are numbered as given. Of two that overlap, the one that begins later (ties: the later one given) begins where
the other ends. One that is null, or has a null bound, or ends before it begins, is empty; bounds outside the text are moved to its ends.

Defined cases: a null text is empty; an empty text has one section, without tokens; null sections are none. Texts may have any length.
Repeated rows are counted each. No rows give no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = ("first", "last", "most", "split")


def read_vocabulary(path: str) -> bytes:
    """A rank file's content, read on the driver."""
    with open(path, "rb") as f:
        return f.read()


def encoding(content: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in content.splitlines() if x.strip())}
    size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    size[list(ranks.values())] = [len(p) for p in ranks]
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size


def token_spans(text: str, ids: list[int], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end characters of each token."""
    end = np.cumsum(size[ids]) if ids else np.zeros(0, dtype=np.int64)
    begin = end - size[ids] if ids else end
    data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    if len(data) == len(text):
        return begin, end
    char = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
    return char[begin], char[end - 1] + 1


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Each line with its line feed; an empty text is one line."""
    at = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) == 10) + 1
    cut = np.concatenate([[0], at, [len(text)] if not len(at) or at[-1] < len(text) else []]).astype(np.int64)
    return (cut[:-1], cut[1:]) if len(cut) > 1 else (np.zeros(1, np.int64), np.zeros(1, np.int64))


def allocate(begin: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For sections [a, b), sorted and apart: their tokens, and how many of these cross a boundary; last of all, those of none."""
    n = len(a)
    edges = np.stack([a, b], axis=1).ravel()
    # cells between edges: odd numbers of edges before a place mean that it is inside a section
    lo, hi = np.searchsorted(edges, begin, "right"), np.searchsorted(edges, end - 1, "right")

    def section(cell: np.ndarray) -> np.ndarray:
        return np.where(cell % 2 == 1, cell // 2, n)

    def place(x: np.ndarray) -> np.ndarray:
        # of sections that touch, an edge is an end and a start at once
        return section(np.searchsorted(edges, x, "right"))

    counts, crossing = np.zeros(n + 1), np.zeros(n + 1)
    whole = lo == hi
    counts += np.bincount(section(lo[whole]), minlength=n + 1)
    for t in np.flatnonzero(~whole):
        x = np.arange(begin[t], end[t])
        own = place(x)
        part = np.bincount(own, minlength=n + 1)
        if rule == "split":
            counts += part / len(x)
            crossing += part > 0
            continue
        if rule == "most":
            best = own[np.argmax(part[own])]  # the first place whose section has most
        else:
            best = own[0 if rule == "first" else -1]
        counts[best] += 1
        crossing[best] += 1
    return counts, crossing


def settled(given: list, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, starts and ends of the sections with characters, sorted and apart."""
    whole = [(x["start"], x["end"]) if x is not None and x["start"] is not None and x["end"] is not None else (0, 0) for x in given]
    s = np.clip(np.array(whole, dtype=np.int64).reshape(-1, 2), 0, length)
    o = np.argsort(s[:, 0], kind="stable")
    a, b = s[o, 0], s[o, 1]
    a = np.maximum(a, np.concatenate([[0], np.maximum.accumulate(b)[:-1]])) if len(a) else a
    live = a < b
    return o[live], a[live], b[live]


def count_sections(docs: DataFrame, content: bytes, pattern: str, rule: str = "most", text: str = "text", doc_id: str = "doc_id", sections: Column | None = None) -> DataFrame:
    """doc_id, section, start, end, n_tokens (double), n_crossing for every section.

    sections: array<struct<start: int, end: int>> of each document; None: its lines.
    """
    if rule not in RULES:
        raise ValueError(f"the rule must be one of {RULES}")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *([] if sections is None else [sections.alias("spans")]))
    given = sections is not None
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, size = encoding(shared.value, pattern)
        for batch in batches:
            row, out = [], []
            for k, t in enumerate(batch.column("text").to_pylist()):
                begin, end = token_spans(t, enc.encode_ordinary(t), size)
                if given:
                    s = batch.column("spans")[k].as_py() or []
                    own, *bounds = settled(s, len(t))
                    some = allocate(begin, end, *bounds, rule)
                    counts, crossing = np.zeros(len(s) + 1), np.zeros(len(s) + 1)
                    counts[[*own, -1]], crossing[[*own, -1]] = some
                    a, b = (np.array([-1 if x is None or x[e] is None else x[e] for x in s], dtype=np.int64) for e in ("start", "end"))
                else:
                    a, b = line_spans(t)
                    counts, crossing = allocate(begin, end, a, b, rule)
                n = len(a) + bool(counts[-1])
                out.append((np.where(np.arange(n) < len(a), np.arange(n), -1), np.append(a, -1)[:n], np.append(b, -1)[:n], counts[:n], crossing[:n]))
                row.append(np.full(n, k))
            if not row:
                continue
            no, a, b, counts, crossing = (np.concatenate(x) for x in zip(*out, strict=True))
            ids = batch.column("doc_id").take(pa.array(np.concatenate(row)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(no, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(counts, pa.float64()), pa.array(crossing, pa.int64())], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, section int, start long, end long, n_tokens double, n_crossing long")


def count_fields(docs: DataFrame, fields: list[str], content: bytes, pattern: str, rule: str = "most", doc_id: str = "doc_id", joined_by: str = "\n\n") -> DataFrame:
    """Tokens of each of fields in the document that they make when joined; a null field is empty. Section k is fields[k]."""
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    spans, at = [], F.lit(0)
    for p in parts:
        spans.append(F.struct(at.alias("start"), (at + F.length(p)).alias("end")))
        at = at + F.length(p) + len(joined_by)
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.concat_ws(joined_by, *parts).alias("text"), F.array(*spans).alias("spans"))
    return count_sections(whole, content, pattern, rule, sections=F.col("spans"))
