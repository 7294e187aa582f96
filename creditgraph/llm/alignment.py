"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes.

Byte offsets where tokens of both end cut a text's tokens into groups, and a group links each of its A tokens with each of its B tokens.

What a byte range of a text knows of them is a fragment: an open prefix (tokens up to the first common end), closed groups, and an open suffix (tokens
after the last common end); without a common end in the range all is prefix. compose() joins the fragments of neighbours, and is associative, so the
fragments of a long text are made in different tasks and composed in a tree of Spark groupings. Texts of up to RANGE bytes are one fragment. A long text
is cut at single spaces between other characters than white space, the first one after each multiple of RANGE, where both tokenizers end a token whatever
stands around; each piece is encoded on its own, and its tokens are dealt to the byte ranges that they end in.

How many documents hold an id pair linked is counted over all documents: blocks of documents count their own pairs first, counts are added by pair, and each
block gets the counts of its own distinct pairs back. No pair moves once for each document, so a frequent one is no large key.

Defined cases: texts that are null, empty, or not given back by the tokens of both have no tokens, and zeros everywhere. Texts and groups may have any
length. Repeated rows are documents of their own. No rows give no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions, short_batches, staged, tidy

RANGE = 1 << 16  # bytes of a range of a long text
FAN = 8  # ranges that one task composes
TOGETHER = 1 << 22  # bytes of texts whose distinct words are encoded together
BLOCK_PAIRS = 1 << 18  # pairs of a block's documents, but for one document
ALONE = {"parquet.block.row.count.limit": "1", "parquet.page.size.row.check.min": "1"}  # a block is a row group: the usual writer and reader hold a hundred rows, whatever their size
LARGE = 1 << 12  # links of a group above which its distinct ids are paired, not its tokens
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Fixed value: how byte-level BPE cuts texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MARK = "▁"  # what pieces have for a space
FRAGMENT = "k int, begin long, ok boolean, cut boolean, pa array<int>, pb array<int>, sa array<int>, sb array<int>, n_a long, n_b long, n_groups long, n_links long, spelled string, keys array<bigint>, times array<bigint>"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level piece stands for: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_bytes(piece: str, letters: dict[str, int]) -> bytes:
    return bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()


def as_ranks(a: str) -> dict[bytes, int] | None:
    """The vocabulary of a byte-level BPE by bytes, if its merges are no more than the order of the ids, so that the faster library, which knows ids only, gives the same.

    That is so when the ith merge makes the ith id after the single bytes, every id is reached from its own bytes by the merges,
    and texts are cut by the usual pattern without more ado.
    """
    import public_tokenizers as public

    told = json.loads(a)
    cut, model = told["pre_tokenizer"] or {}, told["model"]
    usual = told["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and public.PATTERN == PATTERN
    if not usual or model["dropout"] or model["continuing_subword_prefix"] or model["end_of_word_suffix"] or model["ignore_merges"]:
        return None
    merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    vocabulary, order = model["vocab"], {m: i for i, m in enumerate(merges)}
    if any(vocabulary.get(x + y) != 256 + i for i, (x, y) in enumerate(merges)) or len(vocabulary) != 256 + len(merges):
        return None
    for piece in vocabulary:
        parts = [*piece]
        while len(parts) > 1:
            rank, k = min((order.get(p, len(order)), k) for k, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(order):
                return None
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
    letters = byte_letters()
    return {piece_bytes(p, letters): i for p, i in vocabulary.items()}


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a: str, b: bytes, ranks: dict[bytes, int] | None = None):
        from sentencepiece import SentencePieceProcessor

        self.b, letters = SentencePieceProcessor(model_proto=b), byte_letters()
        if ranks:
            import tiktoken

            vocabulary = ranks
            self.a_ids = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_str(a)
            own.encode_special_tokens = True
            vocabulary = {piece_bytes(p, letters): i for p, i in own.get_vocab().items()}
            self.a_ids = lambda text: own.encode(text, add_special_tokens=False).ids
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.a_bytes[i] = piece
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in pieces]
        self.a_size, self.b_size = (np.array([*map(len, x)], np.int64) for x in (self.a_bytes, self.b_bytes))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of a space and text, None if their bytes are others."""
        a, b = self.a_ids(" " + text), self.b.encode(text)
        data = b" " + text.encode()
        if b"".join([self.a_bytes[i] for i in a]) != data or b"".join([self.b_bytes[i] for i in b]) != data:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def words(self, words: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Runs of words that are encoded together, by the number of the first: their ids. Words that are not given back are left out."""
        if not words:
            return {}
        made = self.encode(" ".join(words))
        if made is not None:
            return {0: made}
        if len(words) == 1:
            return {}
        half = len(words) // 2
        return self.words(words[:half]) | {half + i: x for i, x in self.words(words[half:]).items()}


def cross(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of all pairs of a and b, and how often each is."""
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    return (x[:, None] << 32 | y).ravel(), (n[:, None] * m).ravel()


def pairs_of(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """group, key and number of the links in groups that begin at a_at and b_at (with the ends last)."""
    n, m = np.diff(a_at), np.diff(b_at)
    few = n * m <= LARGE
    links = np.where(few, n * m, 0)
    group = np.repeat(np.arange(len(n)), links)
    within = np.arange(len(group)) - np.repeat(np.cumsum(links) - links, links)
    keys = a[a_at[:-1][group] + within // np.maximum(m, 1)[group]] << 32 | b[b_at[:-1][group] + within % np.maximum(m, 1)[group]]
    out = [(group, keys, np.ones(len(keys), np.int64))]
    for g in np.flatnonzero(~few):
        keys, times = cross(a[a_at[g] : a_at[g + 1]], b[b_at[g] : b_at[g + 1]])
        out.append((np.full(len(keys), g), keys, times))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def spelled(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> list[str]:
    """Each group as its A ids and B ids, joined by commas, with a bar between."""
    x, y, i, j = [*map(str, a.tolist())], [*map(str, b.tolist())], a_at.tolist(), b_at.tolist()
    return [f"{x[p]}|{y[r]}" if q - p == 1 == s - r else f"{','.join(x[p:q])}|{','.join(y[r:s])}" for p, q, r, s in zip(i, i[1:], j, j[1:], strict=False)]


def totals(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their times."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(times[order], first)


def none() -> np.ndarray:
    return np.zeros(0, np.int64)


@dataclass
class Fragment:
    """What a byte range knows: open prefix, closed groups (counted, spelled, and their links by key), open suffix. cut: there is a common end."""

    cut: bool = False
    pa: np.ndarray = field(default_factory=none)
    pb: np.ndarray = field(default_factory=none)
    sa: np.ndarray = field(default_factory=none)
    sb: np.ndarray = field(default_factory=none)
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    spelled: str = ""
    keys: np.ndarray = field(default_factory=none)
    times: np.ndarray = field(default_factory=none)


def fragment(a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray) -> Fragment:
    """Of neighbouring tokens, by their ends."""
    common = np.intersect1d(a_end, b_end)
    if not len(common):
        return Fragment(pa=a, pb=b)
    i, j = np.searchsorted(a_end, common, "right"), np.searchsorted(b_end, common, "right")
    _, keys, times = pairs_of(a, b, i, j)
    n, m = np.diff(i), np.diff(j)
    return Fragment(True, a[: i[0]], b[: j[0]], a[i[-1] :], b[j[-1] :], int(n.sum()), int(m.sum()), len(n), int((n * m).sum()), ";".join(spelled(a, b, i, j)), *totals(keys, times))


def closed(a: np.ndarray, b: np.ndarray) -> Fragment:
    """One closed group, without prefix or suffix."""
    if not len(a) and not len(b):
        return Fragment(True)
    ends = np.array([0, len(a)]), np.array([0, len(b)])
    return Fragment(True, n_a=len(a), n_b=len(b), n_groups=1, n_links=len(a) * len(b), spelled=spelled(a, b, *ends)[0], **dict(zip(("keys", "times"), cross(a, b), strict=True)))


def closed_parts(parts: list[Fragment]) -> dict:
    """The closed groups of parts, one after another."""
    keys, times = totals(*(np.concatenate([none(), *(getattr(p, c) for p in parts)]) for c in ("keys", "times")))
    return {**{c: sum(getattr(p, c) for p in parts) for c in ("n_a", "n_b", "n_groups", "n_links")}, "spelled": ";".join(p.spelled for p in parts if p.spelled), "keys": keys, "times": times}


def compose(parts: list[Fragment]) -> Fragment:
    """The fragment of neighbours in order; Fragment() is neutral."""
    def joined(names: list[tuple[Fragment, str]]) -> np.ndarray:
        return np.concatenate([none(), *(getattr(p, c) for p, c in names)])

    at = [k for k, p in enumerate(parts) if p.cut]
    if not at:
        return Fragment(pa=joined([(p, "pa") for p in parts]), pb=joined([(p, "pb") for p in parts]))
    first, last, found = at[0], at[-1], []
    for k, after in zip(at, [*at[1:], None], strict=True):
        found.append(parts[k])
        if after is not None:  # between two cuts everything open is one group
            between = [(parts[k], "s"), *((p, "p") for p in parts[k + 1 : after + 1])]
            found.append(closed(*(joined([(p, c + side) for p, c in between]) for side in "ab")))
    heads, tails = [(p, "p") for p in parts[: first + 1]], [(parts[last], "s"), *((p, "p") for p in parts[last + 1 :])]
    ends = [joined([(p, c + side) for p, c in names]) for names in (heads, tails) for side in "ab"]
    return Fragment(True, *ends, **closed_parts(found))


def finished(whole: Fragment) -> Fragment:
    """A whole text's fragment, whose prefix is its first group."""
    return Fragment(True, **closed_parts([closed(whole.pa, whole.pb), whole]))


class Block:
    """Documents with their numbers and links, until there are BLOCK_PAIRS of these."""

    NUMBERS = ("n_a", "n_b", "n_groups", "n_links")

    def __init__(self, tag: str, id_type: pa.DataType):
        from pyspark import TaskContext

        self.name, self.no, self.id_type = f"{tag}-{TaskContext.get().partitionId()}", 0, id_type
        self.clear()

    def clear(self) -> None:
        self.ids, self.numbers, self.digests, self.sizes, self.keys, self.times, self.size = [], [], [], [], [], [], 0

    def add(self, ids: pa.Array, numbers: np.ndarray, digests: list[str], sizes: np.ndarray, keys: np.ndarray, times: np.ndarray) -> None:
        """Documents with numbers (n, 4); keys and times of all of them in order, of each distinct and sorted, sizes[i] of the ith."""
        for mine, x in zip((self.ids, self.numbers, self.digests, self.sizes, self.keys, self.times), (ids, numbers, digests, sizes, keys, times), strict=True):
            mine.append(x)
        self.size += len(keys)

    def rows(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.size < BLOCK_PAIRS and not (last and self.ids):
            return
        keys, place = np.unique(np.concatenate(self.keys), return_inverse=True)
        numbers = np.concatenate(self.numbers)
        n_docs = np.bincount(place, minlength=len(keys))
        lists = [pa.concat_arrays(self.ids), *(pa.array(numbers[:, c]) for c in range(4)), pa.array([d for ds in self.digests for d in ds], pa.string()), pa.array(np.concatenate(self.sizes), pa.int32())]
        lists += [pa.array(place, pa.int32()), pa.array(np.concatenate(self.times), pa.int64()), pa.array(keys), pa.array(n_docs, pa.int64())]
        out = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
        yield pa.RecordBatch.from_arrays([pa.array([f"{self.name}-{self.no}"]), *out], names=["block", "ids", *self.NUMBERS, "digests", "sizes", "place", "times", "keys", "n_docs"])
        self.no += 1
        self.clear()


def block_schema(id_type: str) -> str:
    return f"block string, ids array<{id_type}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, digests array<string>, sizes array<int>, place array<int>, times array<bigint>, keys array<bigint>, n_docs array<bigint>"


def cut_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Numbers of each text's words, the distinct words, and how many each text has. Words end where both tokenizers end a token."""
    split = pc.split_pattern(texts, " ")
    flat = split.flatten().dictionary_encode()
    words, size = flat.dictionary.to_pylist(), split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    number = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    odd = np.array([not w or w[0].isspace() or w[-1].isspace() for w in words], bool)
    mixed = np.unique(np.repeat(np.arange(len(size)), size)[odd[number]]) if odd.any() else none()
    if len(mixed):  # texts with white space at a space are cut one by one
        known, pieces = {w: i for i, w in enumerate(words)}, np.split(number, np.cumsum(size)[:-1])
        for t in mixed:
            own = CUT.split(texts[int(t)].as_py())
            pieces[t] = np.array([known.setdefault(w, len(known)) for w in own], np.int64)
            size[t] = len(own)
        number, words = np.concatenate(pieces), [*known]
    return number, words, size


def gathered(at: np.ndarray, size: np.ndarray, take: np.ndarray) -> np.ndarray:
    """The places of the entries of each of take, one after another: those of i are at[i] to at[i] + size[i]."""
    n = size[take]
    return np.repeat(at[take] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def short_texts(t: Tokenizers, ids: pa.Array, texts: pa.Array, block: Block) -> None:
    """Adds documents to block, by way of their distinct words."""
    number, words, size = cut_words(texts)
    live = np.unique(number)
    live = np.array([i for i in live.tolist() if words[i] and MARK not in words[i]], np.int64)  # an empty text is one empty word
    numbers, bad, text = np.zeros((len(words), 4), np.int64), np.ones(len(words), bool), [""] * len(words)
    word_of, keys, times = [none()], [none()], [none()]
    inner = [i for i in live.tolist() if words[i].strip() == words[i]]
    edges = [i for i in live.tolist() if words[i].strip() != words[i]]  # beside white space a space ends no token: these stand alone
    for some in [*(inner[k : k + (1 << 14)] for k in range(0, len(inner), 1 << 14)), *([i] for i in edges)]:
        own = [words[i] for i in some]
        made = t.words(own)
        starts = sorted(made)
        width = np.array([len(w.encode()) + 1 for w in own], np.int64)
        for s in starts:
            a, b = made[s]
            a_end, b_end = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
            ends = np.cumsum(width[s:])
            ends = ends[: np.searchsorted(ends, a_end[-1]) + 1]
            of = np.array(some[s : s + len(ends)], np.int64)
            common = np.concatenate([[0], np.intersect1d(a_end, b_end)])
            i, j = np.searchsorted(a_end, common, "right"), np.searchsorted(b_end, common, "right")
            g = np.searchsorted(common, ends, "right") - 1  # groups up to the end of each word
            g_begin = np.concatenate([[0], g[:-1]])
            n_links = np.concatenate([[0], np.cumsum(np.diff(i) * np.diff(j))])
            numbers[of] = np.stack([i[g] - i[g_begin], j[g] - j[g_begin], g - g_begin, n_links[g] - n_links[g_begin]], axis=1)
            bad[of] = False
            groups = spelled(a, b, i, j)
            for w, p, q in zip(of.tolist(), g_begin.tolist(), g.tolist(), strict=True):
                text[w] = ";".join(groups[p:q])
            group, k, n = pairs_of(a, b, i, j)
            word_of.append(of[np.searchsorted(g, group, "right")])
            keys.append(k)
            times.append(n)
    word_of, keys, times = (np.concatenate(x) for x in (word_of, keys, times))
    order = np.argsort(word_of, kind="stable")
    keys, times = keys[order], times[order]
    n_pairs = np.bincount(word_of, minlength=len(words)).astype(np.int64)
    at = np.cumsum(n_pairs) - n_pairs
    doc = np.repeat(np.arange(len(size)), size)
    lost = np.zeros(len(size), bool)
    lost[doc[bad[number]]] = True
    lost |= size == 0
    stay = ~lost[doc]
    number, doc = number[stay], doc[stay]
    out = np.zeros((len(size), 4), np.int64)
    for c in range(4):
        out[:, c] = np.bincount(doc, numbers[number, c], len(size)).astype(np.int64)
    begin = np.searchsorted(doc, np.arange(len(size) + 1)).tolist()
    listed = number.tolist()
    digests = ["" if x else sha256(";".join([text[i] for i in listed[p:q]]).encode()).hexdigest() for x, p, q in zip(lost.tolist(), begin, begin[1:], strict=False)]
    distinct, local = np.unique(keys, return_inverse=True)
    take = gathered(at, n_pairs, number)
    mixed = np.repeat(doc, n_pairs[number]) * max(1, len(distinct)) + local[take]
    mixed, n = totals(mixed, times[take])
    block.add(ids, out, digests, np.bincount(mixed // max(1, len(distinct)), minlength=len(size)).astype(np.int64), distinct[mixed % max(1, len(distinct))], n)


def runs_of(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of about TOGETHER bytes."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for k, n in enumerate(size.tolist()):
        total += n
        if total >= TOGETHER:
            yield begin, k + 1
            begin, total = k + 1, 0
    if begin < len(size):
        yield begin, len(size)


def pieces_of(text: str, wide: int) -> Iterator[tuple[int, str]]:
    """(first byte, piece) of a space and text: each piece stands for a space and itself."""
    begin, at = 0, 0
    while True:
        target = (at // wide + 1) * wide - at  # bytes to the next range; a character has one at least
        m = CUT.search(text, min(len(text), begin + max(1, target)))
        piece = text[begin : m.start()] if m else text[begin:]
        yield at, piece
        if not m:
            return
        at += 1 + len(piece.encode())
        begin = m.end()


def ranged(t: Tokenizers, piece: str, begin: int, wide: int) -> Iterator[tuple[int, int, bool, Fragment]]:
    """(range, begin, ok, fragment) of a piece that begins at byte begin, for each byte range that its tokens end in."""
    made = t.encode(piece)
    if made is None:
        yield begin // wide, begin, False, Fragment()
        return
    a, b = made
    a_end, b_end = begin + np.cumsum(t.a_size[a]), begin + np.cumsum(t.b_size[b])
    last = int(a_end[-1])
    for k in range(begin // wide, (last - 1) // wide + 1):
        i, j = (np.searchsorted(x, [k * wide, (k + 1) * wide], "right") for x in (a_end, b_end))
        yield k, max(begin, k * wide), True, fragment(a[i[0] : i[1]], b[j[0] : j[1]], a_end[i[0] : i[1]], b_end[j[0] : j[1]])


def fragment_rows(rows: list[tuple[int, int, bool, Fragment]]) -> list[pa.Array]:
    ints = pa.list_(pa.int32())
    f = [r[3] for r in rows]
    out = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_()), pa.array([x.cut for x in f], pa.bool_())]
    out += [pa.array([getattr(x, c) for x in f], ints) for c in ("pa", "pb", "sa", "sb")]
    out += [pa.array([getattr(x, c) for x in f], pa.int64()) for c in Block.NUMBERS]
    return [*out, pa.array([x.spelled for x in f], pa.string()), *(pa.array([getattr(x, c) for x in f], pa.list_(pa.int64())) for c in ("keys", "times"))]


def read_fragments(table: pa.Table) -> list[tuple[int, int, bool, Fragment]]:
    def whole(x) -> np.ndarray:
        return x.values.to_numpy(zero_copy_only=False).astype(np.int64)

    out = []
    for k in range(table.num_rows):
        v = {c: table[c][k] for c in table.column_names}
        arrays = {c: whole(v[c]) for c in ("pa", "pb", "sa", "sb", "keys", "times")}
        out.append((v["k"].as_py(), v["begin"].as_py(), v["ok"].as_py(), Fragment(cut=v["cut"].as_py(), spelled=v["spelled"].as_py(), **{c: v[c].as_py() for c in Block.NUMBERS}, **arrays)))
    return sorted(out, key=lambda r: (r[1], r[0]))


def long_texts(docs: DataFrame, shared, s: Scratch, wide: int, id_type: str) -> DataFrame:
    """Block rows of docs (doc_id, text), whose pieces are encoded and composed in many tasks."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                for begin, piece in pieces_of(batch.column(2)[k].as_py(), wide):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([begin], pa.int64()), pa.array([piece], pa.string())], names=["key", "doc_id", "begin", "piece"])

    numbered = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    pieces = s.staged(numbered.mapInArrow(tidy(cut), f"key long, doc_id {id_type}, begin long, piece string"), "pieces")  # written, so that keys stay as they are

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tokenizers(*shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                rows = [*ranged(t, batch.column(3)[k].as_py(), batch.column(2)[k].as_py(), wide)]
                own = (batch.column(c).slice(k, 1).take(pa.array([0] * len(rows), pa.int64())) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([*own, *fragment_rows(rows)], names=names)

    schema = f"key long, doc_id {id_type}, {FRAGMENT}"
    names = docs.sparkSession.createDataFrame([], schema).columns
    made = pieces.repartition(partitions(docs.sparkSession), "key", "begin").mapInArrow(tidy(encoded), schema)

    def merge(table: pa.Table) -> pa.Table:
        rows = read_fragments(table)
        k, begin = rows[0][0] // FAN, rows[0][1]
        own = (table[c].combine_chunks().slice(0, 1) for c in ("key", "doc_id"))
        return pa.table([*own, *fragment_rows([(k, begin, all(r[2] for r in rows), compose([r[3] for r in rows]))])], names=names)

    ranges = (pieces.agg(F.max(F.col("begin") + F.octet_length("piece"))).first()[0] or 0) // wide + 1
    while True:
        made = made.groupBy("key", F.floor(F.col("k") / FAN).alias("_level")).applyInArrow(merge, schema)
        ranges = -(-ranges // FAN)
        if ranges <= 1:
            break

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            block = block or Block("l", batch.column(1).type)
            for k, (_, _, ok, f) in enumerate(read_unsorted(batch)):
                f = finished(f) if ok else Fragment()
                numbers = np.array([[f.n_a, f.n_b, f.n_groups, f.n_links]], np.int64)
                block.add(batch.column(1).slice(k, 1), numbers, [sha256(f.spelled.encode()).hexdigest() if ok else ""], np.array([len(f.keys)]), f.keys, f.times)
                yield from block.rows()
        if block:
            yield from block.rows(last=True)

    return made.mapInArrow(tidy(finish), block_schema(id_type))


def read_unsorted(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bool, Fragment]]:
    for k in range(batch.num_rows):
        yield read_fragments(pa.Table.from_batches([batch.slice(k, 1)]))[0]


def align(docs: DataFrame, a: str, b: bytes, text: str = "text", doc_id: str = "doc_id", wide: int = RANGE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    a: a byte-level BPE of the tokenizers library, as JSON; b: a sentencepiece model with byte fallback, whose pieces have spaces in front only.
    """
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast((a, b, as_ranks(a)))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = block = None
        for batch in batches:
            t, block = t or Tokenizers(*shared.value), block or Block("s", batch.column(0).type)
            ids, texts = batch.column(0), batch.column(1)
            for p, q in runs_of(texts):
                short_texts(t, ids.slice(p, q - p), texts.slice(p, q - p), block)
                yield from block.rows()
        if block:
            yield from block.rows(last=True)

    size = F.octet_length("text")
    with Scratch(spark) as s:
        blocks = rows.where(size <= wide).mapInArrow(tidy(short), block_schema(id_type))
        blocks = s.staged(blocks.unionByName(long_texts(rows.where(size > wide), shared, s, wide, id_type)), "blocks", **ALONE)
        held = blocks.select("block", F.posexplode(F.arrays_zip("keys", "n_docs")).alias("place", "x")).select("block", "place", F.col("x.keys").alias("key"), F.col("x.n_docs").alias("n"))
        counts = s.staged(held.groupBy("key").agg(F.sum("n").alias("n")), "pair-counts")
        best = counts.groupBy(F.shiftright("key", 32).alias("a")).agg(F.max("n").alias("most"))  # a row for each of A's ids at most
        told = counts.join(F.broadcast(best), F.shiftright("key", 32) == F.col("a")).select("key", F.col("n").alias("docs"), (F.col("n") == F.col("most")).alias("best"))
        answers = held.select(F.col("block").alias("of"), "place", "key").join(told, "key").select("of", "place", "docs", "best")
        own = blocks.drop("keys", "n_docs")
        out = own.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(scored, f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
        return staged(out, "aligned")


def scored(own: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of a block, with the corpus-wide counts of its pairs."""
    place = answers["place"].to_numpy()
    docs, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
    docs[place], best[place] = answers["docs"].to_numpy(), answers["best"].to_numpy()
    lists = {c: own[c].combine_chunks().flatten() for c in own.column_names if c != "block"}
    at, times, size = (lists[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("place", "times", "sizes"))
    sums = []
    for value in (best[at] * times, docs[at] * times):
        run = np.concatenate([[0], np.cumsum(value)])
        ends = np.cumsum(size)
        sums.append(run[ends] - run[ends - size])
    return pa.table([lists["ids"], *(lists[c] for c in Block.NUMBERS), *map(pa.array, sums), lists["digests"]], names=["doc_id", *Block.NUMBERS, "n_best", "count_sum", "groups_sha256"])


def public_tokenizers() -> tuple[str, bytes]:
    """Two installed public tokenizers, read on the driver."""
    import public_tokenizers as public

    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(public.path("piece_bpe_32k.model"), "rb") as g:
        return f.read(), g.read()
