"""Byte-level BPE encoding and decoding.

The merges are Spark higher-order functions: a word's bytes are an array of pieces, and a fold joins the adjacent pair of
lowest rank until no pair has a rank. Ranks come from a literal map of the whole vocabulary: SLOTS small maps, each of the
pieces whose checksum falls there. Words are counted over all documents, the fold encodes the most frequent distinct ones
(at most MOST_WORDS, of LONGEST characters at most), and their ids are broadcast. Tasks cut whole texts into words by the vocabulary's
pattern and put the words' ids in order; a word outside the broadcast is merged where it stands, as there are too many
such words for the interpreted fold: the new words of some megabytes of text together, one merge of each at a time. No text is shuffled. Decoding looks each id's bytes up in a literal array and
concatenates them.

Defined cases: a null text is encoded as an empty one, to no ids. Texts, words and ids may have any length.
Ids outside the vocabulary decode to nothing. No rows give no rows. A column that clashes with the new one gets to keep its name:
the new one takes underscores before its own.
"""

from __future__ import annotations

import base64
import binascii
import json
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, free_name, partitions, short_batches, tidy, top_words

#: Fixed value: the usual pattern, whose matches chunks() and plain_words() know; texts are matched whole by any other.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SLOTS = 1 << 12
MOST_WORDS = 200_000
LONGEST = 64  # characters of a word of the dictionary
MARKS = frozenset(".,;:!?")  # neither letters, numbers nor white space
NONE = (1 << 31) - 1
CACHED = 100_000  # chunks that a Python worker remembers
PIECE = 1 << 20  # characters of text in a piece of work, or one text
TOGETHER = 1 << 14  # words that are merged together
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file, read on the driver: a line holds a piece in base64 and its rank, which is its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(8)
def splitter(pattern: str) -> regex.Pattern:
    """pattern with white space as Unicode's property, whatever the library takes it for."""
    inside = regex.sub(r"\[(?:\\.|[^\]])*\]", lambda m: m[0].replace(r"\s", SPACE), pattern)
    return regex.compile(regex.sub(r"\\([sS])(?![^\[]*\])", lambda m: f"[{'^' * (m[1] == 'S')}{SPACE}]", inside))


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The literal map from pieces, in hexadecimal, to ranks: an array of SLOTS small maps, chosen by checksum."""
    slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    for piece, rank in ranks.items():
        key = piece.hex().upper()
        slots[binascii.crc32(key.encode()) % SLOTS][key] = rank
    return F.from_json(F.lit(json.dumps(slots, separators=(",", ":"))), "array<map<string, int>>")


def merged(words: Column, ranks: Column) -> Column:
    """The ids of each word in an array of words, by a fold over its bytes."""

    def of(slots: Column, piece: Column) -> Column:
        return F.try_element_at(F.get(slots, (F.crc32(piece.cast("binary")) % SLOTS).cast("int")), piece)

    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def counted(n: Column) -> Column:
        """1 to n, none if n is 0."""
        return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def step(slots: Column, s: Column) -> Column:
        p, r = s["p"], s["r"]

        def join(k: Column) -> Column:
            def with_pair(pair: Column) -> Column:
                left = F.when(k > 1, F.array(of(slots, F.concat(F.get(p, k - 2), pair)))).otherwise(F.array().cast("array<int>"))
                right = F.when(k < F.size(r), F.array(of(slots, F.concat(pair, F.get(p, k + 1))))).otherwise(F.array().cast("array<int>"))
                pieces = F.concat(F.slice(p, F.lit(1), k - 1), F.array(pair), F.slice(p, k + 2, F.size(p)))
                return F.struct(pieces.alias("p"), F.concat(F.slice(r, F.lit(1), F.greatest(k - 2, F.lit(0))), left, right, F.slice(r, k + 2, F.size(r))).alias("r"))

            return let(F.concat(F.get(p, k - 1), F.get(p, k)), with_pair)

        return let(F.array_min(r), lambda best: F.when(best.isNull(), s).otherwise(let(F.array_position(r, best).cast("int"), join)))

    def one(slots: Column, x: Column) -> Column:
        n = (F.length(x) / 2).cast("int")
        start = F.struct(F.transform(counted(n), lambda i: F.substring(x, 2 * i - 1, F.lit(2))).alias("p"), F.transform(counted(n - 1), lambda i: of(slots, F.substring(x, 2 * i - 1, F.lit(4)))).alias("r"))
        return F.transform(F.aggregate(counted(n - 1), start, lambda s, _: step(slots, s))["p"], lambda q: of(slots, q))

    return let(ranks, lambda slots: F.transform(F.transform(words, lambda w: F.hex(F.encode(w, "UTF-8"))), lambda x: one(slots, x)))


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes that ids stand for."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    table = F.split(F.lit("|".join(pieces)), "[|]")
    return F.unhex(F.get(F.transform(F.array(table), lambda t: F.array_join(F.transform(ids, lambda i: F.get(t, i)), "")), F.lit(0)))


@lru_cache(8)
def finder(pattern: str) -> Callable[[str], list[str]]:
    """The matches of pattern in a text, whole and in order."""
    compiled = splitter(pattern)
    return compiled.findall if pattern == USUAL else lambda text: [m[0] for m in compiled.finditer(text) if m[0]]


def cutter(pattern: str) -> Callable[[str], list[str] | None]:
    return chunks if pattern == USUAL else lambda text: None


#: White space other than the space, and what shows in a text that some of it lies beside a space.
OTHER = [chr(c) for c in (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
MEETINGS = {c: (f" {c}", f"{c} ") for c in OTHER}


def chunks(text: str) -> list[str] | None:
    """text cut at its spaces, where the pieces, each with its space before it, can be matched alone; None if they can't be.

    The pattern's matches end at every space that has no white space beside it, and take that space with what follows.
    """
    if "  " in text or any(a in text or b in text for c, (a, b) in MEETINGS.items() if c in text):
        return None
    return text.split(" ")


def plain_words(chunk: str, find) -> list[str]:
    """The words of a space and a chunk. Letters, with a mark after them or not, need no pattern: it takes them so."""
    if chunk.isalpha():
        return [" " + chunk]
    if chunk[-1:] in MARKS and chunk[:-1].isalpha():
        return [" " + chunk[:-1], chunk[-1]]
    return find(" " + chunk)


def pieces(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in runs of about PIECE characters; a null one is empty."""
    some, size = [], 0
    for t in texts:
        some.append(t.as_py() or "")
        size += len(some[-1])
        if size >= PIECE:
            yield some
            some, size = [], 0
    if some:
        yield some


def after_first(texts: list[str]) -> pa.ListArray:
    """The chunks of each text but its first one."""
    return pc.list_slice(pc.split_pattern(pa.array(texts, pa.string()), " "), 1)


def chunk_words(seen: pa.StructArray, whole: Counter, find: Callable[[str], list[str]]) -> pa.RecordBatch:
    """word, n: the words of counted chunks, as plain_words() takes them, and those of whole. Most chunks are letters, with a mark or not: Arrow takes these together."""
    chunk, n = seen.field(0), seen.field(1)
    plain = pc.utf8_is_alpha(chunk)
    words, counts = [chunk.filter(plain)], [n.filter(plain)]
    chunk, n = (x.filter(pc.invert(plain)) for x in (chunk, n))
    stem, mark = pc.utf8_slice_codeunits(chunk, 0, -1), pc.utf8_slice_codeunits(chunk, -1)
    marked = pc.and_(pc.utf8_is_alpha(stem), pc.is_in(mark, pa.array(sorted(MARKS))))
    words.append(stem.filter(marked))
    counts.append(n.filter(marked))
    for m, k in zip(mark.filter(marked).to_pylist(), n.filter(marked).to_pylist(), strict=True):
        whole[m] += k
    rest = pc.invert(marked)
    for c, k in zip(chunk.filter(rest).to_pylist(), n.filter(rest).to_pylist(), strict=True):
        for w in plain_words(c, find):
            whole[w] += k
    spaced = pc.binary_join_element_wise("", pa.concat_arrays(words), " ")
    both = pa.table({"word": pa.concat_arrays([spaced, pa.array(list(whole), pa.string())]), "n": pa.concat_arrays([*counts, pa.array(list(whole.values()), pa.int64())])})
    sums = both.group_by("word", use_threads=False).aggregate([("n", "sum")])
    return pa.RecordBatch.from_pydict({"word": sums["word"].combine_chunks(), "n": sums["n_sum"].combine_chunks()})


def word_counts(docs: DataFrame, pattern: str) -> DataFrame:
    """word, n over all of docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, cut = finder(pattern), cutter(pattern)
        for batch in batches:
            for some in pieces(batch.column("text")):
                whole, plain = Counter(), []
                for t in some:
                    c = cut(t)
                    if c is None:
                        whole.update(find(t))
                    else:
                        plain.append(t)
                        whole.update(find(c[0]))
                yield chunk_words(pc.value_counts(after_first(plain).flatten()), whole, find)

    return docs.select("text").mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Pairs:
    """The pairs of ids that a vocabulary merges, sorted, with the ids that they become; and the ids of single bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, ids = array("q"), array("i")
        for p, r in ranks.items():
            for i in range(1, len(p)):
                if p[:i] in ranks and p[i:] in ranks:
                    keys.append(ranks[p[:i]] << 32 | ranks[p[i:]])
                    ids.append(r)
        keys.append(1 << 62)
        ids.append(NONE)
        order = np.argsort(np.frombuffer(keys, dtype=np.int64), kind="stable")
        self.keys, self.ids = np.frombuffer(keys, dtype=np.int64)[order], np.frombuffer(ids, dtype=np.int32)[order]
        self.bytes = np.array([ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int32)

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ids that a and b become (which are the ranks of their merges), NONE where they don't merge or one is no id."""
        key = np.where((a >= 0) & (b >= 0), a.astype(np.int64) << 32 | b, 1 << 62)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ids[at], np.int32(NONE))


def fold_words(words: list[bytes], pairs: Pairs) -> list[bytes]:
    """The ids of words, of LONGEST bytes at most, as bytes of 32-bit numbers: the same merges, for words outside the dictionary."""
    out: list[bytes] = [b""] * len(words)
    size = np.array([*map(len, words)], dtype=np.int64)
    for least, most in ((0, 8), (8, 16), (16, LONGEST)):
        every = np.flatnonzero((size > least) & (size <= most))
        for begin in range(0, len(every), TOGETHER):
            no = every[begin : begin + TOGETHER]
            ids = np.full((len(no), most), -1, dtype=np.int32)
            ids[np.arange(most) < size[no, None]] = pairs.bytes[np.frombuffer(b"".join([words[i] for i in no]), dtype=np.uint8)]
            for i, made in fold_together(no, ids, pairs):
                out[i] = made
    return out


def fold_together(no: np.ndarray, ids: np.ndarray, pairs: Pairs) -> Iterator[tuple[int, bytes]]:
    """(number, ids) of words of about the same length, a row of ids each, filled up with -1.

    Every round makes one merge in each word that has one left, so all of them get shorter by one together.
    """
    rank = pairs.merge(ids[:, :-1], ids[:, 1:])
    while len(no):
        rows, width = np.arange(len(no)), ids.shape[1]
        k = rank.argmin(axis=1) if width > 1 else np.zeros(len(no), dtype=np.int64)
        best = rank[rows, k] if width > 1 else np.full(len(no), NONE)
        done = best == NONE
        for i, row, n in zip(no[done], ids[done], (ids[done] >= 0).sum(axis=1), strict=True):
            yield i, row[:n].tobytes()
        no, ids, rank, k, best = no[~done], ids[~done], rank[~done], k[~done], best[~done]
        if not len(no):
            return
        rows, col = np.arange(len(no)), np.arange(width - 1)
        ids[rows, k] = best
        ids = np.take_along_axis(ids, col + (col > k[:, None]), axis=1)
        rank = np.take_along_axis(rank, col[:-1] + (col[:-1] >= k[:, None]), axis=1)
        for at, live in ((k - 1, k > 0), (k, k < width - 2)):
            rank[rows[live], at[live]] = pairs.merge(ids[rows[live], at[live]], ids[rows[live], at[live] + 1])


def fold_long_word(word: bytes, ranks: dict[bytes, int]) -> bytes:
    """The ids of one word of any length, by a heap of pairs."""
    n = len(word)
    parts: list[bytes] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    heap = [(r, i, 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, size = heappop(heap)
        j = after[i]
        if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != size:
            continue  # one of the two has been merged since
        pair = parts[i] = parts[i] + parts[j]
        parts[j] = b""
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := get(pair + parts[k])) is not None:
                heappush(heap, (r, i, len(pair) + len(parts[k])))
        h = before[i]
        if h >= 0 and (r := get(parts[h] + pair)) is not None:
            heappush(heap, (r, h, len(parts[h]) + len(pair)))
    return np.array([ranks[p] for p in parts if p], dtype=np.int32).tobytes()


class Dictionary:
    """The ids of broadcast words as bytes of 32-bit numbers, and what a Python worker has made of chunks with them."""

    def __init__(self, words: dict[str, bytes], ranks: dict[bytes, int], pairs: Pairs, pattern: str):
        self.words, self.ranks, self.pairs, self.find, self.cut = words, ranks, pairs, finder(pattern), cutter(pattern)
        self.cache: dict[str, bytes] = {}

    def fold(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words that are not in the dictionary."""
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        made = fold_words([w if len(w) <= LONGEST else b"" for w in coded], self.pairs)
        return {w: m or fold_long_word(c, self.ranks) for w, c, m in zip(words, coded, made, strict=True)}

    def joined(self, split: list[list[str]]) -> list[bytes]:
        """The ids of each list of words."""
        known = self.words
        new = self.fold([*{w for ws in split for w in ws if w not in known}])
        return [b"".join([known.get(w) or new[w] for w in ws]) for ws in split]

    def chunk_ids(self, found: list[str]) -> list[bytes]:
        """The ids of each of distinct chunks, with a space before it."""
        known, cache, find = self.words, self.cache, self.find
        out = [(c.isalpha() and known.get(" " + c)) or cache.get(c) for c in found]
        new = [i for i, x in enumerate(out) if x is None]
        made = self.joined([plain_words(found[i], find) for i in new])
        if len(cache) + len(new) > CACHED:
            cache.clear()
        for i, x in zip(new, made, strict=True):
            out[i] = x
            if len(cache) < CACHED:
                cache[found[i]] = x
        return out

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has.

        Entries are each distinct chunk's ids, and for every text those of its first chunk, or of all of it if it can't be cut.
        """
        cut = [self.cut(t) for t in texts]
        heads = self.joined([self.find(t if c is None else c[0]) for t, c in zip(texts, cut, strict=True)])
        rest = after_first(["" if c is None else t for t, c in zip(texts, cut, strict=True)])
        flat = rest.flatten().dictionary_encode()
        entries = [*self.chunk_ids(flat.dictionary.to_pylist()), *heads]
        size = np.fromiter((len(e) >> 2 for e in entries), dtype=np.int64, count=len(entries))
        begin, ids = np.cumsum(size) - size, np.frombuffer(b"".join(entries), dtype=np.int32)
        chunks_of = rest.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.cumsum(chunks_of) - chunks_of
        order = np.insert(flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), at, len(flat.dictionary) + np.arange(len(texts)))
        take = size[order]
        ends = np.cumsum(take)
        place = np.repeat(begin[order] - (ends - take), take) + np.arange(int(take.sum()))
        bounds = np.concatenate([[0], ends])
        first = at + np.arange(len(texts))
        return ids[place], bounds[first + chunks_of + 1] - bounds[first]


def dictionary_rows(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most: int = MOST_WORDS) -> pa.Table:
    """The most frequent words of docs (text) with their ids, made by the fold: words, ids, a list of them in each row."""
    spark = docs.sparkSession
    with Scratch(spark) as s:
        counts = s.staged(word_counts(docs, pattern), "word-counts")
        top = top_words(counts.where(F.length("word") <= LONGEST), most)
        parts = partitions(spark)
        some = top.select("word").repartition(parts).groupBy(F.pmod(F.xxhash64("word"), F.lit(512))).agg(F.collect_list("word").alias("words")).repartition(parts)  # MOST_WORDS / 512 words each
        some = s.staged(some, "words")  # so the plan with the literal has one stage: it would be described anew, some megabytes each time, after every stage before it
        return some.select("words", merged(F.col("words"), rank_map(ranks)).alias("ids")).toArrow()


class Words:
    """dictionary_rows(), sent as columns; a Python worker makes objects of them once."""

    def __init__(self, rows: pa.Table):
        self.rows = rows

    @cached_property
    def known(self) -> dict[str, bytes]:
        """The words with their ids as bytes."""
        known = {}
        for batch in self.rows.to_batches():
            ids = batch.column("ids").flatten()
            ends = np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64) * 4).tolist()
            raw, begin = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32).tobytes(), 0
            for w, end in zip(batch.column("words").flatten().to_pylist(), ends, strict=True):
                known[w] = raw[begin:end]
                begin = end
        return known


def dictionary(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most: int = MOST_WORDS) -> dict[str, bytes]:
    """The most frequent words of docs (text) with their ids, made by the fold."""
    return Words(dictionary_rows(docs, ranks, pattern, most)).known


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the ids of each text, in a last column."""
    ids = free_name(docs, ids)
    short_batches(docs.sparkSession)
    known = dictionary_rows(docs.select(F.col(text).alias("text")), ranks, pattern)  # stays columns on the driver: as objects the words would take ten times as much, and pickling them as much again
    shared, kept, at = docs.sparkSession.sparkContext.broadcast((Words(known), ranks, Pairs(ranks))), list(docs.columns), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, *own = shared.value
        d = Dictionary(words.known, *own, pattern)
        for batch in batches:
            done = 0
            for some in pieces(batch.column(at)):
                made, size = d.ids(some)
                made = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *size]), pa.int32()), pa.array(made, pa.int32()))
                own = batch.slice(done, len(some))
                yield pa.RecordBatch.from_arrays([*own.columns, made], names=[*kept, ids])
                done += len(some)

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of an installed public vocabulary, read on the driver."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id with counts and digests of the ids and of the bytes that they decode to."""
    out = encode(docs.select("doc_id", "text"), ranks, pattern)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2(decoded(F.col("ids"), ranks), 256).alias("decoded_sha256"))
