"""Exact Jaccard self-join of shingle sets that skips by set relations.

Shingles are ordered from rare to frequent, by counts over all documents in a table of SLOTS counters (so roughly, which
costs time only: any order is right), and by hash where those are alike. The index lists hold a set under its first shingles: so many that
two linked sets share one of them. An entry has the set's size and the shingle's position in it, lists are sorted by size, and two
entries meet only where sizes and positions leave room for enough common shingles after them. So a list is skipped through in runs
of sizes and positions, and frequent shingles have no lists to speak of.

Set relations save the rest. Equal sets are one set from the start. In lists of more than LIGHT entries (of like sizes) a
set is compared with the list's leader first, which gives the shingles that it differs in from the leader. Where all sets of a leader
are linked with it, its answers are theirs and no pair of them is compared. Elsewhere their intersections are derived from the leader's
answers: two sets R and T of leader S have |S| - |S-R| - |S-T| + |RxS and TxS| shingles in common, where RxS are those that R and S differ in,
so only the few differing shingles are sent and multiplied, as matrices, in bounded blocks. A set that differs from the leader in more than twice what links may
differ in is compared by its whole set with others like it; one below that and one above three times it are never compared, as they can't be
linked. Only links that connect components come out of blocks, so no group is expanded into its pairs as rows.

The last step still takes time with the square of the number of sets that are much alike, but not linked with their leader.
Shingles are told apart by 64-bit hashes; "exact" holds unless two of those collide.

Defined cases: null and empty texts have no shingles, and are linked with nothing. Rows that repeat an id
are one document, of which one row is compared; a null id has a null component. No rows give no rows. Other columns of docs play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, by_key, free_name, short_batches, staged, tidy

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
CHUNK = 1 << 18  # characters of text in a piece of work, or one text
SALTS = 256
BROADCAST_IDS = 1_000_000  # more documents in lists than this are joined with their texts by shuffle
SLOTS, SLOT_BITS, PART = 1 << 24, 24, 1 << 18  # counters of shingles, and how many of them go in a row
FULL = (1 << 16) - 1  # a task writes its counters and begins anew before one exceeds this
GRADE = 1.15  # counts that differ by less than this factor are taken as alike
LIGHT = 16  # lists of so many entries at most are compared entry by entry; in longer ones leaders settle what they can first
FEW = 5_000  # edges that one task connects
BLOCK, ROWS = 200_000, 512  # shingles, and sets, that are compared at once with another such block


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p = np.ones((2, n), dtype=U)
    p[0, 1:], p[1, 1:] = U(BASE), U(pow(BASE, -1, 1 << 64))
    return np.cumprod(p[0]), np.cumprod(p[1])


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of all words: runs of bytes other than 9 to 13 and 32, with A-Z in lower case."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([b"", *parts, b""]), dtype=np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    a, b = edge[::2], edge[1::2]
    up, down = powers(1 << max(len(data) - 1, 1).bit_length())
    value = mixed(np.arange(256, dtype=U) + U(1))[data] * up[: len(data)]
    sums = np.concatenate([np.zeros(1, dtype=U), np.cumsum(value)])
    h = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(U))
    starts = np.cumsum([1, *(len(p) + 1 for p in parts)])[:-1]
    return np.searchsorted(starts, a, "right") - 1, h


def sets_of(texts: list[str], k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles; all words as one shingle, if they are fewer."""
    owner, h = word_hashes(texts)
    count = np.bincount(owner, minlength=len(texts)).astype(int)
    first = np.concatenate([[0], np.cumsum(count)])
    s = mixed(h)
    for j in range(1, k):
        s = mixed(s[: len(h) - j] + h[j:] * U(3)) if len(h) > j else s[:0]
    out = []
    for i, n in enumerate(count):
        if n >= k:
            out.append(np.unique(s[first[i] : first[i] + n - k + 1]))
        elif n:
            x = np.array([n], dtype=U)
            for w in h[first[i] : first[i] + n]:
                x = mixed(x * U(5) + w)
            out.append(x)
        else:
            out.append(np.zeros(0, dtype=U))
    return out


def pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts) in runs of about CHUNK characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


class Threshold:
    """Sets link when den * intersection >= num * union."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the threshold must be over 0 and at most 1")
        self.num, self.den = num, den

    def links(self, inter, a, b):
        return self.den * inter >= self.num * (a + b - inter)

    def need(self, a, b):
        """The least intersection of linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """So many shingles of a set of n share one with every linked set's first ones."""
        return n - self.need(n, -(-self.num * n // self.den)) + 1

    def meet(self, na, pa, nb, pb):
        """Whether sets of sizes na <= nb can be linked if a shingle at these positions is the first that they share."""
        need = self.need(na, nb)
        return (self.den * na >= self.num * nb) & (pa <= na - need) & (pb <= nb - need)

    def bands(self) -> list[int]:
        """Least sizes of the bands: a linked set is in a set's own band or in one beside it."""
        e = [1]
        while e[-1] < 1 << 40:
            e.append(e[-1] * self.den // self.num + 1)
        return e

    def differ(self, n):
        """The most shingles that two linked sets differ in, if their sizes are at most two bands above n."""
        return 2 * (n * self.den * self.den / (self.num * self.num) + self.den / self.num + 2) * (self.den - self.num) / (self.den + self.num)


def packed(counts: np.ndarray) -> bytes:
    """Counters as bytes: the distances of those that are not 0, and their values."""
    at = np.flatnonzero(counts)
    gaps = np.diff(at, prepend=0).astype(np.int32)
    return zlib.compress(gaps.tobytes() + counts[at].astype(np.int64).tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of packed() counters."""
    data = zlib.decompress(data)
    n = len(data) // 12
    return np.cumsum(np.frombuffer(data, dtype=np.int32, count=n)), np.frombuffer(data[4 * n :], dtype=np.int64)


def described(docs: DataFrame, k: int) -> DataFrame:
    """Rows of documents: doc_id, n and a 128-bit key of the set; and rows of counters: part, counts, of the shingles that a task saw."""

    def counters(seen: np.ndarray) -> pa.RecordBatch:
        rows = [(p, packed(seen[p * PART : (p + 1) * PART])) for p in range(SLOTS // PART)]
        zeros = pa.array([0] * len(rows), pa.int64())
        return pa.RecordBatch.from_pydict({"doc_id": pa.nulls(len(rows), pa.int64()), "n": zeros, "k1": zeros, "k2": zeros, "part": pa.array([p for p, _ in rows], pa.int32()), "counts": pa.array([c for _, c in rows], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, most = np.zeros(SLOTS, dtype=np.uint16), 0  # most: what no counter exceeds
        for b in batches:
            for at, some in pieces([x or "" for x in b.column("text").to_pylist()]):
                sets = sets_of(some, k)
                slots, n = np.unique(np.concatenate(sets) >> U(64 - SLOT_BITS), return_counts=True)
                n = np.minimum(n, FULL)
                top = int(n.max(initial=0))
                if most + top > FULL:
                    yield counters(seen)
                    seen[:], most = 0, 0
                seen[slots.astype(np.int64)] += n.astype(np.uint16)
                most += top
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column("doc_id").slice(at, len(some)),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "k1": pa.array([int(mixed(s + U(1)).sum(dtype=U).view(np.int64)) for s in sets], pa.int64()),
                    "k2": pa.array([int(mixed(s ^ U(BASE)).sum(dtype=U).view(np.int64)) for s in sets], pa.int64()),
                    "part": pa.array([-1] * len(some), pa.int32()),
                    "counts": pa.nulls(len(some), pa.binary()),
                })
        if most:
            yield counters(seen)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n long, k1 long, k2 long, part int, counts binary")


def ranks(counted: DataFrame) -> np.ndarray:
    """For every slot the grade of its count, from the tasks' counters: SLOTS bytes, whatever the input."""

    def totals(finish):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("part", "some", "counts")), strict=True))
            for (part, _), same in groupby(rows, key=lambda r: r[:2]):
                out = np.zeros(PART, dtype=np.int64)
                for *_, c in same:
                    at, n = unpacked(c)
                    out[at] += n
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "some": pa.array([0], pa.int32()), "counts": pa.array([finish(out)], pa.binary())})

        return tidy(run)

    def grades(total: np.ndarray) -> bytes:
        return np.ceil(np.log(total + 1) / np.log(GRADE)).astype(np.uint8).tobytes()

    rows = counted.where("part >= 0").select("part", F.pmod(F.xxhash64("counts"), F.lit(16)).cast("int").alias("some"), "counts")
    by, schema = ("part", "some"), "part int, some int, counts binary"
    sums = rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(totals(packed), schema)
    out = np.zeros(SLOTS, dtype=np.uint8)
    for r in sums.repartition("part").sortWithinPartitions("part").mapInArrow(totals(grades), schema).toLocalIterator():
        out[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["counts"], dtype=np.uint8)
    return out


def first_shingles(sets: list[np.ndarray], rank: np.ndarray, t: Threshold) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(list, size, position, number of the set) of the shingles that sets are listed under."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=U)
    owner = np.repeat(np.arange(len(sets)), n)
    o = np.lexsort((flat, rank[(flat >> U(64 - SLOT_BITS)).astype(np.int64)], owner))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    keep = at < np.repeat(t.prefix(n), n)
    return flat[o][keep].view(np.int64), n[owner[keep]], at[keep], owner[keep]


def entries_of(docs: DataFrame, rank: np.ndarray, t: Threshold, k: int) -> DataFrame:
    """(list, n, at, member): the index lists that each document is in."""
    shared = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = whole(b.column("doc_id"))
            for at, some in pieces([x or "" for x in b.column("text").to_pylist()]):
                lists, n, place, owner = first_shingles(sets_of(some, k), shared.value, t)
                yield pa.RecordBatch.from_pydict({"list": pa.array(lists), "n": pa.array(n, pa.int32()), "at": pa.array(place, pa.int32()), "member": pa.array(ids[at + owner])})

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(tidy(run), "list long, n int, at int, member long")


def whole(column: pa.Array) -> np.ndarray:
    """A column of numbers without nulls."""
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def arrays(column: pa.ListArray) -> list[np.ndarray]:
    """A column of arrays of numbers without nulls."""
    return np.split(column.flatten().to_numpy(zero_copy_only=False), np.cumsum(whole(column.value_lengths()))[:-1]) if len(column) else []


def meetings(lists: np.ndarray, n: np.ndarray, at: np.ndarray, ids: np.ndarray, t: Threshold, most: int) -> np.ndarray:
    """Distinct pairs (less id, greater id) of entries that can be linked; they are sorted by list and size, and a list has most of them at most."""
    found = [np.zeros((0, 2), dtype=np.int64)]
    i = np.arange(len(lists))
    for lag in range(1, most):
        i = i[i + lag < len(lists)]
        i = i[lists[i] == lists[i + lag]]  # an entry with no partner at a lag has none at greater ones
        if not len(i):
            break
        j = i + lag
        hit = t.meet(n[i], at[i], n[j], at[j]) & (ids[i] != ids[j])
        found.append(np.stack([np.minimum(ids[i[hit]], ids[j[hit]]), np.maximum(ids[i[hit]], ids[j[hit]])], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def light_pairs(entries: DataFrame, t: Threshold, most: int = LIGHT) -> DataFrame:
    """Pairs (a, b) from lists of `most` entries at most; and rows (list, n, at, a) of the other lists, and of those at the edge of a task.

    Lists are dealt out by ranges of (list, size, position, id), so a long one goes to several tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("list", "n", "at", "member")
        tail = [np.zeros(0, dtype=np.int64)] * 4
        first = last = None  # the task's first list, and one that is known to be long

        def rows_of(lists, n, at, a, b) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"list": pa.array(lists), "n": pa.array(n, pa.int32()), "at": pa.array(at, pa.int32()), "a": pa.array(a), "b": b})

        def left(rows: list[np.ndarray]) -> pa.RecordBatch:
            return rows_of(*rows, pa.nulls(len(rows[0]), pa.int64()))

        for batch in batches:
            rows = [np.concatenate([x, whole(batch.column(c))]) for x, c in zip(tail, columns, strict=True)]
            if not len(rows[0]):
                continue
            lists = rows[0]
            first = lists[0] if first is None else first
            start = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
            size = np.diff([*start, len(lists)])
            long = (size > most) | (lists[start] == first) | ((lists[start] == last) if last is not None else False)
            if long[-1]:
                last = lists[-1]
            long, ends = np.repeat(long, size), lists == lists[-1]
            out, now = long, ~long & ~ends
            tail = [x[~long & ends] for x in rows]  # may go on in the next batch
            if out.any():
                yield left([x[out] for x in rows])
            pairs = meetings(*(x[now] for x in rows), t, most)
            none = np.zeros(len(pairs), dtype=np.int64)
            yield rows_of(none, none, none, pairs[:, 0], pa.array(pairs[:, 1]))
        if len(tail[0]):
            yield left(tail)

    by = ("list", "n", "at", "member")
    return entries.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(tidy(run), "list long, n int, at int, a long, b long").distinct()


def rest_pairs(left: DataFrame, t: Threshold, s: Scratch, most: int = LIGHT) -> DataFrame:
    """(a, b, star) of the lists in left (list, n, at, member): all pairs of short ones, and of long ones those of a leader and a member.

    Entries of a long list are taken by band of sizes, and meet those of their own band and of the next ones to it.
    """
    size = left.groupBy("list").agg(F.count("*").alias("entries"))
    own = s.staged(left.join(size, "list"), "left")
    short = own.where(F.col("entries") <= most)
    x, y = (short.select("list", F.col("n").alias(f"n{i}"), F.col("at").alias(f"p{i}"), F.col("member").alias(f"m{i}")) for i in (1, 2))
    need = F.ceil(t.num * (F.col("n1") + F.col("n2")) / F.lit(t.num + t.den))
    both = x.join(y, "list").where((F.col("m1") < F.col("m2")) & (F.col("p1") <= F.col("n1") - need) & (F.col("p2") <= F.col("n2") - need))
    pairs = both.select(F.col("m1").alias("a"), F.col("m2").alias("b"), F.lit(False).alias("star")).distinct()
    band = F.size(F.filter(F.lit(t.bands()), lambda e: e <= F.col("n")))
    long = own.where(F.col("entries") > most).select("list", "member", F.explode(F.array(band, band + 1)).alias("scheme"))
    led = long.groupBy("list", "scheme").agg(F.min("member").alias("leader"), F.max("member").alias("other")).where("leader != other").drop("other")
    stars = long.join(led, ["list", "scheme"]).where("leader != member").select(F.col("leader").alias("a"), F.col("member").alias("b"), F.lit(True).alias("star")).distinct()
    return pairs.unionByName(stars)


def counted(s: np.ndarray) -> bytes:
    """How many of the sorted hashes begin with which bits: a byte for each of about n / 4 values; none if a count exceeds a byte."""
    bits = max(6, (len(s) // 4).bit_length())
    c = np.bincount((s >> U(64 - bits)).astype(np.int64), minlength=1 << bits)
    return c.astype(np.uint8).tobytes() if c.max(initial=0) < 256 else b""


def apart_at_least(x: bytes, y: bytes) -> int:
    """A lower bound of the number of shingles that two sets differ in, from their counted()."""
    if not x or not y:
        return 0
    c, d = (np.frombuffer(z, dtype=np.uint8).astype(np.int64) for z in (x, y))
    n = min(len(c), len(d))
    return int(np.abs(c.reshape(n, -1).sum(axis=1) - d.reshape(n, -1).sum(axis=1)).sum())


def beside(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """pairs (a, b, ...) with the column of sets for both, as x and y. That of a goes along once for each salt of its pairs, so a leader of many is no hot key."""
    p = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    left = p.select("a", "salt").distinct().join(sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col(column).alias("x")), "a")
    right = p.join(sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col(column).alias("y")), "b")
    return right.join(left, ["a", "salt"]).select(*pairs.columns, "na", "nb", "x", "y")


def told_apart(pairs: DataFrame, counts: DataFrame, t: Threshold) -> DataFrame:
    """(a, b, star, na, nb, least, close) of the pairs (a, b, star) that counts (doc_id, n, counts) do not tell too far apart, and of all stars.

    least: a lower bound of the number of shingles that the sets differ in. close: whether the sets themselves must be compared.
    """

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *own, x, y = batch.columns
            found = [apart_at_least(a, b) for a, b in zip(x.to_pylist(), y.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(found, pa.int32())], names=["a", "b", "star", "na", "nb", "least"])

    told = beside(pairs, counts, "counts").mapInArrow(tidy(least), "a long, b long, star boolean, na int, nb int, least int")
    most = F.col("na") + F.col("nb") - 2 * F.ceil(t.num * (F.col("na") + F.col("nb")) / F.lit(t.num + t.den))
    close = (F.col("least") <= most) | (F.col("star") & (F.col("least") <= 3 * t.differ(F.col("na"))))
    return told.where(F.col("star") | close).withColumn("close", close)


def compared(told: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """(a, b, star, na, nb, inter, apart, items, linked) of told_apart()'s pairs.

    inter: the size of the intersection; apart: in how many shingles they differ. items, for stars: what b differs in from a, if that
    is no more than three times what links may differ in. For pairs that are not close inter is null and apart a lower bound.
    """

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *own, x, y = batch.columns
            x, y, star = arrays(x), arrays(y), own[2].to_pylist()
            inter = np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(x, y, strict=True)], dtype=np.int32)
            size = np.array([len(a) + len(b) for a, b in zip(x, y, strict=True)], dtype=np.int32)
            items = [np.setxor1d(a, b, assume_unique=True) if s and d <= 3 * t.differ(len(a)) else None for a, b, d, s in zip(x, y, size - 2 * inter, star, strict=True)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(inter, pa.int32()), pa.array(size - 2 * inter, pa.int32()), pa.array(items, pa.list_(pa.int64()))], names=["a", "b", "star", "na", "nb", "inter", "apart", "items"])

    near = beside(told.where("close").select("a", "b", "star"), sets, "hashes").mapInArrow(tidy(common), "a long, b long, star boolean, na int, nb int, inter int, apart int, items array<long>")
    far = told.where("not close").select("a", "b", "star", "na", "nb", F.lit(None).cast("int").alias("inter"), F.col("least").alias("apart"), F.lit(None).cast("array<long>").alias("items"))
    return near.withColumn("linked", t.links(F.col("inter"), F.col("na"), F.col("nb"))).unionByName(far.withColumn("linked", F.lit(False)))


def components(edges: DataFrame, keep: Scratch) -> DataFrame:
    """(id, component), the smallest id reachable, for every id in edges (a, b).

    Each round every node joins the node of least hash among itself and its neighbours, and the edges are contracted to
    these; a constant share of the nodes goes with every round, however long the paths are. The last FEW edges are connected in one task.
    """
    with Scratch(edges.sparkSession) as s:
        left = s.staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "edges")
        labels, seed, n = None, 0, left.count()

        def moved(step: DataFrame) -> DataFrame:
            """labels after their components have moved by step (id, to)."""
            if labels is None:
                return step.select("id", F.col("to").alias("component"))
            return labels.join(step.select(F.col("id").alias("component"), "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))

        while n > FEW:
            seed += 1
            both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
            near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64(F.lit(seed), "b").alias("h"), F.col("b").alias("to"))).alias("n"))
            own = F.struct(F.xxhash64(F.lit(seed), "a").alias("h"), F.col("a").alias("to"))
            step = s.staged(near.select(F.col("a").alias("id"), F.least("n", own)["to"].alias("to")), "steps")
            labels = s.staged(moved(step), "labels")
            ends = left.join(step.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
            left = s.staged(ends.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
            n = left.count()
        if n:
            labels = s.staged(moved(left.select("a", "b").coalesce(1).mapInArrow(connected, "id long, to long")), "labels")
        if labels is None:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
        least = labels.groupBy("component").agg(F.min("id").alias("least"))
        return keep.staged(labels.join(least, "component").select("id", F.col("least").alias("component")), "components")


def connected(edges: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, to): for every id in edges (a, b), of one task, the least one that it is connected with."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while (p := root.setdefault(v, v)) != v:
            root[v] = root[p]
            v = p
        return v

    for batch in edges:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_pydict({"id": pa.array([*root], pa.int64()), "to": pa.array([find(v) for v in root], pa.int64())})


def join_sets(docs: DataFrame, num: int = 80, den: int = 100, k: int = 5, text: str = "text", doc_id: str = "doc_id", light: int = LIGHT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; documents link when den * intersection >= num * union of their k-word shingles."""
    t = Threshold(num, den)
    short_batches(docs.sparkSession)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with Scratch(docs.sparkSession) as s:
        told = s.staged(described(own, k), "sets")
        rank = ranks(told)
        told = told.where("part < 0")
        classes = s.staged(told.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep")), "classes")
        rep = told.join(classes, ["k1", "k2", "n"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"))
        rep = s.staged(rep, "rep")
        # only the least of equal sets is listed: it stands for its class
        copies = rep.where("doc_id != rep").select("doc_id").distinct()
        if not rep.where("doc_id = rep").groupBy("doc_id").count().where("count > 1").isEmpty():
            own = own.dropDuplicates(["doc_id"])
        found = components(linked(joined(own, copies, "left_anti", s), rank, t, k, s, light), s)
        return staged(rep.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")), "joined")


def drop_near_copies(docs: DataFrame, num: int = 80, den: int = 100, k: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without those that links connect with a smaller id; empty texts and rows without an id stay. Few ids are broadcast, so that no texts are shuffled."""
    name = free_name(docs, "gone")
    found = join_sets(docs, num, den, k, text, doc_id)
    gone = staged(found.where("component_id is not null and doc_id != component_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, docs[doc_id].cast("long") == F.col(name), "left_anti")


def joined(own: DataFrame, ids: DataFrame, how: str, s: Scratch) -> DataFrame:
    """Texts with ids in ids (doc_id), or without; few ids are broadcast."""
    ids = s.staged(ids, "ids")
    return own.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def hashed(own: DataFrame, pairs: DataFrame, k: int, s: Scratch, column: str) -> DataFrame:
    """doc_id, n and the column (counts: counted() of the set; hashes: the set) of the documents in pairs (a, b)."""

    kind = pa.binary() if column == "counts" else pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, some in pieces([x or "" for x in b.column("text").to_pylist()]):
                sets = sets_of(some, k)
                made = [counted(x) if column == "counts" else x.view(np.int64) for x in sets]
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").slice(at, len(some)), "n": pa.array([len(x) for x in sets], pa.int32()), column: pa.array(made, kind)})

    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    return s.staged(joined(own, ids, "left_semi", s).select("doc_id", "text").mapInArrow(tidy(run), f"doc_id long, n int, {column} {'binary' if column == 'counts' else 'array<long>'}"), column)


def linked(own: DataFrame, rank: np.ndarray, t: Threshold, k: int, s: Scratch, most: int = LIGHT) -> DataFrame:
    """(a, b) links that connect all sets of own which links connect."""
    if t.num == t.den:  # equal sets only
        return own.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).limit(0)
    light = s.staged(light_pairs(entries_of(own, rank, t, k), t, most), "light")
    rest = rest_pairs(light.where("b is null").select("list", "n", "at", F.col("a").alias("member")), t, s, most)
    every = light.where("b is not null").select("a", "b", F.lit(False).alias("star")).unionByName(rest)
    pairs = s.staged(every.groupBy("a", "b").agg(F.max("star").alias("star")), "pairs")
    # counts of hashes tell of most pairs that they are too far apart, and of those no sets are sent
    told = s.staged(told_apart(pairs, hashed(own, pairs, k, s, "counts"), t), "told")
    sets = hashed(own, told, k, s, "hashes")
    known = s.staged(compared(told, sets, t), "compared")
    links = known.where("linked").select("a", "b")
    # a leader whose members are not all linked with it has not settled its lists, if it has more than one
    left = s.staged(known.where("star").groupBy("a").agg(F.count("*").alias("size"), F.max(~F.col("linked")).alias("open")).where("open and size > 1").select("a"), "open")
    if left.isEmpty():
        return links
    stars = known.where("star").join(left, "a")
    near = stars.where("items is not null").select(F.col("a").alias("leader"), F.lit(0).alias("kind"), F.col("b").alias("doc_id"), F.col("nb").alias("n"), F.col("na").alias("base"), (F.col("na") - F.col("inter")).alias("gone"), "items")
    far = stars.where(F.col("apart") > 2 * t.differ(F.col("na"))).select(F.col("a").alias("leader"), F.col("b").alias("doc_id"))
    far = s.staged(far, "far")
    far = sets.join(F.broadcast(far) if far.count() <= BROADCAST_IDS else far, "doc_id").select("leader", F.lit(1).alias("kind"), "doc_id", "n", F.lit(0).alias("base"), F.lit(0).alias("gone"), F.col("hashes").alias("items"))
    return links.unionByName(in_blocks(near.unionByName(far), t, s))


def in_blocks(groups: DataFrame, t: Threshold, s: Scratch) -> DataFrame:
    """Further links among the sets of each group (leader, kind), told by what they differ in (items) from a base that lacks gone of their shingles.

    Sets of a group lie in blocks of about BLOCK items and ROWS sets by band of sizes, and a block meets those of its own band
    and of the next. Only links come out: of a pair of blocks no more than it takes to connect the sets that its links connect.
    """
    key = ["leader", "kind", "band"]
    placed = groups.withColumn("band", F.size(F.filter(F.lit(t.bands()), lambda e: e <= F.col("n"))))
    size = s.staged(placed.groupBy(*key).agg(F.greatest(F.ceil(F.sum(F.size("items")) / BLOCK), F.ceil(F.count("*") / ROWS), F.lit(1)).alias("parts")), "sizes")
    placed = s.staged(placed.join(size, key).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).drop("parts"), "placed")
    blocks = s.staged(placed.select(*key, "part").distinct(), "blocks")
    low = blocks.select("leader", "kind", F.col("band").alias("b1"), F.col("part").alias("p1"))
    high = blocks.select("leader", "kind", F.col("band").alias("b2"), F.col("part").alias("p2"))
    meet = low.join(high, ["leader", "kind"]).where("b2 - b1 in (0, 1) and (b1 < b2 or p1 <= p2)").withColumn("meeting", F.xxhash64("leader", "kind", "b1", "p1", "b2", "p2"))
    sides = meet.select("meeting", "leader", "kind", F.col("b1").alias("band"), F.col("p1").alias("part"), F.lit(0).alias("side")).unionByName(meet.select("meeting", "leader", "kind", F.col("b2").alias("band"), F.col("p2").alias("part"), F.lit(1).alias("side")))
    sent = placed.join(sides, [*key, "part"]).select("meeting", "side", "doc_id", "n", "base", "gone", "items")

    def meeting(g: pa.RecordBatch) -> list[tuple[int, int]]:
        side, base = whole(g.column("side")), int(g.column("base")[0].as_py())
        items, (ids, n, gone) = arrays(g.column("items")), (whole(g.column(c)) for c in ("doc_id", "n", "gone"))
        x, y = (np.flatnonzero(side == i) for i in (0, 1))
        inter = common([items[i] for i in x], [items[i] for i in y])
        inter += base - gone[x][:, None] - gone[y][None]
        na, nb, ids, others = n[x], n[y], ids[x], ids[y]
        hit = t.links(inter, na[:, None], nb[None]) & (ids[:, None] != others[None])
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while root.get(v, v) != v:
                v = root[v]
            return v

        out = []
        for i, j in zip(*np.nonzero(hit), strict=True):
            a, b = find(int(ids[i])), find(int(others[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(ids[i]), int(others[j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in by_key(batches, "meeting"):
            out = np.array(meeting(g), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"a": pa.array(out[:, 0]), "b": pa.array(out[:, 1])})

    met = sent.repartition("meeting").sortWithinPartitions("meeting", "side", "doc_id")
    return s.staged(met.mapInArrow(tidy(run), "a long, b long"), "links")


def common(x: list[np.ndarray], y: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each of x with each of y, as matrix products over slices of the shingles that both sides have."""
    fx, fy = np.concatenate(x), np.concatenate(y)
    shared = np.intersect1d(fx, fy)
    out = np.zeros((len(x), len(y)), dtype=np.int64)
    rows = [np.repeat(np.arange(len(z)), [len(s) for s in z]) for z in (x, y)]
    at = [np.searchsorted(shared, f) for f in (fx, fy)]
    live = [(c < len(shared)) & (shared[np.minimum(c, len(shared) - 1)] == f) if len(shared) else np.zeros(len(f), bool) for c, f in zip(at, (fx, fy), strict=True)]
    for start in range(0, len(shared), width):
        m = []
        for side, z in enumerate((x, y)):
            pick = live[side] & (at[side] >= start) & (at[side] < start + width)
            one = np.zeros((len(z), min(width, len(shared) - start)), dtype=np.float32)
            one[rows[side][pick], at[side][pick] - start] = 1
            m.append(one)
        out += np.rint(m[0] @ m[1].T).astype(np.int64)
    return out
