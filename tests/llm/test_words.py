"""Words are counted by columns, and go to the tasks as columns, with what plain loops make of them."""

import pickle
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import regex

from creditgraph.llm import bpe


def test_chunks_count_as_by_a_loop():
    find = bpe.finder(bpe.USUAL)
    chunks = ["", "a", "é", "word", "word", "word,", "word.", ",", "!?", "x1", "1", "don't", "it's.", "naïve;", "a,b", "日本語", "日本語!", "\n", "a\nb", "\u200d", "e\u0301", "e\u0301,"]
    whole = Counter({" word": 3, "Head": 1})
    want = Counter(whole)
    for c in chunks:
        want.update(bpe.plain_words(c, find))
    got = bpe.chunk_words(pc.value_counts(pa.array(chunks)), whole, find)
    assert got.num_rows == len(want) and dict(zip(got.column("word").to_pylist(), got.column("n").to_pylist(), strict=True)) == want
    assert bpe.chunk_words(pc.value_counts(pa.array([], pa.string())), Counter(), find).num_rows == 0


def test_letters_are_those_of_the_pattern():
    """Arrow's letters and Python's are letters to the pattern: no more of them are taken without it."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    letter = regex.compile(r"\p{L}")
    for arrow, c in zip(pc.utf8_is_alpha(pa.array(every)).to_pylist(), every, strict=True):
        assert not (arrow or c.isalpha()) or letter.match(c), hex(ord(c))


def test_broadcast_words_are_columns():
    rows = pa.table({"words": [["a", "bc"], []], "ids": [[[1], [2, 3]], []]}, schema=pa.schema({"words": pa.list_(pa.string()), "ids": pa.list_(pa.list_(pa.int32()))}))
    words = pickle.loads(pickle.dumps(bpe.Words(rows)))
    assert "known" not in vars(words)
    assert words.known == {"a": (1).to_bytes(4, "little"), "bc": (2).to_bytes(4, "little") + (3).to_bytes(4, "little")}
