"""Greedy word-piece counts in linear time.

The vocabulary is a trie with failure links. A state's failure link is where matching goes on after the longest pieces
of its string are popped, and its pop count is how many pieces those are; both are computed once, so a word's count
needs one pass over its bytes and never builds a piece. Distinct words of a slice are counted once and advance together.

A word is put behind the marker and cut into the longest piece at each place, from the left. A word that can't be cut to
its end counts as one unknown token. Words are maximal runs of bytes other than the six ASCII white spaces.

Defined results: null, empty and blank texts have no words and no tokens; rows are counted each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.llm.common import lean
from veristrata.llm.trie import MARK, NORMAL, USER_DEFINED, DoubleArray, Encoded, Vocabulary, by_size, matrix, read_vocabulary, text_slices

_NOWHERE = -1
#: Words of more bytes are walked alone.
LONG_WORD = 1 << 12


class LongestMatch:
    def __init__(self, vocabulary: Vocabulary):
        self.trie = trie = DoubleArray({p.encode(): i for i, (p, kind) in enumerate(zip(vocabulary.pieces, vocabulary.kinds)) if kind in (NORMAL, USER_DEFINED)})
        self.fail = np.full(len(trie.base), _NOWHERE, np.int64)
        self.pops = np.zeros(len(trie.base), np.int64)
        self.lists = None
        places = np.flatnonzero(trie.used)
        for depth in range(1, int(trie.depth.max()) + 1):
            states = places[trie.depth[places] == depth]
            whole = trie.value[states] >= 0
            self.fail[states[whole]], self.pops[states[whole]] = 0, 1
            states = states[~whole]
            at, byte = self.fail[trie.parent[states]], trie.byte[states]
            pops = self.pops[trie.parent[states]].copy()
            at, pops = self._follow(at, byte, pops)
            self.fail[states], self.pops[states] = at, pops

    def _follow(self, at: np.ndarray, byte: np.ndarray, pops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes failure links until the byte can be read, adding up pops; _NOWHERE where it never can."""
        at, pops = at.copy(), pops.copy()
        open_ = np.flatnonzero(at != _NOWHERE)
        while len(open_):
            to, ok = self.trie.step(at[open_], byte[open_])
            at[open_[ok]] = to[ok]
            open_ = open_[~ok]
            pops[open_] += self.pops[at[open_]]
            at[open_] = self.fail[at[open_]]
            open_ = open_[at[open_] != _NOWHERE]
        return at, pops

    def counts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """One number for each distinct word: its pieces, or -1 if it can't be cut."""
        out = np.zeros(len(words), np.int32)
        marked = pc.binary_join_element_wise(pa.scalar(MARK.encode(), pa.binary()), words, pa.scalar(b"", pa.binary()))
        for places, part, width in by_size(marked):
            if width > LONG_WORD:
                out[places] = [self._walk(word) for word in part.to_pylist()]
                continue
            text, sizes = matrix(part, width)
            at, pops = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            for i in range(width):
                first = int(np.searchsorted(sizes, i, "right"))  # sizes ascend
                at[first:], pops[first:] = self._follow(at[first:], text[first:, i], pops[first:])
            while len(open_ := np.flatnonzero(at > 0)):
                pops[open_] += self.pops[at[open_]]
                at[open_] = self.fail[at[open_]]
            out[places] = np.where(at == _NOWHERE, -1, pops)
        return np.ones(len(words), np.int64), out

    def _walk(self, word: bytes) -> int:
        """The same for one word of any length, in constant memory."""
        if self.lists is None:
            self.lists = [x.tolist() for x in (self.trie.base, self.trie.check, self.fail, self.pops)]
        base, check, fail, pops = self.lists
        at = total = 0
        for byte in word:
            while True:
                to = base[at] + byte
                if base[at] > 0 and to < len(check) and check[to] == at:
                    at = to
                    break
                total += pops[at]
                at = fail[at]
                if at == _NOWHERE:
                    return -1
        while at > 0:
            total += pops[at]
            at = fail[at]
        return -1 if at == _NOWHERE else total


def _counter(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LongestMatch = shared.value
        cache = Encoded(model.counts)
        for whole in batches:
            for batch in text_slices(whole, 1):
                split = pc.ascii_split_whitespace(pc.fill_null(batch.column(1).cast(pa.string()), ""))
                words = split.flatten()
                real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(batch)), np.diff(split.offsets.to_numpy()))[real]
                places = cache.places(words.filter(pa.array(real)).cast(pa.binary()))
                found = cache.items[cache.starts[places]]
                sums = [np.bincount(owner, weights, len(batch)).astype(np.int64) for weights in (None, np.where(found < 0, 1, found), found < 0)]
                yield pa.record_batch([batch.column(0), *[pa.array(x, pa.int64()) for x in sums]], names=["row", "n_words", "n_tokens", "n_unknown"])

    return count


def token_counts(docs: DataFrame, path: str, carry: list[str] | None = None) -> DataFrame:
    """doc_id, the carry columns, n_words, n_tokens and n_unknown (words that can't be cut) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(LongestMatch(read_vocabulary(path)))
    row = F.struct(F.col("doc_id"), *[F.col(c) for c in carry or []])
    source = docs.select(row.alias("row"), F.col("text").alias("text"))
    out = source.mapInArrow(lean(_counter(shared)), f"row {source.schema['row'].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long")
    return out.select("row.*", "n_words", "n_tokens", "n_unknown")
