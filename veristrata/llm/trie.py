"""A double-array trie over bytes that answers many strings at once, a cache of encoded units, and the piece file reader."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that are matched in text, and pieces that stand for one byte, by the type numbers of the piece file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
MARK = "▁"
#: Pieces of a vocabulary, at most; it is broadcast.
MOST_PIECES = 1 << 20
#: Places that are tried together for a node's children.
SPAN = 1 << 10


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value) of each field of one protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire = tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if wire == 5 else 8
            value, at = data[at : at + size], at + size
        yield tag >> 3, wire, value


@dataclass(frozen=True)
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool


def read_vocabulary(path: str) -> Vocabulary:
    """The pieces of a .model file; text is taken as it is, so files with a normalisation table are refused."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, kinds, dummy = [], [], [], True
    for number, _, value in _fields(data):
        if number == 1:
            own = {n: v for n, _, v in _fields(value)}
            pieces.append(own[1].decode())
            scores.append(struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0])
            kinds.append(own.get(3, NORMAL))
        elif number == 3:
            own = {n: v for n, _, v in _fields(value)}
            if own.get(2):
                raise ValueError("the model normalises text by a table, which is not supported")
            dummy = bool(own.get(3, 1))
    if len(pieces) > MOST_PIECES:
        raise ValueError(f"{len(pieces)} pieces; {MOST_PIECES} at most")
    return Vocabulary(pieces, scores, kinds, dummy)


def _level_order(tree: list[dict[int, int]]) -> Iterator[tuple[int, dict[int, int]]]:
    """(node, children) of the nodes that have children, from the root on."""
    queue = [0]
    for node in queue:
        if tree[node]:
            yield node, tree[node]
            queue.extend(tree[node].values())


class DoubleArray:
    """base/check arrays; the child of state s by byte c is base[s] + c if check there is s. value: of the string that ends in a state, else -1."""

    def __init__(self, strings: dict[bytes, int]):
        tree: list[dict[int, int]] = [{}]
        ends = [-1]
        for string, value in strings.items():
            at = 0
            for c in string:
                to = tree[at].get(c)
                if to is None:
                    to = tree[at][c] = len(tree)
                    tree.append({})
                    ends.append(-1)
                at = to
            ends[at] = value
        taken = np.zeros(4 * len(tree) + 4 * SPAN, bool)
        taken[0] = True
        spot = [0] * len(tree)  # where each node of the tree is placed
        start_of = [0] * len(tree)
        low = tail = 1
        for node, children in _level_order(tree):
            codes = sorted(children)
            at = max(1, low - codes[0])
            while True:  # all places of a span are tried at once
                if at + SPAN + 512 >= len(taken):
                    taken = np.append(taken, np.zeros(len(taken), bool))
                blocked = taken[at + codes[0] : at + codes[0] + SPAN]
                for c in codes[1:]:
                    blocked = blocked | taken[at + c : at + c + SPAN]
                first = int(blocked.argmin())
                if not blocked[first]:
                    break
                at += SPAN
            start = at + first
            for c in codes:
                taken[start + c] = True
                spot[children[c]] = start + c
            start_of[node] = start
            tail = max(tail, start + codes[-1] + 1)
            while taken[low : low + SPAN].all():
                low += SPAN
            if start - low > 16 * SPAN:  # holes that few nodes fit are left
                low += SPAN
        size = tail + 257
        place = np.array(spot)
        base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        value, depth, parent, byte = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
        base[place], value[place] = start_of, ends
        for node, children in _level_order(tree):
            for c, child in children.items():
                to = spot[child]
                check[to] = parent[to] = spot[node]
                byte[to], depth[to] = c, depth[spot[node]] + 1
        self.base, self.check, self.value = base, check, value
        self.depth, self.parent, self.byte = depth, parent, byte
        self.used = np.zeros(size, bool)
        self.used[place] = True

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, whether they exist)."""
        to = np.minimum(self.base[state] + byte, len(self.check) - 1)
        return to, (self.check[to] == state) & (self.base[state] > 0)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start .. start + size - 1 of each, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Encoded:
    """Remembers what encode made of a unit, for at most `most` units at a time.

    encode: an array of distinct binary values to (numbers of items, items one after another).
    """

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], most: int = 1 << 19):
        self.encode, self.most = encode, most
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.binary())
        self.sizes, self.starts, self.items = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def places(self, units: pa.Array) -> np.ndarray:
        """The place of each unit among the known; new ones are encoded."""
        coded = units.dictionary_encode()
        own = coded.dictionary
        if len(self.known) + len(own) > self.most:
            self._forget()
        at = pc.index_in(own, value_set=self.known)
        fresh = own.filter(pc.is_null(at))
        if len(fresh):
            sizes, items = self.encode(fresh)
            self.starts = np.append(self.starts, len(self.items) + np.cumsum(sizes) - sizes)
            self.sizes, self.items = np.append(self.sizes, sizes), np.append(self.items, items)
            unplaced = pc.is_null(at).to_numpy(zero_copy_only=False)
            at = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at[unplaced] = len(self.known) + np.arange(len(fresh))
            self.known = pa.concat_arrays([self.known, fresh])
        else:
            at = at.to_numpy(zero_copy_only=False).astype(np.int64)
        return at[coded.indices.to_numpy(zero_copy_only=False)]


def matrix(units: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes padded with 0 to width, sizes) of a binary array."""
    offsets = np.frombuffer(units.buffers()[1], np.int32)[units.offset : units.offset + len(units) + 1].astype(np.int64)
    sizes = np.diff(offsets)
    data = np.frombuffer(units.buffers()[2], np.uint8) if units.buffers()[2] is not None and units.buffers()[2].size else np.zeros(1, np.uint8)
    at = offsets[:-1, None] + np.arange(width)
    inside = np.arange(width) < sizes[:, None]
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.int32), sizes


def by_size(units: pa.Array, rows: int = 1 << 13, cells: int = 1 << 21) -> Iterator[tuple[np.ndarray, pa.Array, int]]:
    """(places, units, greatest size) of slices of units of like size, each of at most `cells` bytes when padded."""
    sizes = pc.binary_length(units).to_numpy(zero_copy_only=False)
    order = np.argsort(sizes, kind="stable")
    i = 0
    while i < len(order):
        j = min(i + rows, len(order))
        while j > i + 1 and (j - i) * int(sizes[order[j - 1]]) > cells:
            j = i + max(1, (j - i) // 2)
        yield order[i:j], units.take(pa.array(order[i:j])), int(sizes[order[j - 1]])
        i = j


def text_slices(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about limit bytes of the column, a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, start = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)
