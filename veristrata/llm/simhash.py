"""SimHash fingerprints and near-duplicate components through a Gray-order hierarchical index.

Fingerprints are 64-bit majority votes over XXH64 hashes of word shingles. Equal fingerprints collapse to one class
first, so exact copies never meet each other. Two fingerprints that differ in at most 2 of 64 bits agree on at least 2
of 4 blocks of 16 bits; each class is routed by every pair of blocks, which finds every link and keeps groups small.

A task sorts its fingerprints by the Gray rank of their remaining bits (neighbours in Gray order share long bit
patterns) and stacks nodes of FANOUT children over them. A node holds the bits that all below it share, and an upper
node takes over what its children have in common. A query adds up differing bits on the way down and drops a whole
group as soon as the sum passes the limit; a different routing key drops it at once.

A task returns a spanning forest of its links, not all pairs. Components follow by repeated minimum labels and pointer
jumping over written tables, so no component is ever collected.

Defined results: null or word-less text has fingerprint zero and is linked like any other; fewer words than a shingle
make one shingle of them all; a null doc_id is given a fingerprint, links others like any row and has the component of its
class, which is null only where no row of it has a doc_id; rows that share a doc_id are rows of their own. doc_id may be of any
type with an order. Columns of the input keep their names: the operator uses only doc_id, text and the carry columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.llm.common import as_bytes, lean, materialise, partitions, pieces

SHINGLE = 3
SEED = 42
MOST_BITS = 2
BLOCKS = 4
FANOUT = 16
#: Query rows whose walks are held in memory together.
QUERIES = 1 << 11

_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c in (9, 10, 11, 12, 13) else c for c in range(256))


def shingle_hashes(data: bytes, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of whole data, piece by piece."""
    digest = xxhash.xxh64_intdigest
    for _, piece in pieces(data, size - 1):
        words = piece.translate(_LOWER).split()
        n = len(words)
        if n < size:
            if n and len(piece) == len(data):
                yield np.array([digest(b" ".join(words), SEED)], np.uint64)
            continue
        flat = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        yield np.array([digest(flat[i:j], SEED) for i, j in zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist())], np.uint64)


def _votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set; bit 8*i+j is bit j of byte i."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return total


def fingerprint(data: bytes | None, size: int = SHINGLE) -> int:
    votes, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(data or b"", size):
        votes += _votes(hashes)
        n += len(hashes)
    if not n:
        return 0
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint(data.as_py()) for data in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array(values, pa.int64())], names=["row", "fp"])


def fingerprints(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id, the carry columns and fp of each row."""
    source = docs.select(F.struct("doc_id", *(carry or [])).alias("row"), as_bytes("text").alias("text"))
    kind = source.schema["row"].dataType.simpleString()
    return source.mapInArrow(lean(_fingerprints), f"row {kind}, fp long").select("row.*", "fp")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each value in the reflected Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """Levels of (pattern, mask) nodes over fingerprints sorted by routing key and Gray rank."""

    def __init__(self, key: np.ndarray, fp: np.ndarray, fanout: int = FANOUT):
        self.fanout = fanout
        self.order = np.lexsort((gray_rank(fp), key))
        self.key, self.fp = key[self.order], fp[self.order]
        any_bit, all_bits = self.fp, self.fp
        low, high = self.key, self.key
        self.levels = [(self.fp, np.full(len(fp), ~np.uint64(0)), low, high)]
        while len(any_bit) > 1:
            cuts = np.arange(0, len(any_bit), fanout)
            any_bit, all_bits = np.bitwise_or.reduceat(any_bit, cuts), np.bitwise_and.reduceat(all_bits, cuts)
            low, high = low[cuts], high[np.minimum(cuts + fanout, len(high)) - 1]
            shared = ~(any_bit ^ all_bits)
            self.levels.append((all_bits & shared, shared, low, high))

    def links(self, queries: np.ndarray, limit: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j) of sorted places, i among queries and i < j, of one key and at most limit differing bits."""
        level = len(self.levels) - 1
        nodes = len(self.levels[level][0])
        who = np.repeat(queries, nodes)
        at = np.tile(np.arange(nodes), len(queries))
        sums = np.zeros(len(who), np.int64)
        seen = np.zeros(len(who), np.uint64)
        while True:
            pattern, mask, low, high = self.levels[level]
            fresh = mask[at] & ~seen
            sums = sums + np.bitwise_count((self.fp[who] ^ pattern[at]) & fresh)
            last = np.minimum((at + 1) * self.fanout**level, len(self.fp)) - 1
            ok = (sums <= limit) & (low[at] <= self.key[who]) & (self.key[who] <= high[at]) & (last > who)
            who, at, sums, seen = who[ok], at[ok], sums[ok], seen[ok] | fresh[ok]
            if level == 0:
                own = at > who
                return who[own], at[own]
            level -= 1
            below = len(self.levels[level][0])
            first = at * self.fanout
            count = np.minimum(first + self.fanout, below) - first
            at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            who, sums, seen = np.repeat(who, count), np.repeat(sums, count), np.repeat(seen, count)


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least member of the component of each of n nodes."""
    label = np.arange(n)
    for a, b in links:
        while True:
            one, other = label[a], label[b]
            apart = one != other
            if not apart.any():
                break
            one, other = one[apart], other[apart]
            low = np.minimum(one, other)
            np.minimum.at(label, one, low)
            np.minimum.at(label, other, low)
            while (label != label[label]).any():
                label = label[label]
    return label


def _linker(limit: int):
    def link(table: pa.Table) -> pa.Table:
        key = table.column("route").to_numpy()
        fp = table.column("fp").to_numpy().view(np.uint64)
        index = GrayIndex(key, fp)
        n = len(fp)
        label = forest(n, (index.links(np.arange(i, min(i + QUERIES, n)), limit) for i in range(0, n, QUERIES)))
        child = np.flatnonzero(label != np.arange(n))
        ordered = index.fp.view(np.int64)
        return pa.table({"a": ordered[child], "b": ordered[label[child]]})

    return link


def _routes(blocks: int, kept: int):
    """Columns that hold one value for each choice of kept of the blocks: the choice and the bits there."""
    from itertools import combinations

    width = 64 // blocks
    out = []
    for number, chosen in enumerate(combinations(range(blocks), kept)):
        bits = None
        for place, block in enumerate(chosen):
            part = F.shiftleft(F.shiftrightunsigned("fp", block * width).bitwiseAND(F.lit((1 << width) - 1)), place * width)
            bits = part if bits is None else bits.bitwiseOR(part)
        out.append(bits.bitwiseOR(F.lit(number << (kept * width)).cast("long")))
    return F.array(*out)


def fingerprint_links(classes: DataFrame, limit: int = MOST_BITS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b) forest edges that connect all fingerprints with a chain of links; exact for any input.

    Routing values are spread over cells by hash; a cell holds whole routing groups.
    """
    cells = max(64, 4 * partitions(classes.sparkSession))
    routed = classes.select("fp", F.explode(_routes(blocks, blocks - limit)).alias("route"))
    routed = routed.withColumn("cell", F.pmod(F.xxhash64("route"), F.lit(cells)).cast("int"))
    return routed.groupBy("cell").applyInArrow(_linker(limit), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(fp, least): for each fingerprint of the edges (a, b), the least one of all that are reachable.

    Each round takes the least label over the neighbours and jumps to the label's own label. The number of rounds grows with the logarithm of a component's diameter.
    """
    edges = materialise(edges.distinct(), "edges")
    both = materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = materialise(both.select(F.col("a").alias("fp")).distinct().withColumn("least", F.col("fp")), "labels")
    while True:
        near = both.join(label.select(F.col("fp").alias("b"), F.col("least").alias("offer")), "b").groupBy("a").agg(F.min("offer").alias("offer"))
        step = materialise(label.join(near, F.col("fp") == F.col("a")).select("fp", "least", F.least("least", "offer").alias("new")), "step")
        jump = step.select(F.col("fp").alias("at"), F.col("new").alias("beyond"))
        after = materialise(step.join(jump.hint("merge"), F.col("new") == F.col("at")).select("fp", "least", F.least("new", "beyond").alias("after")), "jump")
        moved = after.where("after <> least").limit(1).count()
        label = after.select("fp", F.col("after").alias("least"))
        if not moved:
            return label


def simhash_components(docs: DataFrame, limit: int = MOST_BITS, blocks: int = BLOCKS, carry: list[str] | None = None) -> DataFrame:
    """doc_id, the carry columns, fp, component (least doc_id reachable over links of at most limit bits, itself included) and component_fp (the component's least fingerprint as a signed number) of each row."""
    marked = materialise(fingerprints(docs, carry), "fingerprints")
    classes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    linked = components(fingerprint_links(classes, limit, blocks))
    reached = linked.join(classes, "fp").groupBy("least").agg(F.min("first").alias("reached"))
    linked = materialise(linked.join(reached, "least"), "components")
    of_class = classes.join(linked, "fp", "left").select("fp", F.coalesce("reached", "first").alias("component"), F.coalesce("least", "fp").alias("component_fp"))
    return marked.join(of_class.hint("merge"), "fp").select("doc_id", *(carry or []), "fp", "component", "component_fp")
