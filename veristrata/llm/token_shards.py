"""Training-order shards of token sequences.

Texts become token ids, each text ended by an end token; the ids of a task are cut into sequences of LENGTH, and only its
last one is padded (with end tokens). Sequences are numbered task by task. A keyed Feistel network over the least
even number of bits that can hold the numbers, walked until it falls inside, permutes these numbers into slots: every
slot is taken once, no table is kept, and any task can compute it alone. A shard is a range of STRIDE slots; the task that gets the range
writes it as one file of fixed-stride little-endian ids, so slot s lies at (s mod STRIDE) * LENGTH * width of file s div STRIDE, and
reading can go on from any slot.

Packed ids are written to the shared folder once, before numbering: a lost executor never changes the numbers of others.
The order depends on the key and on how the input files are split into tasks.

Defined results: null and empty texts add nothing; an empty table gives no shard; texts of any length run on over
sequences; rows that share a doc_id are packed each for itself.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.llm.common import fresh_path, lean, materialise, open_uri
from veristrata.llm.trie import Encoded, ragged, text_slices

LENGTH = 512
STRIDE = 8192
ROUNDS = 6
#: Sequences that are packed together.
PACK = 8192
LEVEL = 9

#: How text is cut before merges apply: the public pattern of byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Only a lone space between two other characters surely begins a unit of its own.
_ODD = f"^ | $|{_SPACE} | {_SPACE}"


def feistel(values: np.ndarray, size: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """The slots of numbers below size: a permutation of range(size) for each key."""
    half = max(1, ((max(size, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [struct.unpack("<Q", hashlib.blake2b(struct.pack("<qI", key, r), digest_size=8).digest())[0] for r in range(rounds)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return (left << np.uint64(half)) | right

    out = once(values.astype(np.uint64))
    while True:
        outside = np.flatnonzero(out >= np.uint64(size))
        if not len(outside):
            return out.astype(np.int64)
        out[outside] = once(out[outside])


class ByteLevelTokenizer:
    """A byte-level vocabulary file's merges, by the library that the file is made for; distinct units are encoded once."""

    def __init__(self, data: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.coder = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.cache = Encoded(self._units)

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # a unit's first byte tells whether a space stands before it
        ids = [self.coder.encode_ordinary(u) for u in units.cast(pa.string()).to_pylist()]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return sizes, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, numbers of ids)."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts, " ")
        counts = np.diff(split.offsets.to_numpy()).astype(np.int64)
        counts[odd] = 0
        words = split.filter(pa.array(~odd)).flatten() if odd.any() else split.flatten()
        first = np.zeros(len(words), bool)
        first[(np.cumsum(counts) - counts)[counts > 0]] = True
        units = pc.if_else(pa.array(first), words, pc.binary_join_element_wise(pa.scalar(" "), words, ""))
        places = self.cache.places(units.cast(pa.binary()))
        sizes = self.cache.sizes[places]
        items = self.cache.items[ragged(self.cache.starts[places], sizes)]
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        edge = bounds[np.concatenate(([0], np.cumsum(counts)))]
        if not odd.any():
            return items, np.diff(edge)
        parts = [np.array(self.coder.encode_ordinary(t.as_py()), np.int32) if strange else items[a:b] for t, strange, a, b in zip(texts, odd.tolist(), edge, edge[1:])]
        return np.concatenate(parts) if parts else items, np.array([len(p) for p in parts], np.int64)


def _width(end: int) -> np.dtype:
    return np.dtype("<u2" if end < 1 << 16 else "<u4")


def _packer(shared, length: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = None
        press = zstandard.ZstdCompressor(level=LEVEL)
        part, start, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row(ids: np.ndarray, tokens: int) -> pa.RecordBatch:
            n = len(ids) // length
            return pa.record_batch([pa.array([part], pa.int64()), pa.array([start], pa.int64()), pa.array([n], pa.int64()), pa.array([tokens], pa.int64()), pa.array([press.compress(ids.astype(_width(tokenizer.end)).tobytes())], pa.binary())], names=["part", "start", "n", "tokens", "ids"])

        for whole in batches:
            if tokenizer is None:
                tokenizer = ByteLevelTokenizer(shared.value)
            for batch in text_slices(whole, 0):
                ids, sizes = tokenizer.encode(batch.column(0).cast(pa.string()))
                sizes = sizes[sizes > 0]
                ids = np.insert(ids, np.cumsum(sizes), tokenizer.end)
                held.append(ids)
                size += len(ids)
                if size >= PACK * length:
                    ids = np.concatenate(held)
                    full = len(ids) // length * length
                    yield row(ids[:full], full)
                    start += full // length
                    held, size = [ids[full:]], len(ids) - full
        if size:
            ids = np.concatenate(held)
            yield row(np.append(ids, np.full(-len(ids) % length, tokenizer.end, ids.dtype)), len(ids))

    return pack


def _dealer(first: dict, total: int, key: int, length: int, stride: int, width: str):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, unpress = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        for batch in batches:
            for part, start, n, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                rows = np.frombuffer(unpress.decompress(ids), width).reshape(n, length)
                slots = feistel(first[part] + start + np.arange(n), total, key)
                order = np.argsort(slots)
                slots = slots[order]
                shards = slots // stride
                cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), n]
                found = [(int(shards[a]), press.compress(slots[a:b].tobytes() + rows[order[a:b]].tobytes()), b - a) for a, b in zip(cuts, cuts[1:])]
                yield pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], names=["shard", "n", "ids"])

    return deal


def shard_path(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:010d}.bin"


def _writer(folder: str, total: int, length: int, stride: int, width: str):
    def write(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        n = min(stride, total - shard * stride)
        out = np.zeros((n, length), width)
        filled = np.zeros(n, bool)
        unpress = zstandard.ZstdDecompressor()
        for count, data in zip(table.column("n").to_pylist(), table.column("ids").to_pylist()):
            data = unpress.decompress(data)
            at = np.frombuffer(data[: 8 * count], np.int64) - shard * stride
            out[at] = np.frombuffer(data[8 * count :], width).reshape(count, length)
            filled[at] = True
        if not filled.all():
            raise ValueError(f"shard {shard} has empty slots")
        system, path = open_uri(shard_path(folder, shard))
        system.create_dir(path.rpartition("/")[0], recursive=True)
        spare = f"{path}.{uuid.uuid4().hex}"  # an attempt's own file takes the name only when it is whole
        with system.open_output_stream(spare) as file:
            file.write(out)
        system.move(spare, path)
        return pa.table({"shard": [shard], "first_slot": [shard * stride], "n_sequences": [n], "n_bytes": [out.nbytes], "sha256": [hashlib.sha256(out).hexdigest()], "path": [shard_path(folder, shard)]})

    return write


def write_shards(docs: DataFrame, vocabulary: str, folder: str | None = None, key: int = 0, length: int = LENGTH, stride: int = STRIDE) -> DataFrame:
    """Writes the shards and returns their manifest: shard, first_slot, n_sequences, n_bytes, sha256, path."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "shards")
    with open(vocabulary, "rb") as f:
        data = f.read()
    width = _width(max(int(line.split()[1]) for line in data.splitlines()) + 1).str
    shared = spark.sparkContext.broadcast(data)
    packed = materialise(docs.select("text").mapInArrow(lean(_packer(shared, length)), "part long, start long, n long, tokens long, ids binary"), "packed")
    sizes = packed.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row for each task
    first, total = {}, 0
    for part, n in sizes:
        first[part] = total
        total += n
    dealt = packed.mapInArrow(lean(_dealer(first, total, key, length, stride, width)), "shard long, n long, ids binary")
    out = dealt.groupBy("shard").applyInArrow(_writer(folder, total, length, stride, width), "shard long, first_slot long, n_sequences long, n_bytes long, sha256 string, path string")
    return materialise(out, "manifest")


def read_slots(folder: str, first: int, count: int, width: str = "<u2", length: int = LENGTH, stride: int = STRIDE) -> Iterator[np.ndarray]:
    """The sequences of slots first .. first + count - 1, by range reads."""
    step = np.dtype(width).itemsize * length
    while count:
        system, path = open_uri(shard_path(folder, first // stride))
        n = min(count, stride - first % stride)
        with system.open_input_file(path) as file:
            data = file.read_at(n * step, first % stride * step)
        yield from np.frombuffer(data, width).reshape(-1, length)
        first, count = first + n, count - n
