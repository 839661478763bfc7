"""What the operators of this folder share: shared storage, word splitting and vectorised hashing."""

from __future__ import annotations

import ctypes
import functools
import gc
import operator
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
#: bytes.split() without an argument splits on exactly these six.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: A text of more bytes than this is worked on in pieces.
PIECE_BYTES = 4 << 20

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a folder of this machine is set, but only if driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veristrata-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/veristrata/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read back: lineage ends here and a lost executor loses nothing."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: str):
    return F.col(column).cast("binary")


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        done = 1
        while done < size:
            step = np.uint64(pow(base, done, 1 << 64))
            have[done : 2 * done] = have[:done] * step
            done *= 2
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each values[start:end], by differences of one running polynomial sum."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * powers(len(values), _BASE), out=total[1:])
    back = powers(len(values) + 1, _INVERSE)
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a byte buffer start and end."""
    edge = np.diff(np.concatenate(([True], SPACE[buf], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def pieces(data: bytes, overlap: int, limit: int = PIECE_BYTES) -> Iterator[tuple[int, bytes]]:
    """(words before it, piece): data, cut at white space; each piece repeats the last overlap words of the one before."""
    if len(data) <= limit:
        yield 0, data
        return
    at = base = 0
    gap = re.compile(rb"[ \t-\r]")
    while True:
        cut = gap.search(data, at + limit) if at + limit < len(data) else None
        end = cut.start() if cut else len(data)
        piece = data[at:end]
        yield base, piece
        if end >= len(data):
            return
        tail = len(piece)
        back = piece.rsplit(None, overlap) if overlap else [piece]
        words = len(piece.split())
        if overlap and len(back) == overlap + 1:
            tail = len(back[0])
            base += words - overlap
        elif overlap:  # fewer words than the overlap: keep them all
            following = gap.search(data, end + limit)
            limit = (following.start() if following else len(data)) - at
            continue
        else:
            base += words
        at += tail


def chunks(ids: list, texts: list, overlap: int, limit: int = PIECE_BYTES) -> Iterator[list[tuple[object, int, bytes]]]:
    """Lists of (id, words before, bytes) of about limit bytes each."""
    out: list = []
    size = 0
    for key, data in zip(ids, texts):
        if not data:
            continue
        for base, piece in pieces(data, overlap, limit):
            out.append((key, base, piece))
            size += len(piece)
            if size >= limit:
                yield out
                out, size = [], 0
    if out:
        yield out


#: Bytes of rows that may be broadcast; beyond it the join shuffles.
MOST_BROADCAST = 32 << 20


def _width(name: str, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        return F.greatest(F.size(name), F.lit(0)) * 8 + 24
    return F.lit(16)


def small(keys: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """keys, to be broadcast if their measured bytes are few. Give a written table: it is read for that."""
    sizes = [_width(f.name, f.dataType) for f in keys.schema.fields]
    total = keys.agg(F.sum(functools.reduce(operator.add, sizes).cast("long"))).first()[0]
    return F.broadcast(keys) if (total or 0) <= most else keys


def row_key(*columns: str) -> Column:
    """Tells rows of one doc_id apart by what they hold; rows that hold the same are judged the same."""
    return F.xxhash64(*columns)


def without(docs: DataFrame, rows: DataFrame, key: Column) -> DataFrame:
    """docs without the rows that are listed by doc_id (null is a value like any other) and _key; key computes _key from docs."""
    listed = small(rows.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_listed")))
    return docs.join(listed, docs["doc_id"].eqNullSafe(F.col("_id")) & (key == F.col("_listed")), "left_anti")


def open_uri(uri: str):
    """(file system, path) of a folder or file in shared storage, for workers without a JVM."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


_held: dict[object, object] = {}


def held(key: object, build: Callable[[], object]):
    """What build makes, kept by this worker for its later tasks until another key is asked for."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


@functools.cache
def _libc():
    try:
        return ctypes.CDLL(None)
    except OSError:
        return None


@functools.cache
def _frugal() -> None:
    """Large blocks of memory go back to the system as soon as they are freed, for the life of this worker."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        _libc().mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD; setting it also stops its growth
        _libc().mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
    except AttributeError:  # another C library
        pass


def trim() -> None:
    """Gives memory that this process no longer uses back to the system: workers live on for later tasks."""
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        _libc().malloc_trim(0)
    except AttributeError:
        pass


def lean(mapper):
    """A mapper of batches whose worker gives memory back, at last when its task ends."""

    def run(batches):
        _frugal()
        try:
            yield from mapper(batches)
        finally:
            trim()

    return run
