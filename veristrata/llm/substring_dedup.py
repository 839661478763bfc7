"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is WINDOW consecutive words of one document. Its minimiser is the smallest hash among its grams of GRAM
words. Consecutive windows with the same minimiser travel as one packed string to the bucket of that minimiser, so
every occurrence of a window meets all others in one bucket while each word is shipped about three times instead of
WINDOW times. In the bucket the windows are sorted by hash, runs of equal hashes are compared word for word, and each
window gets the smallest doc_id that holds it.

Hot strings: equal strings of one block of documents are packed once, with INLINE occurrences at most. The bucket's
load therefore follows the number of blocks, not of copies. What goes beyond INLINE travels in buckets of its own,
dealt by document, and is joined to the verdicts on those strings afterwards (a sort-merge join that Spark can split).

Hot buckets: a first pass adds up the bytes of each bucket. One of more than HEAVY bytes (a string in every block, or a
minimiser with very many contexts) is dealt over salted groups of blocks, in which equal strings are packed once more, and
their windows then go to as many buckets as the load asks for, by the hash of the whole window. No task holds more than a share.

Defined results: null or word-less text has no windows and 0 words; a null doc_id neither removes nor loses words;
rows that share a doc_id don't remove from each other, and each loses only words that its own windows cover (rows are told
apart by a hash of their text); texts of any length are worked on in pieces that overlap by WINDOW - 1 words. doc_id is a whole
number. Columns of the input keep their names: the operator uses only doc_id, text and the carry columns.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.llm.common import SPACE, as_bytes, chunks, lean, materialise, mix, partitions, row_key, span_hash, word_bounds

WINDOW = 13
GRAM = 3
INLINE = 8
#: Bytes of text whose words are hashed together, and that are packed together.
BLOCK = 1 << 20
PACK = 4 << 20
#: Buckets for each shuffle partition: a bucket is small beside a task's memory.
BUCKETS = 20
#: Bytes of strings in a bucket, before equal ones are packed, from which it is split; more if MOST_HEAVY buckets would have them.
HEAVY = 128 << 20
MOST_HEAVY = 1 << 20

_ROUTED = "bucket int, salt int, hot boolean, blob binary"
_SPLIT = "bucket int, hot boolean, blob binary"
_FOUND = "kind int, doc_id long, text_key long, at int, until int, key binary, least long"
_FOUND_ARROW = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("at", pa.int32()), ("until", pa.int32()), ("key", pa.binary()), ("least", pa.int64())])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def super_kmers(block: list, window: int = WINDOW, gram: int = GRAM):
    """(minimiser, start, end, doc, position) arrays and the normalised bytes that start and end refer to."""
    buf = np.frombuffer(b"\n".join(x[2] for x in block), np.uint8)
    starts, ends = word_bounds(buf)
    sizes = ends - starts
    firsts = np.cumsum([0] + [len(x[2]) + 1 for x in block[:-1]])
    owner = np.searchsorted(firsts, starts, "right") - 1
    keep = np.append(~SPACE[buf], True)
    keep[ends] = True
    flat = np.append(np.where(SPACE[buf], np.uint8(32), buf), np.uint8(32))[keep]
    at = np.cumsum(sizes + 1) - (sizes + 1)
    until = at + sizes
    n = len(at) - window + 1
    if n <= 0:
        return None
    words = span_hash(flat, at, until)
    grams = np.zeros(len(words) - gram + 1, np.uint64)
    for j in range(gram):
        grams = mix(grams + words[j : len(words) - gram + 1 + j])
    least = _sliding_min(grams, window - gram + 1)
    whole = np.flatnonzero(owner[:n] == owner[window - 1 :])
    if not len(whole):
        return None
    low = least[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (np.diff(whole) != 1) | (low[1:] != low[:-1])
    a = whole[new]
    b = np.append(whole[np.flatnonzero(new)[1:] - 1], whole[-1])
    first_word = np.searchsorted(owner, np.arange(len(block)))
    base = np.array([x[1] for x in block], np.int64)
    return low[new], at[a], until[b + window - 1], owner[a], a - first_word[owner[a]] + base[owner[a]], flat.tobytes()


def _bucket_of(least: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(least) % np.uint64(buckets)).astype(np.int64)


class Heavy:
    """The buckets that are split, in order, the number of groups each is dealt over, and the numbers of the buckets that take its windows."""

    def __init__(self, buckets: np.ndarray, sizes: np.ndarray, limit: int, first: int):
        order = np.argsort(buckets)
        self.buckets = buckets[order]
        self.parts = 1 + (2 * sizes[order] - 1) // limit
        self.first = first + np.cumsum(self.parts) - self.parts

    def _at(self, bucket: int) -> int:
        at = int(np.searchsorted(self.buckets, bucket))
        return at if at < len(self.buckets) and self.buckets[at] == bucket else -1

    def salts(self, bucket: int) -> int:
        at = self._at(bucket)
        return int(self.parts[at]) if at >= 0 else 1

    def targets(self, bucket: int) -> tuple[int, int]:
        """(first number, how many)"""
        at = self._at(bucket)
        return int(self.first[at]), int(self.parts[at])


class _Packer:
    """Strings and their places by bucket, until they are packed; only of the heavy buckets, or only of the others."""

    def __init__(self, buckets: int, heavy: Heavy, only_heavy: bool):
        self.buckets, self.press = buckets, zstandard.ZstdCompressor(level=3)
        self.heavy, self.only_heavy = heavy, only_heavy
        self._clear()

    def _clear(self) -> None:
        self.seen: dict[int, dict[bytes, list]] = {}
        self.rows: list[tuple[int, int]] = []  # doc_id and key of the text
        self.size = 0

    def add(self, block: list, window: int, gram: int) -> None:
        self.size += sum(len(x[2]) for x in block)
        made = super_kmers(block, window, gram)
        if made is None:
            return
        low, start, end, owner, position, flat = made
        row = owner + len(self.rows)
        self.rows += [x[0] for x in block]
        bucket = _bucket_of(low, self.buckets)
        if len(self.heavy.buckets):
            mine = np.isin(bucket, self.heavy.buckets) == self.only_heavy
            bucket, start, end, row, position = bucket[mine], start[mine], end[mine], row[mine], position[mine]
        seen = self.seen
        for b, x, y, doc, at in zip(bucket.tolist(), start.tolist(), end.tolist(), row.tolist(), position.tolist()):
            own = seen.get(b)
            if own is None:
                own = seen[b] = {}
            places = own.get(s := flat[x:y])
            if places is None:
                own[s] = [doc, at]
            else:
                places += (doc, at)

    def pack(self) -> pa.RecordBatch:
        rows, extra = [], {}
        mark = abs(hash(self.rows[0])) if self.rows else 0  # of whole numbers: the same in every run
        ids = np.array([x[0] for x in self.rows], np.int64)
        text_keys = np.array([x[1] for x in self.rows], np.int64)
        id_list = ids.tolist()
        for bucket, own in self.seen.items():
            counts, lows, highs, docs, places = [], [], [], [], []
            for s, found in own.items():
                if len(found) == 2:
                    low = high = id_list[found[0]]
                else:
                    held = [id_list[x] for x in found[::2]]
                    low, high = min(held), max(held)
                if len(found) > 2 * INLINE:
                    key, size = _key(s), s.count(b" ") + 1
                    for doc, at in zip(found[2 * INLINE :: 2], found[2 * INLINE + 1 :: 2]):
                        extra.setdefault(id_list[doc] % self.buckets, []).append((key, id_list[doc], int(text_keys[doc]), at, size))
                    counts.append(-INLINE)
                    found = found[: 2 * INLINE]
                else:
                    counts.append(len(found) // 2)
                lows.append(low)
                highs.append(high)
                docs += found[::2]
                places += found[1::2]
            blob = (b"\n".join(own), np.array(counts, np.int8), np.array(lows, np.int64), np.array(highs, np.int64), ids[docs], text_keys[docs], np.array(places, np.int32), [])
            rows.append((bucket, mark % self.heavy.salts(bucket), False, self.press.compress(pickle.dumps(blob, 5))))
        rows += [(self.buckets + k, 0, True, self.press.compress(pickle.dumps(found, 5))) for k, found in extra.items()]
        self._clear()
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 4, (pa.int32(), pa.int32(), pa.bool_(), pa.binary()))], names=["bucket", "salt", "hot", "blob"])


def _loader(buckets: int, window: int, gram: int):
    """Counts the bytes that each bucket gets from a task."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in chunks(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), (x.as_py() for x in batch.column(2)), window - 1, BLOCK):
                made = super_kmers(block, window, gram)
                if made is not None:
                    np.add.at(total, _bucket_of(made[0], buckets), made[2] - made[1])
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["bucket", "size"])

    return load


def _router(buckets: int, window: int, gram: int, heavy: Heavy, only_heavy: bool):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(buckets, heavy, only_heavy)
        for batch in batches:
            for block in chunks(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), (x.as_py() for x in batch.column(2)), window - 1, BLOCK):
                packer.add(block, window, gram)
                if packer.size >= PACK:
                    yield packer.pack()
        if packer.seen:
            yield packer.pack()

    return route


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def window_minima(strings: list[bytes], lows: np.ndarray, window: int = WINDOW):
    """For distinct packed strings, each held first by document lows[i]: (least document of every window, first window of each string, words of each string).

    Windows are sorted by hash; windows of one hash are compared byte for byte before they count as equal.
    """
    joined = b"\n".join(strings)
    buf = np.frombuffer(joined, np.uint8)
    at, until = word_bounds(buf)
    firsts = np.cumsum([0] + [len(s) + 1 for s in strings[:-1]])
    owner = np.searchsorted(firsts, at, "right") - 1
    sizes = np.bincount(owner, minlength=len(strings))
    words = span_hash(buf, at, until)
    n = len(words) - window + 1
    begin = np.flatnonzero(owner[:n] == owner[window - 1 :])
    code = span_hash(words, begin, begin + window)
    own = lows[owner[begin]]
    order = np.lexsort((own, code))
    sorted_code = code[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_code[1:] != sorted_code[:-1]
    group = np.cumsum(new) - 1
    head = order[np.flatnonzero(new)]
    least = np.empty(len(order), np.int64)
    least[order] = own[order][np.flatnonzero(new)][group]
    first = np.empty(len(order), np.int64)
    first[order] = head[group]
    doubled = np.flatnonzero(first != np.arange(len(order)))
    clash = set()
    begin_at, end_at = at[begin], until[begin + window - 1]
    for i, j in zip(doubled.tolist(), first[doubled].tolist()):
        if joined[begin_at[i] : end_at[i]] != joined[begin_at[j] : end_at[j]]:
            clash.add(j)
    for j in clash:
        exact: dict[bytes, int] = {}
        members = np.flatnonzero(first == j).tolist()
        for i in members:
            key = joined[begin_at[i] : end_at[i]]
            exact[key] = min(exact.get(key, int(own[i])), int(own[i]))
        for i in members:
            least[i] = exact[joined[begin_at[i] : end_at[i]]]
    windows = sizes - window + 1
    return least, np.cumsum(windows) - windows, sizes


def _key(string: bytes) -> bytes:
    return hashlib.blake2b(string, digest_size=16).digest()


class _Held:
    """What a group knows of a string: the least and greatest document that hold it, places (doc_id, text key, position) and links (key, offset) to packed strings that it is a part of and that have further places."""

    __slots__ = ("low", "high", "over", "places", "links")

    def __init__(self):
        self.low, self.high, self.over, self.places, self.links = np.iinfo(np.int64).max, np.iinfo(np.int64).min, False, [], set()

    def take(self, low: int, high: int) -> None:
        self.low, self.high = min(self.low, low), max(self.high, high)


def _merged(blobs: list) -> dict[bytes, _Held]:
    out: dict[bytes, _Held] = {}
    for joined, counts, lows, highs, docs, texts, positions, _ in blobs:
        until = np.cumsum(np.abs(counts.astype(np.int64))).tolist()
        places = list(zip(docs.tolist(), texts.tolist(), positions.tolist()))
        at = 0
        for s, count, low, high, end in zip(joined.split(b"\n"), counts.tolist(), lows.tolist(), highs.tolist(), until):
            held = out.setdefault(s, _Held())
            held.take(low, high)
            held.over |= count < 0
            held.places += places[at:end]
            at = end
    return out


def _splitter(buckets: int, window: int, heavy: Heavy):
    """Packs equal strings of a group of blocks once and deals their windows over the buckets that stand for the heavy one."""

    def split(table: pa.Table) -> pa.Table:
        if table.column("hot")[0].as_py():
            return table.select(["bucket", "hot", "blob"])
        unpack, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        first, parts = heavy.targets(table.column("bucket")[0].as_py())
        strings = _merged([pickle.loads(unpack.decompress(x.as_py())) for x in table.column("blob")])
        joined = b"\n".join(strings)
        buf = np.frombuffer(joined, np.uint8)
        at, until = word_bounds(buf)
        sizes = np.array([len(s) + 1 for s in strings], np.int64)
        owner = np.searchsorted(np.cumsum(sizes) - sizes, at, "right") - 1
        n = len(at) - window + 1
        begin = np.flatnonzero(owner[:n] == owner[window - 1 :])
        part = (span_hash(span_hash(buf, at, until), begin, begin + window) % np.uint64(parts)).astype(np.int64)
        new = np.ones(len(begin), bool)
        new[1:] = (np.diff(begin) != 1) | (owner[begin[1:]] != owner[begin[:-1]]) | (part[1:] != part[:-1])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(begin)) - 1
        word = np.searchsorted(owner, np.arange(len(sizes)))
        whole = list(strings.items())
        out: dict[int, dict[bytes, _Held]] = {}
        for i, j in zip(starts.tolist(), ends.tolist()):
            a, b = begin[i], begin[j] + window - 1
            string, of = whole[owner[a]]
            offset = int(a - word[owner[a]])
            held = out.setdefault(int(part[i]), {}).setdefault(joined[at[a] : until[b]], _Held())
            held.take(of.low, of.high)
            held.places += [(doc, text, place + offset) for doc, text, place in of.places]
            if of.over:
                held.links.add((_key(string), offset))
        rows, extra = [], {}
        for number, own in out.items():
            counts, places, links = [], [], []
            for e, (s, held) in enumerate(own.items()):
                counts.append(len(held.places) if len(held.places) <= INLINE else -INLINE)
                places += held.places[:INLINE]
                links += [(e, key, offset) for key, offset in held.links]
                if len(held.places) > INLINE:
                    key, size = _key(s), s.count(b" ") + 1
                    for doc, text, place in held.places[INLINE:]:
                        extra.setdefault(doc % buckets, []).append((key, doc, text, place, size))
            docs, texts, positions = (np.array([p[k] for p in places], t) for k, t in ((0, np.int64), (1, np.int64), (2, np.int32)))
            blob = (b"\n".join(own), np.array(counts, np.int8), np.array([h.low for h in own.values()], np.int64), np.array([h.high for h in own.values()], np.int64), docs, texts, positions, links)
            rows.append((first + number, False, press.compress(pickle.dumps(blob, 5))))
        rows += [(buckets + k, True, press.compress(pickle.dumps(found, 5))) for k, found in extra.items()]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "hot": pa.array([r[1] for r in rows], pa.bool_()), "blob": pa.array([r[2] for r in rows], pa.binary())})

    return split


def _bucket(window: int):
    def judge(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        blobs = [pickle.loads(unpack.decompress(x)) for x in table.column("blob").to_pylist()]
        if table.column("hot")[0].as_py():
            rows = [r for blob in blobs for r in blob]
            return _found([(2, [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [r[3] + r[4] for r in rows], [r[0] for r in rows], [None] * len(rows))])
        index: dict[bytes, int] = {}
        who, lows, docs, texts, positions = [], [], [], [], []
        links: dict[int, set] = {}
        for joined, counts, low, high, doc, text, position, linked in blobs:
            at = np.array([index.setdefault(s, len(index)) for s in joined.split(b"\n")], np.int64)
            who.append(np.repeat(at, np.abs(counts)))
            lows.append((at, low, high, counts < 0))
            docs.append(doc)
            texts.append(text)
            positions.append(position)
            for e, key, shift in linked:
                links.setdefault(int(at[e]), set()).add((key, shift))
        least_of = np.full(len(index), np.iinfo(np.int64).max)
        most_of = np.full(len(index), np.iinfo(np.int64).min)
        over_of = np.zeros(len(index), bool)
        for at, low, high, over in lows:
            np.minimum.at(least_of, at, low)
            np.maximum.at(most_of, at, high)
            over_of[at] |= over
        strings = list(index)
        least, offset, sizes = window_minima(strings, least_of, window)
        low_of = np.minimum.reduceat(least, offset)
        high_of = np.maximum.reduceat(least, offset)
        who, docs, texts, positions = np.concatenate(who), np.concatenate(docs), np.concatenate(texts), np.concatenate(positions).astype(np.int64)
        whole = docs > high_of[who]
        parts = [(0, docs[whole], texts[whole], positions[whole], positions[whole] + sizes[who[whole]], None, None)]
        part = np.flatnonzero(~whole & (docs > low_of[who]))
        got: tuple[list, list, list, list] = ([], [], [], [])
        for k in part.tolist():
            e = who[k]
            for i, j in _runs(least[offset[e] : offset[e] + sizes[e] - window + 1] < docs[k]):
                for column, value in zip(got, (int(docs[k]), int(texts[k]), int(positions[k]) + i, int(positions[k]) + j + window - 1)):
                    column.append(value)
        parts.append((0, *got, None, None))
        verdicts: tuple[list, list, list, list] = ([], [], [], [])
        over_of[list(links)] = True
        for e in np.flatnonzero(over_of & (most_of > low_of)).tolist():
            asked = sorted({(_key(strings[e]), 0), *links.get(e, ())})
            own = least[offset[e] : offset[e] + sizes[e] - window + 1]
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for i, j in zip(cuts, cuts[1:]):
                for key, shift in asked:
                    for column, value in zip(verdicts, (shift + i, shift + j + window - 1, key, int(own[i]))):
                        column.append(value)
        parts.append((1, [None] * len(verdicts[0]), [None] * len(verdicts[0]), verdicts[0], verdicts[1], verdicts[2], verdicts[3]))
        return _found(parts)

    return judge


def _found(parts: list) -> pa.Table:
    tables = []
    for kind, doc, text, at, until, key, least in parts:
        n = len(at)
        columns = [pa.array(np.full(n, kind, np.int32)), pa.array(doc, pa.int64()), pa.array(text, pa.int64()), pa.array(at).cast(pa.int32()) if n else pa.array([], pa.int32()), pa.array(until).cast(pa.int32()) if n else pa.array([], pa.int32()), pa.array(key, pa.binary()) if key is not None else pa.nulls(n, pa.binary()), pa.array(least, pa.int64()) if least is not None else pa.nulls(n, pa.int64())]
        tables.append(pa.Table.from_arrays(columns, schema=_FOUND_ARROW))
    return pa.concat_tables(tables)


def _loads(source: DataFrame, buckets: int, window: int, gram: int, limit: int) -> Heavy:
    """The buckets of more than limit bytes; where they would be too many to name to every task, those of more than their even share of MOST_HEAVY."""
    sizes = materialise(source.mapInArrow(lean(_loader(buckets, window, gram)), "bucket int, size long").groupBy("bucket").agg(F.sum("size").alias("size")), "loads")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    limit = max(limit, total // MOST_HEAVY)
    found = sizes.where(F.col("size") > limit).toArrow()  # MOST_HEAVY rows at most
    return Heavy(found.column("bucket").to_numpy().astype(np.int64), found.column("size").to_numpy().astype(np.int64), limit, 2 * buckets)


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, text_key, spans): word ranges [at, until) of the rows with that hash of their text, covered by a window that also starts in a document with a smaller doc_id. Buckets of more than heavy bytes are split."""
    spark = docs.sparkSession
    buckets = max(64, BUCKETS * partitions(spark))
    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), row_key("text").alias("text_key"), as_bytes("text"))
    loads = _loads(source, buckets, window, gram, heavy)
    routed = source.mapInArrow(lean(_router(buckets, window, gram, loads, False)), _ROUTED).select("bucket", "hot", "blob")
    if len(loads.buckets):
        dealt = source.mapInArrow(lean(_router(buckets, window, gram, loads, True)), _ROUTED)
        routed = routed.unionByName(dealt.groupBy("bucket", "salt").applyInArrow(_splitter(buckets, window, loads), _SPLIT))
    found = materialise(routed.groupBy("bucket").applyInArrow(_bucket(window), _FOUND), "spans")
    late = found.where("kind = 2").select("doc_id", "text_key", "key", F.col("at").alias("base"))
    verdict = found.where("kind = 1").select("key", "at", "until", "least")
    late = late.join(verdict.hint("merge"), "key").where("least < doc_id").select("doc_id", "text_key", (F.col("base") + F.col("at")).alias("at"), (F.col("base") + F.col("until")).alias("until"))
    spans = found.where("kind = 0").select("doc_id", "text_key", "at", "until").unionByName(late)
    return spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("at", "until")).alias("spans"))


def _stripper(tidy: bool):
    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_of, removed, kept = [], [], []
            for data, spans in zip(batch.column(1), batch.column(2).to_pylist()):
                data = data.as_py() or b""
                words = data.split()
                words_of.append(len(words))
                if spans:
                    flag = bytearray(len(words))
                    for span in spans:
                        flag[span["at"] : min(span["until"], len(words))] = b"\x01" * max(0, min(span["until"], len(words)) - span["at"])
                    words = [w for w, gone in zip(words, flag) if not gone]
                removed.append(words_of[-1] - len(words))
                kept.append((b" ".join(words) if tidy or removed[-1] else data).decode("utf-8", "replace"))
            yield pa.record_batch([batch.column(0), pa.array(words_of, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["row", "n_words", "n_removed", "kept_text"])

    return strip


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, carry: list[str] | None = None, tidy: bool = True, heavy: int = HEAVY) -> DataFrame:
    """docs' doc_id and the carry columns, with n_words, n_removed and kept_text (the words left, joined by one space; without tidy, a text that loses no word stays as it is)."""
    carry = carry or []
    spans = repeated_spans(docs, window, gram, heavy)
    row = F.struct(F.col("doc_id"), *[F.col(c) for c in carry])
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("text").alias("text_key"), row.alias("row"), as_bytes("text").alias("text"))
    joined = marked.join(spans, ["doc_id", "text_key"], "left").select("row", "text", "spans")
    kind = joined.schema["row"].dataType.simpleString()
    out = joined.mapInArrow(lean(_stripper(tidy)), f"row {kind}, n_words long, n_removed long, kept_text string")
    return out.select("row.*", "n_words", "n_removed", "kept_text")
