"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton of a block of items recognises every word sequence that occurs in one of them. Training words stream
through it; after each word it holds the longest suffix that still occurs. A suffix of WINDOW words or more marks its
last WINDOW words, and an item shorter than WINDOW marks its whole length where it ends.

Items are dealt to blocks of at most BLOCK_WORDS words (an item is never split unless it is itself longer, and then with
overlap), so a broadcast automaton has a fixed bound whatever the number of items. Every document streams
through every block's automaton: a stated query set against all rows, in blocks. The first block's scan returns every row;
the others' return only the finds of rows that have any, which are united by row. A worker builds a block's automaton once.

Defined results: null and word-less texts have no words; items without words are never found; equal items are all
counted; null item_ids are left out; rows that share a doc_id are judged each for itself, a null doc_id like any other. Ids of
any type are read as strings in the digest. Columns of the input keep their names: the operators use only doc_id, text and the carry columns.
"""

from __future__ import annotations

import functools
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.llm.common import as_bytes, held, lean, materialise, pieces, row_key

WINDOW = 13
#: Words of one block of items; its automaton has at most twice as many states.
BLOCK_WORDS = 200_000
#: A document is contaminated if it has hits, and hits * SHARE >= words.
SHARE = 20

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(_WORDS).split()


class SuffixAutomaton:
    """Built online over several word sequences; each state keeps which items' windows end in it."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, set] = {}
        shorts = []
        for item, words in items:
            at = 0
            for k, word in enumerate(words):
                at = self._extend(at, self.vocabulary.setdefault(word, len(self.vocabulary)))
                if k + 1 >= window:
                    ends.setdefault(at, set()).add(item)
            if 0 < len(words) < window:
                shorts.append((item, words))
        self.windows = self._windows(ends)
        own: dict[int, list] = {}
        for item, words in shorts:
            at = 0
            for word in words:
                at = self.step[at][self.vocabulary[word]]
            own.setdefault(at, []).append((len(words), item))
        self.shorts = self._inherit(own)

    def _state(self, length: int, link: int, step: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        return len(self.link) - 1

    def _extend(self, last: int, word: int) -> int:
        known = self.step[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, word, known)
        new = self._state(self.length[last] + 1, 0, {})
        at = last
        while at != -1 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at != -1:
            known = self.step[at][word]
            self.link[new] = known if self.length[known] == self.length[at] + 1 else self._split(at, word, known)
        return new

    def _split(self, at: int, word: int, known: int) -> int:
        twin = self._state(self.length[at] + 1, self.link[known], dict(self.step[known]))
        self.link[known] = twin
        while at != -1 and self.step[at].get(word) == known:
            self.step[at][word] = twin
            at = self.link[at]
        return twin

    def _windows(self, ends: dict[int, set]) -> list[frozenset | None]:
        """By state: the items of the last window words of its sequences, None for shorter ones. States in order of length take over from the suffix link."""
        order = np.argsort(self.length, kind="stable").tolist()
        cut = [-1] * len(order)  # the state that holds just the last window words
        for state in order:
            if self.length[state] >= self.window:
                link = self.link[state]
                cut[state] = cut[link] if self.length[link] >= self.window else state
        held_by: dict[int, set] = {}
        for state, items in ends.items():
            held_by.setdefault(cut[state], set()).update(items)
        fixed = {state: frozenset(items) for state, items in held_by.items()}
        return [fixed.get(c) for c in cut]

    def _inherit(self, own: dict[int, list]) -> dict[int, list]:
        """Short items by state, with those of all its suffixes."""
        out: dict[int, list] = {}
        for state in np.argsort(self.length, kind="stable").tolist():
            found = own.get(state, []) + (out.get(self.link[state], []) if state else [])
            if found:
                out[state] = found
        return out

    def scan(self, words: list[bytes]) -> Iterator[tuple[int, int, frozenset | tuple]]:
        """(end, matched words, items) of each window and each short item that occurs, by its end."""
        ids = map(self.vocabulary.get, words)
        step, link, length, window, shorts, windows = self.step, self.link, self.length, self.window, self.shorts, self.windows
        state = size = 0
        for end, word in enumerate(ids, 1):
            if word is None:
                state = size = 0
                continue
            to = step[state].get(word)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = step[state].get(word)
            if to is None:
                size = 0
                continue
            state = to
            size += 1
            if size >= window:
                yield end, window, windows[state]
            if state in shorts:
                for most, item in shorts[state]:
                    if most <= size:
                        yield end, most, (item,)


def _search(automaton: SuffixAutomaton, data: bytes) -> tuple[int, list[tuple[int, int]], set]:
    """(words, hit ranges, items) of one whole text."""
    n, spans, items = 0, [], set()
    for base, piece in pieces(data.translate(_WORDS), automaton.window - 1):
        words = piece.split()
        n = base + len(words)
        for end, size, found in automaton.scan(words):
            items.update(found)
            low, high = base + end - size, base + end
            if spans and spans[-1][0] <= low <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(high, spans[-1][1]))
            else:
                spans.append((low, high))
    return n, spans, items


_SPANS = pa.list_(pa.struct([("at", pa.int64()), ("until", pa.int64())]))
_FINDS = "n_words long, spans array<struct<at:long,until:long>>, items array<string>"


def _finds(searched: list) -> list[pa.Array]:
    return [
        pa.array([n for n, _, _ in searched], pa.int64()),
        pa.array([[{"at": a, "until": b} for a, b in spans] for _, spans, _ in searched], _SPANS),
        pa.array([sorted(items) for _, _, items in searched], pa.list_(pa.string())),
    ]


def _scanner(shared, name: str, every: bool):
    """The finds of each row, or only of the rows that have any."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            automaton = held(name, lambda: SuffixAutomaton(**shared.value))
            searched = [_search(automaton, data.as_py() or b"") for data in batch.column(1)]
            rows = batch.column(0)
            if not every:
                chosen = [bool(spans) for _, spans, _ in searched]
                rows, searched = rows.filter(pa.array(chosen, pa.bool_())), [x for x, ok in zip(searched, chosen) if ok]
            yield pa.record_batch([rows, *_finds(searched)], names=["row", "n_words", "spans", "items"])

    return scan


def item_blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[list]:
    """Items as (item_id, words), in blocks of at most block_words words; the driver holds two blocks at a time."""
    block, size = [], 0
    for row in benchmark.where("item_id is not null").select(F.col("item_id").cast("string"), as_bytes("text")).toLocalIterator():
        words = words_of(row[1])
        for i in range(0, max(1, len(words) - window + 1), block_words) if len(words) > block_words else (0,):
            part = words[i : i + block_words + window - 1] if len(words) > block_words else words
            if block and size + len(part) > block_words:
                yield block
                block, size = [], 0
            if part:
                block.append((row[0], part))
                size += len(part)
    yield block


def _united(spans: list[dict]) -> list[dict]:
    """Ranges that touch or overlap as one, in order; so they don't depend on how items were dealt to blocks."""
    out: list[dict] = []
    for span in sorted(spans, key=lambda s: s["at"]):
        if out and span["at"] <= out[-1]["until"]:
            out[-1]["until"] = max(out[-1]["until"], span["until"])
        else:
            out.append(dict(span))
    return out


def _covered(spans: list[dict]) -> int:
    return sum(span["until"] - span["at"] for span in spans)


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [_united(x or []) for x in batch.column(2).to_pylist()]
        items = [sorted(x or []) for x in batch.column(3).to_pylist()]
        digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(spans, _SPANS), pa.array(map(_covered, spans), pa.int64()), pa.array(map(len, items), pa.int64()), pa.array(digests, pa.string())],
            names=["row", "n_words", "spans", "n_hit", "n_items", "items_sha256"],
        )


def _whole(shared, name: str):
    scan = _scanner(shared, name, True)
    return lambda batches: _summarise(scan(batches))


def contamination(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None, window: int = WINDOW, share: int = SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, the carry columns, n_words, n_hit, n_items, items_sha256, spans (hit word ranges) and contaminated of each row."""
    spark = docs.sparkSession
    row = F.struct(F.struct(F.col("doc_id"), *[F.col(c) for c in carry or []]).alias("kept"), row_key("text").alias("text_key"))
    source = docs.select(row.alias("row"), as_bytes("text").alias("text"))
    kind = source.schema["row"].dataType.simpleString()
    summary = f"row {kind}, n_words long, spans array<struct<at:long,until:long>>, n_hit long, n_items long, items_sha256 string"
    blocks = item_blocks(benchmark, window, block_words)
    block, following = next(blocks), next(blocks, None)
    shared = spark.sparkContext.broadcast({"items": block, "window": window})
    if following is None:
        out = source.mapInArrow(lean(_whole(shared, uuid.uuid4().hex)), summary)
    else:
        first = materialise(source.mapInArrow(lean(_scanner(shared, uuid.uuid4().hex, True)), f"row {kind}, {_FINDS}"), "scanned")
        ids = docs.select(F.struct(F.col("doc_id"), row_key("text").alias("text_key")).alias("row"), as_bytes("text").alias("text"))
        own = ids.schema["row"].dataType.simpleString()
        more = []
        while following is not None:
            shared = spark.sparkContext.broadcast({"items": following, "window": window})
            more.append(materialise(ids.mapInArrow(lean(_scanner(shared, uuid.uuid4().hex, False)), f"row {own}, {_FINDS}"), "scanned"))
            shared.unpersist()
            following = next(blocks, None)
        united = functools.reduce(DataFrame.unionByName, more).groupBy(F.col("row.doc_id").alias("_id"), F.col("row.text_key").alias("_key")).agg(F.flatten(F.collect_set("spans")).alias("more_spans"), F.flatten(F.collect_set("items")).alias("more_items"))
        joined = first.join(united, F.col("row.kept.doc_id").eqNullSafe(F.col("_id")) & (F.col("row.text_key") == F.col("_key")), "left")
        empty = "array()"
        joined = joined.selectExpr("row", "n_words", f"concat(spans, coalesce(more_spans, {empty})) as spans", f"array_union(items, coalesce(more_items, {empty})) as items")
        out = joined.mapInArrow(lean(_summarise), summary)
    return out.select("row.kept.*", "n_words", "n_hit", "n_items", "items_sha256", "spans", (F.expr(f"n_hit > 0 and {share} * n_hit >= n_words")).alias("contaminated"))


_RUN = re.compile(rb"[^ ]+")


def cut_spans(data: bytes, spans: list[dict], longest: int, share: int) -> bytes:
    """A text without the hit ranges (united, in order) that have at least `longest` words, or without all of them if they are a share-th of its words."""
    folded = data.translate(_WORDS)
    places = [m.span() for m in _RUN.finditer(folded)]
    whole = share * _covered(spans) >= len(places)
    out, edge = [], 0
    for span in spans:
        if whole or span["until"] - span["at"] >= longest:
            at, until = places[span["at"]][0], places[span["until"] - 1][1]
            out.append(data[edge:at])
            edge = until
    return b"".join(out) + data[edge:]


def _cutter(longest: int, share: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [data.as_py() for data in batch.column(1)]
            clean = [cut_spans(data, spans, longest, share).decode("utf-8", "replace") if data is not None and spans else None if data is None else data.decode("utf-8", "replace") for data, spans in zip(texts, batch.column(2).to_pylist())]
            yield pa.record_batch([batch.column(0), pa.array(clean, pa.string())], names=["row", "clean_text"])

    return cut


def remove_spans(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None, longest: int = WINDOW, share: int = SHARE, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, the carry columns and clean_text: each row's text without the hit ranges of at least `longest` words, and without any hit range where the hits are a share-th of the words or more. A null text stays null."""
    carry = carry or []
    named = docs.select(F.struct("doc_id", *carry).alias("kept"), "doc_id", "text")
    found = contamination(named, benchmark, ["kept", "text"], window, share, block_words)
    source = found.select(F.col("kept").alias("row"), as_bytes("text").alias("text"), "spans")
    kind = source.schema["row"].dataType.simpleString()
    return source.mapInArrow(lean(_cutter(longest, share)), f"row {kind}, clean_text string").select("row.*", "clean_text")
