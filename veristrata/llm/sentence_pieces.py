"""Unigram encoding with a piece vocabulary, and decoding.

A text gets the segmentation with the greatest sum of piece scores: Viterbi over a double-array trie of the pieces. No
piece continues across a space that follows another character, so a text falls into units (a run of markers and what
follows it) that are solved alone, each distinct unit once. Units of like length advance together, one byte position at a time.

A character without a piece of its own costs UNKNOWN_PENALTY less than the least score and becomes byte pieces (or the
unknown piece, where the vocabulary has no byte pieces). Of equal sums the segmentation whose last piece starts first wins.

Defined results: null and empty texts have no pieces and decode to an empty text; a marker in the text itself decodes to
a space, like every marker; bytes that are not UTF-8 after decoding become U+FFFD.
"""

from __future__ import annotations

import array
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.llm.common import lean
from veristrata.llm.trie import BYTE, MARK, NORMAL, UNKNOWN, USER_DEFINED, DoubleArray, Encoded, Vocabulary, by_size, matrix, ragged, read_vocabulary, text_slices

UNKNOWN_PENALTY = 10.0
#: Bytes of text that are encoded together.
SLICE = 2 << 20
#: Units of more bytes are solved alone, byte by byte.
LONG_UNIT = 1 << 12


class UnigramModel:
    def __init__(self, vocabulary: Vocabulary):
        self.dummy_prefix = vocabulary.dummy_prefix
        matched = [i for i, kind in enumerate(vocabulary.kinds) if kind in (NORMAL, USER_DEFINED)]
        self.scores = np.array(vocabulary.scores, np.float64)
        self.trie = DoubleArray({vocabulary.pieces[i].encode(): i for i in matched})
        self.unknown = next(i for i, kind in enumerate(vocabulary.kinds) if kind == UNKNOWN)
        self.unknown_score = float(self.scores[matched].min()) - UNKNOWN_PENALTY
        self.bytes = np.full(256, self.unknown, np.int32)
        decoded = []
        for i, (piece, kind) in enumerate(zip(vocabulary.pieces, vocabulary.kinds)):
            if kind == BYTE:
                self.bytes[int(piece[3:5], 16)] = i
                decoded.append(bytes([int(piece[3:5], 16)]))
            else:
                decoded.append(piece.replace(MARK, " ").encode() if kind in (NORMAL, USER_DEFINED) else b" \xe2\x81\x87 " if kind == UNKNOWN else b"")
        self.falls_back = bool((self.bytes != self.unknown).any())
        self.is_byte = np.zeros(len(decoded), bool)
        self.is_byte[self.bytes[self.bytes != self.unknown]] = True
        self.decoded_sizes = np.array([len(x) for x in decoded], np.int64)
        self.decoded_starts = np.cumsum(self.decoded_sizes) - self.decoded_sizes
        self.decoded = np.frombuffer(b"".join(decoded), np.uint8)
        self.piece_bytes = [len(piece.encode()) for piece in vocabulary.pieces]
        self.reach = max([4, *(self.piece_bytes[i] for i in matched)])
        self.lists = None

    def encode_units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of pieces, pieces) of distinct units; their markers are written as spaces, the first left out."""
        marked = pc.replace_substring(pc.binary_join_element_wise(pa.scalar(" ", pa.string()), units.cast(pa.string()), ""), " ", MARK).cast(pa.binary())
        sizes = np.zeros(len(units), np.int64)
        found = []
        for places, part, width in by_size(marked):
            own, ids = self._viterbi(part, width) if width <= LONG_UNIT else self._walk(part)
            sizes[places] = own
            found.append((places, own, ids))
        starts = np.cumsum(sizes) - sizes
        items = np.zeros(int(sizes.sum()), np.int32)
        for places, own, ids in found:
            items[ragged(starts[places], own)] = ids
        return sizes, items

    def _viterbi(self, units: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
        text, sizes = matrix(units, width)
        text = np.ascontiguousarray(text.T)  # what belongs to one position lies together
        n = len(sizes)
        rows = np.arange(n)
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0
        came = np.zeros((width + 1, n), np.int32)
        piece = np.zeros((width + 1, n), np.int32)
        for i in range(width):
            byte = text[i]
            char = np.where(byte < 0x80, 1, np.where(byte < 0xE0, 2, np.where(byte < 0xF0, 3, 4)))
            who = origin = rows[(sizes > i) & ((byte & 0xC0) != 0x80)]
            single = np.zeros(n, bool)
            state = np.zeros(len(who), np.int64)
            for j in range(i, width):
                inside = sizes[who] > j
                who, state = who[inside], state[inside]
                state, ok = self.trie.step(state, text[j, who])
                who, state = who[ok], state[ok]
                if not len(who):
                    break
                value = self.trie.value[state]
                ended = value >= 0
                at, value = who[ended], value[ended]
                single[at[char[at] == j + 1 - i]] = True
                score = best[i, at] + self.scores[value]
                better = score > best[j + 1, at]
                at, value = at[better], value[better]
                best[j + 1, at], came[j + 1, at], piece[j + 1, at] = score[better], i, value
            at = origin[~single[origin]]
            to = np.minimum(i + char[at], sizes[at])
            score = best[i, at] + self.unknown_score
            better = score > best[to, at]
            at, to = at[better], to[better]
            best[to, at], came[to, at], piece[to, at] = score[better], i, self.unknown
        steps = []
        who, end = rows, sizes.copy()
        while len(who):
            start = came[end, who]
            steps.append((who, start, end, piece[end, who]))
            who, end = who[start > 0], start[start > 0]
        who, start, end, ids = (np.concatenate(x) for x in zip(*steps))
        order = np.lexsort((start, who))
        who, start, end, ids = who[order], start[order], end[order], ids[order]
        spread = np.where((ids == self.unknown) & self.falls_back, end - start, 1)
        at = ragged(np.zeros(len(spread), np.int64), spread)
        ids, who, start = np.repeat(ids, spread), np.repeat(who, spread), np.repeat(start, spread)
        if self.falls_back:
            raw = ids == self.unknown
            ids[raw] = self.bytes[text[start[raw] + at[raw], who[raw]]]
        return np.bincount(who, minlength=n), ids

    def _walk(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for units of any length, one after another: 4 bytes are kept for each byte of a unit, and sums only as far back as a piece reaches."""
        if self.lists is None:
            self.lists = self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.scores.tolist()
        base, check, values, scores = self.lists
        reach, fallback, out, sizes = self.reach, self.unknown_score, [], []
        for unit in units.to_pylist():
            n = len(unit)
            piece = array.array("i", bytes(4 * (n + 1)))
            sums = [-math.inf] * (reach + 1)
            sums[0] = 0.0
            for i in range(n):
                here = sums[i % (reach + 1)]
                sums[i % (reach + 1)] = -math.inf  # from now on the place of what ends reach + 1 bytes later
                byte = unit[i]
                if byte & 0xC0 == 0x80 or here == -math.inf:
                    continue
                char = min(1 if byte < 0x80 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4, n - i)
                state, single = 0, False
                for j in range(i, n):
                    to = base[state] + unit[j]
                    if not (base[state] > 0 and to < len(check) and check[to] == state):
                        break
                    state = to
                    value = values[state]
                    if value >= 0:
                        end = j + 1
                        single = single or end - i == char
                        if here + scores[value] > sums[end % (reach + 1)]:
                            sums[end % (reach + 1)], piece[end] = here + scores[value], value
                if not single and here + fallback > sums[(i + char) % (reach + 1)]:
                    sums[(i + char) % (reach + 1)], piece[i + char] = here + fallback, self.unknown
            ids, end = array.array("i"), n
            while end:
                own = piece[end]
                if own == self.unknown:
                    start = end - 1
                    while unit[start] & 0xC0 == 0x80:
                        start -= 1
                    ids.extend([int(self.bytes[b]) for b in reversed(unit[start:end])] if self.falls_back else [own])
                    end = start
                else:
                    ids.append(own)
                    end -= self.piece_bytes[own]
            ids.reverse()
            out.append(np.frombuffer(ids, np.int32) if len(ids) else np.zeros(0, np.int32))
            sizes.append(len(ids))
        return np.array(sizes, np.int64), np.concatenate(out)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The texts of id sequences that end at ends, one after another."""
        sizes = self.decoded_sizes[ids]
        data = self.decoded[ragged(self.decoded_starts[ids], sizes)].tobytes()
        edge = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], ends))].tolist()
        skip = int(self.dummy_prefix)
        return [data[a + (skip if data[a : a + 1] == b" " else 0) : b] for a, b in zip(edge, edge[1:])]


_UNIT = re.compile(r" *[^ ]+| +$")


def units_of(texts: pa.Array, dummy_prefix: bool) -> tuple[np.ndarray, pa.Array]:
    """(numbers of units, units) of texts; a unit's first marker is left out."""
    texts = pc.fill_null(texts, "")
    odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.or_(pc.ends_with(texts, " "), pc.equal(texts, ""))))
    if not dummy_prefix or pc.any(odd).as_py():
        parts = []
        for text, strange in zip(texts.to_pylist(), odd.to_pylist()):
            if not text:
                parts.append([])
            elif not dummy_prefix:
                raise ValueError("vocabularies without a leading marker are not supported")
            else:
                parts.append([u[1:] for u in _UNIT.findall(" " + text)] if strange else text.split(" "))
        split = pa.array(parts, pa.list_(pa.string()))
    else:
        split = pc.split_pattern(texts, " ")
    return np.diff(split.offsets.to_numpy()).astype(np.int64), split.flatten().cast(pa.binary())


#: What sentence_pieces can return of a decoded text: the text itself, or only whether it is the text that was encoded.
TEXT, COMPARED = "decoded", "round_trip"


def _coder(shared, decode: str | None):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: UnigramModel = shared.value
        cache = Encoded(model.encode_units)
        for whole in batches:
            for batch in text_slices(whole, 1, SLICE):
                texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
                counts, units = units_of(texts, model.dummy_prefix)
                places = cache.places(units)
                sizes = cache.sizes[places]
                ids = cache.items[ragged(cache.starts[places], sizes)]
                ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(counts)]
                del units, places, sizes
                columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids, pa.int32()))]
                names = ["row", "ids"]
                if decode:
                    found = model.decode(ids, ends)
                    if decode == TEXT:
                        columns.append(pa.array([x.decode("utf-8", "replace") for x in found], pa.string()))
                    else:
                        columns.append(pc.equal(pa.array(found, pa.binary()), texts.cast(pa.binary())))
                    columns.append(pa.array(np.add.reduceat(np.append(model.is_byte[ids], False).astype(np.int64), np.minimum(np.concatenate(([0], ends[:-1])), len(ids))) * (np.diff(np.concatenate(([0], ends))) > 0), pa.int64()))
                    names += [decode, "n_byte_pieces"]
                yield pa.record_batch(columns, names=names)

    return code


def _broadcast(spark, path: str):
    return spark.sparkContext.broadcast(UnigramModel(read_vocabulary(path)))


def sentence_pieces(docs: DataFrame, path: str, carry: list[str] | None = None, decode: str | None = TEXT) -> DataFrame:
    """doc_id, the carry columns and ids (array<int>) of each row; with decode also n_byte_pieces and, for TEXT, decoded (the text decoded from ids) or, for COMPARED, round_trip (whether that is the row's text, null read as empty)."""
    row = F.struct(F.col("doc_id"), *[F.col(c) for c in carry or []])
    source = docs.select(row.alias("row"), F.col("text").alias("text"))
    kind = source.schema["row"].dataType.simpleString()
    more = f", {decode} {'string' if decode == TEXT else 'boolean'}, n_byte_pieces long" if decode else ""
    out = source.mapInArrow(lean(_coder(_broadcast(docs.sparkSession, path), decode)), f"row {kind}, ids array<int>{more}")
    return out.select("row.*", "ids", *([decode, "n_byte_pieces"] if decode else []))
