"""Cross-entropy difference: how much better a target corpus' language model predicts a document than the whole corpus' one.

Both models are interpolated bigram models of one form over one vocabulary, which is every word of all documents and one
unknown word. Every word and every pair of neighbours counts, however rare:

    P(w | v) = L * c(v, w) / c(v) + (1 - L * kept(v) / c(v)) * P(w)        P(w) = (c(w) + 1) / (N + V)

where kept(v) = c(v), as no pair is left out. A row is scored by models that haven't read it: its own counts are taken out of
the background model, and out of the target model if it is one of the targets. Else every text would be predicted from itself, a
target doubly so, and rare words would say nothing. Nothing that grows with the corpus is held in one place: documents are written
in blocks of about BLOCK_BYTES as codes of the block's own words. Each block hands on its distinct words and pairs with their
counts, dealt by hash into packed buckets whose number grows with the corpus; a bucket sums them by word or pair and gives each
block the sums back in the order in which it had sent them. A pair with a word that no other block has isn't sent, as the
block's own counts are the sums already.

Callers can ask for smaller models: with most_words, words with less than 1/most_words of all tokens are one unknown word;
with most_pairs, pairs with less than 1/most_pairs of them are left out and their share of a context goes to the unigram
model, so each distribution still sums to one. These models are held by every worker.

Defined results: null and blank texts have no tokens, losses of 0 and a score of 0; a target without tokens gives the
uniform model over the vocabulary; documents listed twice as targets count once; rows that share a doc_id are counted and scored each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.llm.common import fresh_path, lean, materialise, mix, open_uri, partitions, small, span_hash, trim
from veristrata.llm.trie import text_slices

WEIGHT = 0.5
#: Bytes of text in a block, or one text that is longer.
BLOCK_BYTES = 16 << 20
#: Blocks' words and pairs that meet in a bucket on average, at most.
BUCKET_WORDS = 500_000
BUCKET_PAIRS = 2_000_000
#: Distinct pairs that a task holds before it hands them on.
HELD = 1 << 20


def _tokens(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, pa.Array]:
    """(row of each token, lower-cased tokens)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column(column).cast(pa.string()), "")))
    words = split.flatten()
    real = pc.not_equal(words, "")
    owner = np.repeat(np.arange(len(batch)), np.diff(split.offsets.to_numpy()))
    return owner[real.to_numpy(zero_copy_only=False)], words.filter(real)


def _word_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in text_slices(whole, 0, 16 << 20):
            owner, words = _tokens(batch, 0)
            coded = words.dictionary_encode()
            at = coded.indices.to_numpy(zero_copy_only=False)
            n = len(coded.dictionary)
            target = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)[owner]
            yield pa.record_batch([coded.dictionary, pa.array(np.bincount(at, minlength=n), pa.int64()), pa.array(np.bincount(at, target, n).astype(np.int64), pa.int64())], names=["word", "n", "n_target"])


class Vocabulary:
    """Ids 1..V of the words in order; 0 is unknown; V + 1 is the start of a text, which is only a context."""

    def __init__(self, words: list[str]):
        self.words = pa.array(words, pa.string())
        self.size = len(words) + 2

    def ids(self, words: pa.Array) -> np.ndarray:
        coded = words.dictionary_encode()
        known = pc.fill_null(pc.add(pc.index_in(coded.dictionary, value_set=self.words), 1), 0).to_numpy(zero_copy_only=False)
        return known[coded.indices.to_numpy(zero_copy_only=False)].astype(np.int64)

    def pairs(self, owner: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """context * size + word of each token."""
        before = np.concatenate(([0], ids[:-1]))
        first = np.ones(len(ids), bool)
        first[1:] = owner[1:] != owner[:-1]
        before[first] = self.size - 1
        return before * self.size + ids


def _pair_counter(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Vocabulary = shared.value
        held: list = []

        def merged() -> list:
            keys, n, m = (np.concatenate(x) for x in zip(*held))
            unique, at = np.unique(keys, return_inverse=True)
            return [(unique, np.bincount(at, n, len(unique)).astype(np.int64), np.bincount(at, m, len(unique)).astype(np.int64))]

        def out(parts: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array(x, pa.int64()) for x in parts[0]], names=["pair", "n", "n_target"])

        for whole in batches:
            for batch in text_slices(whole, 0):
                owner, words = _tokens(batch, 0)
                if not len(owner):
                    continue
                pairs = vocabulary.pairs(owner, vocabulary.ids(words))
                target = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)[owner]
                unique, at = np.unique(pairs, return_inverse=True)
                held.append((unique, np.bincount(at, minlength=len(unique)), np.bincount(at, target, len(unique)).astype(np.int64)))
                if sum(len(x[0]) for x in held) > HELD:
                    held[:] = merged()
                    if len(held[0][0]) > HELD // 2:
                        yield out(held)
                        held.clear()
        if held:
            yield out(merged())

    return count


def _within(owner: np.ndarray, keys: np.ndarray, size: int, weights: np.ndarray | None = None) -> np.ndarray:
    """How often (or with what sum of weights) each token's key, below size, comes up in its own row."""
    both, at = np.unique(owner * size + keys, return_inverse=True)
    return np.bincount(at, weights, len(both)).astype(np.int64)[at]


def _losses(word_n: np.ndarray, context_n: np.ndarray, kept_n: np.ndarray, pair_n: np.ndarray, total: np.ndarray, n_words: int, weight: float) -> np.ndarray:
    """The loss of each token, given the counts of its word, context and pair in a model, and the model's tokens."""
    seen = np.maximum(context_n, 1)
    return -np.log((1 - weight * kept_n / seen) * (word_n + 1.0) / (total + n_words + 1) + weight * pair_n / seen)


class Bigrams:
    """One corpus' model: counts by word id, by context, of a context's pairs in the shared table, and of these pairs."""

    def __init__(self, size: int, words: np.ndarray, contexts: np.ndarray, pairs: np.ndarray, counts: np.ndarray, weight: float):
        self.words, self.contexts, self.counts, self.weight = words, contexts, np.append(counts, 0), weight
        self.kept = np.bincount(pairs // size, counts, size).astype(np.int64)
        self.total, self.n_words = int(words.sum()), size - 2

    def losses(self, context: np.ndarray, word: np.ndarray, at: np.ndarray, own: tuple) -> np.ndarray:
        """own: what the row's own counts take from those of the word, context, kept pairs and pair, and from the tokens."""
        return _losses(self.words[word] - own[0], self.contexts[context] - own[1], self.kept[context] - own[2], np.where(at >= 0, self.counts[at], 0) - own[3], self.total - own[4], self.n_words, self.weight)


class Models:
    def __init__(self, vocabulary: Vocabulary, pairs: np.ndarray, background: Bigrams, target: Bigrams):
        self.vocabulary, self.pairs, self.background, self.target = vocabulary, pairs, background, target


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: Models = shared.value
        size = models.vocabulary.size
        for whole in batches:
            for batch in text_slices(whole, 1):
                owner, words = _tokens(batch, 1)
                pairs = models.vocabulary.pairs(owner, models.vocabulary.ids(words)) if len(owner) else np.zeros(0, np.int64)
                unique, where = np.unique(pairs, return_inverse=True)
                at = np.full(len(unique), -1, np.int64)
                if len(models.pairs):
                    at = np.minimum(np.searchsorted(models.pairs, unique), len(models.pairs) - 1)
                    at[models.pairs[at] != unique] = -1
                context, word, at = pairs // size, pairs % size, at[where]
                n = np.bincount(owner, minlength=len(batch))
                inside = at >= 0
                own = (_within(owner, word, size), _within(owner, context, size), _within(owner, context, size, inside), np.where(inside, _within(owner, where, len(unique) + 1), 0), n[owner])
                target = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)[owner]
                sums = [np.bincount(owner, m.losses(context, word, at, o), len(batch)) / np.maximum(n, 1) for m, o in ((models.target, [x * target for x in own]), (models.background, own))]
                yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), *[pa.array(x, pa.float64()) for x in sums]], names=["row", "n_tokens", "target_loss", "background_loss"])

    return score


def train(docs: DataFrame, is_target: str, most_words: int | None = None, most_pairs: int | None = None, weight: float = WEIGHT) -> Models:
    """Both models in one place, for bounds that keep them small, from docs' text; is_target names a boolean column."""
    spark = docs.sparkSession
    source = docs.select(F.col("text"), F.coalesce(F.col(is_target), F.lit(False)).alias("target"))
    words = materialise(source.mapInArrow(lean(_word_counter), "word string, n long, n_target long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target")), "words")
    total = words.agg(F.sum("n"), F.sum("n_target")).first()
    tokens, target_tokens = int(total[0] or 0), int(total[1] or 0)
    common = words.where(F.lit(True) if most_words is None else F.col("n") * most_words >= tokens).orderBy("word").toArrow()
    vocabulary = Vocabulary(common.column("word").to_pylist())
    size = vocabulary.size
    shared = spark.sparkContext.broadcast(vocabulary)
    pairs = materialise(source.mapInArrow(lean(_pair_counter(shared)), "pair long, n long, n_target long").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target")), "pairs")
    contexts = pairs.groupBy(F.expr(f"pair div {size}").alias("context")).agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target")).toArrow()
    table = pairs.where(F.lit(True) if most_pairs is None else F.col("n") * most_pairs >= tokens).toArrow().sort_by("pair")
    keys = table.column("pair").to_numpy()
    models = []
    for column, all_ in (("n", tokens), ("n_target", target_tokens)):
        known = common.column(column).to_numpy()
        unigram = np.concatenate(([all_ - known.sum()], known, [0])).astype(np.int64)
        seen = np.zeros(size, np.int64)
        seen[contexts.column("context").to_numpy()] = contexts.column(column).to_numpy()
        models.append(Bigrams(size, unigram[: size - 1], seen, keys, table.column(column).to_numpy(), weight))
    return Models(vocabulary, keys, *models)


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers, compressed byte place by byte place."""
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    places = pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(places, np.uint8).reshape(8, n).T).view("<i8").ravel()


def _pack_words(words: pa.Array) -> bytes:
    """Words, none of which holds a line feed."""
    data = "\n".join(words.to_pylist()).encode()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpack_words(data: bytes) -> list[str]:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True).decode().split("\n")


def _dealt(buckets: np.ndarray, n_buckets: int, *within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the members by bucket, where each bucket starts in it)."""
    order = np.lexsort((*within, buckets)) if within else np.argsort(buckets, kind="stable")
    return order, np.searchsorted(buckets[order], np.arange(n_buckets + 1))


class Block:
    """A written block: its rows (row, n_tokens, target), its distinct words, and its tokens as their codes. The word "", the last, stands for the start of a text and is only a context."""

    def __init__(self, folder: str, block: int):
        files, path = open_uri(folder)
        with files.open_input_file(f"{path}/{block}.arrow") as source:
            self.rows, self.words, codes = (pa.ipc.open_stream(source).read_all().combine_chunks().to_batches()[0] for _ in range(3))
        self.words = self.words.column(0)
        self.codes = _unpack(codes.column(0)[0].as_py())
        self.size = len(self.words)
        self.n_tokens = self.rows.column(1).to_numpy()
        self.owner = np.repeat(np.arange(len(self.rows)), self.n_tokens)
        self.target = self.rows.column(2).to_numpy(zero_copy_only=False).astype(bool)[self.owner]
        self.before = np.full(len(self.codes), self.size - 1, np.int64)
        inside = np.flatnonzero(self.owner[1:] == self.owner[:-1])
        self.before[inside + 1] = self.codes[inside]

    def counts(self) -> list[np.ndarray]:
        """By code: how often it is a word in all rows and in targets, and how often a context."""
        return [np.bincount(x, weights, self.size).astype(np.int64) for x in (self.codes, self.before) for weights in (None, self.target)]

    def dealt_words(self, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(pc.binary_length(self.words).to_numpy().astype(np.int64))
        starts = np.concatenate(([0], ends[:-1]))
        data = np.frombuffer(b"".join(self.words.cast(pa.binary()).to_pylist()), np.uint8)
        return _dealt((span_hash(data, starts, ends) % np.uint64(n_buckets)).astype(np.int64), n_buckets)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct context * size + word, and which of them each token is."""
        return np.unique(self.before * self.size + self.codes, return_inverse=True)

    def dealt_pairs(self, pairs: np.ndarray, ids: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places in pairs of those that are sent, by bucket; where each bucket starts; the ids of their contexts and words)."""
        v, w = ids[pairs // self.size], ids[pairs % self.size]
        sent = np.flatnonzero((v >= 0) & (w >= 0))
        v, w = v[sent], w[sent]
        buckets = mix(mix(v.astype(np.uint64)) + w.astype(np.uint64)) % np.uint64(n_buckets)
        order, starts = _dealt(buckets.astype(np.int64), n_buckets, w, v)
        return sent[order], starts, v[order], w[order]


def _block_writer(folder: str):
    """Writes rows in blocks of their own files and yields what each block holds."""

    def flush(held: list, block: int) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        owner, words = _tokens(rows, 1)
        coded = words.dictionary_encode()
        n_tokens = np.bincount(owner, minlength=len(rows))
        target = rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
        parts = [
            pa.record_batch([rows.column(0), pa.array(n_tokens, pa.int64()), rows.column(2)], names=["row", "n_tokens", "target"]),
            pa.record_batch([pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([""])])], names=["word"]),
            pa.record_batch([pa.array([_pack(coded.indices.to_numpy(zero_copy_only=False))], pa.large_binary())], names=["codes"]),
        ]
        files, path = open_uri(folder)
        with files.open_output_stream(f"{path}/{block}.arrow") as sink:
            for part in parts:
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
        return pa.record_batch([pa.array([int(x)], pa.int64()) for x in (block, len(coded.dictionary) + 1, n_tokens.sum(), n_tokens[target].sum())], names=["block", "n_words", "n", "n_target"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # attempts of one task have ids of their own, so a block's file is that of the attempt whose rows are kept
        block = TaskContext.get().taskAttemptId() << 24
        files, path = open_uri(folder)
        files.create_dir(path)
        held, size = [], 0
        for whole in batches:
            for batch in text_slices(whole, 1):
                more = pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
                if held and size + more > BLOCK_BYTES:
                    yield flush(held, block)
                    held, size, block = [], 0, block + 1
                held.append(batch)
                size += more
        if held:
            yield flush(held, block)

    return write


def _word_sender(folder: str, n_buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                found = Block(folder, block)
                order, starts = found.dealt_words(n_buckets)
                counts = found.counts()
                full = np.flatnonzero(np.diff(starts))
                parts = [order[starts[i] : starts[i + 1]] for i in full.tolist()]
                yield pa.record_batch(
                    [pa.array(np.full(len(full), block), pa.int64()), pa.array(full, pa.int64()), pa.array([_pack_words(found.words.take(pa.array(x))) for x in parts], pa.binary()), pa.array([_pack(np.concatenate([c[x] for c in counts])) for x in parts], pa.binary())],
                    names=["block", "bucket", "words", "counts"],
                )

    return send


def _word_summer(n_buckets: int):
    def add(key: tuple, sent: pa.Table) -> pa.Table:
        """The sums of each block's words, and an id of each word that several blocks have (else -1); fresh: how many words no row before had."""
        sent = sent.sort_by("block")
        words = [_unpack_words(x) for x in sent.column("words").to_pylist()]
        sizes = np.array([len(x) for x in words])
        coded = pa.array([w for x in words for w in x], pa.string()).dictionary_encode()
        codes, n = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
        counts = [_unpack(x).reshape(4, -1) for x in sent.column("counts").to_pylist()]
        sums = []
        for k in range(4):
            total = np.zeros(n, np.int64)
            np.add.at(total, codes, np.concatenate([x[k] for x in counts]))
            sums.append(total[codes])
        ids = np.where(np.bincount(codes, minlength=n) > 1, np.arange(n) * n_buckets + key[0].as_py(), -1)[codes]
        first = np.zeros(len(codes), np.int64)
        first[np.unique(codes, return_index=True)[1]] = 1
        ends = np.cumsum(sizes)
        cut = list(zip((ends - sizes).tolist(), ends.tolist()))
        return pa.table(
            [sent.column("block"), sent.column("bucket"), pa.array([_pack(ids[a:b]) for a, b in cut], pa.binary()), pa.array([_pack(np.concatenate([x[a:b] for x in sums])) for a, b in cut], pa.binary()), pa.array([int(first[a:b].sum()) for a, b in cut], pa.int64())],
            names=["block", "bucket", "ids", "counts", "fresh"],
        )

    return add


def _given(found: Block, totals: pa.Table, column: str, n_buckets: int, width: int) -> np.ndarray:
    """width rows of numbers by code, out of the buckets' answers."""
    order, starts = found.dealt_words(n_buckets)
    out = np.zeros((width, found.size), np.int64)
    for bucket, data in zip(totals.column("bucket").to_pylist(), totals.column(column).to_pylist()):
        out[:, order[starts[bucket] : starts[bucket + 1]]] = _unpack(data).reshape(width, -1)
    return out


def _pair_sender(folder: str, n_buckets: int, n_pair_buckets: int):
    """A block's pairs of words that other blocks have too."""

    def send(key: tuple, totals: pa.Table) -> pa.Table:
        found = Block(folder, block := key[0].as_py())
        pairs, at = found.pairs()
        places, starts, v, w = found.dealt_pairs(pairs, _given(found, totals, "ids", n_buckets, 1)[0], n_pair_buckets)
        n, m = (np.bincount(at, weights, len(pairs)).astype(np.int64)[places] for weights in (None, found.target))
        full = np.flatnonzero(np.diff(starts))
        cut = [(int(starts[i]), int(starts[i + 1])) for i in full]
        columns = [pa.array([_pack(x) for x in column], pa.binary()) for column in ([np.diff(v[a:b], prepend=0) for a, b in cut], [w[a:b] for a, b in cut], [n[a:b] for a, b in cut], [m[a:b] for a, b in cut])]
        del found, pairs, at, places, v, w, n, m
        trim()
        return pa.table([pa.array(np.full(len(full), block), pa.int64()), pa.array(full, pa.int64()), *columns], names=["block", "bucket", "v", "w", "n", "n_target"])

    return send


def _pair_summer(sent: pa.Table) -> pa.Table:
    v, w, n, m = ([_unpack(x) for x in sent.column(c).to_pylist()] for c in ("v", "w", "n", "n_target"))
    sizes = np.array([len(x) for x in w])
    v, w = np.concatenate([np.cumsum(x) for x in v]), np.concatenate(w)
    order = np.lexsort((w, v))
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(v[order]) != 0) | (np.diff(w[order]) != 0)
    group = np.cumsum(first) - 1
    ends = np.cumsum(sizes)
    out = []
    for counts in (n, m):
        sums = np.empty(len(order), np.int64)
        sums[order] = np.add.reduceat(np.concatenate(counts)[order], np.flatnonzero(first))[group]
        out.append(pa.array([_pack(sums[b - s : b]) for s, b in zip(sizes.tolist(), ends.tolist())], pa.binary()))
    return pa.table([sent.column("block"), sent.column("bucket"), *out], names=["block", "bucket", "n", "n_target"])


def _block_scorer(folder: str, n_buckets: int, n_pair_buckets: int, tokens: tuple[int, int], n_words: int, weight: float):
    """The losses of a block's rows, given the sums of its words and pairs."""

    def score(key: tuple, totals: pa.Table, sums: pa.Table) -> pa.Table:
        found = Block(folder, key[0].as_py())
        pairs, at = found.pairs()
        places, starts, v, w = found.dealt_pairs(pairs, _given(found, totals, "ids", n_buckets, 1)[0], n_pair_buckets)
        counts = _given(found, totals, "counts", n_buckets, 4)
        v, w = found.before, found.codes
        own = _within(found.owner, w, found.size), _within(found.owner, v, found.size), _within(found.owner, at, len(pairs) + 1), found.n_tokens[found.owner]
        buckets, losses = sums.column("bucket").to_pylist(), []
        for k, (weights, name) in enumerate(((None, "n"), (found.target, "n_target"))):
            n = np.bincount(at, weights, len(pairs)).astype(np.int64)
            for bucket, data in zip(buckets, sums.column(name).to_pylist()):
                n[places[starts[bucket] : starts[bucket + 1]]] = _unpack(data)
            less = own if weights is None else [x * weights for x in own]
            context = counts[k + 2][v] - less[1]
            loss = _losses(counts[k][w] - less[0], context, context, n[at] - less[2], tokens[k] - less[3], n_words, weight)
            losses.append(np.bincount(found.owner, loss, len(found.rows)) / np.maximum(found.n_tokens, 1))
        out = pa.table([found.rows.column(0), found.rows.column(1), pa.array(losses[1], pa.float64()), pa.array(losses[0], pa.float64())], names=["row", "n_tokens", "target_loss", "background_loss"])
        del found, pairs, at, v, w, places, counts, own, less, context, loss
        trim()
        return out

    return score


def _whole_models(source: DataFrame, weight: float) -> DataFrame:
    """row, n_tokens and both losses of source's row, text and target, by models of every word and pair."""
    spark = source.sparkSession
    folder = fresh_path(spark, "blocks")
    blocks = materialise(source.mapInArrow(lean(_block_writer(folder)), "block long, n_words long, n long, n_target long"), "block_list")
    n_blocks, words, tokens, target_tokens = (int(x or 0) for x in blocks.agg(F.count(F.lit(1)), F.sum("n_words"), F.sum("n"), F.sum("n_target")).first())
    n_buckets = max(partitions(spark), -(-words // BUCKET_WORDS))
    n_pair_buckets = max(partitions(spark), -(-tokens // BUCKET_PAIRS))
    sent = blocks.select("block").repartition(max(partitions(spark), n_blocks), "block").mapInArrow(lean(_word_sender(folder, n_buckets)), "block long, bucket long, words binary, counts binary")
    totals = materialise(sent.groupBy("bucket").applyInArrow(_word_summer(n_buckets), "block long, bucket long, ids binary, counts binary, fresh long"), "words")
    n_words = int(totals.agg(F.sum("fresh")).first()[0] or 0) - 1  # the start of a text is no word
    totals = totals.select("block", "bucket", "ids", "counts")
    pairs = totals.groupBy("block").applyInArrow(_pair_sender(folder, n_buckets, n_pair_buckets), "block long, bucket long, v binary, w binary, n binary, n_target binary")
    sums = pairs.groupBy("bucket").applyInArrow(_pair_summer, "block long, bucket long, n binary, n_target binary")
    score = _block_scorer(folder, n_buckets, n_pair_buckets, (tokens, target_tokens), n_words, weight)
    return totals.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(score, f"row {source.schema['row'].dataType.simpleString()}, n_tokens long, target_loss double, background_loss double")


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, carry: list[str] | None = None, most_words: int | None = None, most_pairs: int | None = None, weight: float = WEIGHT) -> DataFrame:
    """doc_id, the carry columns, n_tokens, the losses per token of both models, and score = target_loss - background_loss (low: like the target).

    targets: doc_id of the documents that the target model is trained on.
    """
    ids = materialise(targets.select("doc_id").where("doc_id is not null").distinct().withColumn("target", F.lit(True)), "targets")
    row = F.struct(F.col("doc_id"), *[F.col(c) for c in carry or []])
    source = docs.select("doc_id", row.alias("row"), F.col("text").cast("string").alias("text")).join(small(ids), "doc_id", "left").select("row", "text", F.coalesce("target", F.lit(False)).alias("target"))
    if most_words is None and most_pairs is None:
        out = _whole_models(source, weight)
    else:
        models = docs.sparkSession.sparkContext.broadcast(train(source, "target", most_words, most_pairs, weight))
        out = source.mapInArrow(lean(_scorer(models)), f"row {source.schema['row'].dataType.simpleString()}, n_tokens long, target_loss double, background_loss double")
    return out.select("row.*", "n_tokens", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score"))
