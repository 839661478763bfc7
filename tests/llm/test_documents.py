"""The document operators against plain-Python versions, over texts that hold the odd cases."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
import xxhash

from veristrata.llm import decontaminate, language_id, lm_scoring, quality_rules, sentence_pieces, simhash, substring_dedup, token_counts, token_shards
from veristrata.llm.queries import BYTE_LEVEL, PIECES
from veristrata.llm.trie import read_vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, n_words string"


def _corpus():
    rng = random.Random(5)
    vocabulary = ["the", "of", "Über", "é", "日本", "x1", "a.b", "end.", "AA", "zz"] + [f"w{i}" for i in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = [None, "", " \n\t ", "one", "one two", "A b C d", "a  b   c d\x0be", "\n\nline one two\nline one two\n x\nline one two", "dup " * 60, "tail space "]
    for i in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        if i % 3 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = passage[rng.randint(0, 10) :]
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    texts += [texts[12], texts[12], texts[15] + " extra", " ".join(passage)]
    return list(enumerate(texts, 1))


ROWS = _corpus()


@pytest.fixture(scope="module")
def docs(spark):
    # row and n_words clash with names that operators use
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "r", "n") for i, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_counts(docs):
    got = {r.doc_id: r for r in quality_rules.word_statistics(docs).collect()}
    for i, text in ROWS:
        words = _words(text)
        windows = defaultdict(list)
        for k in range(len(words) - 4):
            windows[tuple(words[k : k + 5])].append(k)
        covered = {p for at in windows.values() if len(at) > 1 for k in at for p in range(k, k + 5)}
        lines = [x for x in (text or "").split("\n") if _words(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        row = got[i]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want, i


def test_quality_rules_learn_a_threshold(spark):
    texts = [(i, " ".join(f"good{i}x{k}" if i % 4 else f"b{k}$$ ** &" for k in range(20))) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i, _ in texts], "doc_id long, quality int, toxic int")
    rules = quality_rules.learn(docs, labels)
    assert rules
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert all(not got[i].kept for i in range(0, 200, 4))
    empty = labels.where("doc_id < 0")
    assert quality_rules.learn(docs, empty) == []
    assert quality_rules.quality_rules(docs, empty).where("kept = base_failed").count() == 0


@pytest.mark.parametrize("heavy", [substring_dedup.HEAVY, 3000, 200])
def test_substring_dedup(docs, heavy):
    """Also with nearly all buckets split, and some of them."""
    low = {}
    for i, text in ROWS:
        words = _words(text)
        for k in range(len(words) - 12):
            key = tuple(words[k : k + 13])
            low[key] = min(low.get(key, i), i)
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs, carry=["lang", "n_chars"], heavy=heavy).collect()}
    assert len(got) == len(ROWS)
    removed = 0
    for i, text in ROWS:
        words = _words(text)
        gone = {p for k in range(len(words) - 12) if low[tuple(words[k : k + 13])] < i for p in range(k, k + 13)}
        kept = " ".join(w for p, w in enumerate(words) if p not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(words), len(gone), kept), i
        removed += len(gone)
    assert removed


@pytest.mark.parametrize("parts", [1, 4])
@pytest.mark.parametrize("heavy", [substring_dedup.HEAVY, 2000])
def test_substring_dedup_hot_copies(spark, heavy, parts):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"own{i} {passage} tail{i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(docs, heavy=heavy).collect()}
    assert got == {i: 30 if i else 0 for i in range(100)}


def test_substring_dedup_hot_minimiser(spark):
    """One phrase in ever other surroundings, many of them repeated: its bucket is dealt by whole windows."""
    rng = random.Random(11)
    sides = [[" ".join(f"s{rng.randrange(40)}" for _ in range(9)) for _ in range(30)] for _ in range(2)]
    rows = [(i, f"{rng.choice(sides[0])} a b c {rng.choice(sides[1])}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = [sorted((r.doc_id, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(docs, heavy=heavy).collect()) for heavy in (substring_dedup.HEAVY, 1500)]
    low = {}
    for i, text in rows:
        words = text.split()
        for k in range(len(words) - 12):
            low.setdefault(tuple(words[k : k + 13]), i)
    want = []
    for i, text in rows:
        words = text.split()
        gone = {p for k in range(len(words) - 12) if low[tuple(words[k : k + 13])] < i for p in range(k, k + 13)}
        want.append((i, len(gone), " ".join(w for p, w in enumerate(words) if p not in gone)))
    assert found == [want, want]


def test_equal_hashes_are_compared(monkeypatch):
    import numpy as np

    monkeypatch.setattr(substring_dedup, "span_hash", lambda values, starts, ends: np.zeros(len(starts), np.uint64))
    strings = [b" ".join(b"%d" % (i + s) for i in range(14)) for s in (0, 1, 5)]
    least, offset, sizes = substring_dedup.window_minima(strings, np.array([7, 3, 1]))
    assert least.tolist() == [7, 3, 3, 3, 1, 1] and offset.tolist() == [0, 2, 4] and sizes.tolist() == [14, 14, 14]


def test_pieces_of_long_texts():
    from veristrata.llm.common import pieces

    rng = random.Random(2)
    data = b" ".join(b"x" * rng.randint(1, 9) + b"%d" % i for i in range(3000)) + b" " + b"y" * 900 + b" end"
    words = data.split()
    for overlap in (0, 2, 12):
        upto = 0
        for base, piece in pieces(data, overlap, 200):
            own = piece.split()
            assert words[base : base + len(own)] == own and base <= max(0, upto - overlap if upto else 0)
            upto = base + len(own)
        assert upto == len(words)


def _fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = _words(low)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def test_simhash(docs):
    prints = {i: _fingerprint(t) for i, t in ROWS}
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component) for r in simhash.simhash_components(docs).collect()}
    assert got == {i: (prints[i], root(i)) for i in prints}


def test_gray_index_finds_all_links():
    import numpy as np

    rng = np.random.default_rng(3)
    fp = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    near = fp[:100] ^ (np.uint64(1) << rng.integers(0, 63, 100).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 100).astype(np.uint64))
    fp = np.unique(np.concatenate((fp, near)))
    index = simhash.GrayIndex(np.zeros(len(fp), np.int64), fp)
    a, b = index.links(np.arange(len(fp)))
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if int(index.fp[i] ^ index.fp[j]).bit_count() <= 2}
    assert set(zip(a.tolist(), b.tolist())) == want and len(want) >= 90


def test_fingerprint_chains(spark):
    """A chain of links is one component, however long, and each block pair finds its share of links."""
    rng = random.Random(1)
    chain, at = [], rng.getrandbits(64)
    for _ in range(60):
        chain.append(at)
        for b in rng.sample(range(64), 2):
            at ^= 1 << b
    signed = [x - (1 << 64) if x >> 63 else x for x in chain]
    classes = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = simhash.components(simhash.fingerprint_links(classes))
    assert {r.least for r in found.collect()} == {min(signed)} and found.count() == 60


def _contamination(text, items):
    def own(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    words, hit, named = own(text), set(), set()
    for item, t in items:
        w = own(t)
        size = min(13, len(w))
        windows = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()
        for k in range(len(words) - size + 1):
            if windows and tuple(words[k : k + size]) in windows:
                hit |= set(range(k, k + size))
                named.add(item)
    return len(words), len(hit), len(named), hashlib.sha256(",".join(sorted(map(str, named))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block_words", [400_000, 30])
def test_contamination(spark, docs, block_words):
    long_text = ROWS[-1][1]
    items = [(1, long_text), (2, "one two"), (3, ""), (4, None), (5, long_text[20:]), (10, "the of"), (11, ROWS[20][1]), (12, "one two")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, benchmark, carry=["lang"], block_words=block_words).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == {i: _contamination(t, items) for i, t in ROWS}
    assert any(r.contaminated for r in got)
    none = decontaminate.contamination(docs, benchmark.where("item_id < 0")).where("n_hit > 0 or contaminated").count()
    assert none == 0


def test_remove_spans(spark):
    """A long find is cut from a long text, all finds from a text that they make up a share of, a short find stays."""
    item, short = " ".join(f"I{i}" for i in range(20)), "tiny item"
    other = " ".join(f"o{i}" for i in range(900))
    rows = [(1, f"{other} -- {item}! end"), (2, f"{other} Tiny, item end"), (3, f"own words tiny item {item}"), (4, other), (5, None)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, kept string")
    benchmark = spark.createDataFrame([("x", item), ("y", short)], "item_id string, text string")
    for block_words in (100, 20):
        got = {r.doc_id: (r.clean_text, r.kept) for r in decontaminate.remove_spans(docs, benchmark, ["kept"], block_words=block_words).collect()}
        assert got == {1: (f"{other} -- ! end", "k"), 2: (rows[1][1], "k"), 3: ("own words ", "k"), 4: (other, "k"), 5: (None, "k")}


def test_sentence_pieces(docs):
    vocabulary = read_vocabulary(PIECES)
    score = {p: s for p, s, k in zip(vocabulary.pieces, vocabulary.scores, vocabulary.kinds) if k == 1}
    number = {p: i for i, p in enumerate(vocabulary.pieces)}
    unknown = min(score.values()) - 10

    def encode(text):
        if not text:
            return []
        s = "▁" + text.replace(" ", "▁")
        best = [(0.0, 0, None)] + [(float("-inf"), 0, None)] * len(s)
        for i in range(len(s)):
            for j in range(i + 1, min(len(s), i + 48) + 1):
                own = score.get(s[i:j], unknown if j == i + 1 else None)
                if own is not None and best[i][0] + own > best[j][0]:
                    best[j] = (best[i][0] + own, i, s[i:j])
        out, at = [], len(s)
        while at:
            piece = best[at][2]
            out[:0] = [number[piece]] if piece in score else [number[f"<0x{b:02X}>"] for b in piece.encode()]
            at = best[at][1]
        return out

    got = {r.doc_id: r for r in sentence_pieces.sentence_pieces(docs, PIECES, carry=["text"]).collect()}
    compared = {r.doc_id: r for r in sentence_pieces.sentence_pieces(docs, PIECES, decode=sentence_pieces.COMPARED).collect()}
    for i, text in ROWS:
        assert list(got[i].ids) == list(compared[i].ids) == encode(text), (i, text)
        assert got[i].decoded == (text or "") and compared[i].round_trip


def test_long_units_are_walked_alike(monkeypatch):
    import pyarrow as pa

    rng = random.Random(4)
    signs = ["the", "ing", "é", "日本", "x", "▁", "😀", "\x01", "e", " "]
    units = pa.array(["".join(rng.choice(signs) for _ in range(n)).encode() for n in (1, 3, 50, 700) for _ in range(8)], pa.binary())
    vocabulary = read_vocabulary(PIECES)
    pieces, words = sentence_pieces.UnigramModel(vocabulary), token_counts.LongestMatch(vocabulary)
    want = [x.tolist() for x in (*pieces.encode_units(units), *words.counts(units))]
    monkeypatch.setattr(sentence_pieces, "LONG_UNIT", 0)
    monkeypatch.setattr(token_counts, "LONG_WORD", 0)
    assert [x.tolist() for x in (*pieces.encode_units(units), *words.counts(units))] == want


def test_unigram_log_scores():
    """Real log scores, of which the best sum isn't the longest match: against every segmentation."""
    import itertools

    import pyarrow as pa

    from veristrata.llm.trie import NORMAL, UNKNOWN, Vocabulary

    scores = {"▁": -2.5, "a": -3.1, "b": -3.3, "c": -4.0, "ab": -4.9, "bc": -5.2, "abc": -11.0, "▁a": -4.1, "ca": -6.4, "▁abc": -9.5}
    vocabulary = Vocabulary(["<unk>", *scores], [0.0, *scores.values()], [UNKNOWN, *[NORMAL] * len(scores)], True)
    model = sentence_pieces.UnigramModel(vocabulary)
    for text in map("".join, itertools.chain.from_iterable(itertools.product("abc", repeat=n) for n in range(1, 7))):
        counts, ids = model.encode_units(pa.array([text.encode()], pa.binary()))
        s = "▁" + text
        cuts = ([0, *c, len(s)] for k in range(len(s)) for c in itertools.combinations(range(1, len(s)), k))
        best = max(sum(scores.get(s[i:j], -99) for i, j in itertools.pairwise(c)) for c in cuts)
        assert abs(sum(vocabulary.scores[i] for i in ids) - best) < 1e-9 and "".join(vocabulary.pieces[i] for i in ids) == s


def test_token_counts(docs):
    vocabulary = read_vocabulary(PIECES)
    known = {p for p, k in zip(vocabulary.pieces, vocabulary.kinds) if k == 1}

    def count(word):
        s, n = "▁" + word, 0
        while s:
            size = next((j for j in range(len(s), 0, -1) if s[:j] in known), 0)
            if not size:
                return 1, 1
            s, n = s[size:], n + 1
        return n, 0

    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in token_counts.token_counts(docs, PIECES).collect()}
    for i, text in ROWS:
        found = [count(w) for w in _words(text)]
        assert got[i] == (len(found), sum(n for n, _ in found), sum(u for _, u in found)), i


def test_token_shards(spark, docs, tmp_path):
    import base64

    import numpy as np
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_LEVEL, "rb"))}
    coder = tiktoken.Encoding("t", pat_str=token_shards.PATTERN, mergeable_ranks=ranks, special_tokens={})
    end = len(ranks)
    folder = f"file://{tmp_path}/shards"
    manifest = token_shards.write_shards(docs.coalesce(1).orderBy("doc_id"), BYTE_LEVEL, folder, key=9, length=16, stride=8).orderBy("shard").collect()
    want = [i for _, t in ROWS if t for i in [*coder.encode_ordinary(t), end]]
    want += [end] * (-len(want) % 16)
    total = len(want) // 16
    assert sum(r.n_sequences for r in manifest) == total and [r.first_slot for r in manifest] == list(range(0, total, 8))
    slots = list(token_shards.read_slots(folder, 0, total, length=16, stride=8))
    order = token_shards.feistel(np.arange(total), total, 9)
    assert np.concatenate([slots[s] for s in order]).tolist() == want
    resumed = list(token_shards.read_slots(folder, 5, 7, length=16, stride=8))
    assert all((a == b).all() for a, b in zip(resumed, slots[5:12]))
    assert token_shards.write_shards(docs.where("doc_id < 0"), BYTE_LEVEL).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_permutation(size):
    import numpy as np

    slots = token_shards.feistel(np.arange(size), size, 4)
    assert sorted(slots.tolist()) == list(range(size))
    if size > 100:
        assert (slots != token_shards.feistel(np.arange(size), size, 5)).any()


def test_lm_scoring(spark, docs):
    import math

    targets = spark.createDataFrame([(i,) for i in range(20, 40)] + [(20,)], "doc_id long")
    got = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(docs, targets, most_words=200, most_pairs=300).collect()}
    texts = {i: _words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in ROWS}
    total = sum(map(len, texts.values()))
    n = defaultdict(int)
    for words in texts.values():
        for w in words:
            n[w] += 1
    known = sorted(w for w in n if n[w] * 200 >= total)
    ids = {w: i + 1 for i, w in enumerate(known)}

    def pairs(words):
        own = [ids.get(w, 0) for w in words]
        return list(zip(["<s>", *own], own))

    whole = defaultdict(int)
    for words in texts.values():
        for p in pairs(words):
            whole[p] += 1
    table = {p for p, c in whole.items() if c * 300 >= total}

    def model(members, left_out):
        uni, context, pair = defaultdict(int), defaultdict(int), defaultdict(int)
        for i in members:
            for v, w in pairs(texts[i]) if i != left_out else ():
                uni[w] += 1
                context[v] += 1
                pair[v, w] += 1
        size = len(known) + 1

        def loss(v, w):
            p = (uni[w] + 1) / (sum(uni.values()) + size)
            kept = sum(c for (a, b), c in pair.items() if a == v and (a, b) in table)
            c = max(context[v], 1)
            direct = pair[v, w] if (v, w) in table else 0
            return -math.log(0.5 * direct / c + (1 - 0.5 * kept / c) * p)

        return loss

    for i in (1, 2, 5, 13, 25, 30):
        target, background = model(range(20, 40), i), model(texts, i)
        own = pairs(texts[i])
        want = [sum(f(v, w) for v, w in own) / max(1, len(own)) for f in (target, background)]
        assert got[i].n_tokens == len(own)
        assert abs(got[i].target_loss - want[0]) < 1e-9 and abs(got[i].background_loss - want[1]) < 1e-9 and abs(got[i].score - want[0] + want[1]) < 1e-9


def test_lm_scoring_keeps_rare_words_and_pairs(spark, monkeypatch):
    """More words and pairs than any bound held before; many small blocks; against counts in plain Python."""
    import math

    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 1 << 18)
    texts = {0: " ".join(f"w{i}" for i in range(210_000)), 1: "a b c a b", 2: "a b rare pair a b", 3: None, 4: "rare pair", 5: "w7 w8 a b W9", 6: " "}
    texts |= {i: "a b c " * 20_000 for i in range(7, 11)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3, "doc_id")
    got = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(frame, spark.createDataFrame([(2,), (5,)], "doc_id long")).collect()}
    assert set(got) == set(texts)
    tokens = {i: (t or "").lower().split() for i, t in texts.items()}
    v_all = len({w for ws in tokens.values() for w in ws})

    def model(members, left_out):
        uni, context, pair = defaultdict(int), defaultdict(int), defaultdict(int)
        for i in members:
            for v, w in zip(["<s>", *tokens[i]], tokens[i]) if i != left_out else ():
                uni[w] += 1
                context[v] += 1
                pair[v, w] += 1
        total = sum(uni.values())

        def loss(v, w):
            p = (uni[w] + 1) / (total + v_all + 1)
            return -math.log(0.5 * pair[v, w] / context[v] + 0.5 * p if context[v] else p)

        return loss

    for i in texts:
        target, background = model((2, 5), i), model(texts, i)
        own = list(zip(["<s>", *tokens[i]], tokens[i]))
        want = [sum(f(v, w) for v, w in own) / max(1, len(own)) for f in (target, background)]
        assert got[i].n_tokens == len(own)
        assert abs(got[i].target_loss - want[0]) < 1e-9 and abs(got[i].background_loss - want[1]) < 1e-9


def test_rows_that_share_a_doc_id(spark):
    passage, own = " ".join(f"p{i}" for i in range(20)), " ".join(f"q{i}" for i in range(14))
    docs = spark.createDataFrame([(1, passage), (2, passage), (2, own), (2, f"{own} x"), (3, own)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(docs).collect())
    assert got == [(1, 20, 0), (2, 14, 0), (2, 15, 0), (2, 20, 20), (3, 14, 14)]
    items = spark.createDataFrame([("b", own), ("a", own), ("c", "p1 p2")], "item_id string, text string")
    for block_words in (100, 14):
        found = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.contamination(docs, items, block_words=block_words).collect())
        both, one = (hashlib.sha256(x.encode()).hexdigest() for x in ("a,b", "c"))
        assert found == [(1, 20, 2, 1, one), (2, 14, 14, 2, both), (2, 15, 14, 2, both), (2, 20, 2, 1, one), (3, 14, 14, 2, both)]


def test_rows_without_a_doc_id_link_others(spark, monkeypatch):
    """doc 1 and doc 2 are each two bits from a row without a doc_id, and four from each other."""
    from pyspark.sql import functions as F

    rows = [(1, 0b0011, "x"), (None, 0, "x"), (2, 0b1100, "x"), (None, -1, "x"), (None, -1, "y"), (5, 1 << 40 | 1 << 50 | 1 << 60, "x")]
    marked = spark.createDataFrame(rows, "doc_id long, fp long, component string")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, carry=None: docs.select("doc_id", *[F.col(c) for c in carry or []], "fp"))
    got = sorted(((r.doc_id, r.fp, r.component) for r in simhash.simhash_components(marked).collect()), key=str)
    assert got == sorted([(1, 3, 1), (None, 0, 1), (2, 12, 1), (None, -1, None), (None, -1, None), (5, rows[5][1], 5)], key=str)


def test_names_that_operators_use(spark):
    """Columns named like the operators' own, as extra input and as carried."""
    names = ["_target", "target", "kept", "row", "_host", "likelihood", "text_key", "spans", "fp", "component", "_key"]
    rows = [(i, f"word{i % 3} and the other one here {i}", "en", "s", *["v"] * len(names)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    items = spark.createDataFrame([(1, "the other one")], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    for out in (
        lm_scoring.cross_entropy_difference(docs, labels, ["_target"]),
        lm_scoring.cross_entropy_difference(docs, labels, ["target"], most_words=50, most_pairs=50),
        decontaminate.contamination(docs, items, ["kept", "text_key"]),
        decontaminate.remove_spans(docs, items, ["kept"]),
        language_id.identify_documents(docs, ["doc_id", "_host", "likelihood"]),
        substring_dedup.substring_dedup(docs, carry=["row", "text_key"]),
        simhash.simhash_components(docs, carry=["_key"]),
        token_counts.token_counts(docs, PIECES, ["row"]),
        sentence_pieces.sentence_pieces(docs, PIECES, ["row"]),
        quality_rules.quality_rules(docs, labels),
    ):
        assert out.count() == 12


def test_empty_tables(docs):
    none = docs.where("doc_id < 0")
    assert substring_dedup.substring_dedup(none).count() == 0
    assert simhash.simhash_components(none).count() == 0
    assert sentence_pieces.sentence_pieces(none, PIECES).count() == 0
    assert token_counts.token_counts(none, PIECES).count() == 0
    assert language_id.identify_documents(none).count() == 0
    assert lm_scoring.cross_entropy_difference(none, none.select("doc_id")).count() == 0


def test_null_ids_pass(spark):
    rows = [(None, "a b c d e f g h i j k l m n"), (4, "a b c d e f g h i j k l m n"), (7, "a b c d e f g h i j k l m n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == {None: 0, 4: 0, 7: 14}
    assert {r.component for r in simhash.simhash_components(docs).collect()} == {4}


def test_language_held_out(spark):
    rng = random.Random(8)
    parts = {"en": ["th", "the", "ing", "and", "sh", "wh"], "fr": ["eau", "é", "que", "oi", "ou", "è"], "de": ["sch", "ü", "ung", "ein", "ß", "tz"]}
    rows = [(i, " ".join("".join(rng.choices(parts[g], k=rng.randint(1, 3))) for _ in range(30)), g) for i, g in enumerate(list(parts) * 60)]
    train = spark.createDataFrame(rows[:90], "doc_id long, text string, lang string")
    model = language_id.learn(train)
    test = spark.createDataFrame([(*r, f"h{r[0] % 4}", None) for r in rows[90:]] + [(900, None, "en", None, None), (901, "123 456", "fr", "h1", None)], "doc_id long, text string, lang string, host string, declared string")
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in language_id.identify(test, model, ["doc_id"], host=F.col("host"), declared=F.col("declared")).collect()}
    right = sum(got[i].language == g for i, _, g in rows[90:])
    assert right >= 0.98 * len(rows[90:])
    assert not got[900].accepted and got[900].language is None and not got[901].accepted


def test_language_evidence_decides_for_poor_texts(spark):
    """A text that could be either is read as its declaration, or its host, says."""
    from pyspark.sql import functions as F

    rows = [(i, "aa bb cc dd" if i % 2 else "xx yy zz ww", "p" if i % 2 else "q") for i in range(200)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    pages = [(i, *((t, g) if i < 190 else ("mm", "?")), f"site.{g}", g) for i, t, g in rows]
    pages = [(i, t, "site.p" if g == "?" else host, "p" if g == "?" else d) for i, t, g, host, d in pages]
    frame = spark.createDataFrame(pages, "doc_id long, text string, host string, declared string")
    got = {r.doc_id: r for r in language_id.identify(frame, model, ["doc_id"], host=F.col("host"), declared=F.col("declared")).collect()}
    assert all(got[i].language == "p" for i in range(190, 200))
