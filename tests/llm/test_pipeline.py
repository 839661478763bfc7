"""The pipeline's stages on a small table, each against a plain version of its decision."""

import re

import corpus_pipeline
from tests.llm.test_documents import _contamination, _fingerprint, _words
from veristrata.llm.common import materialise

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r.doc_id: r for r in docs.collect()}
    results = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
        results.append({r.doc_id: r for r in docs.collect()})
    language, near, passages, clean, pieces = results
    assert set(language) <= set(before) and len(language) >= 0.98 * len(before)
    assert all(language[i] == before[i] for i in language)

    prints = {i: _fingerprint(r.text) for i, r in language.items()}
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert set(near) == {i for i in prints if root(i) == i}

    low = {}
    for i in sorted(near):
        words = _words(near[i].text)
        for k in range(len(words) - 12):
            low.setdefault(tuple(words[k : k + 13]), i)
    for i, r in near.items():
        words = _words(r.text)
        gone = {p for k in range(len(words) - 12) if low[tuple(words[k : k + 13])] < i for p in range(k, k + 13)}
        left = " ".join(w for p, w in enumerate(words) if p not in gone) if gone else r.text
        assert (i in passages) == (not words or len(gone) < len(words))
        if i in passages:
            assert passages[i].text == left and passages[i].n_chars == (len(left) if gone else r.n_chars)

    assert set(clean) == {i for i, r in passages.items() if not _contamination(r.text, items)[4]}
    assert set(pieces) == set(clean) and all(r.n_pieces == len(r.ids) and r.round_trip for r in pieces.values())


def test_run_gives_the_stages_result(spark):
    got = corpus_pipeline.run(spark, SF)
    assert set(got.columns) == {"doc_id", "ids", "n_pieces", "round_trip"} and got.count() > 100


def test_names():
    assert len(corpus_pipeline.STAGES) == 5 and all(re.fullmatch("[a-z_]+", n) for n, _ in corpus_pipeline.STAGES)
