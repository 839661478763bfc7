"""Registered queries give whole results, against plain counts over the tables."""

import re
from collections import Counter

import pytest

from veristrata.plans import building, registry
from veristrata.sources.tables import read, sentences

SF = "/root/testdata/sf0.001"

SENTENCES = [
    "We don't have jobs. We have temps.", "They don't have equity in their home.", "He said wages rose in 2019.",
    "wages fell by 4 percent", "Ohio is growing, but according to data wages fell in May", "Amazon announced cuts.",
    "She is not a doctor.", "It isn't over", "Taxes are high", "Last year was the second quarter.", "several states and many large cities grew",
    "I have no money!", "Look, they told us so", "The rate was 4.1% in July 2020", "Prices never fell", "there are no jobs",
]


def test_every_term_has_its_frequency(spark):
    got = {r.term: r.df for r in registry.QUERIES["d02_all_term_frequencies"](spark, SF).collect()}
    top = {r.term: r.df for r in registry.QUERIES["d02_term_frequencies"](spark, SF).collect()}
    assert len(top) == 50 < len(got) and top.items() <= got.items()
    word = next(t for t in sorted(got, key=got.get) if re.fullmatch("[a-z]{6,}", t))  # a rare one
    texts = [r.text or "" for r in read(spark, SF, "documents").collect()]
    assert got[word] == sum(word in re.findall("[a-z0-9]+", t.lower()) for t in texts)


def test_every_term_has_a_likelihood_for_every_label(spark):
    rows = registry.QUERIES["d11_all_naive_bayes_fit"](spark, SF).collect()
    labels, terms = {r.label for r in rows}, {r.term for r in rows}
    assert len(terms) > 100 and len(rows) == len(labels) * len(terms)
    assert set(Counter((r.term, r.label) for r in rows).values()) == {1}
    assert any(r.n == 0 for r in rows)
    old = {(r.term, r.label): (r.n, r.log_likelihood) for r in registry.QUERIES["d11_naive_bayes_fit"](spark, SF).collect()}
    assert old.items() <= {(r.term, r.label): (r.n, r.log_likelihood) for r in rows}.items()


CLAIMS = ["b13_claim_grammar", "h06_claim_forms", "n13_skip_ladder", "g18_figures", "g22_periods", "f13_augmented_pairs"]


@pytest.mark.parametrize("name", CLAIMS[:3])
def test_claim_queries_judge_every_sentence(spark, name):
    want = {(r.doc_id, r.idx) for r in sentences(read(spark, SF, "documents").select("doc_id", "text")).collect()}
    got = [(r.doc_id, r.idx) for r in registry.QUERIES[name](spark, SF).select("doc_id", "idx").collect()]
    assert len(got) == len(want) > 16 and set(got) == want


def test_claim_queries_read_the_documents(spark, tmp_path):
    """The claims as one document."""
    spark.createDataFrame([(7, "\n".join(SENTENCES))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {name: registry.QUERIES[name](spark, str(tmp_path)).collect() for name in CLAIMS}
    lines = [r.text for r in building._claims(spark, str(tmp_path)).orderBy("idx").collect()]
    assert {lines[r.idx] for r in got["b13_claim_grammar"] if r.reported} == {"He said wages rose in 2019.", "Look, they told us so"}
    assert {lines[r.idx]: r.positive for r in got["h06_claim_forms"] if r.positive}["there are no jobs"] == "there are jobs"
    assert {lines[r.idx] for r in got["n13_skip_ladder"] if r.skipped == "reported_speech"} <= {"He said wages rose in 2019."}
    assert {lines[r.idx] for r in got["g18_figures"]} >= {"wages fell by 4 percent"}
    assert {lines[r.idx] for r in got["g22_periods"]} >= {"He said wages rose in 2019."}
    assert {r.hypothesis for r in got["f13_augmented_pairs"]} >= {"Taxes are not high"}
