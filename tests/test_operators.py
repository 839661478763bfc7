"""Operators on hand-made rows: ties, empties, two-label keys, late and revised updates."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veristrata.functions import claims as K
from veristrata.functions import pages as P
from veristrata.functions import roles as Y
from veristrata.functions import text as T
from veristrata.operators import calibration as C
from veristrata.operators import datasets as B
from veristrata.operators import composition as J
from veristrata.operators import metrics as M
from veristrata.operators import retrieval as R
from veristrata.operators import splits as X
from veristrata.operators import transcripts as S
from veristrata.sources import datasets as D

CORPUS = [(0, "the cat sat on the mat"), (1, "the dog sat on the log"), (2, "cats and dogs"), (3, "a cat and a dog met"), (4, "zebra"), (5, "")]


def _scored(spark, rows):
    return spark.createDataFrame([(i, c, bool(h)) for i, (c, h) in enumerate(rows)], "id int, confidence double, correct boolean")


def test_bm25_against_a_plain_version(spark):
    docs = spark.createDataFrame(CORPUS, "doc_id long, text string")
    queries = spark.createDataFrame([(7, "cat cat dog"), (8, "nothing here"), (9, "the")], "qid long, text string")
    got = {(r.qid, r.doc_id): r.score for r in R.bm25(queries, docs).collect()}
    toks = {i: t.split() for i, t in CORPUS}
    avg = sum(map(len, toks.values())) / len(toks)
    want = {}
    for q, text in ((7, "cat cat dog"), (9, "the")):
        for i, t in toks.items():
            s = 0.0
            for term in text.split():
                df, tf = sum(term in x for x in toks.values()), t.count(term)
                if tf:
                    s += math.log(1 + (len(toks) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
            if s:
                want[q, i] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    with pytest.raises(ValueError):
        R.top(queries, 0)


def test_top_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([(1, 9, 2.0), (1, 3, 2.0), (1, 5, 2.0), (1, 1, 0.0)], "qid int, doc_id int, score double")
    assert [r.doc_id for r in R.top(rows, 2).orderBy("rank").collect()] == [3, 5]
    assert R.top(rows, 9).count() == 3


def test_tokens(spark):
    row = spark.createDataFrame([("Soul_Food_-LRB-film-RRB- ½ Élan's colon",)], "t string").select(T.tokens(F.col("t")).alias("t"), T.title_norm(F.col("t")).alias("n")).first()
    assert row.t == ["soul", "food", "film", "½", "élan", "s"] and row.n == "soul food film ½ élan s"
    assert spark.createDataFrame([("é",)], "t string").select(T.nfc(F.col("t"))).first()[0] == "é"


@pytest.mark.parametrize(
    "text, reason",
    [
        ("Too few words", "too_short"),
        ("Did the bill pass yesterday", "question"),
        ("Was it so, really then?", "question"),
        ("Look at the numbers now", "imperative"),
        ("I think taxes rose in Ohio", "opinion"),
        ("Taxes should rise in Ohio", "opinion"),
        ("big red house over there", "no_assertion"),
        ("the house was very big", "no_anchor"),
        ("the house was in Ohio", "check_worthy"),
        ("wages rose 4 percent today", "check_worthy"),
        ("taxes fell last march again", "check_worthy"),
    ],
)
def test_check_worthy(spark, text, reason):
    assert spark.createDataFrame([(text,)], "t string").select(T.check_worthy(F.col("t"))).first()[0] == reason


def test_split_does_not_depend_on_order_and_keeps_keys_whole(spark):
    rng = random.Random(4)
    rows = [(i, f"k{rng.randint(0, 60)}", rng.choice("abc")) for i in range(300)]
    frame = lambda r: spark.createDataFrame(r, "id int, key string, label string")
    one = {r.id: r.split for r in X.stratified_split(frame(rows), {"cal": 0.5}, "test", "s").collect()}
    two = {r.id: r.split for r in X.stratified_split(frame(rows[::-1]).repartition(5), {"cal": 0.5}, "test", "s").collect()}
    assert one == two and len(one) == 300
    assert X.split_conflicts(X.stratified_split(frame(rows), {"cal": 0.5}, "test", "s")).count() == 0


@pytest.mark.parametrize("n, taken", [(1, 0), (3, 2), (5, 2), (7, 4)])
def test_cuts_round_half_to_even(spark, n, taken):
    rows = spark.createDataFrame([(str(i), "a") for i in range(n)], "key string, label string")
    assert X.stratified_split(rows, {"cal": 0.5}, "test", "s").where("split = 'cal'").count() == taken


def test_holdout_raises_when_short(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "x")], "key string, label string")
    assert X.holdout(rows, 2).where("held").count() == 2
    with pytest.raises(Exception, match="too few keys"):
        X.holdout(rows, 3).collect()


def test_budget_prefix_stops_at_first_overflow(spark):
    rows = spark.createDataFrame([(str(i), n) for i, n in enumerate([5, 90, 1, 1, 1])], "key string, n long")
    order = sorted(range(5), key=lambda i: __import__("hashlib").sha1(f"s:{i}".encode()).hexdigest()[:16])
    upto, want = 0, []
    for i in order:
        upto += [5, 90, 1, 1, 1][i]
        if upto > 20:
            break
        want.append(str(i))
    assert {r.key for r in X.budget_prefix(rows, 20, "s").collect()} == set(want)


def test_curve_cuts_only_between_ties(spark):
    rows = [(0.9, 1), (0.9, 0), (0.5, 1), (0.5, 1), (0.1, 0)]
    curve = M.risk_coverage(_scored(spark, rows)).orderBy("answered").collect()
    assert [(r.answered, round(r.risk, 6)) for r in curve] == [(2, 0.5), (4, 0.25), (5, 0.4)]
    targets = {(r.kind, r.target): r.value for r in M.operating_points(_scored(spark, rows), (0.25, 0.1), (0.5,)).collect()}
    assert targets == {("coverage_at_risk", 0.25): 0.8, ("coverage_at_risk", 0.1): None, ("risk_at_coverage", 0.5): 0.25}


def test_reliability_keeps_empty_bins(spark):
    bins = M.reliability(_scored(spark, [(0.0, 0), (1.0, 1), (1.0, 0)])).orderBy("bin").collect()
    assert [b.n for b in bins] == [1] + [0] * 13 + [2] and bins[14].accuracy == 0.5


def test_auc_counts_ties_half(spark):
    rows = spark.createDataFrame([(1.0, True), (1.0, False), (2.0, True), (0.0, False)], "s double, y boolean")
    assert M.roc_auc(rows, "s", "y").first().auc == 0.875
    assert M.roc_auc(rows.where("y"), "s", "y").first().auc is None


def test_bands_follow_each_other(spark):
    rng = random.Random(6)
    rows = [(round(c, 2), rng.random() < c) for c in (rng.random() for _ in range(800))]
    got = {r.band: r for r in C.fit_bands(_scored(spark, rows)).collect()}
    ranked = sorted(rows, key=lambda r: -r[0])
    start, want = 0, {}
    for band, target in C.TARGETS.items():
        for i in reversed(range(start, len(ranked))):
            if i + 1 < len(ranked) and ranked[i][0] == ranked[i + 1][0]:
                continue
            n = i - start + 1
            if n >= 30 and sum(h for _, h in ranked[start : i + 1]) / n >= target:
                want[band] = (ranked[i][0], n)
                start = i + 1
                break
    assert {b: (r.threshold, r.support) for b, r in got.items()} == want
    assert C.fit_bands(_scored(spark, [(0.5, 0)] * 40)).count() == 0


def test_decisions(spark):
    rows = spark.createDataFrame([("strong", 0.9, 1), (None, 0.9, 1), ("weak", 0.1, 1), (None, 0.1, 1)], "band string, sufficiency double, predicted int")
    assert [(r.outcome, r.verdict) for r in C.decide(rows).collect()] == [("answered", 1), ("declined_low_confidence", None), ("declined_insufficient_evidence", None), ("declined_both", None)]


def test_fits(spark):
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 3, 600)
    logits = rng.normal(size=(600, 3)) + 2 * np.eye(3)[labels]
    frame = spark.createDataFrame([(i, (3 * x).tolist(), int(y)) for i, (x, y) in enumerate(zip(logits, labels))], "id int, logits array<double>, label int")
    best = C.fit_temperature(frame)
    grid = {r.temperature: r.nll for r in C.nll_at(frame, [best, best * 1.2, best / 1.2]).collect()}
    assert grid[best] == min(grid.values()) and best > 1
    scale, bias = C.fit_vector_scaling(frame, 3)
    assert abs(sum(bias)) < 1e-9 and 0.5 < scale / best < 2
    assert C.minorant_slopes(np.array([1.0, 0.0, 0.5, 2.0]), np.array([1.0, 1.0, 2.0, 1.0])).tolist() == [0.5, 0.5, 0.5, 2.0]


def test_logistic_separates(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = x[:, 0] + 0.3 * rng.normal(size=400) > 0
    rows = spark.createDataFrame([(float(a), float(b), 5.0, bool(c)) for (a, b), c in zip(x, y)], "a double, b double, k double, y boolean")
    model = C.standardised_logistic(rows, ["a", "b", "k"], "y")
    assert model["weights"][0] > 2 and abs(model["weights"][1]) < 1 and model["deviations"][2] == 1.0
    right = rows.withColumn("p", C.sufficiency(model)).where("(p >= 0.5) = y").count()
    assert right > 350


def test_mcnemar_and_wilson(spark):
    rows = spark.createDataFrame([(True, False)] * 8 + [(False, True)] * 2 + [(True, True)] * 5, "a boolean, b boolean")
    got = M.mcnemar(rows, "a", "b").first()
    assert (got.a_only, got.b_only, got.p_value) == (8, 2, 0.109375)
    assert M.mcnemar(rows.where("a and b"), "a", "b").first().p_value == 1.0
    audit = M.subgroup_audit(spark.createDataFrame([("g", i < 3) for i in range(10)], "g string, w boolean"), "g", "w").first()
    assert abs(audit.low - 0.10779) < 1e-5 and abs(audit.high - 0.60322) < 1e-5 and not audit.comparable


def test_strict_recall_needs_a_whole_group(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 3), (2, 20, 2)], "qid int, doc_id int, rank int")
    gold = spark.createDataFrame([(1, "a", 10), (1, "a", 11), (2, "a", 20), (2, "a", 99), (2, "b", 20), (3, "a", 5)], "qid int, grp string, doc_id int")
    first = {r.qid: r.first for r in M.completion_ranks(ranked, gold).collect()}
    assert first == {1: 3, 2: 2, 3: None}


def test_lineage_with_cycle(spark):
    src = spark.createDataFrame([("a", "b", "https://www.x.org/1"), ("b", "c", "https://y.org"), ("c", None, "https://www.z.org"), ("d", "e", ""), ("e", "d", "https://e.org"), ("f", "gone", "")], "source_id string, parent_id string, url string")
    roots = {r.source_id: r.root for r in J.lineage_roots(src).collect()}
    assert roots["a"] == roots["b"] == roots["c"] == "c" and roots["f"] == "f"
    assert {r.source_id: r.independent for r in J.independent_sources(src).collect()}["a"] == "z.org"


@pytest.mark.parametrize(
    "statuses, want",
    [
        (["supported"], ("supported", "established")),
        (["contradicted", "contradicted"], ("contradicted", "established")),
        (["insufficient"], ("insufficient", "unresolved")),
        (["contested", "insufficient"], ("insufficient", "contested")),
        (["supported", "contradicted"], ("qualified", "contested")),
        (["supported", "insufficient"], ("qualified", "partially_established")),
        (["contradicted", "insufficient"], ("qualified", "partially_contradicted")),
        (["qualified_support"], ("qualified", "qualified_support")),
        (["qualified_contradiction", "insufficient"], ("qualified", "qualified_contradiction")),
    ],
)
def test_claim_summary(spark, statuses, want):
    got = J.claim_summary(spark.createDataFrame([(1, s) for s in statuses], "claim_id int, status string")).first()
    assert (got.relationship, got.summary) == want


def test_click_window_edges(spark):
    clicks = spark.createDataFrame([("v", 1, 100.0)], "key string, click_id int, at double")
    cues = spark.createDataFrame([("v", i, e) for i, e in enumerate([69.9, 70.0, 70.1, 100.0, 100.1])], "key string, cue_id int, end double")
    assert sorted(r.cue_id for r in S.click_window(clicks, cues).collect()) == [2, 3]


def test_pages(spark):
    urls = ["https://A.org/x#f", "http://a.org/x", "https://u@a.org/", "https://a.org:443/y?q=1", "https://localhost/", "https://10.0.0.1/x", "https://a.org:8080/"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(P.public_url(F.col("u"))).collect()]
    assert got == ["https://a.org/x", "", "", "https://a.org/y?q=1", "", "", ""]
    page = "<html><head><title> T  t </title></head><body><nav>no</nav><h1>Head</h1><p>One <a href='/x'>link</a>.</p><div hidden>gone<p>x</p></div><script>var a='<p>';</script><p>Two</body>"
    read = spark.createDataFrame([(page,), (None,)], "html string").select(P.read_html("html").alias("r")).select("r.*").collect()
    assert read[0].markdown == "# Head\n\nOne [link](/x).\n\nTwo" and read[0].title == "T  t" and read[0].n_links == 1
    assert read[1].markdown == ""


def test_sources(spark, tmp_path):
    fever = tmp_path / "f.jsonl"
    fever.write_text('{"id": 1, "label": "SUPPORTS", "claim": " A  B", "evidence": [[["1", "2", "P", "3"], ["1", "2", "O", "0"]], [["1", "2", "P", "3"], ["1", "2", "O", "0"]], [["1", "2", null, null]]]}\n')
    row = D.read_fever(spark, str(fever)).first()
    assert row.key == "a b" and [[(r.page, r.sent) for r in g] for g in row.groups] == [[("O", 0), ("P", 3)]] and row.pages == ["O", "P"]
    fever.write_text('{"id": 1, "label": "MAYBE", "claim": "A", "evidence": []}\n')
    with pytest.raises(Exception, match="unknown label"):
        D.read_fever(spark, str(fever)).collect()
    averitec = tmp_path / "a.json"
    averitec.write_text('[{"claim": "C", "label": "Supported", "questions": [{"question": "Q", "answers": [{"answer": "Yes.", "boolean_explanation": "Because"}]}, {"question": "", "answers": [{"answer": ""}]}]}, {"claim": "D", "label": "Refuted", "questions": []}]')
    rows = D.read_averitec(spark, str(averitec), 10).orderBy("id").collect()
    assert [r.id for r in rows] == [10, 11] and [(q.q, q.a) for q in rows[0].questions] == [("Q", "Yes. Because")]
    mnli = tmp_path / "m.jsonl"
    mnli.write_text('{"gold_label": "-", "sentence1": "a", "sentence2": "b"}\n{"gold_label": "neutral", "sentence1": " a ", "sentence2": "b", "promptID": "7", "genre": "g"}\n')
    assert [(r.pair_id, r.premise) for r in D.read_mnli(spark, str(mnli), "dev").collect()] == [("dev-2", "a")]
    lines = spark.createDataFrame([(1, "0\tFirst.\nx\tbad\n1\t\n2\tThird.\textra")], "doc_id long, lines string")
    assert [(r.idx, r.text) for r in D.page_lines(lines).collect()] == [(0, "First."), (2, "Third.")]
    for name, text in (("w-1", '{"id": "", "text": ""}\n{"id": "B", "lines": "0\\tb"}\n'), ("w-2", '{"id": "A", "lines": "0\\ta"}\n{"id": "B", "lines": "0\\tz"}\n')):
        (tmp_path / name).write_text(text)
    pages, counters = D.ingest_pages(spark, [str(tmp_path / "w-1"), str(tmp_path / "w-2")])
    assert [(r.doc_id, r.title, r.lines) for r in pages.orderBy("doc_id").collect()] == [(0, "B", "0\tb"), (1, "A", "0\ta")]
    assert counters.first().asDict() == {"records": 4, "empty_ids": 1, "pages": 2, "duplicates": 1}


def _one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, day",
    [
        ("By Ann Lee | March 3, 2020\n\nBody", "2020-03-03"),
        ("Published on Monday, May 4, 2021 - News", "2021-05-04"),
        ("Updated March 3, 2020", None),
        ("March 3, 2020\nApril 4, 2020", None),
        ("February 31, 2020", None),
        ("nothing", None),
    ],
)
def test_byline_date(spark, text, day):
    assert _one(spark, P.byline_date(F.col("t")), text) == day


def test_publication_date(spark):
    meta = F.array(F.lit("2020-03-03T10:00:00Z"), F.lit("soon"))
    assert _one(spark, P.publication_date(F.col("t"), meta), "Published March 3, 2020\n").day == "2020-03-03"
    assert _one(spark, P.publication_date(F.col("t"), meta), "Published March 4, 2020\n").problem == "Conflicting publication notices."
    assert _one(spark, P.publication_date(F.col("t"), F.array().cast("array<string>")), "x").day is None


def test_notes_and_prose(spark):
    blocks = "# Head\n\nA.\n\n# Notes\n\none\n\ntwo\n\n# End\n\nlast"
    assert _one(spark, P.note_flags(P.blocks(F.col("t"))), blocks) == [False, False, True, True, True, False, False]
    long = "word " * 30
    assert [_one(spark, P.citable(F.col("t")), t) for t in (long, "short", "# " + long, long + "... Read more", "[" + long + "](http://x)", "Table 1: " + long)] == [True, False, False, False, False, False]


@pytest.mark.parametrize(
    "text, roles",
    [
        ("Unemployment rose in June.", ["reported_observation"]),
        ("The rate is defined as a share of workers.", ["definition"]),
        ("The index includes the 500 largest firms.", ["reported_observation", "definition"]),
        ("Prices will rise next year.", ["reported_observation", "forecast"]),
        ("Click here to subscribe now.", ["instruction"]),
        ("What happened in June?", ["unknown"]),
        ("Very nice weather today", ["unknown"]),
        ('"Wages are much too low," she said.', ["reported_observation", "attributed_opinion"]),
        ("We believe wages fell.", ["reported_observation", "attributed_opinion"]),
    ],
)
def test_roles(spark, text, roles):
    rows = spark.createDataFrame([(1, 0, text, False, False, False)], "passage_id int, idx int, text string, spoken boolean, caption boolean, reprint boolean")
    assert Y.type_sentences(rows).first().roles == roles


def test_opinion_is_inherited_along_a_run(spark):
    texts = ["We believe wages fell.", "“They fell a lot in June.", "Instead, prices rose in May.", "Unemployment rose in June."]
    rows = spark.createDataFrame([(1, i, t, False, False, False) for i, t in enumerate(texts)], "passage_id int, idx int, text string, spoken boolean, caption boolean, reprint boolean")
    got = {r.idx: "attributed_opinion" in r.roles for r in Y.type_sentences(rows).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False}


def test_sources_of_speech_and_opinion(spark):
    urls = ["https://x.org/opinion/a", "https://x.org/remarks-by-the-president", "https://x.org/full-text-of-speech", "https://x.org/text-of-bill", "https://x.org/a/transcript"]
    got = [(r.o, r.s) for r in spark.createDataFrame([(u,) for u in urls], "u string").select(Y.opinion_source(F.col("u")).alias("o"), Y.speech_text_source(F.col("u")).alias("s")).collect()]
    assert got == [(True, False), (False, True), (False, True), (False, False), (False, True)]
    assert _one(spark, Y.caption_passage(F.col("t")), "A man walks. (AP Photo/Evan Vucci)") and not _one(spark, Y.caption_passage(F.col("t")), "A man walks.")


def test_claim_functions(spark):
    assert [t for a, b in K.sentence_spans("Mr. Smith met J. Doe. \"Yes.\" It rose 3.5 percent in 2019. End") for t in ["Mr. Smith met J. Doe. \"Yes.\" It rose 3.5 percent in 2019. End"[a:b]]] == ["Mr. Smith met J. Doe.", "\"Yes.\"", "It rose 3.5 percent in 2019.", "End"]
    one = spark.range(1)

    def of(column):
        return one.select(column.alias("x")).first().x

    def figures(text):
        return K.read_figures(F.lit(text))

    found = {f["text"]: (f["value"], f["kind"], f["relation"]) for f in of(figures("over 3.5 million jobs, about $1,200, rose by 4 percent, 2 percentage points, in 2019, 7 left"))}
    assert found == {"3.5 million": (3.5e6, "count", "at_least"), "$1,200": (1200.0, "currency", "near"), "4 percent": (4.0, "relative_percent", None), "2 percentage points": (2.0, "percentage_points", None)}
    text = "é 12 of 30% and\n 1.5 then 12"
    assert all(text[f.start : f.end] == f.text for f in of(figures(text))) and [f.text for f in of(figures(text))] == ["12", "30%", "1.5", "12"]
    assert of(figures("")) == of(K.read_figures(F.lit(None).cast("string"))) == []
    assert of(K.hedged_form(F.lit("about 100 jobs"), figures("97 jobs and 250 jobs"))) == "about 97 jobs"
    assert of(K.hedged_form(F.lit("over 100 jobs"), figures("97 jobs"))) is None
    assert of(K.hedged_form(F.lit("about 100 jobs or nearly 40%"), figures("39% of 102, 98, 101"))) == "about 101 jobs or nearly 39%"
    assert [tuple(p)[:2] for p in of(K.read_periods(F.lit("since March 2020, 2010 to 2012, in 2015")))] == [(24242, K.FOREVER), (24120, 24155), (24180, 24191)]
    names = ("Virginia", "West Virginia", "Ohio", "Virginia Beach")
    assert of(K.place_qualifiers(F.lit("West Virginia and Virginia and Ohio"), F.lit("in Ohio"), names)) == ["West Virginia", "Virginia"]
    assert of(K.place_qualifiers(F.lit("Ohioan West Virginia Beach, Ohio"), F.lit(""), names)) == ["West Virginia", "Virginia Beach", "Ohio"]
    assert [x["label"] for x in K.inline_links(r"[a](b(c)) ![i](x) \[no](y) [q [z]](w) [e](f)")] == ["a", "e"]
    assert K.inline_links("[a](b [c](d)") == []


def test_pack_and_runs(spark):
    claims = spark.createDataFrame([(1, "two words")], "id int, text string")
    evidence = spark.createDataFrame([(1, 1, "A_b", "x y"), (1, 2, "A_b", "z"), (1, 3, "C", "w w w"), (1, 4, "A_b", "v")], "id int, rank int, title string, text string")
    assert {b: B.pack(claims, evidence, b).first().n_read for b in (1, 4, 5, 6, 9, 10, 12)} == {1: 0, 4: 0, 5: 1, 6: 2, 9: 2, 10: 3, 12: 4}
    assert B.render(evidence).first().text == "A b: x y z C: w w w A b: v"
    ranks = B.shuffle_runs(evidence, 3).orderBy("rank").collect()
    assert [r.rank for r in ranks] == [1, 2, 3, 4] and [r.text for r in ranks if r.text in ("x y", "z")] == ["x y", "z"]


def test_pair_rules(spark):
    news = spark.createDataFrame([("p", "h", "states"), ("p", "h", "states"), ("q", "h", "states")], "premise string, hypothesis string, relation string")
    base = spark.createDataFrame([("q", "h")], "premise string, hypothesis string")
    assert [(r.premise, r.relation) for r in B.fresh_pairs(news, base).collect()] == [("p", "states")]
    with pytest.raises(Exception, match="two relations"):
        B.fresh_pairs(news.union(spark.createDataFrame([("p", "h", "unrelated")], news.schema)), base).collect()
    gold = spark.createDataFrame([(1, 0, "a", 0), (1, 0, "b", 0), (1, 1, "c", 0), (1, 2, "z", 0)], "id int, grp int, page string, sent int")
    known = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0)], "page string, sent int")
    assert tuple(B.smallest_gold(gold, known).first()) == (1, 1, 1)
    assert B.repeat_rows(spark.createDataFrame([("a",)], "id string"), 3).orderBy("id").collect()[2].id == "a#2"


def test_speaker_context_with_overlaps(spark):
    """Two ended segments behind ten that still run, equal ends, segments without length, and interim ones: against a plain search."""
    from veristrata.operators.transcripts import speaker_context

    rng = random.Random(3)
    rows = [(1, f"a{i:02}", "x", float(i), t, True) for i, t in enumerate([2.0, 3.0, *[99.0] * 10])] + [(1, "q", "x", 20.0, 21.0, True)]
    rows += [(2, f"{i:03}", rng.choice(["x", "y", None]), s := float(rng.randint(0, 30)), s + rng.choice([0, 0, 1, 5, 20]), rng.random() < 0.8) for i in range(120)]
    frame = spark.createDataFrame(rows, "session long, id string, speaker string, start double, end double, final boolean")
    got = {(r.session, r.id): list(r.preceding) for r in speaker_context(frame).collect()}
    assert len(got) == len(rows) and got[1, "q"] == ["a00", "a01"]
    for session, name, speaker, start, _, _ in rows:
        fit = sorted((e, s, i) for z, i, p, s, e, final in rows if z == session and p == speaker and final and i != name and e <= start and s < start)
        assert got[session, name] == [i for _, _, i in fit[-2:]], name


def test_composed_text(spark):
    """Composed and decomposed spellings are one term; only texts that need it go to Python."""
    import unicodedata

    from veristrata.functions import text as T

    texts = ["caf\u00e9 \u212bngstr\u00f6m", "cafe\u0301 A\u030angstro\u0308m", "\u1112\u1161\u11ab", "\u304b\u3099", "plain", None, "", "\u65e5\u672c \u2019"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.nfc(F.col("text")).alias("n"), T.tokens(F.col("text")).alias("t"), F.col("text").rlike(T.COMPOSABLE).alias("sent"))
    rows = frame.collect()
    assert [r.n for r in rows] == [None if t is None else unicodedata.normalize("NFC", t) for t in texts]
    assert rows[0].t == rows[1].t and [r.sent for r in rows[4:]] == [False, None, False, False]


def test_numbering(spark):
    from veristrata.operators.numbering import numbered, unit_bucket

    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([0.5, rng.random()]), rng.randint(0, 5)) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, g string, v double, w long")
    got = {r.id: (r.pos, r.n, r.running) for r in numbered(frame, unit_bucket("v"), ["v", "id"], ["g"], "w").collect()}
    for group in ("a", "b", None):
        own = sorted((v, i, w) for i, g, v, w in rows if g == group)
        for k, (_, i, _) in enumerate(own):
            assert got[i] == (k + 1, len(own), sum(w for _, _, w in own[: k + 1]))
    whole = numbered(frame.select("id", "v"), unit_bucket("v"), ["v", "id"]).orderBy("pos").collect()
    assert [r.id for r in whole] == [i for _, i in sorted((v, i) for i, _, v, _ in rows)]


def test_gold_holds_whole_items(spark):
    from veristrata.sources.tables import gold

    item = " ".join(f"w{i}" for i in range(12))
    docs = [(1, f"x {item} y"), (2, item.replace(" ", "\n ")), (3, f"x{item} y"), (4, item[:30]), (5, f"{item} and again {item}"), (6, None), (7, "two  words")]
    items = [(10, item), (11, "two words"), (12, ""), (13, None), (14, "words two"), (15, f"{item} z")]
    found = gold(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == [(10, 1), (10, 2), (10, 5), (11, 7)]


def test_stored_index(spark, tmp_path):
    """The stored index gives the documents' own scores; its scan for a term reads a part of the files."""
    from veristrata.operators import retrieval as R

    docs = spark.createDataFrame([(i, f"term{i % 7} common word{i}") for i in range(60)] + [(90, ""), (91, None)], "doc_id long, text string").where("text is not null")
    queries = spark.createDataFrame([(1, "term3 common common"), (2, "absent"), (3, "word5 term5")], "qid long, text string")
    index = R.Index.build(docs, f"{tmp_path}/index")
    own = {(r.qid, r.doc_id): round(r.score, 9) for r in R.bm25(queries, docs).collect()}
    assert own and own == {(r.qid, r.doc_id): round(r.score, 9) for r in R.Index(spark, f"{tmp_path}/index").bm25(queries).collect()}
    assert index.meta.first()["n_docs"] == 61


def test_isotonic_is_the_minimax(spark):
    """Each value is the greatest of the least means over the runs that begin at or before it and end at or after it."""
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 30):
        y, w = rng.integers(0, 4, n) / 2, rng.integers(1, 5, n).astype(float)
        mean = lambda a, b: (y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
        want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(C.minorant_slopes(y, w), want)


def test_vector_scaling_reaches_the_optimum(spark):
    """No small move of scale or bias lowers the loss."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3)) * 2
    z = 0.4 * x + np.array([0.8, -0.3, -0.5])
    label = [int(rng.choice(3, p=np.exp(r) / np.exp(r).sum())) for r in z]
    frame = spark.createDataFrame([(i, r.tolist(), y) for i, (r, y) in enumerate(zip(x, label))], "id int, logits array<double>, label int")
    temperature, bias = C.fit_vector_scaling(frame, 3)

    def loss(scale, b):
        m = scale * x + b
        return np.mean(np.log(np.exp(m).sum(axis=1)) - m[np.arange(len(x)), label])

    best = loss(1 / temperature, np.array(bias))
    assert abs(sum(bias)) < 1e-9
    for step in (1e-3, -1e-3):
        assert loss(1 / temperature + step, np.array(bias)) > best
        for k in range(3):
            moved = np.array(bias)
            moved[k] += step
            assert loss(1 / temperature, moved) > best


def test_page_reader():
    """Headings of every level, omitted and hidden parts, marks, links, regions, dates, depth."""
    from veristrata.functions.html import Page

    read = lambda body, url="https://x.org/a/b": Page(body, url)
    assert read("<h2>Notes</h2><p>a</p><h3>Next</h3>").markdown == "# Notes\n\na\n\n# Next"
    for hidden in ("<header>h</header>", "<table><tr><td>t</td></tr></table>", "<figcaption>f</figcaption>", "<p style='color:red; display : none !important'>d</p>", "<div aria-hidden='true'>x<p>y</p></div>", "<p style='visibility:hidden;'>v</p>"):
        assert read(f"<p>a</p>{hidden}<p>b</p>").markdown == "a\n\nb", hidden
    assert read("<p style='display:nonesuch'>a</p>").markdown == "a"
    assert read("<html data-wf-site=1 data-wf-page=2><p class='k w-dyn-hide'>x</p>y</html>").markdown == "y" and read("<p class='w-dyn-hide'>x</p>").markdown == "x"
    assert read("x<sup>2</sup> H<sub>2</sub>O <del>a</del><ins>b</ins><br> c<pre>p  q</pre>").markdown == "x^(2) H_(2)O [deleted: a][inserted: b]\nc\n\np  q"
    assert read("<a href='../c'>l</a> <a>n</a> <a href='https://y.org/'>m").markdown == "[l](https://x.org/c) [n](https://x.org/a/b) [m"
    assert read("<p>out</p><main><p>in</p></main>").markdown == "in" and read("<article>a</article><article>b</article>").markdown == "a\n\nb"
    assert read("<article>x<div itemprop='articleBody'>body</div></article>").markdown == "body"
    assert read("<main><article>x</article>").markdown == "x"  # main is never ended
    dated = read("<head><title> T </title><meta property='article:published_time' content='2020-01-02'><meta name='datePublished' content='2020-01-02'><meta name='datePublished' content='2020-01-03'></head>x")
    assert dated.metadata == {"article:published_time": "2020-01-02", "datePublished": "2020-01-03"} and dated.conflict and dated.title == "T" and dated.markdown == "x"
    assert read("<script type='application/ld+json'>{}</script>").linked_data == ["{}"]
    assert read("<div>" * 129 + "x").problem == "too_deep" and read("<div>" * 128 + "x").markdown == "x"
