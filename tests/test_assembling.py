"""Screens, readings and cross-fitted calibrators that SQL doesn't cover, against plain versions."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veristrata.functions import claims as K
from veristrata.functions.text import FUNCTION_WORDS
from veristrata.operators import crossfit as X
from veristrata.operators import readings as D
from veristrata.operators import screening as N


def _terms(text):
    return re.findall(r"\w+", text.lower())


def _content(text):
    return [t for t in _terms(text) if t not in FUNCTION_WORDS]


def _phrases(text):
    out = set()
    for clause in re.split("[.!?,;:]", text):
        run = []
        for t in [*_terms(clause), "the"]:
            if t not in FUNCTION_WORDS:
                run.append(t)
                continue
            n = min(3, len(run))
            out |= {tuple(run[i : i + n]) for i in range(len(run) - n + 1)} if n > 1 else set()
            run = []
    return out


def test_topics(spark):
    rng = random.Random(4)
    words = "the of wages growth rate fell rose tax cut plan in jobs".split()
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", ", ", ". "]) for _ in range(rng.randint(1, 14))) for _ in range(80)] + ["", "the of"]
    rows = [(i, rng.choice(texts), rng.choice(texts), rng.choice(texts)) for i in range(200)]
    frame = spark.createDataFrame(rows, "id long, claim string, query string, body string")
    got = {r.id for r in N.on_topic(frame, "claim", "query", "body").collect()}
    want = set()
    for i, claim, query, body in rows:
        own, asked = set(_content(body)), set(_content(query))
        clauses = [_terms(c) for c in re.split("[.!?,;:]", body)]
        held = any(tuple(c[k : k + len(p)]) == p for p in _phrases(claim) for c in clauses for k in range(len(c)))
        if own & set(_content(claim)) and len(own & asked) >= min(2, len(asked)) and (held or not _phrases(claim)):
            want.add(i)
    assert got == want and 5 < len(want) < 195
    assert {r.id: set(r.p) for r in frame.select("id", N.topic_phrases(F.col("claim")).alias("p")).collect()} == {i: {" ".join(p) for p in _phrases(c)} for i, c, _, _ in rows}


def test_fallback_queries(spark):
    rows = [("Wages in the city rose after May.", "France", "2019-05-01"), ("Two of the jobs fell", "", "2020"), ("He was not there", "", ""), ("Wages fell (to them) about now!", "", "2018-01"), ("growth " * 90 + "x", "", "2019"), ("The 3 of us", "", "2019")]
    got = [r.q for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c string, k string, d string").orderBy("i").select(N.fallback_query(F.col("c"), F.col("k"), F.col("d")).alias("q")).collect()]
    assert got == ["Wages city rose after May. France 2019", "Two of the jobs fell 2020", "", "Wages fell (to them) about 2018", "", ""]


def test_context_phrases(spark):
    terms = spark.createDataFrame([("tax", 2.0), ("cut", 4.0), ("plan", 3.0), ("paris", 9.0)], "term string, idf double")
    candidates = [(1, 0, "tax cut"), (1, 1, "plan plan"), (1, 2, "Paris plan"), (1, 3, "Lwood plan"), (1, 4, "unknown words"), (2, 0, "unknown"), (2, 1, "tax")]
    got = N.context_phrases(spark.createDataFrame(candidates, "claim long, pos int, text string"), terms).collect()
    assert sorted((r.claim, r.place, r.pos, r.mean_idf) for r in got) == [(1, 1, 2, 6.0), (1, 2, 0, 3.0), (2, 1, 1, 2.0)]


def test_reading_units(spark):
    rows = [("s", ["One here. Two there.", "Three."], ["Four"], "https://x.org/", "published"), ("late", ["x"], [], "https://x.org/", "later_publication"), ("none", [], [], "https://x.org/", None)]
    frame = spark.createDataFrame(rows, "id string, excerpts array<string>, reading_passages array<string>, url string, temporal_status string").withColumn("assertion_passages", F.col("excerpts"))
    units = D.reading_units(D.research_packet(frame, F.col("url")), K.segment).collect()
    assert [(u.unit_id, u.origin, u.text) for u in sorted(units, key=lambda u: u.unit_id)] == [("s:p1:u1", "assertion", "One here."), ("s:p1:u2", "assertion", "Two there."), ("s:p2:u1", "assertion", "Three."), ("s:p3:u1", "context", "Four")]
    passages = {"s:p1": rows[0][1][0], "s:p2": rows[0][1][1], "s:p3": "Four"}
    assert all(passages[u.passage_id][u.start : u.end] == u.text for u in units)


def _soft(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def test_isotonic_out_of_fold(spark):
    """Every row by a fit on the other fold: pooled ties, one class against the rest, straight lines between knots, sums of one."""
    from veristrata.operators.calibration import minorant_slopes

    rng = np.random.default_rng(3)
    z = np.round(rng.normal(size=(120, 3)) * 2, 1)
    label = [int(rng.choice(3, p=p)) for p in _soft(z / 2)]
    fold = [i % 2 for i in range(120)]
    frame = spark.createDataFrame([(i, z[i].tolist(), label[i], fold[i]) for i in range(120)], "id int, logits array<double>, label int, fold int")
    got = {r.id: np.array(r.p) for r in X.out_of_fold(frame, 2, 3, "isotonic").collect()}
    p, y, f = _soft(z), np.array(label), np.array(fold)
    for held in (0, 1):
        raw = np.zeros((120, 3))
        for k in range(3):
            x, at = np.unique(p[f != held, k], return_inverse=True)
            w = np.bincount(at).astype(float)
            fit = minorant_slopes(np.bincount(at, (y[f != held] == k).astype(float)) / w, w)
            raw[:, k] = np.interp(p[:, k], x, fit)
        for i in np.flatnonzero(f == held):
            want = raw[i] / raw[i].sum() if raw[i].sum() > 0 else p[i]
            assert np.allclose(got[i], want, atol=1e-9), i
    losses = {r.name: (r.nll, r.chosen) for r in X.calibrator_losses(frame, 2, 3, ["none", "temperature"]).collect()}
    assert abs(losses["none"][0] + np.mean([math.log(p[i, label[i]]) for i in range(120)])) < 1e-5
    assert losses["temperature"][1] and losses["temperature"][0] < losses["none"][0]
    with pytest.raises(ValueError):
        X.out_of_fold(frame, 1, 3, "none")


def test_out_of_fold_auc(spark):
    """A feature that tells scores high, one that doesn't near a half."""
    rng = random.Random(8)
    rows = [(i, rng.gauss(i % 2, 0.4), rng.random(), bool(i % 2), i // 2 % 3) for i in range(200)]
    frame = spark.createDataFrame(rows, "id long, a double, b double, good boolean, fold int")
    assert X.out_of_fold_auc(frame, 3, ["a"], "good").first().auc > 0.9
    assert abs(X.out_of_fold_auc(frame, 3, ["b"], "good").first().auc - 0.5) < 0.15
