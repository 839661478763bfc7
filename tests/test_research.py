"""Steps of research on odd rows, and reading windows against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from veristrata.operators import research as Q


def _window(quotable, anchors, selected):
    def grow(taken, places):
        out = list(dict.fromkeys(taken))
        for p in places:
            for q in range(max(0, p - 4), min(p + 5, len(quotable))):
                if len(out) < 9 and quotable[q] and q not in out:
                    out.append(q)
        return out

    plain = grow([], anchors)
    return sorted(plain if set(selected) <= set(plain) else grow(selected, [*selected, *anchors]))


def test_windows(spark):
    draw = random.Random(5)
    rows = []
    for i in range(120):
        n = draw.randrange(1, 40)
        quotable = [draw.random() < 0.7 for _ in range(n)]
        able = [k for k in range(n) if quotable[k]]
        rows.append((i, quotable, draw.sample(able, min(len(able), draw.randrange(0, 5))), draw.sample(able, min(len(able), draw.randrange(0, 3)))))
    frame = spark.createDataFrame(rows, "id int, quotable array<boolean>, anchors array<int>, selected array<int>")
    got = frame.select("id", Q.window_positions(F.col("quotable"), F.col("anchors"), F.col("selected")).alias("w")).collect()
    assert {r.id: r.w for r in got} == {i: _window(q, a, s) for i, q, a, s in rows}


def test_anchors(spark):
    blocks = ["red fox runs", "the red and the blue", "fox red hill", "nothing here", "blue fox red"]
    rows = spark.createDataFrame([(blocks, ["red", "fox"], [True, True, True, True, False]), (blocks, ["blue"], [True] * 5), (blocks, [], [True] * 5), ([], ["red"], [])], "b array<string>, t array<string>, q array<boolean>")
    got = [r.a for r in rows.select(Q.anchor_positions(F.col("b"), F.col("t"), F.col("q")).alias("a")).collect()]
    assert got == [[0, 2], [1, 4], [], []]


@pytest.mark.parametrize(
    "text, want",
    [
        ("The Clean Air Act of 1970 and Clean Water Act", [("Clean Air Act of 1970", 4, 25), ("Clean Water Act", 30, 45)]),
        ("The Act was read", []),
        ("Act Law", [("Act Law", 0, 7)]),
        ("the clean air act", []),
        ("", []),
    ],
)
def test_law_mentions(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(Q.law_mentions(F.col("t")).alias("m")).first().m
    assert [tuple(m) for m in got] == want


def test_law_hint(spark):
    rows = [
        ("it became law", [(1, "The Fair Act"), (2, "the Fair Act"), (3, None)], (2, "Fair Act")),
        ("it became law", [(1, "Fair Act"), (2, "Free Act")], None),
        ("it became law, the Big Act", [(1, "Fair Act")], None),
        ("it was signed", [(1, "Fair Act")], None),
        (None, [(1, "Fair Act")], None),
        ("the law holds", [], None),
    ]
    frame = spark.createDataFrame([(i, c, x) for i, (c, x, _) in enumerate(rows)], "n int, claim string, context array<struct<id:long,text:string>>")
    got = {r.n: r.h and (r.h.id, r.h.text) for r in frame.select("n", Q.law_hint(F.col("claim"), F.filter("context", lambda s: s["text"].isNotNull())).alias("h")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(rows)}


def test_topic_budget(spark):
    long = "fox " * 70
    rows = spark.createDataFrame([("The fox slept", [(1, long), (2, "no match"), (3, long)]), ("of the", [(1, "of the")])], "claim string, before array<struct<id:long,text:string>>")
    found = rows.select("claim", Q.topic_context(F.col("claim"), F.col("before")).alias("c")).collect()
    assert [[(x.id, len(x.text.split())) for x in r.c] for r in found] == [[(1, 26), (3, 70)], []]
    asked = rows.select(Q.topic_query(F.col("claim"), Q.topic_context(F.col("claim"), F.col("before"))).alias("q")).collect()
    assert [r.q for r in asked] == ["fox slept", "of the"]


def test_cues(spark):
    lines = [("a", 0, "[0:05]  one   two "), ("a", 1, "no cue"), ("a", 2, "[1:00:00] three"), ("a", 3, "[0:10] back"), ("a", 4, None), ("b", 0, "x")]
    got = Q.cues(spark.createDataFrame(lines, "k string, n int, line string"), ["k"], "n").orderBy("n").collect()
    assert [(r.n, r.start, round(r.end, 2), r.text) for r in got] == [(0, 5.0, 3599.99, "one two"), (2, 3600.0, 3600.0, "three"), (3, 10.0, 12.99, "back")]


def test_page_allowance(spark):
    url = lambda i: f"u{i}"
    hits = [("a", 0, 2, i, url(i), False, False) for i in range(30)] + [("a", 1, 2, i, url(i + 2), i == 1, False) for i in range(9)]
    hits += [("b", 0, 1, 0, None, True, False), ("b", 0, 1, 1, "x", True, False), ("b", 0, 1, 2, "x", True, False), ("b", 0, 1, 3, "y", True, False), ("b", 0, 1, 4, "z", True, False)]
    hits += [("c", 0, 1, i, url(i), False, True) for i in range(4)]
    got = Q.page_allowance(spark.createDataFrame(hits, "k string, query long, queries long, pos int, url string, gives boolean, concept boolean"), ["k"]).orderBy("k", "n").collect()
    assert [(r.k, r.url) for r in got] == [("a", "u0"), ("a", "u1"), ("a", "u2"), ("a", "u3"), ("a", "u4"), ("b", "x"), ("b", "y"), ("c", "u0"), ("c", "u1")]


def test_empty(spark):
    rows = spark.createDataFrame([], "pair_id string, prompt_id string, genre string, label string, premise string, hypothesis string")
    assert Q.genre_pairs(rows).count() == 0
    one = spark.createDataFrame([("a", "p", "g", "neutral", "x", "y"), ("b", "p", "g", "neutral", "x", "y"), ("c", "p", "g", "neutral", "z", "z")], rows.schema)
    assert [(r.id, r.relation) for r in Q.genre_pairs(one, 1).collect()] == [("mnli:a", "bears_on")]
