"""Registered queries give their SQL's rows on small tables of odd texts."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_queries import _plain
from veristrata.functions import claims as K
from veristrata.plans import registry

ODD = [
    "0997 starts.\n1 one. 148.9 went! 22 2 22.\n3\n44 and 4",
    " a.  b .\n \n　 \nend \t\n\t\nlast",
    "cut.\x0bnot here. cut\x0chere.\rand.\t here",
    " ".join(f"w{i}" for i in range(70)) + "\x0bx. " + "\x0b".join(f"v{i}" for i in range(70)),
    "",
    "...",
    None,
    "0. 1. 2. 3. 4. 5. 6. 7. 8. 9. 10. 11. red fox 11. 12 red. 13 fox 31.",
    "élano noé", "Énot an", "ñn’té", "NOTHING_", "no_", "nö", "isn'tö", "é never", "cano no",
    "the red fox runs. 1 red fox. 2 red fox runs 2. 0 fox",
]

SAID = [
    "caf\u00e9 first\x0bwords here", "a \u00e9its b", "\u00e9Clean Water Act passed", "c", "it\u00e9 said", "the\u017fe words", "It became law", "that law\u00e9", "we\u00e9re not", "ours\x0bonce", "theirs", "_it_", "the bill", "hi\u017f", "hi\u017fx",
    "Big\x0bBill and Old Law", "", "la quetion\u00e9our plus", "\u00e9 it.", "Th\u00efs", "\u0130t \u0131t", "this law", "that act\u00e9",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of tables and a connection that reads them."""
    folder = str(tmp_path_factory.mktemp("odd"))
    tables = {
        "documents": ([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars int"),
        "labels": ([(i, i % 2, 0) for i in range(len(ODD))], "doc_id long, quality int, toxic int"),
        "benchmark": ([(i, t) for i, t in enumerate(["red fox", "the red fox runs 31", "cut here end", "0997 starts 22", ""])], "item_id long, text string"),
    }
    turns = [(c, n, ("user", "assistant")[(n // (1 + c % 2)) % 2], SAID[(c * 5 + n * (1 + c % 3)) % len(SAID)]) for c in range(30) for n in range(16)]
    tables["conversations"] = (turns, "conv_id long, turn int, role string, text string")
    con = duckdb.connect()
    for name, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet/*.parquet')")
    return folder, con


@pytest.fixture(scope="module")
def keys(spark, tmp_path_factory):
    """Tables like those of odd, of null, composed and decomposed sources, labels that repeat, and rows without id."""
    folder = str(tmp_path_factory.mktemp("keys"))
    sources = [None, "e\u0301", "\u00e9", "", "a_1", "src"]
    docs = [(i, f"a{i}. b. c. d{i}. e. f. g{i}. h. i. j{i}.", "en", sources[i % 6], 9) for i in range(1, 15)]
    docs += [(None, "q. b. said twice. s. only here", "en", "src", 9), (21, "t. u. v. said twice. w", "en", "src", 9), (22, None, "en", "src", 9)]
    labels = [(i, 0, 0) for i in (*range(0, 24, 2), 4, 4, 7, 9, 9, 13)] + [(None, 0, 0)]
    con = duckdb.connect()
    for name, rows, kind in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars int"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet/*.parquet')")
    return folder, con


def _rows(spark, odd, name):
    folder, con = odd
    frame = registry.QUERIES[name](spark, folder)
    names = sorted(frame.columns)
    got = sorted((tuple(_plain(r[c]) for c in names) for r in frame.collect()), key=repr)
    cursor = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = sorted((tuple(_plain(dict(zip(columns, r))[c]) for c in names) for r in cursor.fetchall()), key=repr)
    return got, want


@pytest.mark.parametrize("name", ["i06_two_stage_text", "a15_page_scan", "a17_page_sentences", "a23_stored_sentences", "g01_clipped_sentences", "p09_claims_to_judge"])
def test_sentences_by_sql(spark, odd, name):
    got, want = _rows(spark, odd, name)
    assert got == want and len(got) > 5


def test_stored_sentences_by_sql_on_odd_keys(spark, keys):
    got, want = _rows(spark, keys, "a23_stored_sentences")
    assert got == want and len(got) == 40


def test_claims_to_judge_by_sql_on_odd_keys(spark, keys):
    got, want = _rows(spark, keys, "p09_claims_to_judge")
    assert got == want and ("said twice.", 21, 3) in got and ("q.", None, 0) in got


def test_negated_items_by_sql(spark, odd):
    got, want = _rows(spark, odd, "b22_negated_items")
    assert got == want and len(got) == 3


def test_negation_of_claims_ends_at_letters(spark):
    rows = spark.createDataFrame([("elle est énot",), ("it is not",)], "t string").select(K.negated(F.col("t")).alias("plain"), K.negated(F.col("t"), as_in_sql=True).alias("sql"))
    assert [tuple(r) for r in rows.collect()] == [(False, True), (True, True)]


def test_search_queries_by_sql(spark, odd):
    got, want = _rows(spark, odd, "i08_search_queries")
    assert got == want and len(got) == 480
