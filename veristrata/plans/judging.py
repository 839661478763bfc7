"""Queries over literal fixtures: the gate, demotions, statuses, summaries, lineage, integrity and quantity rules.

The test tables hold no role or relation labels, so these operators run on rows that both engines build from the same
VALUES, crossed with benchmark items to give them a body of rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veristrata.functions import pages as P
from veristrata.operators import composition as J
from veristrata.plans import sql as S
from veristrata.sources.tables import read

_UNITS = [
    ("u1", "p1", "reported_observation", "One rose."),
    ("u2", "p1", "definition", "A rate is defined as a share."),
    ("u3", "p1", "reported_observation,forecast", "It will rise."),
    ("u4", "p2", "unknown", "Perhaps."),
    ("u5", "p2", "speech_reprint,reported_observation", "We said so."),
    ("u6", "p2", "reported_observation,definition", "A count is a number and was 4."),
    ("u7", "p2", "caption", "Photo: A."),
    ("u8", "p3", "attributed_opinion,unknown", "They believe it."),
]
_ROWS = [  # assertion, source, origin, relation, dated elsewhere, qualified, published, independent
    ("a1", "s1", "assertion", "states", False, False, "2020-01-02", "one.org"),
    ("a1", "s2", "assertion", "states", False, True, "", "two.org"),
    ("a2", "s1", "assertion", "states", False, False, "2020-01-02", "one.org"),
    ("a2", "s3", "assertion", "states_negation", False, False, "2020-01-03", "three.org"),
    ("a3", "s4", "assertion", "states", False, False, "2020-01-04", "four.org"),
    ("a3", "s4", "assertion", "states_negation", False, False, "2020-01-04", "four.org"),
    ("a4", "s5", "context", "states", False, False, "2020-01-05", "five.org"),
    ("a5", "s6", "assertion", "states_negation", True, False, "2020-01-06", "six.org"),
    ("a6", "s7", "assertion", "states_negation", False, False, "", "seven.org"),
    ("a7", "s8", "assertion", "states_negation", False, False, "2020-01-07", "eight.org"),
    ("a8", "s9", "assertion", "bears_on", False, False, "2020-01-08", "nine.org"),
    ("a9", "s1", "assertion", "states", False, True, "2020-01-09", "one.org"),
]
_SOURCES = [
    ("s1", None, "https://www.one.org/a"),
    ("s2", "s1", "https://two.org/b"),
    ("s3", "s2", "https://three.org/c"),
    ("s4", "s5", "https://four.org/d"),
    ("s5", "s4", "https://five.org/e"),
    ("s6", "missing", ""),
    ("s7", "s7", "https://seven.org"),
]
_JUDGED = [("a1", "u1"), ("a1", "u4"), ("a2", "u1"), ("a2", "u1"), ("zz", "u6"), ("a3", "u6")]


def _values(rows: list[tuple]) -> str:
    def one(v):
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def _units(spark):
    return spark.createDataFrame(_UNITS, "unit_id string, passage_id string, roles string, text string").withColumn("roles", F.split("roles", ","))


def _rows(spark, d):
    """The fixture's rows for each item; an item keeps some assertions by its id, so claims differ."""
    fixture = spark.createDataFrame(_ROWS, "assertion_id string, source_id string, origin string, relation string, dated_elsewhere boolean, qualified boolean, published_at string, independent string")
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("claim_id"))
    number = F.substring("assertion_id", 2, 2).cast("int")
    return items.crossJoin(F.broadcast(fixture)).where(F.col("claim_id") % (number + 1) == 0)


def gate(spark, d):
    return J.gate(_units(spark)).select("unit_id", "withheld", F.array_join("definitions", ",").alias("definitions"))


def withheld_counts(spark, d):
    return J.withheld_counts(J.gate(_units(spark)))


def integrity(spark, d):
    judged = spark.createDataFrame(_JUDGED, "assertion_id string, unit_id string")
    known = spark.createDataFrame([("a1",), ("a2",), ("a3",)], "assertion_id string")
    return J.integrity(judged, J.gate(_units(spark)), known)


def _demoted(spark, d):
    rows = _rows(spark, d).withColumn("assertion", F.col("assertion_id")).withColumn("assertion_id", F.concat_ws(":", "claim_id", "assertion_id"))
    return J.demote(rows)


def demotions(spark, d):
    return _demoted(spark, d).select("claim_id", "assertion", "source_id", "relation", "not_counted")


def assertion_status(spark, d):
    out = J.assertion_status(_demoted(spark, d).withColumn("assertion_id", F.col("assertion")))
    return out


def claim_summary(spark, d):
    return J.claim_summary(assertion_status(spark, d))


def lineage_roots(spark, d):
    return J.lineage_roots(spark.createDataFrame(_SOURCES, "source_id string, parent_id string, url string"), 4)


def independent_sources(spark, d):
    return J.independent_sources(spark.createDataFrame(_SOURCES, "source_id string, parent_id string, url string"), 4)


def temporal_scope(spark, d):
    published = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = read(spark, d, "orders").select(P.temporal_scope(published, F.lit("1996-06-30")).alias("scope"))
    return rows.groupBy("scope").agg(F.count("*").alias("n"))


def display_text(spark, d):
    made = F.concat(F.lit("See ["), "source", F.lit("](https://example.org/"), F.col("doc_id").cast("string"), F.lit(") or https://x.org/y now"))
    return read(spark, d, "documents").select("doc_id", P.display_text(made).alias("shown"))


def confirmed_support(spark, d):
    rows = read(spark, d, "embeddings").select(F.concat(F.lit("a"), F.col("vec_id").cast("string")).alias("assertion_id"), F.lit("u").alias("unit_id"), F.when(F.col("label") < 5, "states").otherwise("bears_on").alias("relation"), (F.pmod("vec_id", F.lit(5)) == 0).alias("counted"), (F.pmod("vec_id", F.lit(100)) / 100).alias("confidence"))
    second = rows.select("assertion_id", "unit_id", F.when(F.col("confidence") > 0.7, 0.97).otherwise(0.5).alias("score"))
    return J.confirm_support(rows, second).groupBy("relation", "counted").agg(F.count("*").alias("n"))


QUERIES = {
    "h14_gate": gate,
    "d13_withheld_counts": withheld_counts,
    "c11_integrity": integrity,
    "m07_demotions": demotions,
    "m08_assertion_status": assertion_status,
    "m10_claim_summary": claim_summary,
    "c12_lineage_roots": lineage_roots,
    "c13_independent_sources": independent_sources,
    "b28_temporal_scope": temporal_scope,
    "g07_display_text": display_text,
    "m04_confirmed_support": confirmed_support,
}

_U = f"u AS (SELECT unit_id, passage_id, string_split(roles, ',') AS roles, text FROM (VALUES {_values(_UNITS)}) t(unit_id, passage_id, roles, text))"
_CASES = " ".join(f"WHEN list_contains(roles, '{r}') THEN {S.quoted([t])}" for r, t in J.REASONS.items())
_G = _U + f", g AS (SELECT *, CASE {_CASES} WHEN NOT list_contains(roles, 'reported_observation') THEN '{J.DEFINITION_ONLY}' END AS withheld FROM u)"
_R = f"""f AS (SELECT * FROM (VALUES {_values(_ROWS)}) t(assertion, source_id, origin, relation, dated, qualified, published_at, independent)),
r0 AS (SELECT item_id AS claim_id, f.* FROM benchmark, f WHERE item_id % (CAST(substr(assertion, 2, 2) AS INT) + 1) = 0),
r1 AS (SELECT *, CASE WHEN relation IN ('states', 'states_negation') AND origin = 'context' THEN 'context' WHEN relation IN ('states', 'states_negation') AND dated THEN 'different_period' END AS nc FROM r0),
r2 AS (SELECT * EXCLUDE (relation), CASE WHEN nc IS NOT NULL THEN 'bears_on' ELSE relation END AS relation FROM r1),
r3 AS (SELECT *, relation IN ('states', 'states_negation') AND count(DISTINCT relation) FILTER (relation IN ('states', 'states_negation')) OVER (PARTITION BY claim_id, assertion, source_id) = 2 AS both_ FROM r2),
rows_ AS (SELECT * EXCLUDE (relation, nc), CASE WHEN both_ THEN 'bears_on' ELSE relation END AS relation, CASE WHEN both_ THEN 'self_conflict' ELSE nc END AS not_counted FROM r3)"""
_STATUS = _R + f""", g AS (SELECT claim_id, assertion, count(DISTINCT independent) FILTER (relation = 'states') AS sf, count(DISTINCT independent) FILTER (relation = 'states_negation') AS sa,
 coalesce(bool_and(qualified) FILTER (relation IN ('states', 'states_negation')), FALSE) AS narrow, coalesce(bool_or(NOT qualified AND published_at <> '') FILTER (relation IN ('states', 'states_negation')), FALSE) AS dated_ FROM rows_ GROUP BY 1, 2),
l AS (SELECT *, CASE WHEN (sf > 0) = (sa > 0) THEN '' WHEN narrow THEN {S.quoted([J.LIMITS[1]])} WHEN NOT dated_ THEN {S.quoted([J.LIMITS[2]])} ELSE '' END AS limits FROM g),
st AS (SELECT claim_id, assertion AS assertion_id, CASE WHEN sf > 0 AND sa > 0 THEN 'contested' WHEN sf > 0 THEN CASE WHEN limits = '' THEN 'supported' ELSE 'qualified_support' END WHEN sa > 0 THEN CASE WHEN limits = '' THEN 'contradicted' ELSE 'qualified_contradiction' END ELSE 'insufficient' END AS status, limits, sf AS sources_for, sa AS sources_against FROM l)"""
_SRC = f"""src AS (SELECT * FROM (VALUES {_values(_SOURCES)}) t(source_id, parent_id, url)),
ch AS (SELECT source_id, source_id AS root, [source_id] AS seen FROM src UNION ALL
       SELECT ch.source_id, p.source_id, list_append(seen, p.source_id) FROM ch JOIN src c ON c.source_id = ch.root JOIN src p ON p.source_id = c.parent_id WHERE NOT list_contains(seen, p.source_id)),
last AS (SELECT source_id, arg_max(root, len(seen)) AS tail, arg_max(seen, len(seen)) AS seen FROM ch GROUP BY source_id),
roots AS (SELECT l.source_id, CASE WHEN p.source_id IS NOT NULL THEN p.source_id ELSE tail END AS root FROM last l JOIN src t ON t.source_id = l.tail LEFT JOIN src p ON p.source_id = t.parent_id)"""

ORACLES = {
    "h14_gate": f"""WITH {_G}, d AS (SELECT * FROM g WHERE list_contains(roles, 'definition') AND NOT list_has_any(roles, [{S.quoted(list(J.REASONS)[:-1])}]))
SELECT unit_id, withheld, CASE WHEN withheld IS NULL THEN coalesce((SELECT string_agg(d.unit_id, ',' ORDER BY d.unit_id) FROM d WHERE d.passage_id = g.passage_id AND d.unit_id <> g.unit_id), '') END AS definitions FROM g""",
    "d13_withheld_counts": f"WITH {_G} SELECT withheld, count(*) AS n FROM g WHERE withheld IS NOT NULL GROUP BY 1",
    "c11_integrity": f"""WITH {_G}, j AS (SELECT a, u, count(*) AS n FROM (VALUES {_values(_JUDGED)}) t(a, u) GROUP BY 1, 2)
SELECT * FROM (SELECT a AS assertion_id, u AS unit_id, CASE WHEN u NOT IN (SELECT unit_id FROM g WHERE withheld IS NULL) THEN 'withheld_unit' WHEN a NOT IN ('a1', 'a2', 'a3') THEN 'unknown_assertion' WHEN n > 1 THEN 'repeated' END AS problem FROM j) WHERE problem IS NOT NULL""",
    "m07_demotions": f"WITH {_R} SELECT claim_id, assertion, source_id, relation, not_counted FROM rows_",
    "m08_assertion_status": f"WITH {_STATUS} SELECT * FROM st",
    "m10_claim_summary": f"""WITH {_STATUS}, s AS (SELECT claim_id, bool_and(status = 'supported') AS af, bool_and(status = 'contradicted') AS aa, bool_and(status = 'insufficient') AS none_, bool_or(status = 'contested') AS con,
 bool_or(status IN ('supported', 'qualified_support')) AS f_, bool_or(status IN ('contradicted', 'qualified_contradiction')) AS a_, bool_or(status IN ('supported', 'contradicted')) AS firm FROM st GROUP BY 1)
SELECT claim_id, CASE WHEN af THEN 'supported' WHEN aa THEN 'contradicted' WHEN none_ THEN 'insufficient' WHEN con AND NOT (f_ OR a_) THEN 'insufficient' ELSE 'qualified' END AS relationship,
 CASE WHEN af OR aa THEN 'established' WHEN none_ THEN 'unresolved' WHEN con OR (f_ AND a_) THEN 'contested' WHEN firm THEN CASE WHEN a_ THEN 'partially_contradicted' ELSE 'partially_established' END WHEN a_ THEN 'qualified_contradiction' ELSE 'qualified_support' END AS summary FROM s""",
    "c12_lineage_roots": f"WITH RECURSIVE {_SRC} SELECT source_id, root FROM roots",
    "c13_independent_sources": f"""WITH RECURSIVE {_SRC} SELECT r.source_id, CASE WHEN h <> '' THEN h ELSE root END AS independent
FROM roots r JOIN (SELECT source_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)), '^www\\.', '') AS h FROM src) s ON s.source_id = r.root""",
    "b28_temporal_scope": """SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'date_unconfirmed' WHEN strftime(o_orderdate, '%Y-%m-%d') > '1996-06-30' THEN 'later_publication' ELSE 'published_by_cutoff' END AS scope, count(*) AS n FROM orders GROUP BY 1""",
    "g07_display_text": "SELECT doc_id, 'See ' || source || ' or  now' AS shown FROM documents",
    "m04_confirmed_support": """WITH r AS (SELECT CASE WHEN label < 5 THEN 'states' ELSE 'bears_on' END AS relation, vec_id % 5 = 0 AS counted, (vec_id % 100) / 100 AS c FROM embeddings)
SELECT relation, counted OR (relation = 'states' AND NOT counted AND c >= 0.5 AND c > 0.7) AS counted, count(*) AS n FROM r GROUP BY 1, 2""",
}
