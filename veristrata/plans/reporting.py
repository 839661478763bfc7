"""Queries: relations from logits, reviews, display, coverage, direction and policy reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from veristrata.functions import text as T
from veristrata.operators import judgments as J
from veristrata.operators import metrics as M
from veristrata.plans import sql as S
from veristrata.plans.evaluation import _scored
from veristrata.plans.lexical import _gold_groups, _ranked
from veristrata.sources.tables import predictions, read


def _pairs(spark, d):
    """Four classes of a model's output as relations; the label's rest by four is the gold relation."""
    rows = M.score(predictions(read(spark, d, "embeddings"), 4)).withColumn("inverted", F.col("label") >= 8)
    gold = F.element_at(F.array(*map(F.lit, J.RELATIONS)), (F.col("label") % 4 + 1).cast("int"))
    return J.read_pairs(rows, 0.4).select(F.col("id").alias("pair_id"), gold.alias("gold"), "relation", "counted", "confidence", F.when(F.col("label") < 3, "context").otherwise("assertion").alias("origin"), (F.col("label")).alias("assertion_id"))


def pair_relations(spark, d):
    return _pairs(spark, d).select("pair_id", "relation", "counted")


def pair_report(spark, d):
    return J.pair_report(_pairs(spark, d))


def context_review(spark, d):
    rows = _pairs(spark, d)
    second = rows.select("pair_id", F.when(F.col("confidence") < 0.5, "unrelated").otherwise("bears_on").alias("relation"), (F.col("confidence") > 0.8).alias("over_limit"))
    return J.review_context(rows, second).groupBy("origin", "kept").agg(F.count("*").alias("n"))


def display_order(spark, d):
    return J.display_order(_pairs(spark, d), "assertion_id").select("assertion_id", "pair_id", "place")


def shown(spark, d):
    return J.shown(_pairs(spark, d).where("relation = 'bears_on'"), "assertion_id")


def ungrounded(spark, d):
    made = F.concat(F.lit("In "), (F.col("doc_id") + 1000).cast("string"), F.lit(" it rose 4.5% to $1,200."))
    grounds = F.array(F.concat(F.lit("rose 4.5% in "), (F.col("doc_id") * 2 + 1000).cast("string")))
    return read(spark, d, "documents").select("doc_id", F.array_join(J.ungrounded_figures(made, grounds), "|").alias("figures"))


def run_coverage(spark, d):
    rows = read(spark, d, "conversations").select(F.when(T.check_worthy(F.col("text")) != "check_worthy", "filtered").when(F.length("text") > 120, "answered").otherwise("declined_low_confidence").alias("outcome"))
    return J.run_coverage(rows)


def directions(spark, d):
    labels = read(spark, d, "labels")
    truth = labels.select(F.col("doc_id").alias("claim_id"), F.when(F.col("toxic") == 0, F.col("quality") == 1).alias("true"))
    readings = labels.join(read(spark, d, "documents"), "doc_id").select(F.col("doc_id").alias("claim_id"), F.when(F.col("n_chars") > 1500, "for").when(F.col("n_chars") > 600, "none").otherwise("against").alias("direction"))
    return J.direction_report(readings, truth)


def policies(spark, d):
    rows = _scored(spark, d).withColumn("s", F.pmod("id", F.lit(100)) / 100)
    return J.policy_report(rows, {"all": "true", "bands": "confidence >= 0.15", "bands_and_sufficiency": "confidence >= 0.15 and s >= 0.5"})


def page_recall(spark, d):
    pages = _ranked(spark, d, 25).select("qid", F.col("doc_id").alias("page"), "rank")
    return J.page_recall(pages, _gold_groups(spark, d).select("qid", "grp", F.col("doc_id").alias("page")), [1, 5, 10, 25])


def paired_bootstrap(spark, d):
    rows = J.paired_difference(_scored(spark, d).withColumn("other", F.element_at("p", F.col("label") + 1) >= 0.1), "correct", "other")
    return M.bootstrap(rows, "difference", 200, 3)


def parity(spark, d):
    a = _scored(spark, d).select("id", "confidence")
    b = a.withColumn("confidence", F.when(F.col("confidence") > 0.3, F.col("confidence") + 1e-6).otherwise(F.col("confidence")))
    return J.parity(a, b, "id", "confidence").select("id")


QUERIES = {
    "m02_pair_relations": pair_relations,
    "l20_pair_report": pair_report,
    "m05_context_review": context_review,
    "e13_display_order": display_order,
    "e15_shown": shown,
    "g28_ungrounded_figures": ungrounded,
    "m14_run_coverage": run_coverage,
    "d19_directions": directions,
    "l26_policies": policies,
    "l05_page_recall": page_recall,
    "l17_paired_bootstrap": paired_bootstrap,
    "l31_parity": parity,
}

_P = """
lg AS (SELECT vec_id AS id, CAST(label AS INT) AS label, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE) * 10) AS lg FROM embeddings),
ex AS (SELECT id, label, lg, list_transform(lg, lambda x: exp(x - list_max(lg))) AS e FROM lg),
sc AS (SELECT id, label, round(list_max(e) / list_sum(e), 9) AS confidence, list_position(lg, list_max(lg)) - 1 AS predicted FROM ex),
rl AS (SELECT *, ['states', 'states_negation', 'bears_on', 'unrelated'][predicted + 1] AS r0, ['states', 'states_negation', 'bears_on', 'unrelated'][label % 4 + 1] AS gold FROM sc),
tr AS (SELECT *, CASE WHEN label >= 8 AND r0 = 'states' THEN 'states_negation' WHEN label >= 8 AND r0 = 'states_negation' THEN 'states' ELSE r0 END AS r1 FROM rl),
pairs AS (SELECT id AS pair_id, gold, confidence, label AS assertion_id, CASE WHEN label < 3 THEN 'context' ELSE 'assertion' END AS origin, CASE WHEN r1 IN ('states', 'states_negation') AND confidence < 0.4 THEN 'bears_on' ELSE r1 END AS relation FROM tr)"""


def _worthy() -> str:
    from veristrata.plans.lexical import _worthy as rule

    return rule("trim(text)")


ORACLES = {
    "m02_pair_relations": f"WITH {_P} SELECT pair_id, relation, relation IN ('states', 'states_negation') AS counted FROM pairs",
    "l20_pair_report": f"""WITH {_P}, s AS (SELECT count(*) FILTER (relation IN ('states', 'states_negation')) AS counted, count(*) FILTER (relation IN ('states', 'states_negation') AND gold <> relation) AS wrong,
 count(*) FILTER (gold IN ('states', 'states_negation')) AS wanted, count(*) FILTER (gold IN ('states', 'states_negation') AND gold = relation) AS found FROM pairs)
SELECT *, round(wrong / greatest(counted, 1), 6) AS counting_error, round(found / greatest(wanted, 1), 6) AS counted_recall FROM s""",
    "m05_context_review": f"WITH {_P} SELECT origin, NOT (origin = 'context' AND confidence <= 0.8 AND confidence < 0.5) AS kept, count(*) AS n FROM pairs GROUP BY 1, 2",
    "e13_display_order": f"WITH {_P} SELECT assertion_id, pair_id, row_number() OVER (PARTITION BY assertion_id ORDER BY origin <> 'assertion', confidence DESC, pair_id) AS place FROM pairs",
    "e15_shown": f"WITH {_P} SELECT assertion_id, least(count(*), 6) AS shown, greatest(count(*) - 6, 0) AS more FROM pairs WHERE relation = 'bears_on' GROUP BY 1",
    "g28_ungrounded_figures": "SELECT doc_id, CASE WHEN contains('rose 4.5% in ' || (doc_id * 2 + 1000), CAST(doc_id + 1000 AS VARCHAR)) THEN '$1,200' ELSE (doc_id + 1000) || '|$1,200' END AS figures FROM documents",
    "m14_run_coverage": f"""WITH r AS (SELECT CASE WHEN {_worthy()} <> 'check_worthy' THEN 'filtered' WHEN length(text) > 120 THEN 'answered' ELSE 'declined' END AS o FROM conversations),
c AS (SELECT count(*) AS sentences, count(*) FILTER (o = 'filtered') AS filtered, count(*) FILTER (o = 'answered') AS answered, count(*) FILTER (o = 'declined') AS declined FROM r)
SELECT *, CASE WHEN answered + declined > 0 THEN round(answered / (answered + declined), 6) END AS coverage FROM c""",
    "d19_directions": """WITH r AS (SELECT CASE WHEN toxic = 0 THEN quality = 1 END AS t, CASE WHEN n_chars > 1500 THEN 'for' WHEN n_chars > 600 THEN 'none' ELSE 'against' END AS d FROM labels JOIN documents USING (doc_id))
SELECT count(*) FILTER (d <> 'none' AND t IS NOT NULL) AS directional, count(*) FILTER (d <> 'none' AND t IS NOT NULL AND (d = 'for') = t) AS "right", count(*) FILTER (d <> 'none' AND t IS NOT NULL AND (d = 'for') <> t) AS wrong, count(*) FILTER (t IS NULL) AS unscored FROM r""",
    "l26_policies": f"""WITH {S.SCORED}, r AS (SELECT correct, confidence >= 0.15 AS b, (id % 100) / 100 >= 0.5 AS s FROM scored),
f AS (SELECT 'all' AS policy, TRUE AS a, correct FROM r UNION ALL SELECT 'bands', b, correct FROM r UNION ALL SELECT 'bands_and_sufficiency', b AND s, correct FROM r)
SELECT policy, round(avg(CASE WHEN a THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(CASE WHEN a THEN CASE WHEN correct THEN 1.0 ELSE 0.0 END END), 6) AS accuracy, count(*) FILTER (NOT a) AS declined FROM f GROUP BY 1""",
    "l05_page_recall": f"""WITH {S.BM25}, {S.GOLD}, m AS (SELECT g.qid, min(rank) AS first FROM gold g LEFT JOIN (SELECT * FROM ranked WHERE rank <= 25) r ON r.qid = g.qid AND r.doc_id = g.doc_id GROUP BY 1),
ns AS (SELECT CAST(unnest([1, 5, 10, 25]) AS INT) AS n) SELECT n, round(avg(CASE WHEN first <= n THEN 1.0 ELSE 0.0 END), 6) AS doc_recall FROM ns, m GROUP BY n""",
    "l17_paired_bootstrap": f"""WITH {S.SCORED}, nb AS (SELECT row_number() OVER (ORDER BY id) - 1 AS i, CASE WHEN correct THEN 1.0 ELSE 0.0 END - CASE WHEN p[label + 1] >= 0.1 THEN 1.0 ELSE 0.0 END AS v FROM scored), n AS (SELECT count(*) AS n FROM nb),
dr AS (SELECT r, CAST('0x' || substr(sha1('3:' || r || ':' || i), 1, 8) AS BIGINT) % n AS i FROM nb, n, (SELECT unnest(range(0, 200)) AS r)),
m AS (SELECT r, avg(v) AS m FROM dr JOIN nb USING (i) GROUP BY r) SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.5), 6) AS middle, round(quantile_cont(m, 0.975), 6) AS high FROM m""",
    "l31_parity": f"WITH {S.SCORED} SELECT id FROM scored WHERE confidence > 0.3",
}
