"""Queries: classification, calibration, selective prediction, bands, audits and tests on model outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from veristrata.operators import calibration as C
from veristrata.operators import metrics as M
from veristrata.plans import sql as S
from veristrata.sources.tables import predictions, read

CLASSES = 10
CUTS = [i / 20 for i in range(1, 20)]
TEMPERATURES = [0.25, 0.5, 1.0, 2.0, 4.0, 8.0]


def _predictions(spark, d):
    return predictions(read(spark, d, "embeddings"), CLASSES)


def _scored(spark, d):
    return M.score(_predictions(spark, d))


def _quality(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source", F.col("n_chars").alias("score"))
    return docs.join(read(spark, d, "labels"), "doc_id").withColumn("positive", F.col("quality") == 1).withColumn("wrong", F.col("quality") == 0)


def softmax_features(spark, d):
    return M.verdict_features(_scored(spark, d))


def confusion(spark, d):
    return M.confusion(_scored(spark, d), CLASSES)


def class_metrics(spark, d):
    return M.class_metrics(_scored(spark, d), CLASSES)


def macro_f1(spark, d):
    return class_metrics(spark, d).agg(M.r6(F.avg("f1")).alias("macro_f1"), F.sum("support").alias("rows"))


def _rounded_bins(bins):
    return bins.select("bin", "n", M.r6("confidence").alias("confidence"), M.r6("accuracy").alias("accuracy"))


def reliability(spark, d):
    return _rounded_bins(M.reliability(_scored(spark, d)))


def reliability_by_mass(spark, d):
    return _rounded_bins(M.reliability_by_mass(_scored(spark, d)))


def calibration_summary(spark, d):
    return M.calibration_summary(_scored(spark, d))


def risk_coverage(spark, d):
    return M.risk_coverage(_scored(spark, d)).select("confidence", "answered", M.r6("coverage").alias("coverage"), M.r6("risk").alias("risk"))


def aurc_summary(spark, d):
    return M.aurc_summary(_scored(spark, d))


def operating_points(spark, d):
    return M.operating_points(_scored(spark, d))


def roc_auc(spark, d):
    return M.roc_auc(_quality(spark, d), "score", "positive")


def subgroup_audit(spark, d):
    return M.subgroup_audit(_quality(spark, d), "source", "wrong", 10)


def disjoint_groups(spark, d):
    return M.disjoint_groups(M.subgroup_audit(_quality(spark, d), "source", "wrong", 10))


def threshold_sweep(spark, d):
    return M.threshold_sweep(_scored(spark, d), CUTS, "confidence", "correct").select("cut", "tp", "fp", "fn", "f1", "chosen")


def temperature_grid(spark, d):
    return C.nll_at(_predictions(spark, d), TEMPERATURES).select("temperature", M.r6("nll").alias("nll"))


def bands(spark, d):
    return C.fit_bands(_scored(spark, d), {"strong": 0.16, "moderate": 0.12, "weak": 0.08})


def _decided(spark, d):
    scored = C.assign_band(_scored(spark, d), bands(spark, d))
    return C.decide(scored.withColumn("sufficiency", F.pmod("id", F.lit(100)) / 100))


def policy(spark, d):
    answered = F.col("outcome") == "answered"
    return _decided(spark, d).groupBy("outcome").agg(F.count("*").alias("n"), M.r6(F.avg(F.col("correct").cast("double"))).alias("accuracy"), F.count_if(answered & F.col("verdict").isNotNull()).alias("with_verdict"))


def abstention_cube(spark, d):
    rows = _decided(spark, d).select((F.col("predicted") % 2 == 0).alias("even"), (F.col("outcome") != "answered").alias("declined"))
    return rows.cube("even", "declined").agg(F.count("*").alias("n"))


def band_histogram(spark, d):
    return C.assign_band(_scored(spark, d), bands(spark, d)).groupBy("band").agg(F.count("*").alias("n"))


def mcnemar(spark, d):
    other = F.element_at("p", F.col("label") + 1) >= 0.05
    return M.mcnemar(_scored(spark, d).withColumn("other", other), "correct", "other")


def bootstrap(spark, d):
    return M.bootstrap(_scored(spark, d), "correct", 200, 7)


def correlation(spark, d):
    return _scored(spark, d).agg(M.r6(F.corr("confidence", F.pmod("id", F.lit(100)) / 100)).alias("r"))


def counting_error(spark, d):
    """Of predictions of two classes at or over each cut, how many are wrong."""
    grid = spark.createDataFrame([(c,) for c in (0.0, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6)], "cut double")
    rows = _scored(spark, d).where("predicted < 2").groupBy("confidence").agg(F.count("*").alias("n"), F.count_if(~F.col("correct")).alias("wrong"))
    return grid.join(rows, F.col("confidence") >= F.col("cut"), "left").groupBy("cut").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("counted"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("wrong"))


def isotonic(spark, d):
    return C.isotonic_knots(_scored(spark, d), "predicted", "confidence", "correct")


QUERIES = {
    "g33_softmax_features": softmax_features,
    "d10_confusion": confusion,
    "l19_class_metrics": class_metrics,
    "l19_macro_f1": macro_f1,
    "l08_reliability": reliability,
    "l09_reliability_by_mass": reliability_by_mass,
    "l11_calibration_summary": calibration_summary,
    "l12_risk_coverage": risk_coverage,
    "l12_aurc_summary": aurc_summary,
    "l15_operating_points": operating_points,
    "l13_roc_auc": roc_auc,
    "d16_subgroup_audit": subgroup_audit,
    "d16_disjoint_groups": disjoint_groups,
    "k11_threshold_sweep": threshold_sweep,
    "k01_temperature_grid": temperature_grid,
    "k08_bands": bands,
    "k09_band_histogram": band_histogram,
    "m01_policy": policy,
    "l27_abstention_cube": abstention_cube,
    "l18_mcnemar": mcnemar,
    "l16_bootstrap": bootstrap,
    "d20_correlation": correlation,
    "l21_counting_error": counting_error,
    "k03_isotonic": isotonic,
}

_W = f"WITH {S.SCORED}"
_BINS = "every AS (SELECT CAST(unnest(range(0, 15)) AS INT) AS bin), b AS (SELECT bin, count(*) AS n, avg(confidence) AS c, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS a FROM x GROUP BY bin), bins AS (SELECT bin, coalesce(n, 0) AS n, coalesce(c, 0.0) AS c, coalesce(a, 0.0) AS a FROM every LEFT JOIN b USING (bin))"
_WIDE = "x AS (SELECT *, CAST(greatest(ceil(confidence * 15) - 1, 0) AS INT) AS bin FROM scored), " + _BINS
_MASS = "x AS (SELECT *, CAST(ntile(15) OVER (ORDER BY confidence, id) - 1 AS INT) AS bin FROM scored), " + _BINS
_CURVE = "runs AS (SELECT confidence, count(*) AS n, count(*) FILTER (NOT correct) AS wrong FROM scored GROUP BY 1), curve AS (SELECT confidence, CAST(sum(n) OVER w AS BIGINT) AS answered, sum(n) OVER w / (SELECT count(*) FROM scored) AS coverage, sum(wrong) OVER w / sum(n) OVER w AS risk FROM runs WINDOW w AS (ORDER BY confidence DESC))"
_CONF = f"cls AS (SELECT CAST(unnest(range(0, 10)) AS INT) AS c), cells AS (SELECT g.c AS gold, p.c AS predicted, count(id) AS n FROM cls g CROSS JOIN cls p LEFT JOIN scored s ON s.label = g.c AND s.predicted = p.c GROUP BY 1, 2)"
_CLASS = _CONF + ", a AS (SELECT gold AS class, CAST(sum(n) AS BIGINT) AS support, sum(CASE WHEN gold = predicted THEN n ELSE 0 END) AS hits FROM cells GROUP BY 1), r AS (SELECT predicted AS class, sum(n) AS read FROM cells GROUP BY 1), m AS (SELECT class, support, CASE WHEN read > 0 THEN hits / read ELSE 0 END AS p, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS rc FROM a JOIN r USING (class)), cm AS (SELECT class, support, round(p, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END, 6) AS f1 FROM m)"


def _band(place: int, name: str, target: float, before: str) -> str:
    return f"""s{place} AS (SELECT coalesce(max(n), 0) AS n0, coalesce(max(hits), 0) AS h0 FROM ({before})),
e{place} AS (SELECT '{name}' AS band, confidence AS threshold, n, hits, n0, h0 FROM cum, s{place} WHERE n - n0 >= 30 AND (hits - h0) / (n - n0) >= {target} ORDER BY confidence LIMIT 1)"""


_BANDS = (
    "cum AS (SELECT confidence, sum(n) OVER (ORDER BY confidence DESC) AS n, sum(h) OVER (ORDER BY confidence DESC) AS hits FROM (SELECT confidence, count(*) AS n, count(*) FILTER (correct) AS h FROM scored GROUP BY 1)), "
    + _band(1, "strong", 0.16, "SELECT 0 AS n, 0 AS hits")
    + ", "
    + _band(2, "moderate", 0.12, "SELECT n, hits FROM e1")
    + ", "
    + _band(3, "weak", 0.08, "SELECT n, hits FROM e1 UNION ALL SELECT n, hits FROM e2")
    + ", bands AS (SELECT band, threshold, round((hits - h0) / (n - n0), 6) AS within, round(hits / n, 6) AS cumulative, CAST(n - n0 AS BIGINT) AS support FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3))"
)
_DECIDED = _BANDS + """, dec AS (SELECT s.*, (SELECT band FROM bands WHERE threshold <= s.confidence ORDER BY threshold DESC, band DESC LIMIT 1) AS band, (id % 100) / 100 >= 0.5 AS grounded FROM scored s),
o AS (SELECT *, CASE WHEN band IS NOT NULL AND grounded THEN 'answered' WHEN band IS NULL AND NOT grounded THEN 'declined_both' WHEN band IS NULL THEN 'declined_low_confidence' ELSE 'declined_insufficient_evidence' END AS outcome FROM dec)"""
_Q = "q AS (SELECT doc_id, source, n_chars AS score, quality FROM documents JOIN labels USING (doc_id))"
_AUDIT = _Q + f""", g AS (SELECT source AS grp, count(*) AS n, count(*) FILTER (quality = 0) AS errors FROM q GROUP BY 1),
z AS (SELECT *, errors / n AS s, {M.Z} AS z FROM g),
audit AS (SELECT grp, n, errors, s, (s + z*z/(2*n)) / (1 + z*z/n) AS mid, z * sqrt(s*(1-s)/n + z*z/(4*n*n)) / (1 + z*z/n) AS half FROM z),
au AS (SELECT grp, n, errors, round(s, 6) AS error, round(greatest(0.0, mid - half), 6) AS low, round(least(1.0, mid + half), 6) AS high, n >= 10 AS comparable FROM audit)"""

ORACLES = {
    "g33_softmax_features": _W + " SELECT id, round(list_reverse_sort(p)[1], 6) AS max_prob, round(list_reverse_sort(p)[1] - list_reverse_sort(p)[2], 6) AS prob_margin, round(-list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)), 6) AS entropy FROM scored",
    "d10_confusion": f"{_W}, {_CONF} SELECT gold, predicted, n FROM cells",
    "l19_class_metrics": f"{_W}, {_CLASS} SELECT * FROM cm",
    "l19_macro_f1": f"{_W}, {_CLASS} SELECT round(avg(f1), 6) AS macro_f1, CAST(sum(support) AS BIGINT) AS rows FROM cm",
    "l08_reliability": f"{_W}, {_WIDE} SELECT bin, n, round(c, 6) AS confidence, round(a, 6) AS accuracy FROM bins",
    "l09_reliability_by_mass": f"{_W}, {_MASS} SELECT bin, n, round(c, 6) AS confidence, round(a, 6) AS accuracy FROM bins",
    "l11_calibration_summary": f"""{_W}, wide AS (WITH {_WIDE} SELECT sum(n * abs(c - a)) / sum(n) AS ece, max(CASE WHEN n > 0 THEN abs(c - a) END) AS mce FROM bins), mass AS (WITH {_MASS} SELECT sum(n * abs(c - a)) / sum(n) AS adaptive_ece FROM bins),
r AS (SELECT avg(list_sum(list_transform(list_zip(p, range(0, 10)), lambda z: (z[1] - CASE WHEN z[2] = label THEN 1.0 ELSE 0.0 END) ** 2))) AS brier, avg(-ln(greatest(p[label + 1], 1e-12))) AS nll, avg(confidence) - avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS over FROM scored)
SELECT round(ece, 6) AS ece, round(adaptive_ece, 6) AS adaptive_ece, round(mce, 6) AS mce, round(brier, 6) AS brier, round(nll, 6) AS nll, round(over, 6) AS overconfidence FROM wide, mass, r""",
    "l12_risk_coverage": f"{_W}, {_CURVE} SELECT confidence, answered, round(coverage, 6) AS coverage, round(risk, 6) AS risk FROM curve",
    "l12_aurc_summary": f"""{_W}, {_CURVE}, a AS (SELECT sum(risk * (coverage - prev)) AS aurc FROM (SELECT risk, coverage, coalesce(lag(coverage) OVER (ORDER BY answered), 0) AS prev FROM curve)),
c AS (SELECT count(*) AS n, count(*) FILTER (correct) AS hits FROM scored), o AS (SELECT avg(greatest(0, k - hits) / k) AS opt FROM (SELECT hits, unnest(range(1, n + 1)) AS k FROM c))
SELECT round(aurc, 6) AS aurc, round(opt, 6) AS optimal_aurc, round(aurc - opt, 6) AS excess_aurc FROM a, o""",
    "l15_operating_points": f"""{_W}, {_CURVE}, r AS (SELECT CAST(unnest([0.05, 0.1, 0.15, 0.2]) AS DOUBLE) AS target), v AS (SELECT CAST(unnest([0.5, 0.7, 0.9]) AS DOUBLE) AS target)
SELECT 'coverage_at_risk' AS kind, target, round(max(coverage), 6) AS value FROM r LEFT JOIN curve ON risk <= target GROUP BY target
UNION ALL SELECT 'risk_at_coverage', target, round(min_by(risk, coverage), 6) FROM v LEFT JOIN curve ON coverage >= target GROUP BY target""",
    "l13_roc_auc": f"""WITH {_Q}, r AS (SELECT quality = 1 AS pos, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM q),
s AS (SELECT count(*) FILTER (pos) AS hits, count(*) FILTER (NOT pos) AS misses, sum(rk) FILTER (pos) AS ranks FROM r) SELECT hits, misses, round((ranks - hits * (hits + 1) / 2) / (hits * misses), 6) AS auc FROM s""",
    "d16_subgroup_audit": f"WITH {_AUDIT} SELECT * FROM au",
    "d16_disjoint_groups": f"WITH {_AUDIT} SELECT a.grp AS higher, b.grp AS lower FROM au a JOIN au b ON a.low > b.high WHERE a.comparable AND b.comparable",
    "k11_threshold_sweep": f"""{_W}, g AS (SELECT CAST(unnest(range(1, 20)) AS DOUBLE) / 20 AS cut),
f AS (SELECT cut, count(*) FILTER (correct AND confidence >= cut) AS tp, count(*) FILTER (NOT correct AND confidence >= cut) AS fp, count(*) FILTER (correct AND confidence < cut) AS fn FROM g, scored GROUP BY cut),
h AS (SELECT *, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM f) SELECT cut, tp, fp, fn, f1, row_number() OVER (ORDER BY f1 DESC, cut) = 1 AS chosen FROM h""",
    "k01_temperature_grid": f"""{_W}, t AS (SELECT CAST(unnest({TEMPERATURES}) AS DOUBLE) AS temperature)
SELECT temperature, round(avg(ln(list_sum(list_transform(lg, lambda x: exp((x - list_max(lg)) / temperature)))) - (lg[label + 1] - list_max(lg)) / temperature), 6) AS nll FROM scored, t GROUP BY temperature""",
    "k08_bands": f"{_W}, {_BANDS} SELECT * FROM bands",
    "k09_band_histogram": f"{_W}, {_DECIDED} SELECT band, count(*) AS n FROM o GROUP BY band",
    "m01_policy": f"{_W}, {_DECIDED} SELECT outcome, count(*) AS n, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) FILTER (outcome = 'answered') AS with_verdict FROM o GROUP BY outcome",
    "l27_abstention_cube": f"{_W}, {_DECIDED} SELECT predicted % 2 = 0 AS even, outcome <> 'answered' AS declined, count(*) AS n FROM o GROUP BY CUBE (1, 2)".replace("GROUP BY CUBE (1, 2)", "GROUP BY CUBE (predicted % 2 = 0, outcome <> 'answered')"),
    "l18_mcnemar": f"""{_W}, c AS (SELECT count(*) FILTER (correct AND p[label + 1] < 0.05) AS a_only, count(*) FILTER (NOT correct AND p[label + 1] >= 0.05) AS b_only FROM scored),
t AS (SELECT a_only, b_only, a_only + b_only AS n, unnest(range(0, least(a_only, b_only) + 1)) AS k FROM c)
SELECT a_only, b_only, round(least(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)))), 6) AS p_value FROM t GROUP BY a_only, b_only""",
    "l16_bootstrap": f"""{_W}, nb AS (SELECT row_number() OVER (ORDER BY id) - 1 AS i, CASE WHEN correct THEN 1.0 ELSE 0.0 END AS v FROM scored), n AS (SELECT count(*) AS n FROM nb),
dr AS (SELECT r, CAST('0x' || substr(sha1('7:' || r || ':' || i), 1, 8) AS BIGINT) % n AS i FROM nb, n, (SELECT unnest(range(0, 200)) AS r)),
m AS (SELECT r, avg(v) AS m FROM dr JOIN nb USING (i) GROUP BY r) SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.5), 6) AS middle, round(quantile_cont(m, 0.975), 6) AS high FROM m""",
    "d20_correlation": f"{_W} SELECT round(corr(confidence, (id % 100) / 100), 6) AS r FROM scored",
    "l21_counting_error": f"""{_W}, g AS (SELECT CAST(unnest([0.0, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6]) AS DOUBLE) AS cut)
SELECT cut, count(id) AS counted, count(id) FILTER (NOT correct) AS wrong FROM g LEFT JOIN (SELECT * FROM scored WHERE predicted < 2) s ON s.confidence >= cut GROUP BY cut""",
}
