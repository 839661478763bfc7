"""Reports on parts of a set of predictions, and on what a model had read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.operators.metrics import BINS, r6

LEAST_ROWS = 30
COUNTED = (0, 1)


def gold_read(claims: DataFrame, found: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, gold_read): whether a whole gold group (gold: qid, grp, doc_id) is among the first `used` rows of the claim's ranking (found: qid, doc_id, rank); null for a claim (qid, used) without gold."""
    ranks = gold.distinct().join(found.groupBy("qid", "doc_id").agg(F.min("rank").alias("rank")), ["qid", "doc_id"], "left")
    complete = ranks.groupBy("qid", "grp").agg(F.max(F.coalesce("rank", F.lit(2**31 - 1))).alias("last")).groupBy("qid").agg(F.min("last").alias("first"))
    return claims.join(complete, "qid", "left").select("qid", (F.col("first") <= F.col("used")).alias("gold_read"))


def per_claim_brier(p: Column, label: Column) -> Column:
    return F.aggregate(F.transform(p, lambda x, i: F.pow(x - (i == label).cast("double"), 2)), F.lit(0.0), lambda a, x: a + x)


def subgroup_calibration(scored: DataFrame, by: str, bins: int = BINS, least: int = LEAST_ROWS) -> DataFrame:
    """(by, n, accuracy, ece, mean_confidence, overconfidence, brier) of each group of at least `least` rows. Rows are summed by (group, bin) first."""
    index = F.greatest(F.ceil(F.col("confidence") * bins) - 1, F.lit(0)).cast("int")
    cells = scored.withColumn("bin", index).groupBy(by, "bin").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"), F.count_if("correct").alias("h"), F.sum(per_claim_brier(F.col("p"), F.col("label"))).alias("b"))
    out = cells.groupBy(by).agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum("h").alias("h"), F.sum(F.abs(F.col("c") - F.col("h"))).alias("gap"), F.sum("b").alias("b")).where(F.col("n") >= least)
    return out.select(by, "n", r6(F.col("h") / F.col("n")).alias("accuracy"), r6(F.col("gap") / F.col("n")).alias("ece"), r6(F.col("c") / F.col("n")).alias("mean_confidence"), r6((F.col("c") - F.col("h")) / F.col("n")).alias("overconfidence"), r6(F.col("b") / F.col("n")).alias("brier"))


def counting_report(scored: DataFrame, groups: dict[str, str], thresholds: dict[str, float], counted: tuple[int, ...] = COUNTED) -> DataFrame:
    """(part, n, accuracy, counted, counting_error, share_of_counted) of all rows, of each group (a SQL condition), of each band by confidence and of the rows below all bands. A counting error is a wrong row among those whose predicted class counts."""
    band = F.lit("abstained")
    for name, least in sorted(thresholds.items(), key=lambda x: x[1]):
        band = F.when(F.col("confidence") >= least, f"band:{name}").otherwise(band)
    parts = F.array_compact(F.array(F.lit("all"), band, *[F.when(F.expr(rule), f"group:{name}") for name, rule in groups.items()]))
    rows = scored.select(F.explode(parts).alias("part"), "correct", F.col("predicted").isin(*counted).alias("counts"))
    out = rows.groupBy("part").agg(F.count("*").alias("n"), F.count_if("correct").alias("h"), F.count_if("counts").alias("counted"), F.count_if(F.col("counts") & ~F.col("correct")).alias("wrong"))
    whole = scored.agg(F.count_if(F.col("predicted").isin(*counted)).alias("whole"))
    share = F.col("counted") / F.greatest("whole", F.lit(1))
    return out.crossJoin(F.broadcast(whole)).select("part", "n", r6(F.col("h") / F.col("n")).alias("accuracy"), "counted", r6(F.col("wrong") / F.greatest("counted", F.lit(1))).alias("counting_error"), r6(share).alias("share_of_counted"))


def compare_models(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row for two models' scored rows with the same ids: rows, both accuracies, changed predictions, and the correlation of their confidences. Ids that only one has raise."""
    both = a.select("id", F.col("correct").alias("ca"), F.col("predicted").alias("pa"), F.col("confidence").alias("fa")).join(b.select("id", F.col("correct").alias("cb"), F.col("predicted").alias("pb"), F.col("confidence").alias("fb")), "id", "full")
    alone = F.raise_error(F.concat(F.lit("only one model has row "), F.col("id").cast("string"))).cast("boolean")
    both = both.withColumn("ca", F.when(F.col("ca").isNull() | F.col("cb").isNull(), alone).otherwise(F.col("ca")))
    return both.agg(F.count("*").alias("n"), r6(F.avg(F.col("ca").cast("double"))).alias("accuracy_a"), r6(F.avg(F.col("cb").cast("double"))).alias("accuracy_b"), F.count_if(F.col("pa") != F.col("pb")).alias("changed"), r6(F.corr("fa", "fb")).alias("confidence_correlation"))
