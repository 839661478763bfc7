"""Judged pairs and runs: relations from logits, reviews, display order, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veristrata.operators.metrics import r6

RELATIONS = ("states", "states_negation", "bears_on", "unrelated")
INVERSE = {"states": "states_negation", "states_negation": "states"}
MOST_SHOWN = 6
#: Displayed text's figures: amounts, decimals, shares, grouped and long numbers.
FIGURE = r"[$€£]\s?\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d{1,3}(?:,\d{3})*\.\d+%?|\d{1,3}(?:,\d{3})*%|\d{1,3}(?:,\d{3})+|\d{4,}"


def read_pairs(scored: DataFrame, threshold: float) -> DataFrame:
    """scored (predicted, confidence, inverted) with relation and counted: directions below the threshold only bear on; a pair judged on the positive form is turned back."""
    names = F.array(*map(F.lit, RELATIONS))
    relation = F.element_at(names, F.col("predicted") + 1)
    turned = F.when(F.col("inverted") & (relation == "states"), "states_negation").when(F.col("inverted") & (relation == "states_negation"), "states").otherwise(relation)
    direction = turned.isin("states", "states_negation")
    return scored.withColumn("relation", F.when(direction & (F.col("confidence") < threshold), "bears_on").otherwise(turned)).withColumn("counted", F.col("relation").isin("states", "states_negation"))


def nli_relation(label, inverted):
    """The relation that a three-way label stands for."""
    base = F.when(label == "entailment", "states").when(label == "contradiction", "states_negation").otherwise("unrelated")
    return F.when(inverted & (base == "states"), "states_negation").when(inverted & (base == "states_negation"), "states").otherwise(base)


def review_context(rows: DataFrame, second: DataFrame) -> DataFrame:
    """rows (pair_id, origin, relation) with kept: a context row that the second reading (pair_id, relation, over_limit) calls unrelated is withheld; an over-limit or absent reading keeps it."""
    read = second.select("pair_id", F.col("relation").alias("again"), "over_limit")
    drop = (F.col("origin") == "context") & ~F.coalesce("over_limit", F.lit(True)) & (F.coalesce("again", F.lit("")) == "unrelated")
    return rows.join(read, "pair_id", "left").withColumn("kept", ~drop).drop("again", "over_limit")


def display_order(rows: DataFrame, by: str) -> DataFrame:
    """rows with place: assertion research first, then by confidence, then by id."""
    order = Window.partitionBy(by).orderBy(F.col("origin") != "assertion", F.desc("confidence"), "pair_id")
    return rows.withColumn("place", F.row_number().over(order).cast("long"))


def shown(rows: DataFrame, by: str, most: int = MOST_SHOWN) -> DataFrame:
    """(by, shown, more): how many rows are shown and how many are only counted."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).select(by, F.least("n", F.lit(most)).alias("shown"), F.greatest(F.col("n") - most, F.lit(0)).alias("more"))


def ungrounded_figures(prose, grounds):
    """Figures of the prose that stand in none of the grounds (an array)."""
    return F.filter(F.regexp_extract_all(prose, F.lit(FIGURE), F.lit(0)), lambda f: ~F.exists(grounds, lambda g: F.contains(g, f)))


def run_coverage(rows: DataFrame) -> DataFrame:
    """Outcomes of every sentence of a run, and the answered share of those that were judged."""
    counts = rows.agg(F.count("*").alias("sentences"), F.expr("count_if(outcome = 'filtered')").alias("filtered"), F.expr("count_if(outcome = 'answered')").alias("answered"), F.expr("count_if(outcome like 'declined%')").alias("declined"))
    judged = F.col("answered") + F.col("declined")
    return counts.withColumn("coverage", F.when(judged > 0, r6(F.col("answered") / judged)))


def direction_report(readings: DataFrame, truth: DataFrame) -> DataFrame:
    """readings (claim_id, direction: for, against or none) against truth (claim_id, true); a claim without truth row raises, a null truth is unscored."""
    known = truth.select("claim_id", "true", F.lit(True).alias("listed"))
    missing = F.raise_error(F.concat(F.lit("no truth for claim "), F.col("claim_id").cast("string")))
    rows = readings.join(known, "claim_id", "left").withColumn("listed", F.when(F.col("listed").isNull(), missing).otherwise(F.col("listed")))
    directional = F.col("listed") & (F.col("direction") != "none") & F.col("true").isNotNull()
    right = directional & ((F.col("direction") == "for") == F.col("true"))
    return rows.agg(F.count_if(directional).alias("directional"), F.count_if(right).alias("right"), F.count_if(directional & ~right).alias("wrong"), F.count_if(F.col("listed") & F.col("true").isNull()).alias("unscored"))


def policy_report(rows: DataFrame, policies: dict[str, str]) -> DataFrame:
    """Coverage, accuracy and declined rows of each policy, a SQL condition to answer; rows (correct, ...) are read once."""
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("policy"), F.expr(rule).alias("answers")) for name, rule in policies.items()])).alias("p")
    flat = rows.select("correct", pairs).select("correct", "p.*")
    return flat.groupBy("policy").agg(r6(F.avg(F.col("answers").cast("double"))).alias("coverage"), r6(F.avg(F.when(F.col("answers"), F.col("correct").cast("double")))).alias("accuracy"), F.count_if(~F.col("answers")).alias("declined"))


def pair_report(judged: DataFrame) -> DataFrame:
    """judged (gold, relation): counting error (counted and not so) and counted recall over the two directions."""
    counted, wanted = F.col("relation").isin("states", "states_negation"), F.col("gold").isin("states", "states_negation")
    sums = judged.agg(F.count_if(counted).alias("counted"), F.count_if(counted & (F.col("gold") != F.col("relation"))).alias("wrong"), F.count_if(wanted).alias("wanted"), F.count_if(wanted & (F.col("gold") == F.col("relation"))).alias("found"))
    return sums.select("counted", "wrong", "wanted", "found", r6(F.col("wrong") / F.greatest("counted", F.lit(1))).alias("counting_error"), r6(F.col("found") / F.greatest("wanted", F.lit(1))).alias("counted_recall"))


def page_recall(pages: DataFrame, groups: DataFrame, ns: list[int]) -> DataFrame:
    """Share of queries with some gold group whose pages (qid, grp, page) are all among the first n of pages (qid, page, rank)."""
    wanted = groups.select("qid", "grp", "page").distinct()
    met = wanted.join(pages, ["qid", "page"], "left").groupBy("qid", "grp").agg(F.when(F.count_if(F.col("rank").isNull()) == 0, F.max("rank")).alias("at")).groupBy("qid").agg(F.min("at").alias("at"))
    cuts = pages.sparkSession.createDataFrame([(n,) for n in ns], "n int")
    return cuts.crossJoin(met).groupBy("n").agg(r6(F.avg(F.when(F.col("at") <= F.col("n"), 1.0).otherwise(0.0))).alias("doc_recall"))


def paired_difference(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.withColumn("difference", F.col(a).cast("double") - F.col(b).cast("double"))


def parity(left: DataFrame, right: DataFrame, key: str, value: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows of two runs that differ by more than the tolerance, or that one lacks."""
    both = left.select(key, F.col(value).alias("l")).join(right.select(key, F.col(value).alias("r")), key, "full_outer")
    return both.where(F.col("l").isNull() | F.col("r").isNull() | (F.abs(F.col("l") - F.col("r")) > tolerance))
