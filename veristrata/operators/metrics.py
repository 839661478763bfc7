"""Evaluation: retrieval, classification, calibration, selective prediction, intervals and tests.

Scored rows have id, label, p (probabilities), confidence, predicted and correct. Confidence is rounded to nine places so
that equal values tie in every engine. Curves cut only where confidence drops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veristrata.operators.numbering import numbered, unit_bucket
from veristrata.operators.splits import tile

BINS = 15
RISKS = (0.05, 0.10, 0.15, 0.20)
COVERAGES = (0.5, 0.7, 0.9)
Z = 1.959963984540054


def r6(column: Column | str) -> Column:
    return F.round(column, 6)


def softmax(logits: Column) -> Column:
    raised = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))


def score(predictions: DataFrame) -> DataFrame:
    """predictions (id, logits, label) with p, confidence, predicted (the first greatest) and correct."""
    out = predictions.withColumn("p", softmax(F.col("logits")))
    out = out.withColumn("confidence", F.round(F.array_max("p"), 9)).withColumn("predicted", (F.array_position("logits", F.array_max("logits")) - 1).cast("int"))
    return out.withColumn("correct", F.col("predicted") == F.col("label"))


def verdict_features(scored: DataFrame) -> DataFrame:
    ordered = F.sort_array("p", asc=False)
    entropy = F.aggregate("p", F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log(x)).otherwise(0.0))
    return scored.select("id", r6(F.element_at(ordered, 1)).alias("max_prob"), r6(F.element_at(ordered, 1) - F.element_at(ordered, 2)).alias("prob_margin"), r6(entropy).alias("entropy"))


def confusion(scored: DataFrame, classes: int) -> DataFrame:
    """(gold, predicted, n) of every cell."""
    spark = scored.sparkSession
    one = spark.range(classes)
    grid = one.select(F.col("id").cast("int").alias("gold")).crossJoin(one.select(F.col("id").cast("int").alias("predicted")))
    return grid.join(scored.groupBy(F.col("label").alias("gold"), "predicted").agg(F.count("*").alias("n")), ["gold", "predicted"], "left").fillna(0, ["n"])


def class_metrics(scored: DataFrame, classes: int) -> DataFrame:
    """Precision, recall, F1 and support of each class; 0 where undefined."""
    cells = confusion(scored, classes)
    by = cells.groupBy(F.col("gold").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits"))
    read = cells.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("read"))
    precision = F.when(F.col("read") > 0, F.col("hits") / F.col("read")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    out = by.join(read, "class").withColumns({"precision": precision, "recall": recall})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.select("class", "support", r6("precision").alias("precision"), r6("recall").alias("recall"), r6(f1).alias("f1"))


def _binned(scored: DataFrame, index: Column, bins: int) -> DataFrame:
    found = scored.withColumn("bin", index).groupBy("bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    every = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").fillna(0, ["n"]).fillna(0.0, ["confidence", "accuracy"])


def reliability(scored: DataFrame, bins: int = BINS) -> DataFrame:
    """Equal-width bins, closed on the right; empty bins stay as zeros."""
    return _binned(scored, F.greatest(F.ceil(F.col("confidence") * bins) - 1, F.lit(0)).cast("int"), bins)


def reliability_by_mass(scored: DataFrame, bins: int = BINS) -> DataFrame:
    """Bins of equal numbers of rows; the first n mod bins have one more."""
    placed = numbered(scored.select("id", "confidence", "correct"), unit_bucket("confidence"), ["confidence", "id"])
    return _binned(placed, tile("pos", "n", bins), bins)


def calibration_summary(scored: DataFrame, bins: int = BINS) -> DataFrame:
    gap = F.abs(F.col("confidence") - F.col("accuracy"))
    wide = reliability(scored, bins).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(F.when(F.col("n") > 0, gap)).alias("mce"))
    mass = reliability_by_mass(scored, bins).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("adaptive_ece"))
    picked = F.element_at("p", F.col("label") + 1)
    squares = F.aggregate(F.transform("p", lambda x, i: F.pow(x - (i == F.col("label")).cast("double"), 2)), F.lit(0.0), lambda a, x: a + x)
    rows = scored.agg(F.avg(squares).alias("brier"), F.avg(-F.log(F.greatest(picked, F.lit(1e-12)))).alias("nll"), (F.avg("confidence") - F.avg(F.col("correct").cast("double"))).alias("overconfidence"))
    return wide.crossJoin(mass).crossJoin(rows).select(*[r6(c).alias(c) for c in ("ece", "adaptive_ece", "mce", "brier", "nll", "overconfidence")])


def risk_coverage(scored: DataFrame) -> DataFrame:
    """(confidence, answered, coverage, risk) of every reachable threshold; rows of one confidence are summed before any ordering."""
    runs = scored.groupBy("confidence").agg(F.count("*").alias("n"), F.count_if(~F.col("correct")).alias("wrong"))
    down = Window.orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, 0)
    whole = scored.agg(F.count("*").alias("total"))
    return runs.select("confidence", F.sum("n").over(down).alias("answered"), F.sum("wrong").over(down).alias("errors")).crossJoin(F.broadcast(whole)).select("confidence", "answered", (F.col("answered") / F.col("total")).alias("coverage"), (F.col("errors") / F.col("answered")).alias("risk"))


def _harmonic(n: str) -> Column:
    """1 + 1/2 + ... + 1/n: summed up to 1,000, from there by its expansion, whose next term is below 1e-17."""
    x = F.col(n).cast("double")
    head = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col(n), F.lit(1000)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / i.cast("double"))
    return F.when(F.col(n) <= 0, 0.0).when(F.col(n) <= 1000, head).otherwise(F.log(x) + F.lit(0.5772156649015329) + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x))


def aurc_summary(scored: DataFrame) -> DataFrame:
    curve = risk_coverage(scored)
    width = F.col("coverage") - F.coalesce(F.lag("coverage").over(Window.orderBy("answered")), F.lit(0.0))
    area = curve.select((F.col("risk") * width).alias("part")).agg(F.sum("part").alias("aurc"))
    counts = scored.agg(F.count("*").alias("n"), F.count_if("correct").alias("hits"))
    best = counts.select(((F.col("n") - F.col("hits") - F.col("hits") * (_harmonic("n") - _harmonic("hits"))) / F.col("n")).alias("optimal"))
    return area.crossJoin(best).select(r6("aurc").alias("aurc"), r6("optimal").alias("optimal_aurc"), r6(F.col("aurc") - F.col("optimal")).alias("excess_aurc"))


def operating_points(scored: DataFrame, risks=RISKS, coverages=COVERAGES) -> DataFrame:
    """Coverage at each risk and risk at each coverage; null where no threshold reaches it."""
    curve = risk_coverage(scored)
    spark = scored.sparkSession
    by_risk = spark.createDataFrame([(float(r),) for r in risks], "target double")
    by_coverage = spark.createDataFrame([(float(c),) for c in coverages], "target double")
    one = by_risk.join(curve, F.col("risk") <= F.col("target"), "left").groupBy("target").agg(F.max("coverage").alias("value")).withColumn("kind", F.lit("coverage_at_risk"))
    two = by_coverage.join(curve, F.col("coverage") >= F.col("target"), "left").groupBy("target").agg(F.min_by("risk", "coverage").alias("value")).withColumn("kind", F.lit("risk_at_coverage"))
    return one.unionByName(two).select("kind", "target", r6("value").alias("value"))


def roc_auc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """One row: hits, misses, auc. Rows of one score are counted before ranks are summed, so ties get mean ranks; null if a class is absent."""
    runs = rows.groupBy(score).agg(F.count("*").alias("n"), F.count_if(F.col(positive)).alias("hits"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = runs.select("n", "hits", (before + (F.col("n") + 1) / 2).alias("rank"))
    sums = ranks.agg(F.sum("hits").alias("hits"), F.sum(F.col("n") - F.col("hits")).alias("misses"), F.sum(F.col("hits") * F.col("rank")).alias("ranks"))
    auc = F.when((F.col("hits") > 0) & (F.col("misses") > 0), (F.col("ranks") - F.col("hits") * (F.col("hits") + 1) / 2) / (F.col("hits") * F.col("misses")))
    return sums.select("hits", "misses", r6(auc).alias("auc"))


def wilson(successes: Column, total: Column, z: float = Z) -> tuple[Column, Column]:
    """The score interval, clamped to [0, 1]; null without trials."""
    share = successes / total
    middle = (share + z * z / (2 * total)) / (1 + z * z / total)
    half = z * F.sqrt(share * (1 - share) / total + z * z / (4 * total * total)) / (1 + z * z / total)
    return F.when(total > 0, F.greatest(F.lit(0.0), middle - half)), F.when(total > 0, F.least(F.lit(1.0), middle + half))


def subgroup_audit(rows: DataFrame, group: str, wrong: str, least: int = 30) -> DataFrame:
    """Error rate of each group with its interval; comparable: at least `least` rows."""
    counted = rows.groupBy(F.col(group).alias("grp")).agg(F.count("*").alias("n"), F.count_if(F.col(wrong)).alias("errors"))
    low, high = wilson(F.col("errors"), F.col("n"))
    return counted.select("grp", "n", "errors", r6(F.col("errors") / F.col("n")).alias("error"), r6(low).alias("low"), r6(high).alias("high"), (F.col("n") >= least).alias("comparable"))


def disjoint_groups(audit: DataFrame) -> DataFrame:
    """Pairs of comparable groups whose intervals don't meet. An audit has a row for each group."""
    a = audit.where("comparable").select(F.col("grp").alias("higher"), F.col("low").alias("edge"))
    b = audit.where("comparable").select(F.col("grp").alias("lower"), F.col("high").alias("top"))
    return a.join(b, F.col("edge") > F.col("top")).select("higher", "lower")


def threshold_sweep(rows: DataFrame, cuts: list[float], score: str, positive: str) -> DataFrame:
    """Precision, recall and F1 at each cut, and which cut is chosen: the greatest F1, the first of equals. Scores are counted by cut interval first."""
    grid = rows.sparkSession.createDataFrame([(float(c),) for c in cuts], "cut double")
    runs = rows.groupBy(score).agg(F.count("*").alias("n"), F.count_if(F.col(positive)).alias("hits"))
    found = grid.crossJoin(runs).groupBy("cut").agg(F.sum(F.when(F.col(score) >= F.col("cut"), F.col("hits")).otherwise(0)).alias("tp"), F.sum(F.when(F.col(score) >= F.col("cut"), F.col("n") - F.col("hits")).otherwise(0)).alias("fp"), F.sum(F.when(F.col(score) < F.col("cut"), F.col("hits")).otherwise(0)).alias("fn"))
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    out = found.withColumn("f1", r6(f1))
    return out.withColumn("chosen", F.row_number().over(Window.orderBy(F.desc("f1"), "cut")) == 1)


def mcnemar(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Discordant counts and the exact two-sided p value, its binomial tail summed from log factorials."""
    counts = rows.agg(F.count_if(F.col(a) & ~F.col(b)).alias("a_only"), F.count_if(~F.col(a) & F.col(b)).alias("b_only")).withColumn("n", F.col("a_only") + F.col("b_only"))
    term = "exp(aggregate(sequence(1L, n), 0D, (s, i) -> s + ln(i)) - aggregate(filter(sequence(0L, k), i -> i > 0), 0D, (s, i) -> s + ln(i)) - aggregate(filter(sequence(0L, n - k), i -> i > 0), 0D, (s, i) -> s + ln(i)) - n * ln(2D))"
    tail = f"aggregate(transform(sequence(0L, least(a_only, b_only)), k -> {term}), 0D, (s, x) -> s + x)"
    return counts.select("a_only", "b_only", F.expr(f"case when n = 0 then 1D else round(least(1D, 2 * {tail}), 6) end").alias("p_value"))


def bootstrap(rows: DataFrame, value: str, resamples: int, seed: int) -> DataFrame:
    """Percentile interval of the mean. Draw i of resample r is row h(seed, r, i) mod n: no generator's state is shared, so draws can be made anywhere."""
    numbered = rows.select((F.row_number().over(Window.orderBy("id")) - 1).alias("i"), F.col(value).cast("double").alias("v"))
    n = numbered.agg(F.count("*").alias("n"))
    spark = rows.sparkSession
    draws = numbered.select(F.col("i").alias("d")).crossJoin(spark.range(resamples).select(F.col("id").alias("r"))).crossJoin(F.broadcast(n))
    pick = F.conv(F.substring(F.sha1(F.concat_ws(":", F.lit(str(seed)), "r", "d").cast("binary")), 1, 8), 16, 10).cast("long") % F.col("n")
    means = draws.select("r", pick.cast("int").alias("i")).join(numbered, "i").groupBy("r").agg(F.avg("v").alias("m"))
    cut = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"))
    return cut.select(r6(F.col("q")[0]).alias("low"), r6(F.col("q")[1]).alias("middle"), r6(F.col("q")[2]).alias("high"))


def completion_ranks(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, first) of queries with gold: the least rank at which one whole gold group (qid, grp, doc_id) is inside the ranking, null if none ever is."""
    met = gold.join(ranked.select("qid", "doc_id", "rank"), ["qid", "doc_id"], "left")
    groups = met.groupBy("qid", "grp").agg(F.when(F.count_if(F.col("rank").isNull()) == 0, F.max("rank")).alias("at"))
    return groups.groupBy("qid").agg(F.min("at").alias("first"))


def recall_curve(ranked: DataFrame, gold: DataFrame, claims: DataFrame, ks: list[int]) -> DataFrame:
    """Strict recall at each k over queries with gold, and the ceiling over all claims: those without gold can always be answered."""
    first = completion_ranks(ranked, gold)
    cuts = claims.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    totals = claims.agg(F.count("*").alias("claims"))
    out = cuts.crossJoin(first).groupBy("k").agg(F.count("*").alias("verifiable"), F.avg(F.when(F.col("first") <= F.col("k"), 1.0).otherwise(0.0)).alias("recall"), F.avg(F.when(F.col("first") <= F.col("k"), 1 / F.col("first")).otherwise(0.0)).alias("mrr"))
    share = F.col("verifiable") / F.col("claims")
    return out.crossJoin(F.broadcast(totals)).select("k", "verifiable", r6("recall").alias("recall"), r6("mrr").alias("mrr"), r6(1 - share * (1 - F.col("recall"))).alias("ceiling"), r6(1 - share).alias("nei_share"))


def ndcg(ranked: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """Binary nDCG and loose recall at each k over the union of a query's gold groups."""
    wanted = gold.select("qid", "doc_id").distinct()
    sizes = wanted.groupBy("qid").agg(F.count("*").alias("m"))
    cuts = gold.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    met = wanted.join(ranked.select("qid", "doc_id", "rank"), ["qid", "doc_id"])
    got = cuts.join(met, F.col("rank") <= F.col("k")).groupBy("k", "qid").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.expr("aggregate(sequence(1, cast(least(k, m) as int)), 0D, (a, i) -> a + 1 / log2(i + 1))")
    return cuts.crossJoin(sizes).join(got, ["k", "qid"], "left").groupBy("k").agg(r6(F.avg(F.coalesce("dcg", F.lit(0.0)) / ideal)).alias("ndcg"), r6(F.avg(F.col("dcg").isNotNull().cast("double"))).alias("recall_any"))


def naive_bayes(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label, log_prior, unseen) and (term, label, n, log_likelihood) of unigrams with add-one smoothing. train: label, t (tokens)."""
    rows = train.groupBy("label").agg(F.count("*").alias("n"))
    whole = train.agg(F.count("*").alias("total"))
    counts = train.select("label", F.explode("t").alias("term")).groupBy("label", "term").agg(F.count("*").alias("n"))
    size = counts.agg(F.countDistinct("term").alias("size"))
    mass = counts.groupBy("label").agg(F.sum("n").alias("mass"))
    classes = rows.join(mass, "label", "left").crossJoin(whole).crossJoin(size).select("label", F.log(F.col("n") / F.col("total")).alias("log_prior"), (F.coalesce("mass", F.lit(0)) + F.col("size")).alias("denominator"))
    likelihood = counts.join(F.broadcast(classes), "label").select("term", "label", "n", F.log((F.col("n") + 1) / F.col("denominator")).alias("log_likelihood"))
    return classes, likelihood


def naive_bayes_predict(test: DataFrame, classes: DataFrame, likelihood: DataFrame) -> DataFrame:
    """(id, predicted): only terms that some class has count; equal sums go to the least label. test: id, t."""
    known = likelihood.select("term").distinct()
    held = test.select("id", F.explode("t").alias("term")).groupBy("id", "term").agg(F.count("*").alias("k")).join(known, "term", "left_semi")
    pairs = held.crossJoin(F.broadcast(classes)).join(likelihood.select("term", "label", "log_likelihood"), ["term", "label"], "left")
    part = F.col("k") * F.coalesce("log_likelihood", F.log(1 / F.col("denominator")))
    sums = pairs.groupBy("id", "label").agg(F.sum(part).alias("part"))
    every = test.select("id").crossJoin(F.broadcast(classes)).join(sums, ["id", "label"], "left").withColumn("s", F.round(F.col("log_prior") + F.coalesce("part", F.lit(0.0)), 6))
    return every.groupBy("id").agg(F.min_by("label", F.struct(-F.col("s"), F.col("label"))).alias("predicted"))
