"""From judged sentences to a claim's verdict: gate, demotions, statuses and summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Order decides the reason that is given.
REASONS = {
    "speech_reprint": "reprint of the speaker's own words",
    "attributed_opinion": "attributed opinion",
    "forecast": "forecast or expectation",
    "hypothetical": "hypothetical or illustration",
    "instruction": "instruction or navigation text",
    "caption": "image caption or credit",
    "unknown": "role not established",
}
DEFINITION_ONLY = "definition without a reported observation"
COUNTED = ("states", "states_negation")
LIMITS = (
    "the claim's country is not established",
    "every counted sentence states a narrower scope",
    "no counted sentence comes from a source with a confirmed publication date",
)
NEAR_MISS, CONFIRMED = 0.5, 0.95


def gate(units: DataFrame) -> DataFrame:
    """units (unit_id, passage_id, roles, text) with withheld (null: eligible) and, for eligible ones, definitions of their own paragraph."""
    reason = None
    for role, text in REASONS.items():
        reason = (F.when if reason is None else reason.when)(F.array_contains("roles", role), text)
    reason = reason.when(~F.array_contains("roles", "reported_observation"), DEFINITION_ONLY)
    out = units.withColumn("withheld", reason)
    context = list(REASONS)[:-1]
    defining = F.array_contains("roles", "definition") & ~F.arrays_overlap("roles", F.array(*map(F.lit, context)))
    held = out.where(defining).groupBy("passage_id").agg(F.sort_array(F.collect_list(F.struct("unit_id", "text"))).alias("found"))
    out = out.join(held, "passage_id", "left")
    own = F.filter(F.coalesce("found", F.array().cast("array<struct<unit_id:string,text:string>>")), lambda d: d["unit_id"] != F.col("unit_id"))
    return out.withColumn("definitions", F.when(F.col("withheld").isNull(), F.transform(own, lambda d: d["unit_id"]))).drop("found")


def withheld_counts(gated: DataFrame) -> DataFrame:
    return gated.where("withheld is not null").groupBy("withheld").agg(F.count("*").alias("n"))


def integrity(judgments: DataFrame, gated: DataFrame, assertions: DataFrame) -> DataFrame:
    """Judgments (assertion_id, unit_id) that may not be: of a withheld sentence, of an unknown assertion, or repeated."""
    eligible = gated.where("withheld is null").select("unit_id", F.lit(True).alias("ok_unit"))
    known = assertions.select("assertion_id", F.lit(True).alias("ok_assertion"))
    counted = judgments.groupBy("assertion_id", "unit_id").agg(F.count("*").alias("n"))
    checked = counted.join(eligible, "unit_id", "left").join(known, "assertion_id", "left")
    problem = F.when(F.col("ok_unit").isNull(), "withheld_unit").when(F.col("ok_assertion").isNull(), "unknown_assertion").when(F.col("n") > 1, "repeated")
    return checked.withColumn("problem", problem).where("problem is not null").select("assertion_id", "unit_id", "problem")


def lineage_roots(sources: DataFrame, depth: int = 16) -> DataFrame:
    """(source_id, root): known parents followed until there is none or the chain comes back. sources: source_id, parent_id, url.

    Each step joins every chain with its next parent, so a step serves all sources at once; chains longer than depth raise.
    """
    known = sources.select(F.col("source_id").alias("p")).distinct()
    edges = sources.join(known, F.col("parent_id") == F.col("p")).select(F.col("source_id").alias("child"), "parent_id")
    at = sources.select("source_id", F.col("source_id").alias("root"), F.array("source_id").alias("seen"), F.lit(False).alias("done"))
    for _ in range(depth):
        step = at.join(edges, (F.col("root") == F.col("child")) & ~F.col("done"), "left")
        back = F.array_contains("seen", F.col("parent_id"))
        at = step.select("source_id", F.coalesce("parent_id", "root").alias("root"), F.when(F.col("parent_id").isNotNull() & ~back, F.concat("seen", F.array("parent_id"))).otherwise(F.col("seen")).alias("seen"), (F.col("done") | F.col("parent_id").isNull() | F.coalesce(back, F.lit(False))).alias("done"))
    checked = F.when(F.col("done"), F.col("root")).otherwise(F.raise_error(F.lit("a lineage chain is too long")))
    return at.select("source_id", checked.alias("root"))


def independent_sources(sources: DataFrame, depth: int = 16) -> DataFrame:
    """(source_id, independent): the host of the lineage root without www., or the root itself where it has none."""
    roots = lineage_roots(sources, depth)
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), r"^www\.", "")
    hosts = sources.select(F.col("source_id").alias("root"), host.alias("host"))
    return roots.join(hosts, "root").select("source_id", F.when(F.col("host") != "", F.col("host")).otherwise(F.col("root")).alias("independent"))


def demote(rows: DataFrame) -> DataFrame:
    """rows (assertion_id, source_id, origin, relation, dated_elsewhere) with relation and not_counted as they stand after the demotions.

    Context research and sentences dated outside the claim's period bear on it only; then a source that is read both ways
    loses all its counts.
    """
    counted = F.col("relation").isin(*COUNTED)
    early = F.when(counted & (F.col("origin") == "context"), "context").when(counted & F.col("dated_elsewhere"), "different_period")
    out = rows.withColumn("not_counted", early).withColumn("relation", F.when(early.isNotNull(), "bears_on").otherwise(F.col("relation")))
    left = F.when(F.col("relation").isin(*COUNTED), F.col("relation"))
    own = Window.partitionBy("assertion_id", "source_id")
    both = (F.min(left).over(own) != F.max(left).over(own)) & left.isNotNull()
    out = out.withColumn("both", F.coalesce(both, F.lit(False)))
    return out.withColumn("not_counted", F.when(F.col("both"), "self_conflict").otherwise(F.col("not_counted"))).withColumn("relation", F.when(F.col("both"), "bears_on").otherwise(F.col("relation"))).drop("both")


def assertion_status(rows: DataFrame, scope_known: bool = True) -> DataFrame:
    """(claim_id, assertion_id, status, limits, sources_for, sources_against) from demoted rows (qualified, published_at, independent)."""
    support, against = F.col("relation") == "states", F.col("relation") == "states_negation"
    either = support | against
    grouped = rows.groupBy("claim_id", "assertion_id").agg(
        F.countDistinct(F.when(support, F.col("independent"))).alias("sources_for"),
        F.countDistinct(F.when(against, F.col("independent"))).alias("sources_against"),
        F.coalesce(F.bool_and(F.when(either, F.col("qualified"))), F.lit(False)).alias("narrow"),
        F.coalesce(F.bool_or(F.when(either, ~F.col("qualified") & (F.coalesce("published_at", F.lit("")) != ""))), F.lit(False)).alias("dated"),
    )
    limits = F.array_compact(F.array(F.lit(None if scope_known else LIMITS[0]).cast("string"), F.when(F.col("narrow"), LIMITS[1]).when(~F.col("dated"), LIMITS[2])))
    one = (F.col("sources_for") > 0) != (F.col("sources_against") > 0)
    grouped = grouped.withColumn("limits", F.when(one, limits).otherwise(F.array().cast("array<string>")))
    full = F.size("limits") == 0
    status = F.when((F.col("sources_for") > 0) & (F.col("sources_against") > 0), "contested").when(F.col("sources_for") > 0, F.when(full, "supported").otherwise("qualified_support")).when(F.col("sources_against") > 0, F.when(full, "contradicted").otherwise("qualified_contradiction")).otherwise("insufficient")
    return grouped.select("claim_id", "assertion_id", status.alias("status"), F.array_join("limits", "; ").alias("limits"), "sources_for", "sources_against")


def claim_summary(statuses: DataFrame) -> DataFrame:
    """(claim_id, relationship, summary), never stronger than the weakest assertion."""
    s = F.col("status")
    forward, against = s.isin("supported", "qualified_support"), s.isin("contradicted", "qualified_contradiction")
    g = statuses.groupBy("claim_id").agg(F.bool_and(s == "supported").alias("all_for"), F.bool_and(s == "contradicted").alias("all_against"), F.bool_and(s == "insufficient").alias("none"), F.bool_or(s == "contested").alias("contested"), F.bool_or(forward).alias("f"), F.bool_or(against).alias("a"), F.bool_or(s.isin("supported", "contradicted")).alias("firm"))
    pair = (
        F.when(F.col("all_for"), F.array(F.lit("supported"), F.lit("established")))
        .when(F.col("all_against"), F.array(F.lit("contradicted"), F.lit("established")))
        .when(F.col("none"), F.array(F.lit("insufficient"), F.lit("unresolved")))
        .when(F.col("contested"), F.array(F.when(F.col("f") | F.col("a"), "qualified").otherwise("insufficient"), F.lit("contested")))
        .when(F.col("f") & F.col("a"), F.array(F.lit("qualified"), F.lit("contested")))
        .when(F.col("firm"), F.array(F.lit("qualified"), F.when(F.col("a"), "partially_contradicted").otherwise("partially_established")))
        .otherwise(F.array(F.lit("qualified"), F.when(F.col("a"), "qualified_contradiction").otherwise("qualified_support")))
    )
    return g.select("claim_id", pair[0].alias("relationship"), pair[1].alias("summary"))


def confirm_support(judgments: DataFrame, second: DataFrame) -> DataFrame:
    """judgments (assertion_id, unit_id, relation, counted, confidence) with near misses of support promoted where the second reader's score (assertion_id, unit_id, score) is high."""
    near = (F.col("relation") == "states") & ~F.col("counted") & (F.col("confidence") >= NEAR_MISS)
    return judgments.join(second, ["assertion_id", "unit_id"], "left").withColumn("counted", F.col("counted") | (near & (F.coalesce("score", F.lit(0.0)) >= CONFIRMED))).drop("score")
