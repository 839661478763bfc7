"""Reading packets, their annotations, judged pairs and what is made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.functions.roles import ROLES

def ordered_union(a: Column, b: Column) -> Column:
    """Members of a, then those of b, each at its first place."""
    return F.array_distinct(F.concat(F.coalesce(a, F.array()), F.coalesce(b, F.array())))


def research_packet(sources: DataFrame, public: Column) -> DataFrame:
    """sources (id, temporal_status, excerpts, assertion_passages, reading_passages) as read: later publications, non-public addresses and sources without text go; context_excerpts are the reading passages that aren't excerpts."""
    excerpts = ordered_union(F.col("excerpts"), F.col("assertion_passages"))
    held = sources.where(F.coalesce(F.col("temporal_status") != "later_publication", F.lit(True)) & (public != "")).withColumn("excerpts", excerpts)
    context = F.array_except(F.array_distinct(F.coalesce("reading_passages", F.array())), "excerpts")
    return held.withColumn("context_excerpts", context).where((F.size("excerpts") > 0) | (F.size("context_excerpts") > 0)).drop("assertion_passages", "reading_passages")


def reading_units(packet: DataFrame, spans) -> DataFrame:
    """(source_id, passage_id, origin, unit_id, text, start, end): passages numbered from 1 inside a source, excerpts first, their sentences inside the passage. spans gives the sentences of a text as structs (text, start, end)."""
    both = F.concat(F.transform("excerpts", lambda t: F.struct(F.lit("assertion").alias("origin"), t.alias("text"))), F.transform("context_excerpts", lambda t: F.struct(F.lit("context").alias("origin"), t.alias("text"))))
    passages = packet.select(F.col("id").cast("string").alias("source_id"), F.posexplode(both).alias("p", "passage")).select("source_id", F.concat_ws(":p", "source_id", (F.col("p") + 1).cast("string")).alias("passage_id"), "passage.origin", F.col("passage.text").alias("passage"))
    units = passages.select("source_id", "passage_id", "origin", F.posexplode(spans(F.col("passage"))).alias("u", "s"))
    return units.select("source_id", "passage_id", "origin", F.concat_ws(":u", "passage_id", (F.col("u") + 1).cast("string")).alias("unit_id"), "s.text", "s.start", "s.end")


def role_problems(units: DataFrame, annotations: DataFrame) -> DataFrame:
    """(unit_id, problem) of all that keeps annotations (unit_id, roles) from being one valid role set for each unit."""
    counted = annotations.groupBy("unit_id").agg(F.count("*").alias("n"), F.first("roles").alias("roles"))
    both = units.select("unit_id", F.lit(1).alias("known")).join(counted, "unit_id", "full")
    bad = (F.size("roles") == 0) | (F.size(F.array_distinct("roles")) < F.size("roles")) | F.exists("roles", lambda r: ~r.isin(*ROLES)) | (F.array_contains("roles", "unknown") & (F.size("roles") > 1)) | F.col("roles").isNull()
    problem = F.when(F.col("n").isNull(), "omitted").when(F.col("known").isNull(), "invented").when(F.col("n") > 1, "repeated").when(bad, "invalid_roles")
    return both.select("unit_id", problem.alias("problem")).where("problem is not null")


def pairs_to_judge(assertions: DataFrame, units: DataFrame) -> DataFrame:
    """Each assertion (claim, assertion_id) with each eligible unit (claim, unit_id, eligible) of its claim: an equality on the claim."""
    return assertions.join(units.where("eligible").drop("eligible"), "claim")


def role_agreement(rows: DataFrame) -> DataFrame:
    """(role, tp, fp, fn, precision, recall, support) of role sets got against wanted."""
    marked = rows.select(F.explode(F.array_union("got", "wanted")).alias("role"), "got", "wanted").select("role", F.array_contains("got", F.col("role")).alias("g"), F.array_contains("wanted", F.col("role")).alias("w"))
    sums = marked.groupBy("role").agg(F.count_if(F.col("g") & F.col("w")).alias("tp"), F.count_if(F.col("g") & ~F.col("w")).alias("fp"), F.count_if(~F.col("g") & F.col("w")).alias("fn"))
    share = lambda of: F.round(F.col("tp") / F.greatest(F.col("tp") + F.col(of), F.lit(1)), 6)
    return sums.select("role", "tp", "fp", "fn", share("fp").alias("precision"), share("fn").alias("recall"), (F.col("tp") + F.col("fn")).alias("support"))


def basis(rows: DataFrame) -> DataFrame:
    """(assertion_id, basis): the independent sources that corroborate an assertion, each with the date of its first row. rows: assertion_id, pos, independent_source, published_at."""
    first = rows.groupBy("assertion_id", "independent_source").agg(F.min(F.struct("pos", "published_at")).alias("f"))
    named = F.array_sort(F.collect_list(F.struct(F.col("f.pos"), F.concat(F.col("independent_source"), F.lit(" (published "), F.col("f.published_at"), F.lit(")")).alias("s"))))
    joined = first.groupBy("assertion_id").agg(F.count("*").alias("n"), F.array_join(F.transform(named, lambda x: x["s"]), ", ").alias("s"))
    return joined.select("assertion_id", F.when(F.col("n") == 1, F.concat(F.lit("one source: "), "s")).otherwise(F.concat(F.col("n").cast("string"), F.lit(" independent sources: "), "s")).alias("basis"))


def expectation_report(expected: DataFrame, candidate: DataFrame, moved: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row of counts: what must be retained (kind must_retain) and isn't a candidate, what must go (must_drop) and hasn't moved, what is named twice, in both kinds or unknown. All by key."""
    state = expected.groupBy("key").agg(F.count_if(F.col("kind") == "must_retain").alias("r"), F.count_if(F.col("kind") == "must_drop").alias("d"))
    for name, rows in (("candidate", candidate), ("moved", moved), ("baseline", baseline)):
        state = state.join(rows.select("key").distinct().withColumn(name, F.lit(True)), "key", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return state.agg(
        F.count_if((F.col("r") > 0) & ~flag("candidate")).alias("withheld"),
        F.count_if((F.col("d") > 0) & ~flag("moved")).alias("remaining"),
        F.count_if((F.col("r") > 1) | (F.col("d") > 1)).alias("repeated"),
        F.count_if((F.col("r") > 0) & (F.col("d") > 0)).alias("contradictory"),
        F.count_if(~flag("baseline")).alias("unknown"),
    )


def question_rows(claims: DataFrame) -> DataFrame:
    """(id, label, claim, evidence, gold_resolved): each (q, a) of claims.questions as a one-sentence page "Question i"; what a human assembled is the gold too."""
    evidence = F.transform("questions", lambda x, i: F.struct(F.concat(F.lit("Question "), (i + 1).cast("string")).alias("title"), i.cast("int").alias("idx"), F.trim(F.concat_ws(" ", x["q"], x["a"])).alias("text")))
    return claims.select("id", "label", F.col("text").alias("claim"), evidence.alias("evidence"), (F.size("questions") > 0).alias("gold_resolved"))


def variant_evidence(rows: DataFrame, variant: str, budget: int, words=None) -> DataFrame:
    """rows (id, claim, retrieved, gold: arrays of (title, idx, text)) with evidence: nothing (claim_only), the retrieved prefix that fits the budget (retrieved), or the gold first and then the rest (gold): never less than the gold, never more rows than were retrieved unless the gold itself has."""
    words = words or (lambda text: F.size(F.split(F.trim(text), r"\s+")))
    if variant == "claim_only":
        return rows.withColumn("evidence", F.slice("retrieved", 1, 0))
    if variant not in ("retrieved", "gold"):
        raise ValueError(f"unknown variant {variant!r}")
    named = lambda a: F.transform(a, lambda x: F.struct(x["title"], x["idx"]))
    fill = F.filter("retrieved", lambda x: ~F.array_contains(named(F.col("gold")), F.struct(x["title"], x["idx"])))
    whole = F.col("retrieved") if variant == "retrieved" else F.when(F.size("gold") > 0, F.concat("gold", fill)).otherwise(F.col("retrieved"))
    held = rows.withColumn("_all", whole)
    # sums of a prefix only grow, so those within the budget are the longest prefix that fits
    step = lambda a, x: F.struct((a["used"] + words(x["text"])).alias("used"), (a["n"] + (a["used"] + words(x["text"]) <= budget).cast("int")).alias("n"))
    n = F.aggregate("_all", F.struct(words(F.col("claim")).alias("used"), F.lit(0).alias("n")), step)["n"]
    if variant == "gold":
        n = F.when(F.size("gold") > 0, F.least(F.greatest(F.size("gold"), n), F.greatest(F.size("gold"), F.size("retrieved")))).otherwise(n)
    return held.withColumn("evidence", F.slice("_all", F.lit(1), n)).drop("_all")
