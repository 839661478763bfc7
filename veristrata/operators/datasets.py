"""Dataset building: gold groups, rows, labelled pairs, regrounding, augmentation, validation.

Random choices are hash ranks of a seed and the rows' ids, so they are the same for any partitioning; a generator's
stream has no distributed form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veristrata.functions import claims as K

RELATIONS = {"SUPPORTS": "states", "REFUTES": "states_negation"}
FLIPPED = {"states": "states_negation", "bears_on": "bears_on", "unrelated": "unrelated"}
PAIR_RELATIONS = ("states", "states_negation", "bears_on", "unrelated")


def draw(seed: int, *keys: Column | str) -> Column:
    """A hash of seed and keys, to rank by."""
    return F.sha1(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]).cast("binary"))


def smallest_gold(groups: DataFrame, sentences: DataFrame) -> DataFrame:
    """(id, grp, size) of each claim's smallest gold group whose members (id, grp, page, sent) are all in sentences; the first of equals."""
    met = groups.join(sentences.select("page", "sent", F.lit(True).alias("found")), ["page", "sent"], "left")
    whole = met.groupBy("id", "grp").agg(F.count("*").alias("size"), F.count("found").alias("n")).where("n = size")
    return whole.groupBy("id").agg(F.min(F.struct("size", "grp")).alias("g")).select("id", "g.grp", "g.size")


def must_have(claims: DataFrame, retrieved: DataFrame) -> DataFrame:
    """claims joined with their evidence (id, evidence); one without raises."""
    missing = F.raise_error(F.concat(F.lit("no retrieved evidence for claim "), F.col("id").cast("string")))
    return claims.join(retrieved, "id", "left").withColumn("evidence", F.when(F.col("evidence").isNull(), missing).otherwise(F.col("evidence")))


def grounded(rows: DataFrame, evidence: DataFrame, groups: DataFrame) -> DataFrame:
    """rows (id, label, budget) with grounded: whether some whole gold group stands within the first budget evidence rows (id, page, sent, rank). NEI rows always are."""
    met = groups.join(evidence, ["id", "page", "sent"], "left").join(rows.select("id", "budget"), "id")
    whole = met.groupBy("id", "grp").agg(F.bool_and(F.coalesce(F.col("rank") <= F.col("budget"), F.lit(False))).alias("w")).groupBy("id").agg(F.bool_or("w").alias("w"))
    return rows.join(whole, "id", "left").withColumn("grounded", (F.col("label") == "NOT ENOUGH INFO") | F.coalesce("w", F.lit(False))).drop("w")


def reground(rows: DataFrame, mode: str = "nei") -> DataFrame:
    """Rows that aren't grounded are relabelled or dropped."""
    if mode not in ("nei", "drop"):
        raise ValueError("mode must be nei or drop")
    if mode == "drop":
        return rows.where("grounded")
    return rows.withColumn("label", F.when(F.col("grounded"), F.col("label")).otherwise("NOT ENOUGH INFO"))


def first_pairs(pairs: DataFrame) -> DataFrame:
    """One pair for each premise and hypothesis: the first by kind, then id."""
    own = Window.partitionBy("premise", "hypothesis").orderBy("kind", "id")
    return pairs.where("premise <> hypothesis").withColumn("n", F.row_number().over(own)).where("n = 1").drop("n")


def claim_pairs(claims: DataFrame, evidence: DataFrame, gold: DataFrame, seed: int, gold_each: int = 2, bears_each: int = 1, unrelated_each: int = 1) -> DataFrame:
    """Pairs of claims (id, label, text, key) and sentences: single-sentence gold, retrieved but not gold, and unrelated.

    evidence: id, page, sent, text. gold: id, page, sent (members of one-sentence groups; all of a claim's gold pages count as its own). An unrelated sentence comes
    from the next claim in a hash ring whose pages are disjoint; the ring's shifts are tried in order, so no claim meets all others.
    """
    named = claims.select("id", "label", F.col("text").alias("hypothesis"), F.col("key").alias("grp"))
    singles = gold.join(evidence, ["id", "page", "sent"]).withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("page", "sent"))).where(F.col("n") <= gold_each)
    relation = F.when(F.col("label") == "SUPPORTS", "states").when(F.col("label") == "REFUTES", "states_negation")
    one = named.join(singles.select("id", "page", "sent", "text"), "id").withColumn("relation", relation).where("relation is not null").withColumn("kind", F.lit("a_gold"))
    rest = evidence.join(gold.select("id", "page", "sent"), ["id", "page", "sent"], "left_anti")
    rest = rest.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(draw(seed, "id", "page", "sent")))).where(F.col("n") <= bears_each)
    two = named.join(rest.select("id", "page", "sent", "text"), "id").withColumn("relation", F.lit("bears_on")).withColumn("kind", F.lit("b_retrieved"))
    pages = evidence.select("id", "page").unionByName(gold.select("id", "page")).groupBy("id").agg(F.collect_set("page").alias("pages"))
    donors = evidence.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(draw(seed + 1, "id", "page", "sent")))).where("n = 1").select("id", "page", "sent", "text")
    ring = pages.join(donors, "id", "left").withColumn("place", F.row_number().over(Window.orderBy(draw(seed + 2, "id"))))
    size = ring.agg(F.count("*").alias("size"))
    tries = ring.select("id", "pages", "place").crossJoin(F.broadcast(size)).withColumn("shift", F.explode(F.sequence(F.lit(1), F.lit(20)))).withColumn("other", (F.col("place") + F.col("shift") - 1) % F.col("size") + 1)
    met = tries.join(ring.select(F.col("place").alias("other"), F.col("id").alias("donor"), F.col("pages").alias("their"), "page", "sent", "text"), "other").where("donor <> id and page is not null and not arrays_overlap(pages, their)")
    found = met.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("shift"))).where(F.col("n") <= unrelated_each)
    three = named.join(found.select("id", "page", "sent", "text"), "id").withColumn("relation", F.lit("unrelated")).withColumn("kind", F.lit("c_unrelated"))
    both = one.unionByName(two).unionByName(three)
    columns = [F.concat_ws(":", F.lit("fever"), "id", "kind", "page", "sent").alias("id"), "relation", F.col("text").alias("premise"), "hypothesis", "grp", "kind", K.negated(F.col("hypothesis")).alias("negated")]
    return first_pairs(both.select(*columns))


def swap_pairs(rows: DataFrame, seed: int, every: int = 3) -> DataFrame:
    """Every third row (pos, pair_id, genre, premise, hypothesis) takes the premise of a row of the next genre, as unrelated."""
    genres = rows.select("genre").distinct().withColumn("g", F.row_number().over(Window.orderBy("genre")) - 1)
    size = genres.agg(F.count("*").alias("m"))
    ranked = rows.join(genres, "genre").withColumn("r", F.row_number().over(Window.partitionBy("genre").orderBy(draw(seed, "pair_id"))) - 1)
    per = rows.groupBy("genre").agg(F.count("*").alias("c")).join(genres, "genre").select(F.col("g").alias("dg"), "c")
    asked = ranked.where(F.pmod("pos", F.lit(every)) == 0).crossJoin(F.broadcast(size)).where("m > 1").withColumn("dg", (F.col("g") + 1) % F.col("m")).join(per, "dg").withColumn("dr", F.col("r") % F.col("c"))
    donors = ranked.select(F.col("g").alias("dg"), F.col("r").alias("dr"), F.col("premise").alias("other"), F.col("pair_id").alias("donor"))
    return asked.join(donors, ["dg", "dr"]).select(F.concat_ws(":", "pair_id", F.lit("unrelated"), "donor").alias("id"), F.lit("unrelated").alias("relation"), F.col("other").alias("premise"), "hypothesis")


def negation_augment(pairs: DataFrame, rate: float, seed: int, existing: DataFrame) -> DataFrame:
    """New pairs with negated hypotheses for a hash-drawn share of pairs that permit it and that no split (existing: premise, hypothesis) has."""
    flipped = F.create_map(*[F.lit(x) for pair in FLIPPED.items() for x in pair])
    share = F.conv(F.substring(draw(seed, "id"), 1, 8), 16, 10).cast("long") / 2**32
    made = pairs.where(F.col("relation").isin(*FLIPPED) & ~F.col("negated") & (share < rate)).select(F.concat("id", F.lit(":neg")).alias("id"), flipped[F.col("relation")].alias("relation"), "premise", K.negate_form(F.col("hypothesis")).alias("hypothesis"), "grp", F.lit(True).alias("negated"))
    made = made.where("hypothesis is not null").join(existing.select("premise", "hypothesis"), ["premise", "hypothesis"], "left_anti")
    return made.withColumn("n", F.row_number().over(Window.partitionBy("premise", "hypothesis").orderBy("id"))).where("n = 1").drop("n")


def fresh_pairs(news: DataFrame, base: DataFrame) -> DataFrame:
    """Distinct news pairs (premise, hypothesis, relation) that base lacks; one read two ways raises."""
    once = news.groupBy("premise", "hypothesis").agg(F.min("relation").alias("relation"), F.max("relation").alias("other"))
    checked = F.when(F.col("relation") == F.col("other"), F.col("relation")).otherwise(F.raise_error(F.lit("a pair has two relations")))
    return once.select("premise", "hypothesis", checked.alias("relation")).join(base, ["premise", "hypothesis"], "left_anti")


def repeat_rows(rows: DataFrame, times: int) -> DataFrame:
    """rows, and times - 1 copies with numbered ids."""
    copies = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return copies.withColumn("id", F.when(F.col("k") > 0, F.concat_ws("#", "id", F.col("k").cast("string"))).otherwise(F.col("id"))).drop("k")


def pair_problems(pairs: DataFrame) -> DataFrame:
    """(problem, n) of pairs (id, split, relation, premise, hypothesis, grp): unknown relations, empty or equal texts, repeated ids or texts, groups in two splits."""
    def found(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")

    out = found(pairs.where(~F.col("relation").isin(*PAIR_RELATIONS)), "unknown_relation")
    out = out.unionByName(found(pairs.where("trim(premise) = '' or trim(hypothesis) = '' or premise = hypothesis"), "bad_text"))
    out = out.unionByName(found(pairs.groupBy("id").count().where("count > 1"), "repeated_id"))
    out = out.unionByName(found(pairs.groupBy("premise", "hypothesis").count().where("count > 1"), "repeated_pair"))
    return out.unionByName(found(pairs.groupBy("grp").agg(F.countDistinct("split").alias("s")).where("s > 1"), "split_group"))


def title_runs(evidence: DataFrame) -> DataFrame:
    """evidence (id, rank, title, ...) with run: the number of the run of neighbours of one title."""
    order = Window.partitionBy("id").orderBy("rank")
    starts = F.coalesce((F.lag("title").over(order) != F.col("title")).cast("int"), F.lit(1))
    return evidence.withColumn("s", starts).withColumn("run", F.sum("s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("s")


def pack(claims: DataFrame, evidence: DataFrame, budget: int) -> DataFrame:
    """(id, n_read): how many leading evidence rows (id, rank, title, text) fit a budget of words beside the claim (id, text); a title counts once a run, a sentence 64 words at most."""
    def words(c: Column) -> Column:
        return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))

    order = Window.partitionBy("id").orderBy("rank")
    cost = F.least(words(F.col("text")), F.lit(64)) + F.when(F.coalesce(F.lag("run").over(order) != F.col("run"), F.lit(True)), words(F.col("title"))).otherwise(0)
    upto = title_runs(evidence).withColumn("cost", cost).withColumn("upto", F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = claims.select("id", words(F.col("text")).alias("own")).join(upto, "id", "left")
    return joined.groupBy("id").agg(F.count_if(F.col("own") + F.col("upto") <= budget).alias("n_read"))


def shuffle_runs(evidence: DataFrame, seed: int) -> DataFrame:
    """evidence with new ranks: whole title runs in hash order."""
    runs = title_runs(evidence)
    return runs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(draw(seed, "id", "run"), "rank"))).drop("run")


def render(evidence: DataFrame) -> DataFrame:
    """(id, text): neighbours of one title under one "Title:", in rank order."""
    order = Window.partitionBy("id").orderBy("rank")
    readable = F.replace(F.col("title"), F.lit("_"), F.lit(" "))
    head = F.coalesce(F.lag("run").over(order) != F.col("run"), F.lit(True))
    part = F.when(head, F.concat(readable, F.lit(": "), "text")).otherwise(F.col("text"))
    return title_runs(evidence).withColumn("part", part).groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"]), " ").alias("text"))
