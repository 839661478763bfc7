"""Batch forms of the transcript operators: latest revisions, speaker context, click windows, word budgets, replay times."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTEXT = 2
REFERENCES = 8
CLICK_SECONDS = 30
WORDS_PER_MINUTE = 150
CONTEXT_WORDS = 48


def latest_revisions(updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of the greatest order values for each key: an aggregate, so a hot key is combined before the shuffle."""
    rest = [c for c in updates.columns if c not in keys and c not in order]
    return updates.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("r")).select(*keys, "r.*")


def revision_conflicts(updates: DataFrame) -> DataFrame:
    """(id, revision) given with more than one content, and ids whose start moved."""
    same = updates.groupBy("id", "revision").agg(F.countDistinct("text", "start", "end", "final", "speaker").alias("n")).where("n > 1").select("id", "revision", F.lit("conflicting_content").alias("problem"))
    moved = updates.groupBy("id").agg(F.countDistinct("start").alias("n")).where("n > 1").select("id", F.lit(None).cast("long").alias("revision"), F.lit("moved_start").alias("problem"))
    return same.unionByName(moved)


def speaker_context(segments: DataFrame, size: int = CONTEXT) -> DataFrame:
    """segments (session, id, speaker, start, end, final) with preceding: up to size final segments of the speaker that had begun before it and ended by its start, however many others overlap.

    Final segments are numbered in the order (end, start, id) of their speaker. Merged with the starts into one timeline, a running
    count tells how many had ended, so the last of them are joined by number.
    """
    keys = ["session", "speaker"]
    begun = F.when(F.col("start") < F.col("end"), 0).otherwise(2)  # a segment without length ends after what starts with it
    ends = segments.where("final").select(*keys, F.col("end").alias("t"), begun.alias("kind"), F.col("start").alias("s"), "id")
    starts = segments.select(*keys, F.col("start").alias("t"), F.lit(1).alias("kind"), F.col("start").alias("s"), "id").distinct()
    line = Window.partitionBy(*keys).orderBy("t", "kind", "s", "id").rowsBetween(Window.unboundedPreceding, 0)
    placed = ends.unionByName(starts).withColumn("place", F.sum(F.when(F.col("kind") == 1, 0).otherwise(1)).over(line))
    numbers = placed.where("kind <> 1").select(*keys, "place", F.col("id").alias("held"))
    asked = placed.where("kind = 1 and place > 0").select(*keys, F.col("s").alias("start"), "id", F.explode(F.sequence(F.greatest(F.col("place") - (size - 1), F.lit(1)), "place")).alias("place"))
    asked, numbers, held = (frame.toDF(*[f"{p}_{c}" for c in frame.columns]) for p, frame in (("a", asked), ("n", numbers), ("s", segments)))
    same = functools.reduce(operator.and_, [F.col(f"a_{c}").eqNullSafe(F.col(f"n_{c}")) for c in (*keys, "place")])
    groups = [f"a_{c}" for c in (*keys, "start", "id")]
    found = asked.join(numbers, same).groupBy(*groups).agg(F.transform(F.sort_array(F.collect_list(F.struct("a_place", "n_held"))), lambda x: x["n_held"]).alias("preceding"))
    on = functools.reduce(operator.and_, [F.col(f"s_{c}").eqNullSafe(F.col(f"a_{c}")) for c in (*keys, "start", "id")])
    none = F.array().cast(found.schema["preceding"].dataType)
    return held.join(found, on, "left").select(*[F.col(f"s_{c}").alias(c) for c in segments.columns], F.coalesce("preceding", none).alias("preceding"))


def click_window(clicks: DataFrame, cues: DataFrame, seconds: int = CLICK_SECONDS) -> DataFrame:
    """Each click (key, click_id, at) with the cues (key, cue_id, end) that ended in (at - seconds, at].

    The range becomes an equality: a cue lies in one slot of `seconds`, a click looks at its own slot and the one before.
    """
    placed = cues.withColumn("slot", F.floor(F.col("end") / seconds))
    asked = clicks.withColumn("slot", F.explode(F.array(F.floor(F.col("at") / seconds), F.floor(F.col("at") / seconds) - 1)))
    return asked.join(placed, ["key", "slot"]).where((F.col("end") <= F.col("at")) & (F.col("end") > F.col("at") - seconds)).drop("slot")


def stale_clicks(clicks: DataFrame, cues: DataFrame, seconds: int = 8) -> DataFrame:
    """Clicks whose newest cue ended more than `seconds` before them, or that have none."""
    newest = cues.select("key", F.col("end").alias("t"), F.lit(None).cast("long").alias("click_id")).unionByName(clicks.select("key", F.col("at").alias("t"), "click_id"))
    order = Window.partitionBy("key").orderBy("t", F.col("click_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = newest.withColumn("last", F.last(F.when(F.col("click_id").isNull(), F.col("t")), ignorenulls=True).over(order))
    return seen.where(F.col("click_id").isNotNull() & (F.col("last").isNull() | (F.col("last") < F.col("t") - seconds))).select("key", "click_id")


def word_budget(turns: DataFrame, by: str, order: str, text: str, words: int = CONTEXT_WORDS) -> DataFrame:
    """turns with context: the last `words` words of the turns before, from the oldest kept on."""
    split = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    held = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), split.alias("w"))).over(before)), lambda s: s["w"]))
    start = F.greatest(F.size(held) - (words - 1), F.lit(1))
    return turns.withColumn("context", F.array_join(F.slice(held, start, F.lit(words)), " "))


def replay_times(sentences: DataFrame, by: str, order: str, text: str, rate: float = WORDS_PER_MINUTE) -> DataFrame:
    """sentences with start and end in seconds, at `rate` words a minute."""
    count = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    upto = F.sum(count).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return sentences.withColumn("end", upto * 60 / rate).withColumn("start", F.col("end") - count * 60 / rate)


def most_recent_worthy(rows: DataFrame, by: str, order: str, worthy: Column, most: int = 3) -> DataFrame:
    """rows from the latest back, until `most` worthy ones are met; unworthy ones take no place."""
    after = Window.partitionBy(by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("worthy", worthy).withColumn("met", F.coalesce(F.sum(F.col("worthy").cast("int")).over(after), F.lit(0))).where(F.col("met") < most).drop("met")
