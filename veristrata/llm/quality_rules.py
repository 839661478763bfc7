"""Learned decision lists over text statistics, as ordered Spark conditional expressions.

Statistics, training and scoring are DataFrame expressions throughout. Training takes at most SAMPLE labelled rows (those
with the smallest hash of their doc_id, so the choice doesn't depend on partitions), cuts each statistic at quantiles and
aggregates the rows by the cells that result. Sequential covering then grows one conjunction of thresholds after
another on two thirds of the cells' rows by information gain, prunes its last conditions while precision on the other third doesn't
fall, and removes what the rule covers. What no rule covers is kept.

Defined results: a null text has no words, and its row fails the base conditions; empty labels give an empty list, so
that the base conditions alone decide; labels that name a doc_id twice count once for each distinct value; extra
columns of the input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.llm.common import materialise

#: Labelled rows that a list is learned from, at most.
SAMPLE = 20_000
CUTS = 12
MOST_RULES = 6
MOST_CONDITIONS = 3
#: A rule is taken if this share of what it covers is low quality.
PRECISION = 0.75
LEAST_COVER = 8
WINDOW = 5

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def word_statistics(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id, the carry columns and the five counts of whole texts.

    A text without two equal 5-word windows, told by their hashes, has no repeated words; the others' windows are sorted
    as strings and the places of repeated ones united.
    """
    def window(i: str) -> str:
        return ", ".join(f"ws[{i} + {k}]" for k in range(WINDOW))

    # `transform(array(x), v -> f(v))[0]` computes x once. Everything hangs on one expression, so that a filter which
    # the optimiser pushes below it may compute a row's statistics again but never a text's words for each window.
    words = "filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"
    lines = "filter(split(text, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    hashes = f"transform(sequence(0, size(ws) - {WINDOW}), i -> xxhash64({window('i')}))"
    spans = f"""transform(array(array_sort(transform(sequence(0, size(ws) - {WINDOW}),
            i -> named_struct('w', concat_ws(' ', {window('i')}), 'at', i)))), s ->
        aggregate(
            array_sort(transform(filter(sequence(0, size(s) - 1), k -> (k > 0 and s[k].w = s[k - 1].w)
                or (k < size(s) - 1 and s[k].w = s[k + 1].w)), k -> s[k].at)),
            named_struct('edge', -{WINDOW}, 'total', 0L),
            (a, at) -> named_struct('edge', at, 'total', a.total + least({WINDOW}, at - a.edge)),
            a -> a.total))[0]"""
    statistics = f"""transform(array({words}), ws -> named_struct(
        'n_words', cast(size(ws) as long),
        'word_chars', aggregate(ws, 0L, (a, w) -> a + length(w)),
        'n_symbols', cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '')) as long),
        'n_dup_lines', transform(array({lines}), ls -> cast(size(ls) - size(array_distinct(ls)) as long))[0],
        'n_repeat_words', case when size(ws) < {WINDOW} then 0L else transform(array({hashes}), h ->
            case when size(array_distinct(h)) = size(h) then 0L else {spans} end)[0] end))[0]"""
    named = docs.select("doc_id", *(carry or []), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return named.select("doc_id", *(carry or []), F.expr(statistics).alias("_s")).select("doc_id", *(carry or []), "_s.*")


def base_failed() -> Column:
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


#: The statistics that rules may test, as SQL over the five counts.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.cut!r}D"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered: int
    low: int

    def sql(self) -> str:
        return " and ".join(c.sql() for c in self.conditions)


def decision(rules: list[Rule]) -> Column:
    """True where a document is kept: the first rule that holds rejects it."""
    out = None
    for rule in rules:
        out = F.when(F.expr(rule.sql()), F.lit(False)) if out is None else out.when(F.expr(rule.sql()), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _gain(low: float, all_: float, low0: float, all0: float) -> float:
    """FOIL's information gain of narrowing a rule from (low0, all0) to (low, all_)."""
    if not low:
        return float("-inf")
    return low * (math.log2(low / all_) - math.log2(low0 / all0))


def _covers(conditions: tuple, cell: dict, cuts: dict) -> bool:
    return all((cell[c.feature] > cuts[c.feature].index(c.cut)) == c.above for c in conditions)


def cover(cells: list[dict], cuts: dict[str, list[float]]) -> list[Rule]:
    """The rules, in order. A cell has a bin for each feature (the number of cuts below its values) and the counts grow_low, grow_all, prune_low, prune_all."""
    rules: list[Rule] = []
    rest = cells
    choices = [Condition(f, above, cut) for f, found in cuts.items() for cut in found for above in (True, False)]
    while len(rules) < MOST_RULES:
        taken, inside = (), rest
        while len(taken) < MOST_CONDITIONS:
            low0, all0 = sum(c["grow_low"] for c in inside), sum(c["grow_all"] for c in inside)
            if not low0 or low0 == all0:
                break
            best, gain = None, 1e-9
            for choice in choices:
                narrowed = [c for c in inside if _covers((choice,), c, cuts)]
                all_ = sum(c["grow_all"] for c in narrowed)
                if all_ >= LEAST_COVER and all_ < all0 and (g := _gain(sum(c["grow_low"] for c in narrowed), all_, low0, all0)) > gain:
                    best, gain, kept = choice, g, narrowed
            if best is None:
                break
            taken, inside = (*taken, best), kept

        def precision(conditions: tuple) -> float:
            found = [c for c in rest if _covers(conditions, c, cuts)]
            return (sum(c["prune_low"] for c in found) + 1) / (sum(c["prune_all"] for c in found) + 2)

        while len(taken) > 1 and precision(taken[:-1]) >= precision(taken):
            taken = taken[:-1]
        inside = [c for c in rest if taken and _covers(taken, c, cuts)]
        low, all_ = sum(c["grow_low"] + c["prune_low"] for c in inside), sum(c["grow_all"] + c["prune_all"] for c in inside)
        if not taken or all_ < LEAST_COVER or low < PRECISION * all_:
            break
        rules.append(Rule(taken, all_, low))
        rest = [c for c in rest if not _covers(taken, c, cuts)]
    return rules


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """A decision list from at most sample labelled documents."""
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").distinct()
    chosen = known.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id", "quality").limit(sample).select("doc_id", "quality", "_h")
    chosen = materialise(chosen, "chosen")
    rows = word_statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), ["quality", "_h"])
    rows = materialise(rows, "statistics")
    rows = materialise(rows.where(~base_failed()).select("quality", "_h", *[F.expr(e).alias(f) for f, e in FEATURES.items()]), "features")
    steps = [i / (CUTS + 1) for i in range(1, CUTS + 1)] + [0.97, 0.99]
    found = rows.agg(*[F.percentile(F.col(f), F.array(*map(F.lit, steps))).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(found[f] or [])) for f in FEATURES}
    if not any(cuts.values()):
        return []
    bins = [sum((F.col(f) > F.lit(c)).cast("int") for c in cuts[f]).alias(f) if cuts[f] else F.lit(0).alias(f) for f in FEATURES]
    grow = F.pmod("_h", F.lit(3)) != 0
    cells = rows.select(*bins, (F.col("quality") == 0).alias("low"), grow.alias("grow")).groupBy(*FEATURES).agg(
        F.expr("count_if(low and grow)").alias("grow_low"),
        F.expr("count_if(grow)").alias("grow_all"),
        F.expr("count_if(low and not grow)").alias("prune_low"),
        F.expr("count_if(not grow)").alias("prune_all"),
    )
    return cover([r.asDict() for r in cells.collect()], cuts)


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the five counts, base_failed and kept of each document."""
    rules = learn(docs, labels, sample)
    out = word_statistics(docs).withColumn("base_failed", base_failed())
    return out.select("doc_id", *_COUNTS, "base_failed", (~F.col("base_failed") & decision(rules)).alias("kept"))
