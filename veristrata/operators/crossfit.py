"""Calibrators that are fitted without the rows they score, and the choice between them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.operators import calibration as C
from veristrata.operators import metrics as M

LEAST_P = 1e-12


def temperature(rows: DataFrame, classes: int) -> Callable[[DataFrame], DataFrame]:
    t = C.fit_temperature(rows)
    return lambda held: held.withColumn("p", M.softmax(F.transform("logits", lambda x: x / t)))


def vector(rows: DataFrame, classes: int) -> Callable[[DataFrame], DataFrame]:
    t, bias = C.fit_vector_scaling(rows, classes)
    shift = F.array(*[F.lit(float(b)) for b in bias])
    return lambda held: held.withColumn("p", M.softmax(F.transform("logits", lambda x, i: x / t + F.element_at(shift, i + 1))))


def identity(rows: DataFrame, classes: int) -> Callable[[DataFrame], DataFrame]:
    return lambda held: held.withColumn("p", M.softmax(F.col("logits")))


def _interpolated(x: Column, knots: Column) -> Column:
    """The height at x of the line through knots (array of (x, y), in order); flat outside."""
    below = F.filter(knots, lambda k: k["x"] <= x)
    above = F.filter(knots, lambda k: k["x"] > x)
    a, b = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    return F.when(a.isNull(), b["y"]).when(b.isNull(), a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * (x - a["x"]) / (b["x"] - a["x"]))


def isotonic(rows: DataFrame, classes: int) -> Callable[[DataFrame], DataFrame]:
    """One fit for each class against the rest, made to sum to one again; a row that is zero in every class keeps its softmax.

    Only the ends of a fit's flat runs are kept, so the joined table is a row with a few knots for each class.
    """
    from pyspark.sql import Window

    parts = rows.select(F.posexplode(M.softmax(F.col("logits"))).alias("class", "score"), "label").withColumn("hit", F.col("class") == F.col("label"))
    fits = C.isotonic_knots(parts, "class", "score", "hit")
    line = Window.partitionBy("class").orderBy("x")
    ends = fits.withColumns({"_a": F.lag("y").over(line), "_b": F.lead("y").over(line)}).where("_a is null or _b is null or _a <> y or _b <> y")
    knots = ends.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("class", "k"))), lambda s: s["k"]).alias("_knots"))

    def apply(held: DataFrame) -> DataFrame:
        scored = held.withColumn("_soft", M.softmax(F.col("logits"))).crossJoin(F.broadcast(knots))
        scored = scored.withColumn("_raw", F.transform("_soft", lambda x, i: _interpolated(x, F.element_at("_knots", i + 1))))
        scored = scored.withColumn("_sum", F.aggregate("_raw", F.lit(0.0), lambda a, x: a + x))
        return scored.withColumn("p", F.when(F.col("_sum") > 0, F.transform("_raw", lambda x: x / F.col("_sum"))).otherwise(F.col("_soft"))).drop("_soft", "_knots", "_raw", "_sum")

    return apply


CALIBRATORS = {"none": identity, "temperature": temperature, "vector": vector, "isotonic": isotonic}


def out_of_fold(rows: DataFrame, folds: int, classes: int, name: str) -> DataFrame:
    """rows (id, logits, label, fold) with p from a fit on the rows of all other folds."""
    if folds < 2:
        raise ValueError("two folds at least")
    return functools.reduce(DataFrame.unionByName, [CALIBRATORS[name](rows.where(F.col("fold") != f), classes)(rows.where(F.col("fold") == f)) for f in range(folds)])


def calibrator_losses(rows: DataFrame, folds: int, classes: int, names: list[str] | None = None) -> DataFrame:
    """(name, nll, chosen): the out-of-fold loss of each calibrator, its probabilities held above LEAST_P and made to sum to one again; the least is chosen, the first named on ties."""
    names = names or list(CALIBRATORS)
    parts = []
    for place, name in enumerate(names):
        p = F.transform("p", lambda x: F.greatest(x, F.lit(LEAST_P)))
        total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
        own = out_of_fold(rows, folds, classes, name).agg(F.round(F.avg(F.log(total) - F.log(F.element_at(p, F.col("label") + 1))), 6).alias("nll"))
        parts.append(own.select(F.lit(name).alias("name"), F.lit(place).alias("place"), "nll"))
    found = functools.reduce(DataFrame.unionByName, parts)
    best = found.agg(F.min(F.struct("nll", "place")).alias("b"))
    return found.crossJoin(F.broadcast(best)).select("name", "nll", (F.col("place") == F.col("b.place")).alias("chosen"))


def out_of_fold_auc(rows: DataFrame, folds: int, names: list[str], positive: str) -> DataFrame:
    """The AUC of a logistic model of these features, each row scored by a fit on the other folds."""
    scored = [rows.where(F.col("fold") == f).withColumn("score", C.sufficiency(C.standardised_logistic(rows.where(F.col("fold") != f), names, positive))) for f in range(folds)]
    return M.roc_auc(functools.reduce(DataFrame.unionByName, scored), "score", positive)
