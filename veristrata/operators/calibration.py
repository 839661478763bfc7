"""Fitting and applying calibrators, confidence bands and the two-condition answer policy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veristrata.operators.metrics import r6, softmax

TARGETS = {"strong": 0.90, "moderate": 0.75, "weak": 0.60}
COUNTING_TARGETS = {"strong": 0.95, "moderate": 0.90, "weak": 0.85}
LEAST_SUPPORT = 30
LOWEST_T, HIGHEST_T = 0.05, 20.0
SUFFICIENT = 0.5


def nll_at(predictions: DataFrame, temperatures: list[float]) -> DataFrame:
    """(temperature, nll): mean loss of logits / temperature, all temperatures in one pass."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in temperatures])).alias("temperature")
    rows = predictions.select(F.transform("logits", lambda x: x - F.array_max("logits")).alias("z"), "label", grid)
    total = F.log(F.aggregate(F.transform("z", lambda x: F.exp(x / F.col("temperature"))), F.lit(0.0), lambda a, x: a + x))
    return rows.groupBy("temperature").agg(F.avg(total - F.element_at("z", F.col("label") + 1) / F.col("temperature")).alias("nll"))


def fit_temperature(predictions: DataFrame, steps: int = 4, width: int = 17) -> float:
    """The temperature of least loss: each pass narrows a grid on the log scale around the best of the last."""
    low, high = math.log(LOWEST_T), math.log(HIGHEST_T)
    for _ in range(steps):
        points = np.linspace(low, high, width)
        found = {r[0]: r[1] for r in nll_at(predictions, [math.exp(p) for p in points]).collect()}
        best = min(found, key=lambda t: (found[t], t))
        step = points[1] - points[0]
        low, high = max(math.log(LOWEST_T), math.log(best) - step), min(math.log(HIGHEST_T), math.log(best) + step)
    return best


def fit_vector_scaling(predictions: DataFrame, classes: int, rounds: int = 50) -> tuple[float, list[float]]:
    """(temperature, bias): the least loss of logits / T + b, by Newton steps on the whole gradient and curvature, which one aggregation gives; a step that raises the loss is halved. The bias is centred, as a constant in it changes nothing."""

    def dot(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)

    def sums(scale: float, bias: np.ndarray) -> dict:
        moved = F.transform("logits", lambda x, i: x * F.lit(float(scale)) + F.element_at(F.array(*[F.lit(float(b)) for b in bias]), i + 1))
        rows = predictions.select("logits", "label", softmax(moved).alias("p"))
        rows = rows.select("*", F.transform("p", lambda x, i: x - (i == F.col("label")).cast("double")).alias("gap"), dot("p", "logits").alias("mean"))
        found = {"loss": F.avg(-F.log(F.greatest(F.element_at("p", F.col("label") + 1), F.lit(1e-300)))), "gs": F.avg(dot("gap", "logits")), "hss": F.avg(F.aggregate(F.zip_with("p", "logits", lambda p, x: p * x * x), F.lit(0.0), lambda a, x: a + x) - F.col("mean") * F.col("mean"))}
        for k in range(classes):
            found |= {f"g{k}": F.avg(F.col("gap")[k]), f"hs{k}": F.avg(F.col("p")[k] * (F.col("logits")[k] - F.col("mean")))}
            found |= {f"h{k}_{j}": F.avg(F.col("p")[k] * ((1.0 if j == k else 0.0) - F.col("p")[j])) for j in range(k, classes)}
        return rows.agg(*[v.alias(n) for n, v in found.items()]).first().asDict()

    at, step = np.concatenate(([1.0], np.zeros(classes))), np.zeros(classes + 1)
    best = sums(at[0], at[1:])
    for _ in range(rounds if best["loss"] is not None else 0):
        gradient = np.array([best["gs"], *[best[f"g{k}"] for k in range(classes)]])
        curve = np.zeros((classes + 1, classes + 1))
        curve[0, 0] = best["hss"]
        for k in range(classes):
            curve[0, k + 1] = curve[k + 1, 0] = best[f"hs{k}"]
            for j in range(k, classes):
                curve[k + 1, j + 1] = curve[j + 1, k + 1] = best[f"h{k}_{j}"]
        step = np.linalg.solve(curve + 1e-9 * np.eye(classes + 1), gradient)
        while np.abs(step).max() > 1e-9:
            to = at - step
            to[0] = min(max(to[0], 1 / HIGHEST_T), 1 / LOWEST_T)
            to[1:] = np.clip(to[1:] - to[1:].mean(), -20, 20)
            tried = sums(to[0], to[1:])
            if tried["loss"] <= best["loss"] + 1e-12:
                break
            step = step / 2
        else:
            break
        done = best["loss"] - tried["loss"] < 1e-13
        at, best = to, tried
        if done:
            break
    return 1 / at[0], at[1:].tolist()


def minorant_slopes(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The closest non-decreasing values by weighted squares: slopes of the greatest convex curve below the running sums."""
    x, y = (np.concatenate(([0.0], np.cumsum(v))).tolist() for v in (weights, weights * values))
    corners: list[int] = []
    for i in range(len(x)):
        while len(corners) > 1:
            a, b = corners[-2:]
            if (y[b] - y[a]) * (x[i] - x[b]) < (y[i] - y[b]) * (x[b] - x[a]):
                break
            corners.pop()
        corners.append(i)
    return np.repeat(np.diff(np.take(y, corners)) / np.diff(np.take(x, corners)), np.diff(corners))


def isotonic_knots(rows: DataFrame, by: str, score: str, hit: str) -> DataFrame:
    """(by, x, y): for each group the isotonic fit of hit on score. Rows of one score are summed first, so a group is no longer than its distinct scores."""
    runs = rows.groupBy(by, F.col(score).alias("x")).agg(F.avg(F.col(hit).cast("double")).alias("y"), F.count("*").alias("w"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("x")
        return group.assign(y=minorant_slopes(group["y"].to_numpy(), group["w"].to_numpy(dtype=float)))[[by, "x", "y"]]

    return runs.groupBy(by).applyInPandas(fit, f"{by} {dict(runs.dtypes)[by]}, x double, y double")


def standardised_logistic(rows: DataFrame, names: list[str], positive: str, rounds: int = 30) -> dict:
    """Weights of a logistic model on features standardised by population deviation, penalty weight 1/n; Newton steps on aggregated sums."""
    first = rows.agg(F.count("*"), *[F.avg(n) for n in names], *[F.stddev_pop(n) for n in names]).first()
    n, means, deviations = first[0], list(first[1 : 1 + len(names)]), [d or 1.0 for d in first[1 + len(names) :]]
    x = [F.lit(1.0), *[(F.col(c) - m) / d for c, m, d in zip(names, means, deviations)]]
    w = np.zeros(len(x))
    for _ in range(rounds):
        z = sum((F.lit(float(a)) * b for a, b in zip(w, x)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
        found = list(rows.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], p.alias("p"), F.col(positive).cast("double").alias("y")).agg(*[F.avg(F.col(f"x{i}") * (F.col("p") - F.col("y"))) for i in range(len(x))], *[F.avg(F.col(f"x{i}") * F.col(f"x{j}") * F.col("p") * (1 - F.col("p"))) for i, j in pairs]).first())
        penalty = np.array([0.0] + [1.0 / n] * len(names))
        gradient = np.array(found[: len(x)]) + penalty * w
        curve = np.diag(penalty + 1e-12)
        for (i, j), value in zip(pairs, found[len(x) :]):
            curve[i, j] += value
            if i != j:
                curve[j, i] += value
        step = np.linalg.solve(curve, gradient)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return {"names": names, "means": means, "deviations": deviations, "intercept": float(w[0]), "weights": w[1:].tolist()}


def sufficiency(model: dict) -> Column:
    z = F.lit(model["intercept"])
    for name, mean, deviation, weight in zip(model["names"], model["means"], model["deviations"], model["weights"]):
        z = z + F.lit(weight) * (F.col(name) - F.lit(mean)) / F.lit(deviation)
    return 1 / (1 + F.exp(-z))


def fit_bands(scored: DataFrame, targets: dict[str, float] | None = None, support: int = LEAST_SUPPORT) -> DataFrame:
    """(band, threshold, within, cumulative, support) from the strictest on; a band that nothing reaches is absent.

    A band ends at the lowest confidence down to which the rows not yet taken are right often enough. Equal confidences
    are summed first, and each band is one aggregate over those sums, begun where the one before ended.
    """
    targets = targets or TARGETS
    down = Window.orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, 0)
    runs = scored.groupBy("confidence").agg(F.count("*").alias("n"), F.count_if("correct").alias("hits"))
    runs = runs.select("confidence", F.sum("n").over(down).alias("n"), F.sum("hits").over(down).alias("hits"))
    found = scored.sparkSession.createDataFrame([(0, 0)], "n0 long, h0 long")
    out = None
    for place, (band, target) in enumerate(targets.items()):
        size = F.col("n") - F.col("n0")
        fits = runs.crossJoin(F.broadcast(found)).where((size >= support) & ((F.col("hits") - F.col("h0")) / size >= target))
        end = fits.groupBy().agg(F.min_by(F.struct("confidence", "n", "hits", "n0", "h0"), "confidence").alias("e")).where("e is not null").select("e.*")
        row = end.select(F.lit(place).alias("place"), F.lit(band).alias("band"), F.col("confidence").alias("threshold"), r6((F.col("hits") - F.col("h0")) / (F.col("n") - F.col("n0"))).alias("within"), r6(F.col("hits") / F.col("n")).alias("cumulative"), (F.col("n") - F.col("n0")).alias("support"))
        out = row if out is None else out.unionByName(row)
        found = found.unionByName(end.select(F.col("n").alias("n0"), F.col("hits").alias("h0"))).agg(F.max("n0").alias("n0"), F.max("h0").alias("h0"))
    return out.drop("place")


def assign_band(scored: DataFrame, bands: DataFrame) -> DataFrame:
    """scored with band: the strictest whose threshold the confidence reaches, null to abstain."""
    policy = bands.agg(F.sort_array(F.collect_list(F.struct(F.col("threshold"), F.col("band"))), asc=False).alias("policy"))
    first = F.element_at(F.concat(F.filter("policy", lambda b: F.col("confidence") >= b["threshold"]), F.array(F.lit(None).cast("struct<threshold:double,band:string>"))), 1)
    return scored.crossJoin(F.broadcast(policy)).withColumn("band", first["band"]).drop("policy")


def decide(judged: DataFrame) -> DataFrame:
    """judged (band, sufficiency, predicted) with outcome and verdict; a declined row keeps its prediction and has no verdict."""
    grounded = F.col("sufficiency") >= SUFFICIENT
    outcome = F.when(F.col("band").isNotNull() & grounded, "answered").when(F.col("band").isNull() & ~grounded, "declined_both").when(F.col("band").isNull(), "declined_low_confidence").otherwise("declined_insufficient_evidence")
    return judged.withColumn("outcome", outcome).withColumn("verdict", F.when(F.col("outcome") == "answered", F.col("predicted")))
