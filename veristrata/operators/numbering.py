"""Places in an order over all rows, without one task that sorts them all."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, bucket: Column, order: list, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """rows with pos (place in their group's order, from 1), n (rows of the group) and, with weight, running (its sum up to and with the row).

    bucket must not fall along the order. Rows are numbered inside (group, bucket); what lies before a bucket is summed over the
    table of buckets, which has a row for each bucket only.
    """
    by = by or []
    marked = rows.withColumn("_bucket", bucket)
    kept = F.sum(weight) if weight else F.lit(0)
    sizes = marked.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_m"), kept.alias("_w"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_bucket").alias("_of"),
        F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"), F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_below"), F.sum("_m").over(group).alias("n"),
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    marked = marked.withColumn("_in", F.row_number().over(inside))
    if weight:
        marked = marked.withColumn("_upto", F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)] + [F.col("_bucket").eqNullSafe(F.col("_of"))]
    out = marked.join(offsets, functools.reduce(operator.and_, same)).withColumn("pos", (F.col("_before") + F.col("_in")).cast("long"))
    if weight:
        out = out.withColumn("running", F.col("_below") + F.col("_upto"))
    return out.drop("_bucket", "_of", "_before", "_below", "_in", "_upto", *[f"_by{i}" for i in range(len(by))])


def hash_bucket(h: str) -> Column:
    """The first three digits of a hexadecimal hash: 4,096 buckets in its order."""
    return F.substring(h, 1, 3)


def unit_bucket(value: str, buckets: int = 4096) -> Column:
    """Equal slices of 0..1, in order."""
    return F.floor(F.col(value) * buckets)
