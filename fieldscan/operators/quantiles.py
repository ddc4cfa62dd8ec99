"""Exact linear-interpolated quantiles and the statistics built on them.

``percentile`` holds every distinct value of a group in one task. Here a small
sketch first brackets each quantile, then one more scan counts the rows below
the bracket (folded map-side) and keeps only the few values inside it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscan import constants as C
from fieldscan.operators.lookup import lookup_join
from fieldscan.operators.ranks import accumulated
from fieldscan.session import checkpointed

SKETCH_ACCURACY = 10_000
WINDOW_ROWS = 2_000_000


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, levels: dict[str, float],
                    also: dict[str, Column] | None = None, accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """(keys, total, one column per level, extra aggregates); an empty group has NULL levels.

    A sketch of relative rank error 1/accuracy brackets each level by
    2/accuracy on both sides. Groups of at most ``accuracy`` rows are bracketed
    by their minimum and maximum, so they never depend on the sketch. Rows
    between two brackets fold into one count; only bracketed values survive.
    ``also`` names further aggregates to take in the first scan.
    """
    also = also or {}
    points = sorted(set(levels.values()))
    slack = 2.0 / accuracy
    marks = [mark for p in points for mark in (max(0.0, p - slack), min(1.0, p + slack))]
    v = F.col(value).cast("double")
    sketch = rows.groupBy(*keys).agg(
        F.count(v).alias("total"), F.min(v).alias("_min"), F.max(v).alias("_max"),
        F.percentile_approx(v, marks, accuracy).alias("_marks"), *[c.alias(n) for n, c in also.items()])
    small = F.col("total") <= accuracy
    sides = []
    for i, p in enumerate(points):
        low = F.col("_min") if p - slack <= 0 else F.when(small, F.col("_min")).otherwise(F.col("_marks")[2 * i])
        high = F.col("_max") if p + slack >= 1 else F.when(small, F.col("_max")).otherwise(F.col("_marks")[2 * i + 1])
        sides += [low.alias(f"_low{i}"), high.alias(f"_high{i}")]
    groups = checkpointed(sketch.select(*keys, "total", *sides, *also))
    bounds = groups.drop(*also)
    size = bounds.agg(F.count(F.lit(1)).alias("groups"), F.sum("total").alias("weight"),
                      F.max("total").alias("largest")).first()

    present = rows.where(F.col(value).isNotNull()).select(*keys, v.alias("_v"))
    placed = lookup_join(present, bounds, keys, "total", size["groups"], size["weight"] or 0)
    kept = reduce(lambda a, b: a | b, [F.col("_v").between(F.col(f"_low{i}"), F.col(f"_high{i}"))
                                       for i in range(len(points))])
    gap = reduce(lambda a, b: a + b, [(F.col("_v") > F.col(f"_high{i}")).cast("int") for i in range(len(points))])
    folded = placed.groupBy(*keys, F.col("total").alias("_total"), F.when(~kept, gap).alias("gap"),
                            F.when(kept, F.col("_v")).alias("candidate")) \
        .agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("at"))

    group = [*keys, "_total"]
    largest = size["largest"] or 0
    if max(accuracy, 5 * largest * slack * len(points)) <= WINDOW_ROWS:
        before = Window.partitionBy(*group).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        counted = folded.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
    else:  # the bracketed values themselves are too many for one task
        counted = accumulated(checkpointed(folded), group, "at", largest, ["candidate"])

    def holding(rank: Column) -> Column:
        return F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("n")), F.col("candidate")))

    ranks = {p: (F.col("_total") - 1) * F.lit(p) for p in points}
    picked = counted.groupBy(*group).agg(*[
        side for i, p in enumerate(points)
        for side in (holding(F.floor(ranks[p])).alias(f"lo{i}"), holding(F.ceil(ranks[p])).alias(f"hi{i}"))])

    def at_level(p: float) -> Column:
        lo, hi = F.col(f"lo{points.index(p)}"), F.col(f"hi{points.index(p)}")
        part = ranks[p] - F.floor(ranks[p])
        return F.when(lo.isNull() | hi.isNull(), F.raise_error(F.lit("quantile bracket missed its rank")).cast("double")) \
            .when(part == 0.5, lo * 0.5 + hi * 0.5).otherwise(lo + (hi - lo) * part)  # halves add up with one rounding

    found = picked.select(*keys, *[at_level(p).alias(n) for n, p in levels.items()])
    return join_groups(groups.select(*keys, "total", *also), found, keys)


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join two per-group results on null-safe keys."""
    other = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return left.join(other, match, how).drop(*[f"_{k}" for k in keys])


def median_absolute_deviation(rows: DataFrame, keys: list[str], value: str, medians: DataFrame,
                              median: str) -> DataFrame:
    """(keys, mad): unscaled median of |value - group median|; ``medians`` is materialised."""
    anchored = medians.select(*keys, "total", F.col(median).alias("_median"))
    size = anchored.agg(F.count(F.lit(1)).alias("groups"), F.sum("total").alias("weight")).first()
    spread = lookup_join(rows.where(F.col(value).isNotNull()).select(*keys, value), anchored, keys, "total",
                         size["groups"], size["weight"] or 0) \
        .select(*keys, F.abs(F.col(value) - F.col("_median")).alias("_deviation"))
    return exact_quantiles(spread, keys, "_deviation", {"mad": 0.5}).drop("total")


def index_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """min, max, mean, median, population deviation, count and share of all rows."""
    return exact_quantiles(rows, keys, value, {"median": 0.5}, also={
        "min": F.min(value), "max": F.max(value), "mean": F.avg(value), "standard_deviation": F.stddev_pop(value),
        "valid_percentage": F.count(value) * 100.0 / F.count(F.lit(1))}).withColumnRenamed("total", "valid_count")


def robust_statistics(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per (keys, measure): moments, p05..p95, IQR and unscaled MAD."""
    long = rows.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("value")) for v in values])).alias("m")) \
        .select(*keys, "m.measure", "m.value").where(F.col("value").isNotNull())
    group = [*keys, "measure"]
    levels = {f"p{round(p * 100):02d}": p for p in C.STATISTIC_LEVELS}
    found = exact_quantiles(long, group, "value", levels, also={
        "min": F.min("value"), "max": F.max("value"), "mean": F.avg("value"), "standard_deviation": F.stddev_pop("value")})
    found = checkpointed(found)  # one row per group, read again for the deviations
    mad = median_absolute_deviation(long, group, "value", found, "p50")
    return join_groups(found, mad, group).select(
        *group, F.col("total").alias("count"), "min", "max", "mean", F.col("p50").alias("median"), "standard_deviation",
        F.col("mad").alias("median_absolute_deviation"),
        (F.col("p75") - F.col("p25")).alias("interquartile_range"), *levels)
