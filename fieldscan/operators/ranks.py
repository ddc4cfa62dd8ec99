"""Tie-aware ranks over populations of any size.

Equal values are first folded into counts, and the number of distinct values of
the largest population is measured. Populations up to a fixed bound take one
window; a larger one is range-partitioned, and each value gets its prefix sum
from its partition plus the partition's offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldscan.functions.ranking import empirical_percentile
from fieldscan.operators.lookup import lookup_join
from fieldscan.session import checkpointed

WINDOW_VALUES = 1_000_000


def histogram(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n): distinct values folded to counts, materialised once."""
    return checkpointed(rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")))


def accumulated(folded: DataFrame, keys: list[str], value: str, largest: int,
                carried: list[str] | None = None) -> DataFrame:
    """(keys, value, carried, n, below, total) from a materialised histogram.

    ``largest`` is the measured number of distinct values of the largest
    population. Up to WINDOW_VALUES one window per population does; beyond, the
    values are range-partitioned and each partition adds its offset. Partition
    numbers are used twice there and must mean the same thing both times, so
    that layout is checkpointed. Its offset table has one row per population
    and partition it touches.
    """
    whole, carried = Window.partitionBy(*keys), carried or []
    if largest <= WINDOW_VALUES:
        before = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return folded.select(*keys, value, *carried, "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"),
                             F.sum("n").over(whole).alias("total"))
    placed = checkpointed(folded.repartitionByRange(*keys, value).withColumn("part", F.spark_partition_id()))
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*keys, "part").agg(F.sum("n").alias("part_n")).select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("part").alias("_part"),
        F.coalesce(F.sum("part_n").over(before), F.lit(0)).alias("part_below"),
        F.sum("part_n").over(whole).alias("total"))
    match = F.col("part") == F.col("_part")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    within = Window.partitionBy(*keys, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(offsets, match).select(
        *keys, value, *carried, "n",
        (F.coalesce(F.sum("n").over(within), F.lit(0)) + F.col("part_below")).alias("below"), "total")


def attach_ranks(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Add {value}_below, {value}_equal and {value}_total for every value column.

    All columns share one histogram; rows with a NULL get NULL counts.
    """
    long = rows.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("value")) for v in values])).alias("m")) \
        .select(*keys, "m.measure", "m.value")
    folded = histogram(long, [*keys, "measure"], "value")
    populations = folded.groupBy(*keys, "measure").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("weight"))
    sizes = {row["measure"]: row for row in populations.groupBy("measure").agg(
        F.sum("rows").alias("rows"), F.sum("weight").alias("weight"), F.max("rows").alias("largest")).collect()}
    for v in values:
        size = sizes.get(v) or {"rows": 0, "weight": 0, "largest": 0}
        one = accumulated(folded.where(F.col("measure") == v).drop("measure"), keys, "value", size["largest"]).select(
            *keys, F.col("value").alias(v), F.col("n").alias(f"{v}_equal"),
            F.col("below").alias(f"{v}_below"), F.col("total").alias(f"{v}_total"))
        rows = lookup_join(rows, one, [*keys, v], f"{v}_equal", size["rows"], size["weight"], unmatched=v)
    return rows


def midranks(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Add {value}_percentile = 100 * (below + half of equal) / population."""
    ranked = attach_ranks(rows, keys, values)
    return ranked.select(*rows.columns, *[
        empirical_percentile(F.col(f"{v}_below"), F.col(f"{v}_equal"), F.col(f"{v}_total")).alias(f"{v}_percentile")
        for v in values])


def spearman(rows: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """(keys, population, rho); rho is NULL when either side is constant.

    Pearson on average ranks from plain sums: ``corr`` raises on a constant
    column under ANSI mode. Ranks are centred on (N+1)/2, their exact mean.
    """
    paired = rows.where(F.col(first).isNotNull() & F.col(second).isNotNull()).select(*keys, first, second)
    ranked = attach_ranks(paired, keys, [first, second])

    def centred(v: str):
        return (F.col(f"{v}_below") + (F.col(f"{v}_equal") + 1) / F.lit(2.0)
                - (F.col(f"{v}_total") + 1) / F.lit(2.0))

    sums = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("population"),
        F.sum(centred(first) * centred(second)).alias("xy"),
        F.sum(centred(first) * centred(first)).alias("xx"),
        F.sum(centred(second) * centred(second)).alias("yy"))
    return sums.select(*keys, "population", F.when(
        (F.col("xx") > 0) & (F.col("yy") > 0),
        F.col("xy") / (F.sqrt("xx") * F.sqrt("yy"))).alias("rho"))
