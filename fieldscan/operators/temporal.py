"""Daily series: trend, nearest acquisition, baseline, cutoff."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fieldscan import constants as C
from fieldscan.functions.checks import errors
from fieldscan.functions.ranking import empirical_percentile
from fieldscan.functions.reflectance import is_finite
from fieldscan.functions.timestamps import MICROS_PER_DAY, gap_micros

DIRECT_PAIRS = 2_000_000


def median_slope(days: np.ndarray, values: np.ndarray) -> float:
    """Exact median of all pairwise slopes of one chronological series.

    Short series use the slope matrix. Longer ones narrow a slope interval by
    counting, one row of slopes at a time, until the middle ranks fit in memory.
    """
    n = len(days)
    pairs = n * (n - 1) // 2
    if pairs <= DIRECT_PAIRS:
        i, j = np.triu_indices(n, 1)
        return float(np.median((values[j] - values[i]) / (days[j] - days[i])))

    def rows():
        for i in range(n - 1):
            yield (values[i + 1:] - values[i]) / (days[i + 1:] - days[i])

    low, high = min(r.min() for r in rows()), max(r.max() for r in rows())
    first, last = (pairs - 1) // 2, pairs // 2
    below, inside = 0, pairs
    while inside > DIRECT_PAIRS:
        middle = low + (high - low) / 2
        if not low < middle < high:
            break
        to_middle = sum(int(np.count_nonzero(r <= middle)) for r in rows())
        if to_middle > last:
            high, inside = middle, to_middle - below
        elif to_middle <= first:
            low, below, inside = np.nextafter(middle, np.inf), to_middle, inside - (to_middle - below)
        else:  # the two middle ranks fall on either side of this slope
            left = max(float(r[r <= middle].max(initial=-np.inf)) for r in rows())
            right = min(float(r[r > middle].min(initial=np.inf)) for r in rows())
            return (left + right) / 2
    if inside > DIRECT_PAIRS:  # the interval is down to one or two repeated slopes
        at_low = sum(int(np.count_nonzero(r <= low)) for r in rows())
        return float(((low if first < at_low else high) + (low if last < at_low else high)) / 2)
    kept = np.sort(np.concatenate([r[(r >= low) & (r <= high)] for r in rows()]))
    return float((kept[first - below] + kept[last - below]) / 2)


def _slopes(days: pd.Series, values: pd.Series) -> pd.Series:
    return pd.Series([median_slope(np.asarray(d, dtype=float), np.asarray(v, dtype=float))
                      if d is not None and len(d) >= 3 else None for d, v in zip(days, values)], dtype="float64")


def series_problems(series: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """(keys, observations, problems): repeated days and nonfinite values."""
    return series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"), F.count_distinct(day).alias("_days"),
        F.count_if(~is_finite(F.col(value))).alias("_bad")).select(
        *keys, "observations", errors(
            F.when(F.col("_days") < F.col("observations"), F.lit("repeated or missing days")),
            F.when(F.col("_bad") > 0, F.lit("nonfinite value"))).alias("problems"))


def direction(change: Column, tolerance: float) -> Column:
    return (F.when(change.isNull(), "insufficient observations")
            .when(F.abs(change) <= tolerance, "broadly stable")
            .when(change > 0, "increasing").otherwise("decreasing"))


def theil_sen(series: DataFrame, keys: list[str], day: str, value: str,
              tolerance: float = C.STABLE_TOLERANCE) -> DataFrame:
    """Median pairwise slope per elapsed day of every series.

    A series holds one value per calendar day; a repeated day or a nonfinite
    value fails the job. After that check a series is calendar-bounded, and its
    sorted days travel as one array per series through an Arrow batch.
    """
    point = F.struct(F.datediff(F.col(day), F.lit("1970-01-01")).alias("d"), F.col(value).cast("double").alias("v"))
    folded = series.where(
        F.when(is_finite(F.col(value)), F.lit(True))
        .otherwise(F.raise_error(F.lit("nonfinite daily value")).cast("boolean"))) \
        .groupBy(*keys, day).agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias(value)) \
        .where(F.when(F.col("_n") == 1, F.lit(True))
               .otherwise(F.raise_error(F.lit("repeated day in a series")).cast("boolean"))) \
        .groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("points"))
    slopes = F.pandas_udf(_slopes, DoubleType())
    counted = folded.select(*keys, F.size("points").cast("bigint").alias("observations"),
                            (F.col("points")[F.size("points") - 1]["d"] - F.col("points")[0]["d"]).alias("_span"),
                            slopes(F.transform("points", lambda p: p["d"]),
                                   F.transform("points", lambda p: p["v"])).alias("slope_per_day"))
    sloped = counted.withColumn("fitted_change", F.col("slope_per_day") * F.col("_span"))
    return sloped.select(
        *keys, "observations", "slope_per_day", (F.col("slope_per_day") * 30).alias("slope_per_30_days"),
        "fitted_change", F.when(F.col("slope_per_day").isNotNull(), F.col("_span")).alias("span_days"),
        direction(F.col("fitted_change"), tolerance).alias("direction"))


def series_summary(series: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Daily values in order, their median, smallest and largest."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(day).alias("d"), F.col(value).alias("v"))))
    return series.groupBy(*keys).agg(
        F.transform(ordered, lambda p: p["v"]).alias("daily_values"), F.percentile(value, 0.5).alias("median_of_days"),
        F.min(value).alias("min_day"), F.max(value).alias("max_day"), F.count(value).alias("days"))


def nearest_acquisition(targets: DataFrame, sources: DataFrame, keys: list[str],
                        bucket_seconds: int = 86_400) -> DataFrame:
    """Nearest source in time per target; ties go to the earlier time, then the smaller id.

    targets: keys, target_id, target_at. sources: keys, scene_id, acquired_at.
    Time is cut into buckets. No target meets more than four candidates: its
    neighbours inside its own bucket, from a window over one bucket of one site,
    and the last and first source of the nearest other buckets, from a table
    with one row per site and bucket. A site with crowded days takes shorter
    buckets; the result does not depend on the width.
    """
    def bucket(instant: str) -> Column:
        return F.floor(F.unix_micros(instant) / F.lit(bucket_seconds * 1_000_000)).cast("bigint").alias("bucket")

    candidate = F.struct("acquired_at", "scene_id")
    distinct = sources.groupBy(*keys, "acquired_at").agg(F.min("scene_id").alias("scene_id"))
    wanted = targets.select(*keys, bucket("target_at"), F.col("target_at").alias("at"), F.col("target_id").cast("string").alias("target_id"))
    marked = distinct.select(*keys, bucket("acquired_at"), F.col("acquired_at").alias("at"), candidate.alias("source")) \
        .unionByName(wanted, allowMissingColumns=True)
    # both directions are frames that only grow; one that shrinks is summed up anew for every row
    inside = Window.partitionBy(*keys, "bucket").rangeBetween(Window.unboundedPreceding, 0)
    placed = marked.withColumns({
        "before": F.last("source", ignorenulls=True).over(inside.orderBy("at")),
        "after": F.last("source", ignorenulls=True).over(inside.orderBy(F.desc("at")))}) \
        .where(F.col("target_id").isNotNull())

    ends = distinct.groupBy(*keys, bucket("acquired_at")).agg(
        F.max_by(candidate, F.col("acquired_at")).alias("last"), F.min_by(candidate, F.col("acquired_at")).alias("first"))
    stops = wanted.select(*keys, "bucket").distinct().withColumn("wanted", F.lit(True))
    order = Window.partitionBy(*keys).rangeBetween(Window.unboundedPreceding, -1)  # whole buckets: rows of one bucket never see each other
    around = ends.withColumn("wanted", F.lit(False)).unionByName(stops, allowMissingColumns=True).withColumns({
        "earlier": F.last("last", ignorenulls=True).over(order.orderBy("bucket")),
        "later": F.last("first", ignorenulls=True).over(order.orderBy(F.desc("bucket")))}) \
        .where("wanted").select(*keys, "bucket", "earlier", "later")
    gathered = placed.join(around, [*keys, "bucket"], "left").withColumn("c", F.explode(F.array_compact(
        F.array("before", "after", "earlier", "later"))))
    gap = gap_micros(F.col("c.acquired_at"), F.col("at"))
    best = gathered.groupBy(*keys, "target_id", F.col("at").alias("target_at")).agg(F.min_by(
        F.struct(F.col("c.acquired_at").alias("acquired_at"), F.col("c.scene_id").alias("scene_id"), gap.alias("gap")),
        F.struct(F.abs(gap), F.col("c.acquired_at"), F.col("c.scene_id"))).alias("n"))
    return best.select(*keys, "target_id", "target_at", "n.acquired_at", "n.scene_id",
                       (F.abs(F.col("n.gap")) / float(MICROS_PER_DAY)).alias("absolute_gap_days"),
                       (F.col("n.gap") / float(MICROS_PER_DAY)).alias("signed_gap_days"))


def at_cutoff(observations: DataFrame, cutoff: Column) -> DataFrame:
    """A day is eligible when its *latest* acquisition is not after the cutoff."""
    return observations.withColumns({"eligible": F.col("last_at") <= cutoff,
                                     "strictly_before": F.col("last_at") < cutoff})


def cutoff_audit(gated: DataFrame, keys: list[str]) -> DataFrame:
    return gated.groupBy(*keys).agg(
        F.count_if("eligible").alias("used"), F.count_if("strictly_before").alias("strictly_before"),
        F.count_if(~F.col("eligible")).alias("excluded"),
        F.array_sort(F.collect_list(F.when(~F.col("eligible"), F.col("day")))).alias("excluded_days"))


def days_around(days: DataFrame, wanted: DataFrame, keys: list[str], measure: list[str], value: str, lookback_days: int) -> DataFrame:
    """(keys, measure, day, _around): for each wanted (keys, day) the series' days from ``lookback_days`` before to that day.

    One row per distinct wanted day and measure; the window sees one row per day, so a series is
    bounded by the calendar and a frame by the lookback.
    """
    known = F.struct("day", "first_at", "last_at", F.col(value).cast("double").alias("value"))
    asked = wanted.distinct()
    if measure:
        asked = asked.join(days.select(*keys, *measure).distinct(), keys)
    marked = days.select(*keys, *measure, "day", known.alias("_known")).unionByName(asked, allowMissingColumns=True)
    frame = Window.partitionBy(*keys, *measure).orderBy(F.unix_date("day")).rangeBetween(-lookback_days, 0)
    return marked.withColumn("_around", F.collect_list("_known").over(frame)).where(F.col("_known").isNull()) \
        .select(*keys, *measure, "day", "_around")


def baseline(targets: DataFrame, days: DataFrame, keys: list[str], value: str,
             lookback_days: int = C.BASELINE_LOOKBACK_DAYS, minimum_dates: int = C.BASELINE_MIN_DATES,
             maximum_gap_days: float = C.BASELINE_MAX_GAP_DAYS, measure: list[str] | None = None) -> DataFrame:
    """Compare each target's nearest day with the days of its lookback window.

    targets: keys, target_id, target_at, compared_day, absolute_gap_days.
    days: keys, measure, day, first_at, last_at, value. A baseline day has *every*
    acquisition in [target - lookback, target) and is not the compared day.
    A RANGE frame over the days of a series gathers the days around each day that has
    a target, once however many targets it has; a target then meets one row. A frame
    holds at most lookback_days + 1 days.
    """
    measure = measure or []
    compared = targets.withColumn("_day", F.to_date("target_at")).join(
        days.select(*keys, *measure, F.col("day").alias("compared_day"), F.col(value).alias("target_value")), [*keys, "compared_day"])
    start = F.col("target_at") - F.expr(f"INTERVAL {lookback_days} DAYS")
    around = days_around(days, targets.select(*keys, F.to_date("target_at").alias("day")), keys, measure, value, lookback_days)
    inside = F.filter("_around", lambda d: (d["first_at"] >= start) & (d["last_at"] < F.col("target_at")) & (d["day"] != F.col("compared_day")))
    joined = compared.join(around.withColumnRenamed("day", "_day"), [*keys, *measure, "_day"], "left").withColumn(
        "values", F.coalesce(F.transform(inside, lambda d: d["value"]), F.array().cast("array<double>")))
    n = F.size("values").cast("bigint")
    middle = _array_median(F.col("values"))
    spread = joined.withColumn("_median", middle).withColumn(
        "_mad", _array_median(F.transform("values", lambda v: F.abs(v - F.col("_median")))))
    available = (n >= minimum_dates) & (F.col("absolute_gap_days") <= maximum_gap_days)
    below = F.size(F.filter("values", lambda v: v < F.col("target_value")))
    equal = F.size(F.filter("values", lambda v: v == F.col("target_value")))
    difference = F.col("target_value") - F.col("_median")
    return spread.withColumn("available", available).select(
        *keys, "target_id", *measure, "compared_day", n.alias("baseline_dates"), "available",
        F.when(~F.col("available"), F.lit(C.BASELINE_REASON)).alias("baseline_reason"),
        F.when(F.col("available"), F.col("_median")).alias("baseline_median"),
        F.when(F.col("available"), F.col("_mad")).alias("baseline_mad"),
        F.when(F.col("available"), F.col("target_value")).alias("target_value"),
        F.when(F.col("available"), difference).alias("difference"),
        F.when(F.col("available"), empirical_percentile(below, equal, n)).alias("percentile"),
        F.when(F.col("available") & (F.col("_mad") > 0), difference / F.col("_mad")).alias("mad_distance"))


def _array_median(values: Column) -> Column:
    ordered = F.array_sort(values)
    n = F.size(ordered)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return (low + high) / F.lit(2.0)
