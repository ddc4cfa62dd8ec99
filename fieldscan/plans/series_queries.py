"""Time-series queries over events: five sites, one value per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscan.functions.timestamps import MICROS_PER_DAY, iso_utc
from fieldscan.operators import audit, temporal
from fieldscan.operators.quantiles import exact_quantiles
from fieldscan.plans.registry import query
from fieldscan.plans.views import ACQUISITIONS, acquisitions, d, r, r_scaled, table
from fieldscan.session import checkpointed

SITE = ["site"]
CUTOFF = "2024-01-20 08:35:59.024"


def days(spark: SparkSession, folder: str) -> DataFrame:
    """(site, day, median, first_at, last_at, sources)."""
    return exact_quantiles(acquisitions(spark, folder), ["site", "day"], "value", {"median": 0.5}, also={
        "first_at": F.min("acquired_at"), "last_at": F.max("acquired_at")}).withColumnRenamed("total", "sources")


@query("daily_series", f"""WITH {ACQUISITIONS}
SELECT site, day::VARCHAR AS day, round(median, 9) AS median, sources, strftime(first_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS first_at,
  strftime(last_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS last_at FROM days""")
def daily_series(spark: SparkSession, folder: str) -> DataFrame:
    return days(spark, folder).select("site", d("day").alias("day"), r(F.col("median")).alias("median"), "sources",
                                      iso_utc(F.col("first_at")).alias("first_at"), iso_utc(F.col("last_at")).alias("last_at"))


def trend_sql(source: str = "days", keys: str = "site") -> str:
    return f"""slopes AS (SELECT a.{keys}, (b.median - a.median) / date_diff('day', a.day, b.day) AS slope FROM {source} a JOIN {source} b
  ON a.{keys} = b.{keys} AND a.day < b.day),
medians AS (SELECT {keys}, quantile_cont(slope, 0.5) AS slope FROM slopes GROUP BY ALL),
spans AS (SELECT {keys}, count(*) AS observations, date_diff('day', min(day), max(day)) AS span FROM {source} GROUP BY ALL),
trend AS (SELECT s.{keys}, observations, CASE WHEN observations >= 3 THEN slope END AS slope_per_day,
  CASE WHEN observations >= 3 THEN slope * span END AS fitted_change, CASE WHEN observations >= 3 THEN span END AS span_days
  FROM spans s LEFT JOIN medians m ON s.{keys} = m.{keys}),
directed AS (SELECT *, CASE WHEN fitted_change IS NULL THEN 'insufficient observations' WHEN abs(fitted_change) <= 2e-2 THEN 'broadly stable'
  WHEN fitted_change > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM trend)"""


@query("theil_sen_trend", f"""WITH {ACQUISITIONS}, {trend_sql()}
SELECT site, observations, round(slope_per_day, 12) + 0e0 AS slope_per_day, round(slope_per_day * 30, 12) + 0e0 AS slope_per_30_days,
  round(fitted_change, 12) + 0e0 AS fitted_change, span_days::BIGINT AS span_days, direction FROM directed""")
def theil_sen_trend(spark: SparkSession, folder: str) -> DataFrame:
    trend = temporal.theil_sen(days(spark, folder), SITE, "day", "median")
    return trend.select("site", "observations", *[r_scaled(F.col(c), 12).alias(c) for c in ("slope_per_day", "slope_per_30_days", "fitted_change")],
                        F.col("span_days").cast("bigint").alias("span_days"), "direction")


@query("tile_trends", f"""WITH tiles AS (SELECT user_id AS site, ts::DATE AS day, quantile_cont(value / 1e2, 0.5) AS median FROM events GROUP BY ALL),
{trend_sql('tiles')}
SELECT site, observations, round(slope_per_day, 12) + 0e0 AS slope_per_day, direction FROM directed""")
def tile_trends(spark: SparkSession, folder: str) -> DataFrame:
    daily = exact_quantiles(acquisitions(spark, folder), ["tile", "day"], "value", {"median": 0.5})
    trend = temporal.theil_sen(daily, ["tile"], "day", "median")
    return trend.select(F.col("tile").alias("site"), "observations", r_scaled(F.col("slope_per_day"), 12).alias("slope_per_day"), "direction")


@query("series_check", """WITH daily AS (SELECT user_id AS tile, ts::DATE AS day, day(ts) % 2 = 0 AS even FROM events GROUP BY ALL)
SELECT tile, count(*) + count(*) FILTER (even AND tile % 5 = 0) AS observations,
  concat_ws(';', CASE WHEN count(*) FILTER (even AND tile % 5 = 0) > 0 THEN 'repeated or missing days' END,
    CASE WHEN count(*) FILTER (even AND tile % 3 = 0) > 0 THEN 'nonfinite value' END) AS problems FROM daily GROUP BY ALL""")
def series_check(spark: SparkSession, folder: str) -> DataFrame:
    """Daily values per tile; on even days every third tile lacks a finite value, and every fifth repeats the day."""
    even = F.day("day") % 2 == 0
    daily = acquisitions(spark, folder).groupBy("tile", "day").agg(F.max("value").alias("value")) \
        .withColumn("value", F.when(even & (F.col("tile") % 3 == 0), float("nan")).otherwise(F.col("value")))
    series = daily.union(daily.where(even & (F.col("tile") % 5 == 0)))
    return temporal.series_problems(series, ["tile"], "day", "value").withColumn("problems", F.array_join("problems", ";"))


@query("series_summary", f"""WITH {ACQUISITIONS}
SELECT site, count(*) AS days, round(quantile_cont(median, 0.5), 9) AS median_of_days, round(min(median), 9) AS min_day, round(max(median), 9) AS max_day,
  string_agg(printf('%.6f', round(median, 6)), ';' ORDER BY day) AS daily_values FROM days GROUP BY ALL""")
def series_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = temporal.series_summary(days(spark, folder), SITE, "day", "median")
    return summary.select("site", "days", *[r(F.col(c)).alias(c) for c in ("median_of_days", "min_day", "max_day")],
                          F.array_join(F.transform("daily_values", lambda v: F.format_string("%.6f", F.round(v, 6))), ";").alias("daily_values"))


@query("nearest_acquisition", """WITH targets AS (SELECT user_id AS tile, event_id AS target_id, ts AS target_at FROM events),
sources AS (SELECT user_id AS tile, event_id AS scene_id, ts AS acquired_at FROM events WHERE event_id % 4 > 0),
placed AS (SELECT t.tile, target_id, scene_id, epoch_us(acquired_at) - epoch_us(target_at) AS gap,
  row_number() OVER (PARTITION BY t.tile, target_id ORDER BY abs(epoch_us(acquired_at) - epoch_us(target_at)), acquired_at, scene_id) AS place
  FROM targets t JOIN sources s ON t.tile = s.tile)
SELECT tile, target_id::VARCHAR AS target_id, scene_id, abs(gap)::BIGINT AS absolute_gap_micros, gap::BIGINT AS signed_gap_micros
FROM placed WHERE place = 1""")
def nearest_acquisition(spark: SparkSession, folder: str) -> DataFrame:
    """Every event is a target; the sources of its tile are the events that contribute (three of four)."""
    a = acquisitions(spark, folder)
    targets = a.select("tile", F.col("scene_id").alias("target_id"), F.col("acquired_at").alias("target_at"))
    sources = a.where(F.col("scene_id") % 4 > 0).select("tile", "scene_id", "acquired_at")
    nearest = temporal.nearest_acquisition(targets, sources, ["tile"])
    micros = lambda days: F.round(F.col(days) * float(MICROS_PER_DAY)).cast("bigint")
    return nearest.select("tile", "target_id", "scene_id", micros("absolute_gap_days").alias("absolute_gap_micros"),
                          micros("signed_gap_days").alias("signed_gap_micros"))


def noon_targets(spark: SparkSession, folder: str) -> DataFrame:
    """One target per site and day, at noon, matched to its nearest acquisition."""
    a = acquisitions(spark, folder)
    targets = a.select("site", "day").distinct().select(
        "site", F.date_format("day", "yyyy-MM-dd").alias("target_id"), (F.col("day").cast("timestamp") + F.expr("INTERVAL 12 HOURS")).alias("target_at"))
    nearest = temporal.nearest_acquisition(targets, a.select("site", "scene_id", "acquired_at"), SITE)
    return nearest.select("site", "target_id", "target_at", F.to_date("acquired_at").alias("compared_day"), "absolute_gap_days")


BASELINE_SQL = ACQUISITIONS + """,
targets AS (SELECT DISTINCT site, day::VARCHAR AS target_id, day + INTERVAL 12 HOURS AS target_at FROM acquisitions),
near AS (SELECT t.site, target_id, target_at, acquired_at, abs(epoch_us(acquired_at) - epoch_us(target_at)) / 864e8 AS gap,
  row_number() OVER (PARTITION BY t.site, target_id ORDER BY abs(epoch_us(acquired_at) - epoch_us(target_at)), acquired_at, scene_id) AS place
  FROM targets t JOIN acquisitions a ON t.site = a.site AND abs(date_diff('day', a.day, target_at::DATE)) <= 1),
compared AS (SELECT n.site, target_id, target_at, gap, acquired_at::DATE AS compared_day, d.median AS target_value FROM near n
  JOIN days d ON d.site = n.site AND d.day = n.acquired_at::DATE WHERE place = 1),
base AS (SELECT c.*, d.median AS v FROM compared c LEFT JOIN days d ON d.site = c.site AND d.first_at >= c.target_at - INTERVAL 10 DAYS
  AND d.last_at < c.target_at AND d.day <> c.compared_day),
centred AS (SELECT *, quantile_cont(v, 0.5) OVER (PARTITION BY site, target_id) AS m FROM base),
folded AS (SELECT site, target_id, compared_day, gap, target_value, count(v) AS baseline_dates, count(v) >= 5 AND gap <= 7 AS available,
  quantile_cont(v, 0.5) AS bm, quantile_cont(abs(v - m), 0.5) AS mad,
  CASE WHEN count(v) > 0 THEN 1e2 * (count(*) FILTER (v < target_value) + 5e-1 * count(*) FILTER (v = target_value)) / count(v) END AS pct
  FROM centred GROUP BY site, target_id, compared_day, gap, target_value)"""


def baselines(spark: SparkSession, folder: str, daily: DataFrame | None = None) -> DataFrame:
    return temporal.baseline(noon_targets(spark, folder), checkpointed(days(spark, folder)) if daily is None else daily, SITE, "median", lookback_days=10)


@query("baseline_comparison", f"""WITH {BASELINE_SQL}
SELECT site, target_id, compared_day::VARCHAR AS compared_day, baseline_dates, available,
  round(CASE WHEN available THEN bm END, 8) AS baseline_median, round(CASE WHEN available THEN mad END, 8) AS baseline_mad,
  round(CASE WHEN available THEN target_value - bm END, 8) + 0e0 AS difference, round(CASE WHEN available THEN pct END, 8) AS percentile,
  round(CASE WHEN available AND mad > 0 THEN (target_value - bm) / mad END, 6) + 0e0 AS mad_distance FROM folded""")
def baseline_comparison(spark: SparkSession, folder: str) -> DataFrame:
    b = baselines(spark, folder)
    return b.select("site", "target_id", d("compared_day").alias("compared_day"), "baseline_dates", "available",
                    *[r(F.col(c), 8).alias(c) for c in ("baseline_median", "baseline_mad", "difference", "percentile")],
                    r(F.col("mad_distance"), 6).alias("mad_distance"))


@query("baseline_report", f"""WITH {BASELINE_SQL}
SELECT site, target_id, format('| {{}} | {{:.6f}} | {{:.6f}} | {{:.2f}} |', site, bm, target_value, pct) AS line FROM folded WHERE available""")
def baseline_report(spark: SparkSession, folder: str) -> DataFrame:
    b = baselines(spark, folder).where("available")
    return b.select("site", "target_id", F.format_string(
        "| %s | %.6f | %.6f | %.2f |", "site", "baseline_median", "target_value", "percentile").alias("line"))


@query("cutoff_audit", f"""WITH {ACQUISITIONS}
SELECT site, count(*) FILTER (last_at <= TIMESTAMP '{CUTOFF}') AS used, count(*) FILTER (last_at < TIMESTAMP '{CUTOFF}') AS strictly_before,
  count(*) FILTER (last_at > TIMESTAMP '{CUTOFF}') AS excluded, coalesce(string_agg(day::VARCHAR, ';' ORDER BY day) FILTER (last_at > TIMESTAMP '{CUTOFF}'), '') AS excluded_days
FROM days GROUP BY ALL""")
def cutoff_audit(spark: SparkSession, folder: str) -> DataFrame:
    gated = temporal.at_cutoff(days(spark, folder), F.lit(CUTOFF).cast("timestamp"))
    audit = temporal.cutoff_audit(gated, SITE)
    return audit.withColumn("excluded_days", F.array_join(F.transform("excluded_days", lambda x: F.date_format(x, "yyyy-MM-dd")), ";"))


@query("straddling_days", f"""SELECT user_id AS tile, ts::DATE::VARCHAR AS day, max(ts) <= TIMESTAMP '{CUTOFF}' AS eligible FROM events GROUP BY user_id, ts::DATE
HAVING min(ts) <= TIMESTAMP '{CUTOFF}' AND max(ts) > TIMESTAMP '{CUTOFF}'""")
def straddling_days(spark: SparkSession, folder: str) -> DataFrame:
    folded = acquisitions(spark, folder).groupBy("tile", "day").agg(F.min("acquired_at").alias("first_at"), F.max("acquired_at").alias("last_at"))
    gated = temporal.at_cutoff(folded, F.lit(CUTOFF).cast("timestamp"))
    return gated.where((F.col("first_at") <= F.lit(CUTOFF).cast("timestamp")) & ~F.col("eligible")).select("tile", d("day").alias("day"), "eligible")


@query("cross_input_audit", f"""WITH {BASELINE_SQL}, {trend_sql()},
s(site) AS (SELECT DISTINCT site FROM days),
t AS (SELECT site, '' AS target_id, CASE WHEN site LIKE 'c%' THEN 'missing' WHEN site LIKE 'p%' THEN 'differs' ELSE 'equal' END AS status,
  CASE WHEN site LIKE 'p%' THEN 'direction' ELSE '' END AS differing FROM s),
n AS (SELECT site, target_id, day(compared_day) % 4 AS kind FROM compared),
nearest AS (SELECT site, target_id, CASE kind WHEN 0 THEN 'differs' WHEN 1 THEN 'missing' ELSE 'equal' END AS status, CASE kind WHEN 0 THEN 'scene_id' ELSE '' END AS differing FROM n
  UNION ALL SELECT site, target_id || '+', 'extra', '' FROM n WHERE kind = 2),
b AS (SELECT site, target_id, day(compared_day) % 5 AS kind, available FROM folded),
compared_baselines AS (SELECT site, target_id, CASE WHEN kind = 0 AND available OR kind = 1 THEN 'differs' WHEN kind = 2 THEN 'missing' ELSE 'equal' END AS status,
  concat_ws(';', CASE WHEN kind = 1 THEN 'available' END, CASE WHEN kind = 0 AND available THEN 'percentile' END) AS differing FROM b)
SELECT 'trend' AS part, * FROM t UNION ALL SELECT 'nearest', * FROM nearest UNION ALL SELECT 'baseline', * FROM compared_baselines""")
def cross_input_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Trend, nearest acquisition and baseline recomputed and compared with saved tables, in which rows were changed, dropped and added by their values."""
    daily = checkpointed(days(spark, folder))
    a = acquisitions(spark, folder)
    targets = a.select("site", "day").distinct().select(
        "site", F.date_format("day", "yyyy-MM-dd").alias("target_id"), (F.col("day").cast("timestamp") + F.expr("INTERVAL 12 HOURS")).alias("target_at"))
    nearest = checkpointed(temporal.nearest_acquisition(targets, a.select("site", "scene_id", "acquired_at"), SITE))
    compared = nearest.select("site", "target_id", "target_at", F.to_date("acquired_at").alias("compared_day"), "absolute_gap_days")
    expected = {
        "trend": temporal.theil_sen(daily, SITE, "day", "median").withColumn("target_id", F.lit("")),
        "nearest": nearest,
        "baseline": temporal.baseline(compared, daily, SITE, "median", lookback_days=10)}
    kept = {part: checkpointed(frame) for part, frame in expected.items()}
    by_day = F.day(F.to_date("acquired_at")) % 4
    saved_nearest = kept["nearest"].where(by_day != 1).withColumn("scene_id", F.when(by_day == 0, F.col("scene_id") + 1).otherwise(F.col("scene_id")))
    kind = F.day("compared_day") % 5
    saved = {
        "trend": kept["trend"].where(~F.col("site").startswith("c")).withColumn("direction", F.when(F.col("site").startswith("p"), "unknown").otherwise(F.col("direction"))),
        "nearest": saved_nearest.unionByName(saved_nearest.where(by_day == 2).withColumn("target_id", F.concat("target_id", F.lit("+")))),
        "baseline": kept["baseline"].where(kind != 2).withColumns({
            "percentile": F.when(kind == 0, F.col("percentile") + 1e-3).otherwise(F.col("percentile")),
            "available": F.when(kind == 1, ~F.col("available")).otherwise(F.col("available"))})}
    values = {"trend": ["slope_per_day", "fitted_change", "direction"], "nearest": ["scene_id", "acquired_at", "signed_gap_days"],
              "baseline": ["available", "baseline_dates", "baseline_median", "difference", "percentile", "mad_distance"]}
    return audit.reconcile_parts(saved, kept, ["site", "target_id"], values).withColumn("differing", F.array_join("differing", ";"))
