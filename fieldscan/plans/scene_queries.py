"""Multispectral scene queries: calibration, mosaic, daily observations, catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscan import constants as C
from fieldscan.functions.timestamps import iso_utc
from fieldscan.operators import audit, mosaic, spatial
from fieldscan.plans.registry import query
from fieldscan.plans.views import MOSAIC, SCENE_PIXELS, big, d, r, scene_pixels, scenes, table
from fieldscan.session import dealt_by
from fieldscan.sources import catalog
from fieldscan.sources.tables import series_rows

AREA = ["area"]


def indexed(spark: SparkSession, folder: str) -> DataFrame:
    return mosaic.calibrated_indices(scene_pixels(spark, folder))


def footprints(frame: DataFrame) -> DataFrame:
    """Cells of each area's footprint, counted once."""
    return frame.where("in_footprint").select("area", "cell_x", "cell_y").distinct() \
        .groupBy("area").agg(F.count(F.lit(1)).alias("footprint_pixels"))


@query("calibrated_scene_indices", f"""WITH {SCENE_PIXELS}
SELECT area, scene_id, cell_x, cell_y, valid, round(ndvi, 9) + 0e0 AS ndvi, round(ndre, 9) + 0e0 AS ndre, round(ndmi, 9) + 0e0 AS ndmi FROM indexed""")
def calibrated_scene_indices(spark: SparkSession, folder: str) -> DataFrame:
    return indexed(spark, folder).select("area", "scene_id", "cell_x", "cell_y", "valid", *[r(F.col(n)).alias(n) for n in C.INDEX_NAMES])


@query("index_bounds", f"""WITH {SCENE_PIXELS}
SELECT area, count(*) FILTER (valid) AS valid_pixels,
  count(*) FILTER (valid AND greatest(abs(ndvi + CASE WHEN scene_id % 7 = 0 THEN 1 ELSE 0 END), abs(ndre), abs(ndmi)) > 1.000000000001) AS outside
FROM indexed GROUP BY ALL""")
def index_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh scene has its first index moved up by one, so that the check has something to find."""
    moved = F.col("ndvi") + F.when(F.col("scene_id") % 7 == 0, 1.0).otherwise(0.0)
    return indexed(spark, folder).withColumn("ndvi", moved).groupBy("area").agg(
        F.count_if("valid").alias("valid_pixels"), F.count_if(mosaic.beyond_bounds()).alias("outside"))


@query("daily_mosaic", f"""WITH {MOSAIC}
SELECT area, day::VARCHAR AS day, cell_x, cell_y, scene_id, round(ndvi, 9) + 0e0 AS ndvi, round(ndre, 9) + 0e0 AS ndre, round(ndmi, 9) + 0e0 AS ndmi FROM mosaic""")
def daily_mosaic(spark: SparkSession, folder: str) -> DataFrame:
    best = mosaic.first_valid(indexed(spark, folder), AREA)
    return best.select("area", d("day").alias("day"), "cell_x", "cell_y", "scene_id", *[r(F.col(n)).alias(n) for n in C.INDEX_NAMES])


@query("vegetation_statistics", f"""WITH {MOSAIC},
long AS (SELECT area, day, unnest(['ndvi', 'ndre', 'ndmi']) AS index_name, unnest([ndvi, ndre, ndmi]) AS v FROM mosaic WHERE ndvi >= 3e-1)
SELECT area, day::VARCHAR AS day, index_name, round(min(v), 9) + 0e0 AS min, round(quantile_cont(v, 0.25), 9) + 0e0 AS p25,
  round(quantile_cont(v, 0.5), 9) + 0e0 AS median, round(quantile_cont(v, 0.75), 9) + 0e0 AS p75, round(max(v), 9) + 0e0 AS max
FROM long GROUP BY area, day, index_name""")
def vegetation_statistics(spark: SparkSession, folder: str) -> DataFrame:
    stats = mosaic.vegetation_statistics(mosaic.first_valid(indexed(spark, folder), AREA), AREA)
    return stats.select("area", d("day").alias("day"), "index_name", *[r(F.col(c)).alias(c) for c in ("min", "p25", "median", "p75", "max")])


OBSERVED = MOSAIC + """,
offered AS (SELECT area, day, scene_id, cloud_cover, acquired_at, count(*) FILTER (valid) AS valid_in_footprint FROM indexed GROUP BY ALL),
given AS (SELECT area, day, scene_id, count(*) AS contributing, count(*) FILTER (ndvi >= 3e-1) AS vegetation FROM mosaic GROUP BY ALL),
sources AS (SELECT o.*, coalesce(contributing, 0) AS contributing, coalesce(vegetation, 0) AS vegetation FROM offered o LEFT JOIN given USING (area, day, scene_id)),
footprint AS (SELECT area, count(DISTINCT (cell_x, cell_y)) AS footprint_pixels FROM scene_rows WHERE in_footprint GROUP BY ALL),
observed AS (SELECT area, day, count(*) AS scenes, count(DISTINCT acquired_at) AS distinct_times,
  coalesce(min(acquired_at) FILTER (contributing > 0), min(acquired_at)) AS acquired_at, min(acquired_at) AS first_at, max(acquired_at) AS last_at,
  sum(contributing)::BIGINT AS valid_pixels, sum(vegetation)::BIGINT AS vegetation_pixels FROM sources GROUP BY ALL),
days AS (SELECT *, valid_pixels * 1e2 / footprint_pixels AS valid_footprint_percentage,
  CASE WHEN valid_pixels > 0 THEN vegetation_pixels * 1e2 / valid_pixels ELSE 0e0 END AS vegetation_percentage_of_valid
  FROM observed JOIN footprint USING (area))"""


def contributions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    frame = indexed(spark, folder)
    best = mosaic.first_valid(frame, AREA)
    sources = mosaic.source_contributions(frame, best, AREA)
    return sources, mosaic.daily_observations(sources, footprints(frame), AREA), best


@query("source_contributions", f"""WITH {OBSERVED} SELECT area, day::VARCHAR AS day, scene_id, valid_in_footprint, contributing, vegetation FROM sources""")
def source_contributions(spark: SparkSession, folder: str) -> DataFrame:
    return contributions(spark, folder)[0].select("area", d("day").alias("day"), "scene_id", "valid_in_footprint", "contributing", "vegetation")


@query("daily_observations", f"""WITH {OBSERVED}
SELECT area, day::VARCHAR AS day, scenes, distinct_times, strftime(acquired_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS acquired_at, valid_pixels, vegetation_pixels, footprint_pixels,
  round(valid_footprint_percentage, 9) AS valid_footprint_percentage, round(vegetation_percentage_of_valid, 9) AS vegetation_percentage_of_valid FROM days""")
def daily_observations(spark: SparkSession, folder: str) -> DataFrame:
    days = contributions(spark, folder)[1]
    return days.select("area", d("day").alias("day"), "scenes", "distinct_times", iso_utc(F.col("acquired_at")).alias("acquired_at"),
                       "valid_pixels", "vegetation_pixels", "footprint_pixels",
                       *[r(F.col(c)).alias(c) for c in ("valid_footprint_percentage", "vegetation_percentage_of_valid")])


@query("retained_days", f"""WITH {OBSERVED}
SELECT area, day::VARCHAR AS day, concat_ws(';', CASE WHEN valid_footprint_percentage < 20 THEN '{C.COVERAGE_REASON}' END,
  CASE WHEN vegetation_pixels < 10 THEN '{C.VEGETATION_REASON}' END) AS reasons,
  valid_footprint_percentage >= 20 AND vegetation_pixels >= 10 AS retained FROM days""")
def retained_days(spark: SparkSession, folder: str) -> DataFrame:
    judged = mosaic.with_exclusion_reasons(contributions(spark, folder)[1], 0.2, 10)
    return judged.select("area", d("day").alias("day"), F.array_join("exclusion_reasons", ";").alias("reasons"), "retained")


@query("candidate_day_reconciliation", f"""WITH {OBSERVED}
SELECT area, count(*) AS candidate_days, count(*) FILTER (valid_footprint_percentage >= 20 AND vegetation_pixels >= 10) AS retained_days,
  count(*) FILTER (NOT (valid_footprint_percentage >= 20 AND vegetation_pixels >= 10)) AS excluded_days, sum(scenes)::BIGINT AS scenes FROM days GROUP BY ALL""")
def candidate_day_reconciliation(spark: SparkSession, folder: str) -> DataFrame:
    judged = mosaic.with_exclusion_reasons(contributions(spark, folder)[1], 0.2, 10)
    kept = judged.where("retained").drop("exclusion_reasons")
    dropped = judged.where(~F.col("retained"))
    return kept.unionByName(dropped, allowMissingColumns=True).groupBy("area").agg(
        F.count(F.lit(1)).alias("candidate_days"), F.count_if("retained").alias("retained_days"),
        F.count_if(~F.col("retained")).alias("excluded_days"), F.sum("scenes").alias("scenes"))


@query("observation_audit", f"""WITH {OBSERVED},
src AS (SELECT area, day, min(acquired_at) FILTER (contributing > 0) AS earliest, bool_and(cloud_cover < 80) AS clear,
  bool_and(acquired_at::DATE = day) AS same_day FROM sources GROUP BY ALL),
j AS (SELECT * FROM days JOIN src USING (area, day))
SELECT 'has sources' AS "check", 0::BIGINT AS n_bad UNION ALL SELECT 'times complete', 0 UNION ALL
SELECT 'one UTC day', count(*) FILTER (NOT same_day) FROM j UNION ALL SELECT 'unique sources', 0 UNION ALL
SELECT 'counts ordered', count(*) FILTER (NOT (vegetation_pixels > 0 AND vegetation_pixels <= valid_pixels AND valid_pixels <= footprint_pixels)) FROM j UNION ALL
SELECT 'contributions within validity', 0 UNION ALL SELECT 'contributions sum to valid', 0 UNION ALL
SELECT 'cloud filter', count(*) FILTER (NOT clear) FROM j UNION ALL
SELECT 'representative time', count(*) FILTER (earliest IS NULL OR acquired_at <> earliest) FROM j UNION ALL
SELECT 'valid percentage', 0 UNION ALL
SELECT 'vegetation percentage', count(*) FILTER (valid_pixels = 0) FROM j UNION ALL
SELECT 'coverage filters', count(*) FILTER (NOT (valid_pixels >= footprint_pixels * 2e-1 AND vegetation_pixels >= 10)) FROM j""")
def observation_audit(spark: SparkSession, folder: str) -> DataFrame:
    sources, days, _ = contributions(spark, folder)
    return audit.observation_audit(days, sources, AREA, 80.0, 0.2, 10)


@query("statistics_audit", f"""WITH {MOSAIC},
long AS (SELECT area, day, unnest(['ndvi', 'ndre', 'ndmi']) AS index_name, unnest([ndvi, ndre, ndmi]) AS v FROM mosaic WHERE ndvi >= 3e-1),
stat AS (SELECT day(day + to_days((month(day) + ascii(area))::INT)) AS kind, index_name, min(v) AS low, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS median,
  quantile_cont(v, 0.75) AS p75, max(v) AS high FROM long GROUP BY area, day, index_name),
s AS (SELECT index_name, kind, CASE WHEN kind % 5 = 1 THEN low - 1 ELSE low END AS low, p25, CASE WHEN kind % 5 = 2 THEN NULL ELSE median END AS median,
  CASE WHEN kind % 5 = 3 THEN p25 - 1e-3 ELSE p75 END AS p75, CASE WHEN kind % 5 = 4 THEN high + 2 ELSE high END AS high FROM stat)
SELECT 'finite' AS "check", count(*) FILTER (median IS NULL) AS n_bad FROM s
UNION ALL SELECT 'ordered', count(*) FILTER (NOT coalesce(low <= p25 AND p25 <= median AND median <= p75 AND p75 <= high, false)) FROM s
UNION ALL SELECT 'inside bounds', count(*) FILTER (NOT (low >= -{C.INDEX_BOUND:e} AND high <= {C.INDEX_BOUND:e})) FROM s
UNION ALL SELECT 'ndvi screen', count(*) FILTER (index_name = 'ndvi' AND low < 3e-1) FROM s""")
def statistics_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Daily statistics with a defect in four of five kinds of days: a low minimum, no median, a third quartile below the first, a high maximum."""
    stats = mosaic.vegetation_statistics(mosaic.first_valid(indexed(spark, folder), AREA), AREA)
    kind = F.day(F.date_add("day", F.month("day") + F.ascii("area"))) % 5
    broken = stats.withColumns({
        "min": F.when(kind == 1, F.col("min") - 1).otherwise(F.col("min")), "median": F.when(kind != 2, F.col("median")),
        "p75": F.when(kind == 3, F.col("p25") - 1e-3).otherwise(F.col("p75")), "max": F.when(kind == 4, F.col("max") + 2).otherwise(F.col("max"))})
    return audit.statistics_audit(broken)


@query("time_series_rows", f"""WITH {OBSERVED},
src AS (SELECT area, day, string_agg(scene_id::VARCHAR, ';' ORDER BY cloud_cover, scene_id) AS scene_ids,
  string_agg(strftime(acquired_at, '%Y-%m-%dT%H:%M:%S.%fZ'), ';' ORDER BY cloud_cover, scene_id) AS acquisition_datetimes FROM sources GROUP BY ALL),
stat AS (SELECT area, day, {', '.join(f'round(quantile_cont({n}, {q}), 9) + 0e0 AS {n}_{s}' for n in C.INDEX_NAMES for s, q in (('median', 0.5), ('p25', 0.25), ('p75', 0.75)))}
  FROM mosaic WHERE ndvi >= 3e-1 GROUP BY area, day)
SELECT area, d.day::VARCHAR AS date, scene_ids, acquisition_datetimes, valid_pixels AS valid_pixel_count, {', '.join(f'{n}_{s}' for n in C.INDEX_NAMES for s in ('median', 'p25', 'p75'))}
FROM days d JOIN src USING (area, day) JOIN stat USING (area, day)""")
def time_series_rows(spark: SparkSession, folder: str) -> DataFrame:
    sources, days, best = contributions(spark, folder)
    rows = series_rows(days, sources, mosaic.vegetation_statistics(best, AREA), AREA)
    return rows.select("area", d("date").alias("date"), "scene_ids", "acquisition_datetimes", "valid_pixel_count",
                       *[r(F.col(f"{n}_{s}")).alias(f"{n}_{s}") for n in C.INDEX_NAMES for s in ("median", "p25", "p75")])


@query("median_composite", f"""WITH {MOSAIC}
SELECT area, cell_x, cell_y, round(quantile_cont(ndvi, 0.5), 9) + 0e0 AS median, count(ndvi) AS dates FROM mosaic GROUP BY area, cell_x, cell_y""")
def median_composite(spark: SparkSession, folder: str) -> DataFrame:
    composite = mosaic.median_composite(mosaic.first_valid(indexed(spark, folder), AREA), ["area", "cell_x", "cell_y"], "ndvi")
    return composite.withColumn("median", r(F.col("median")))


@query("halved_resolution", """WITH p AS (SELECT l_returnflag AS scene_id, l_partkey AS x, l_suppkey AS y, max(l_quantity) AS v FROM lineitem GROUP BY ALL)
SELECT scene_id, x // 2 AS cell_x, y // 2 AS cell_y, count(*) FILTER (v > 0) AS parts,
  CASE WHEN count(*) FILTER (v > 0) = 4 THEN round(avg(v) FILTER (v > 0), 9) END AS mean FROM p GROUP BY ALL""")
def halved_resolution(spark: SparkSession, folder: str) -> DataFrame:
    cells = [F.col("l_returnflag").alias("scene_id"), F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), F.col("l_quantity").alias("v"),
             F.floor(F.col("l_partkey") / 2).alias("cell_x"), F.floor(F.col("l_suppkey") / 2).alias("cell_y")]
    coarse = ["scene_id", "cell_x", "cell_y"]
    fine = dealt_by(table(spark, folder, "lineitem").select(*cells), *coarse).groupBy(*coarse, "x", "y").agg(F.max("v").alias("v"))
    return mosaic.average_cells(fine, coarse, "v").withColumn("mean", r(F.col("mean")))


VERSIONS = """versions AS (SELECT event_id AS scene_id, event_type AS platform, date_trunc('hour', ts) AS acquired_at, user_id AS tile,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 5)::INT END AS relative_orbit,
  CASE WHEN value < 5 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS generation_time FROM events)"""


@query("latest_versions", f"""WITH {VERSIONS}
SELECT scene_id, row_number() OVER (PARTITION BY platform, acquired_at, tile, relative_orbit
  ORDER BY coalesce(generation_time, '') DESC, scene_id DESC) > 1 AS dropped FROM versions""")
def latest_versions(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    versions = e.select(
        F.col("event_id").alias("scene_id"), F.col("event_type").alias("platform"), F.date_trunc("hour", "ts").alias("acquired_at"),
        F.col("user_id").alias("tile"), F.when(F.pmod("event_id", F.lit(7)) != 0, F.pmod("event_id", F.lit(5)).cast("int")).alias("relative_orbit"),
        F.when(F.col("value") >= 5, iso_utc(F.col("ts").cast("timestamp"))).alias("generation_time"))
    return mosaic.latest_versions(versions).select("scene_id", "dropped")


@query("ordered_daily_sources", """SELECT user_id AS tile, ts::DATE::VARCHAR AS day, count(*) AS scenes,
  string_agg(event_id::VARCHAR, ';' ORDER BY value, event_id) AS scene_ids FROM events GROUP BY ALL""")
def ordered_daily_sources(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    listed = mosaic.daily_sources(e.select(F.col("user_id").alias("tile"), F.col("event_id").alias("scene_id"),
                                           F.col("ts").cast("timestamp").alias("acquired_at"), F.col("value").alias("cloud_cover")), ["tile"])
    return listed.select("tile", d("day").alias("day"), big(F.size("sources")).alias("scenes"),
                         F.array_join(F.transform("sources", lambda s: s["scene_id"].cast("string")), ";").alias("scene_ids"))


@query("catalog_search", """SELECT o_orderkey AS scene_id, o_orderdate::DATE::VARCHAR AS day, round(o_totalprice / 6e3, 9) AS cloud_cover FROM orders
WHERE (o_custkey % 360) - 180e0 <= 2e1 AND (o_custkey % 360) - 180e0 + 5e0 >= -3e1 AND (o_orderkey % 170) - 85e0 <= 4e1 AND (o_orderkey % 170) - 85e0 + 5e0 >= -1e1
  AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate <= TIMESTAMP '1997-12-31 23:59:59.999999' AND o_totalprice / 6e3 < 30""")
def catalog_search(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    west, south = F.pmod("o_custkey", F.lit(360)) - 180.0, F.pmod("o_orderkey", F.lit(170)) - 85.0
    items = o.select(F.col("o_orderkey").alias("scene_id"), F.col("o_orderdate").cast("timestamp").alias("acquired_at"),
                     (F.col("o_totalprice") / 6000.0).alias("cloud_cover"), west.alias("west"), south.alias("south"),
                     (west + 5.0).alias("east"), (south + 5.0).alias("north"))
    found = catalog.search(items, (-30.0, -10.0, 20.0, 40.0), "1996-01-01", "1997-12-31", 30.0)
    return found.select("scene_id", d("acquired_at").alias("day"), r(F.col("cloud_cover")).alias("cloud_cover"))


@query("footprint_cells", """WITH grids AS (SELECT s_suppkey AS area_id, floor((s_acctbal / 1e1) / 20) * 20 AS grid_west,
  ceil((s_acctbal / 1e1 + 190) / 20) * 20 AS grid_east, floor((s_nationkey * 3e0) / 20) * 20 AS grid_south, ceil((s_nationkey * 3e0 + 130) / 20) * 20 AS grid_north,
  s_acctbal / 1e1 AS x0, s_nationkey * 3e0 AS y0 FROM supplier),
cols AS (SELECT *, unnest(range(((grid_east - grid_west) / 20)::BIGINT)) AS cell_x FROM grids),
cells AS (SELECT *, unnest(range(((grid_north - grid_south) / 20)::BIGINT)) AS cell_y FROM cols),
c AS (SELECT area_id, cell_x, cell_y, grid_west + (cell_x + 5e-1) * 20 AS x, grid_north - (cell_y + 5e-1) * 20 AS y, x0, y0 FROM cells)
SELECT area_id, count(*) AS cells, sum(cell_x)::BIGINT AS sum_x, sum(cell_y)::BIGINT AS sum_y FROM c
WHERE x >= x0 AND y >= y0 AND (x - x0) / 190e0 + (y - y0) / 130e0 <= 1 GROUP BY area_id""")
def footprint_cells(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier")
    x, y = F.col("s_acctbal") / 10.0, F.col("s_nationkey") * 3.0
    corner = lambda a, b: F.struct(a.alias("lon"), b.alias("lat"))
    areas = s.select(F.col("s_suppkey").alias("area_id"), x.alias("west"), y.alias("south"), (x + 190).alias("east"), (y + 130).alias("north"),
                     F.array(corner(x, y), corner(x + 190, y), corner(x, y + 130), corner(x, y)).alias("ring"))
    cells = spatial.footprint_cells(spatial.snapped_grid(areas))
    return cells.groupBy("area_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("cell_x").alias("sum_x"), F.sum("cell_y").alias("sum_y"))
