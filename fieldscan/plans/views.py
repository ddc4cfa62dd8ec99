"""The operators' input roles, read from the given tables.

Each role is written twice: as a DataFrame and as the SQL text the checks use.
Scans are column-pruned; nothing is sampled or cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscan.operators import screening
from fieldscan.session import prepare

MASKS = ["nodata_mask", "cloud_mask", "cirrus_mask"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r(value: Column, digits: int = 9) -> Column:
    """Rounded for comparison; adding zero removes a negative zero."""
    return F.round(value, digits) + F.lit(0.0)


def r_scaled(value: Column, digits: int) -> Column:
    """Rounded in doubles, as the SQL does: a value whose decimal text ends in a tie may lie on either side of it."""
    return F.round(value * 10.0**digits) / 10.0**digits + F.lit(0.0)


def big(value: Column) -> Column:
    return value.cast("bigint")


def d(value: Column | str) -> Column:
    """Dates leave as ISO text, which every engine compares alike."""
    return F.date_format(value, "yyyy-MM-dd")


# --- pixels: line items as image pixels, three scenes of a third each ----------

def pixels(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    flag = lambda bad: bad.cast("int")
    return li.select(
        F.col("l_returnflag").alias("scene_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.date_format("l_shipdate", "yyyyMMdd")).alias("pixel_id"),
        (F.col("l_orderkey") * 7 + F.col("l_linenumber") - 1).alias("grid_index"),
        flag(F.col("l_linestatus") != "F").alias("nodata_mask"),
        flag(F.col("l_tax") >= 0.075).alias("cloud_mask"),
        flag(F.col("l_discount") >= 0.095).alias("cirrus_mask"),
        (F.col("l_discount") * 5.0).alias("red"), (F.col("l_discount") * 3.0).alias("red_edge"),
        (F.col("l_quantity") / 50.0).alias("nir"), (F.col("l_tax") * 5.0).alias("swir"))


def screened(spark: SparkSession, folder: str) -> DataFrame:
    return screening.with_vegetation(screening.with_indices(
        screening.with_quality(pixels(spark, folder), MASKS)))


PIXELS = """
pixels AS (
  SELECT l_returnflag AS scene_id,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS pixel_id,
         l_orderkey * 7 + l_linenumber - 1 AS grid_index,
         CASE WHEN l_linestatus <> 'F' THEN 1 ELSE 0 END AS nodata_mask,
         CASE WHEN l_tax >= 75e-3 THEN 1 ELSE 0 END AS cloud_mask,
         CASE WHEN l_discount >= 95e-3 THEN 1 ELSE 0 END AS cirrus_mask,
         l_discount * 5e0 AS red, l_discount * 3e0 AS red_edge, l_quantity / 5e1 AS nir, l_tax * 5e0 AS swir
  FROM lineitem)"""
INDICES = PIXELS + """,
quality AS (SELECT *, nodata_mask = 0 AND cloud_mask = 0 AND cirrus_mask = 0 AS quality_valid FROM pixels),
indexed AS (SELECT *,
    CASE WHEN quality_valid AND nir + red > 0 THEN (nir - red) / (nir + red) END AS ndvi,
    CASE WHEN quality_valid AND nir + red_edge > 0 THEN (nir - red_edge) / (nir + red_edge) END AS ndre,
    CASE WHEN quality_valid AND nir + swir > 0 THEN (nir - swir) / (nir + swir) END AS ndmi
  FROM quality)"""
SCREENED = INDICES + """,
screened AS (SELECT *, coalesce(quality_valid AND ndvi >= 3e-1, false) AS vegetation,
    coalesce(quality_valid AND ndvi >= 3e-1, false) AND ndre IS NOT NULL AND ndmi IS NOT NULL AS classified
  FROM indexed)"""


def midrank(value: str, population: str = "scene_id") -> str:
    return (f"1e2 * (rank() OVER (PARTITION BY {population} ORDER BY {value}) - 1"
            f" + 5e-1 * count(*) OVER (PARTITION BY {population}, {value})) / count(*) OVER (PARTITION BY {population})")


EVIDENCE = SCREENED + f""",
ranked AS (SELECT *, {midrank('ndvi')} AS ndvi_percentile, {midrank('ndre')} AS ndre_percentile,
    {midrank('ndmi')} AS ndmi_percentile FROM screened WHERE classified),
scored AS (SELECT *, 1e2 - ndmi_percentile AS ndmi_deficit,
    8e-1 + 1e-1 * (1e0 - ndvi_percentile / 1e2) + 1e-1 * (1e0 - ndre_percentile / 1e2) AS support_factor FROM ranked),
evidence AS (SELECT *, greatest(0e0, least(1e2, ndmi_deficit * support_factor)) AS risk_score,
    CASE WHEN ndvi_percentile < 25 THEN 1 WHEN ndvi_percentile < 75 THEN 2 ELSE 3 END AS ndvi_condition,
    CASE WHEN ndre_percentile < 25 THEN 1 WHEN ndre_percentile < 75 THEN 2 ELSE 3 END AS ndre_condition,
    CASE WHEN greatest(0e0, least(1e2, ndmi_deficit * support_factor)) < 25 THEN 1
         WHEN greatest(0e0, least(1e2, ndmi_deficit * support_factor)) < 50 THEN 2
         WHEN greatest(0e0, least(1e2, ndmi_deficit * support_factor)) < 75 THEN 3 ELSE 4 END AS risk_class
  FROM scored)"""


# --- spectra: embeddings as pixels of ten label groups, 64 bands ----------------

def spectra(spark: SparkSession, folder: str, shift: float = 0.0) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return e.select(F.lit("S").alias("scene_id"), F.col("label").cast("bigint").alias("group_id"),
                    F.col("vec_id").alias("pixel_id"), F.posexplode("embedding").alias("band_index", "v")) \
        .select("scene_id", "group_id", "pixel_id", "band_index", (F.col("v").cast("double") + shift).alias("reflectance"))


def cube(spark: SparkSession, folder: str, shift: float = 0.0) -> DataFrame:
    """The same pixels with their whole spectrum as one array."""
    e = table(spark, folder, "embeddings")
    return e.select(F.lit("S").alias("scene_id"), F.col("label").cast("bigint").alias("group_id"), F.col("vec_id").alias("pixel_id"),
                    F.transform("embedding", lambda v: v.cast("double") + shift).alias("reflectance"))


def spectra_bands(spark: SparkSession, folder: str, step: float = 20.0) -> DataFrame:
    """The band dimension: positions up to the longest vector, 400 nm upward; one constant nodata."""
    longest = table(spark, folder, "embeddings").agg(F.max(F.size("embedding")).alias("n")).where("n > 0")
    return longest.select(F.lit("S").alias("scene_id"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("band_index")).select(
        "scene_id", "band_index", (400.0 + step * F.col("band_index")).alias("wavelength_nm"),
        F.concat(F.lit("b"), F.col("band_index").cast("string")).alias("band_name"), F.lit(0.25).alias("nodata"))


SPECTRA = """
points AS (SELECT 'S' AS scene_id, label::BIGINT AS group_id, vec_id AS pixel_id,
    unnest(embedding)::DOUBLE AS reflectance, generate_subscripts(embedding, 1) - 1 AS band_index FROM embeddings),
spectra AS (SELECT *, 4e2 + 2e1 * band_index AS wavelength_nm,
    CASE WHEN reflectance >= 0 AND reflectance <> 25e-2 THEN reflectance END AS valid_reflectance FROM points)"""


# --- scenes: orders as acquisitions, their line items as 10 x 10 cell windows ---

def scenes(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("scene_id"), F.col("o_orderstatus").alias("area"),
        F.col("o_orderdate").cast("timestamp").alias("acquired_at"),
        F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("day"),
        (F.col("o_totalprice") / 6000.0).alias("cloud_cover"), F.col("o_custkey").alias("tile"))


def scene_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Digital numbers per scene and cell, with the scene's calibration attached."""
    li = table(spark, folder, "lineitem")
    dn = li.groupBy(F.col("l_orderkey").alias("scene_id"), F.pmod("l_partkey", F.lit(10)).alias("cell_x"),
                    F.pmod("l_suppkey", F.lit(10)).alias("cell_y")).agg(
        F.max(F.col("l_discount") * 20000.0).alias("b04"), F.max(F.col("l_discount") * 15000.0).alias("b05"),
        F.max(F.col("l_quantity") * 200.0).alias("b8a"), F.max(F.col("l_tax") * 30000.0).alias("b11"),
        F.min("l_linenumber").alias("scl"))
    known = scenes(spark, folder).select("scene_id", "area", "acquired_at", "day", "cloud_cover")
    return dn.join(known, "scene_id").withColumns({
        "in_footprint": (F.col("cell_x") + F.col("cell_y")) < 16,
        "quantification": F.lit(10000.0), "b04_offset": F.lit(-100.0), "b05_offset": F.lit(-100.0),
        "b8a_offset": F.lit(-100.0), "b11_offset": F.lit(-100.0)})

SCENE_PIXELS = """
dn AS (SELECT l_orderkey AS scene_id, l_partkey % 10 AS cell_x, l_suppkey % 10 AS cell_y,
    max(l_discount * 2e4) AS b04, max(l_discount * 15e3) AS b05, max(l_quantity * 2e2) AS b8a,
    max(l_tax * 3e4) AS b11, min(l_linenumber) AS scl FROM lineitem GROUP BY ALL),
scene_rows AS (SELECT dn.*, o_orderstatus AS area, o_orderdate AS acquired_at, date_trunc('month', o_orderdate)::DATE AS day,
    o_totalprice / 6e3 AS cloud_cover, cell_x + cell_y < 16 AS in_footprint,
    cell_x + cell_y < 16 AND scl IN (4, 5) AS clear,
    CASE WHEN b04 > 0 AND (b04 - 1e2) / 1e4 >= 0 THEN (b04 - 1e2) / 1e4 END AS red,
    CASE WHEN b05 > 0 AND (b05 - 1e2) / 1e4 >= 0 THEN (b05 - 1e2) / 1e4 END AS red_edge,
    CASE WHEN b8a > 0 AND (b8a - 1e2) / 1e4 >= 0 THEN (b8a - 1e2) / 1e4 END AS nir,
    CASE WHEN b11 > 0 AND (b11 - 1e2) / 1e4 >= 0 THEN (b11 - 1e2) / 1e4 END AS swir
  FROM dn JOIN orders ON scene_id = o_orderkey),
cleaned AS (SELECT *, clear AND red IS NOT NULL AND red_edge IS NOT NULL AND nir IS NOT NULL AND swir IS NOT NULL
    AND nir + red > 0 AND nir + red_edge > 0 AND nir + swir > 0 AS valid FROM scene_rows),
indexed AS (SELECT *, CASE WHEN valid THEN (nir - red) / (nir + red) END AS ndvi,
    CASE WHEN valid THEN (nir - red_edge) / (nir + red_edge) END AS ndre,
    CASE WHEN valid THEN (nir - swir) / (nir + swir) END AS ndmi FROM cleaned)"""
MOSAIC = SCENE_PIXELS + """,
mosaic AS (SELECT area, day, cell_x, cell_y, scene_id, ndvi, ndre, ndmi FROM (
    SELECT *, row_number() OVER (PARTITION BY area, day, cell_x, cell_y ORDER BY cloud_cover, scene_id) AS place
    FROM indexed WHERE valid) WHERE place = 1)"""


# --- events: acquisitions of five sites ------------------------------------------

def acquisitions(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(F.col("event_type").alias("site"), F.col("event_id").alias("scene_id"),
                    F.col("ts").cast("timestamp").alias("acquired_at"), F.to_date("ts").alias("day"),
                    F.col("user_id").alias("tile"), (F.col("value") / 100.0).alias("value"))


ACQUISITIONS = """
acquisitions AS (SELECT event_type AS site, event_id AS scene_id, ts AS acquired_at, ts::DATE AS day,
    user_id AS tile, value / 1e2 AS value FROM events),
days AS (SELECT site, day, quantile_cont(value, 0.5) AS median, min(acquired_at) AS first_at, max(acquired_at) AS last_at,
    count(*) AS sources FROM acquisitions GROUP BY ALL)"""
