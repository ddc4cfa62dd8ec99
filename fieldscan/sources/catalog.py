"""Catalogue items: scan, search, assets and band metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscan import constants as C
from fieldscan import schemas
from fieldscan.functions.geometry import bbox_overlaps
from fieldscan.functions.reflectance import in_window
from fieldscan.functions.timestamps import zoned_timestamp


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file or per line, under a fixed schema."""
    return spark.read.schema(schemas.ITEM).option("multiLine", True).json(path)


def identity_mismatch(items: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested ids without an item, and items nobody asked for."""
    return requested.select(F.col("scene_id").alias("requested")).join(
        items.select(F.col("id").alias("returned")), F.col("requested") == F.col("returned"), "full_outer") \
        .where(F.col("requested").isNull() | F.col("returned").isNull())


def surface_reflectance(items: DataFrame) -> DataFrame:
    """(scene_id, asset_key, asset): the ortho product when present, else the basic one."""
    keys = ("ortho_sr_hdf5", "basic_sr_hdf5")
    found = F.coalesce(*[F.when(F.try_element_at("assets", F.lit(k)).isNotNull(), F.lit(k)) for k in keys])
    picked = items.select(F.col("id").alias("scene_id"), found.alias("asset_key"), "assets") \
        .withColumn("a", F.try_element_at("assets", F.col("asset_key")))
    bands = F.transform("a.bands", lambda b: F.struct(
        b["name"].alias("name"), b["eo:center_wavelength"].alias("center_wavelength"), b["nodata"].alias("nodata")))
    return picked.select("scene_id", "asset_key", F.struct(F.col("a.href").alias("href"), bands.alias("bands")).alias("asset"))


def scenes_of(items: DataFrame) -> DataFrame:
    """Flat scene rows; a timestamp without a zone fails the job."""
    p = F.col("properties")
    at = zoned_timestamp(p["datetime"], require_time=False)
    checked = F.when(at.isNotNull(), at).otherwise(
        F.raise_error(F.concat(F.lit("acquisition time lacks a zone: "), F.col("id"))).cast("timestamp"))
    return items.select(
        F.col("id").alias("scene_id"), p["platform"].alias("platform"), checked.alias("acquired_at"),
        p["s2:mgrs_tile"].alias("tile"), p["sat:relative_orbit"].alias("relative_orbit"),
        p["s2:generation_time"].alias("generation_time"), p["eo:cloud_cover"].alias("cloud_cover"),
        *[F.get("bbox", F.lit(i)).alias(side) for i, side in enumerate(("west", "south", "east", "north"))])


def search(scenes: DataFrame, box: tuple[float, float, float, float], start_day: str, end_day: str,
           cloud_max: float) -> DataFrame:
    """Box overlap, whole closed days, cloud strictly below the limit.

    Every condition is a plain bound on a column, so all of them reach the scan.
    """
    return scenes.where(
        bbox_overlaps(F.col("west"), F.col("south"), F.col("east"), F.col("north"), box)
        & (F.col("acquired_at") >= F.lit(f"{start_day} 00:00:00").cast("timestamp"))
        & (F.col("acquired_at") <= F.lit(f"{end_day} 23:59:59.999999").cast("timestamp"))
        & (F.col("cloud_cover") < cloud_max))


def multispectral_bands(items: DataFrame) -> DataFrame:
    """(scene_id, band, role, centre, width, resolution, inside): the four analysis bands."""
    roles = F.create_map(*[F.lit(x) for role, band in C.SCENE_BANDS.items() for x in (band, role)])
    entries = items.select(F.col("id").alias("scene_id"), F.explode("assets").alias("band", "a")) \
        .where(F.col("band").isin(*C.SCENE_BANDS.values()))
    first = F.get("a.eo:bands", F.lit(0))
    centre = first["center_wavelength"] * 1000.0
    return entries.select(
        "scene_id", "band", F.try_element_at(roles, "band").alias("role"), centre.alias("center_wavelength_nm"),
        (first["full_width_half_max"] * 1000.0).alias("full_width_half_max_nm"), F.col("a.gsd").alias("native_resolution_m"),
        F.lit(C.GRID_METRES).alias("analysis_resolution_m"), F.coalesce(in_window(centre), F.lit(False)).alias("inside_window"))
