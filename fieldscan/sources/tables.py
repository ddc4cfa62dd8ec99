"""Parquet layouts, the time-series files and one-row documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscan import constants as C
from fieldscan import schemas
from fieldscan.functions.text import join_list, split_list
from fieldscan.functions.timestamps import iso_utc, zoned_timestamp
from fieldscan.operators.audit import all_finite, raise_if_bad


def write_pixels(pixels: DataFrame, path: str) -> None:
    """Hot bands as columns, one directory per scene: column and partition pruning."""
    pixels.repartition("scene_id", F.pmod(F.xxhash64("pixel_id"), F.lit(64))).write.mode("overwrite").partitionBy("scene_id").parquet(path)


def write_spectra(spectra: DataFrame, path: str, slices: int = 64) -> None:
    """Long spectra sorted by band inside each file, so row groups skip bands.

    Pixels of a scene are dealt to ``slices`` tasks; no scene is one task's work.
    """
    spectra.repartition("scene_id", F.pmod("pixel_id", F.lit(slices))).sortWithinPartitions("scene_id", "band_index", "pixel_id") \
        .write.mode("overwrite").partitionBy("scene_id").parquet(path)


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PIXELS).parquet(path)


def read_spectra(spark: SparkSession, path: str, bands: list[int] | None = None) -> DataFrame:
    """Only the wanted bands: the filter reaches Parquet row-group statistics."""
    spectra = spark.read.schema(schemas.SPECTRA).parquet(path)
    return spectra if bands is None else spectra.where(F.col("band_index").isin(*bands))


def write_scene_pixels(pixels: DataFrame, path: str) -> None:
    """Digital numbers of scenes with their day, one directory per day; a day is dealt to 64 tasks."""
    pixels.repartition("day", F.pmod(F.xxhash64("scene_id", "cell_x", "cell_y"), F.lit(64))).write.mode("overwrite").partitionBy("day").parquet(path)


def read_scene_pixels(spark: SparkSession, path: str, days: tuple[str, str] | None = None) -> DataFrame:
    """Digital numbers partitioned by day; the day range prunes directories."""
    rows = spark.read.schema(schemas.SCENE_PIXELS + ", day date").parquet(path)
    return rows if days is None else rows.where(F.col("day").between(*[F.lit(d).cast("date") for d in days]))


def write_evidence(evidence: DataFrame, path: str) -> None:
    evidence.repartition("scene_id", F.pmod(F.xxhash64("pixel_id"), F.lit(64))).write.mode("overwrite").partitionBy("scene_id").parquet(path)


def read_evidence(spark: SparkSession, path: str, schema: str, scenes: list[str] | None = None) -> DataFrame:
    """Saved evidence with the ``schema`` it was written with; wanted scenes prune directories."""
    rows = spark.read.schema(schema).parquet(path)
    return rows if scenes is None else rows.where(F.col("scene_id").isin(*scenes))


def series_rows(observations: DataFrame, sources: DataFrame, statistics: DataFrame,
                keys: list[str] | None = None) -> DataFrame:
    """Flat time-series rows; the ';' lists keep the clearest-first order of the sources."""
    by = [*(keys or []), "day"]
    wide = statistics.groupBy(*by).agg(*[
        F.max(F.when(F.col("index_name") == n, F.col(s))).alias(f"{n}_{s}") for n in C.INDEX_NAMES for s in ("median", "p25", "p75")])
    listed = sources.groupBy(*by).agg(F.array_sort(F.collect_list(
        F.struct("cloud_cover", "scene_id", "acquired_at"))).alias("s"))
    s = F.col("s")
    return observations.join(listed, by).join(wide, by).select(
        *(keys or []), F.col("day").alias("date"), F.col("acquired_at").alias("acquisition_datetime"),
        join_list(F.transform(s, lambda x: iso_utc(x["acquired_at"]))).alias("acquisition_datetimes"),
        join_list(F.transform(s, lambda x: x["scene_id"].cast("string"))).alias("scene_ids"),
        join_list(F.transform(s, lambda x: x["cloud_cover"].cast("string"))).alias("scene_cloud_percent"),
        F.col("valid_pixels").alias("valid_pixel_count"), F.col("vegetation_pixels").alias("vegetation_pixel_count"),
        F.col("footprint_pixels").alias("footprint_pixel_count"), "valid_footprint_percentage", "vegetation_percentage_of_valid",
        *[f"{n}_{x}" for n in C.INDEX_NAMES for x in ("median", "p25", "p75")])


def _all_known(times: Column, cutoff: str) -> Column:
    """Every listed time is at or before the cutoff; a time without a zone fails the job."""
    def known(text: Column) -> Column:
        instant = F.coalesce(zoned_timestamp(text), F.raise_error(F.concat(
            F.lit("acquisition time lacks a zone: "), text)).cast("timestamp"))
        return instant <= F.lit(cutoff).cast("timestamp")

    return F.forall(times, known)


def with_cutoff_flags(rows: DataFrame, cutoff: str) -> DataFrame:
    eligible = _all_known(split_list(F.col("acquisition_datetimes")), cutoff)
    return rows.withColumns({"eligible_at_decision_cutoff": eligible, "after_decision_cutoff": ~eligible,
                             "operational_availability": F.lit("not_established")})


def write_series(rows: DataFrame, path: str, as_json: bool = False) -> None:
    """CSV with a header, or one JSON document per day; ordered by date."""
    ordered = rows.orderBy("date")
    if as_json:
        ordered.write.mode("overwrite").json(path)
    else:
        ordered.write.mode("overwrite").option("header", True).csv(path)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """The CSV back with its list columns split."""
    rows = spark.read.schema(schemas.TIME_SERIES).option("header", True).csv(path)
    return rows.withColumns({c: split_list(F.col(c)) for c in ("acquisition_datetimes", "scene_ids", "scene_cloud_percent")})


def flag_mismatches(series: DataFrame, cutoff: str) -> DataFrame:
    """Rows whose stored eligibility differs from the recomputed one."""
    eligible = _all_known(F.col("acquisition_datetimes"), cutoff)
    return series.where(~(F.col("eligible_at_decision_cutoff").eqNullSafe(eligible)
                          & F.col("after_decision_cutoff").eqNullSafe(~eligible)))


def write_document(document: DataFrame, path: str) -> None:
    """A small JSON document; any nonfinite number stops the write."""
    raise_if_bad(all_finite(document))
    document.write.mode("overwrite").json(path)
