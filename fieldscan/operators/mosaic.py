"""Many overlapping scenes -> one observation per day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscan import constants as C
from fieldscan.functions import reflectance as R
from fieldscan.functions.checks import errors
from fieldscan.functions.timestamps import utc_day
from fieldscan.operators.quantiles import exact_quantiles, join_groups


def latest_versions(scenes: DataFrame) -> DataFrame:
    """Tag reprocessing duplicates: dropped is true for all but the newest version.

    A missing generation time sorts first, and a missing orbit is a value of
    its own. The newest id per acquisition is found with a map-side combined
    aggregate; only those ids come back to mark the rows.
    """
    key = ["platform", "acquired_at", "tile", "relative_orbit"]
    newest = scenes.groupBy(*key).agg(F.max_by(
        "scene_id", F.struct(F.coalesce("generation_time", F.lit("")), F.col("scene_id"))).alias("scene_id"))
    kept = newest.select("scene_id", F.lit(False).alias("_kept"))
    return scenes.join(kept, "scene_id", "left").withColumn("dropped", F.coalesce("_kept", F.lit(True))).drop("_kept")


def daily_sources(scenes: DataFrame, keys: list[str]) -> DataFrame:
    """Clearest-first source list per UTC day: cloud cover, then scene id."""
    return scenes.withColumn("day", utc_day(F.col("acquired_at"))).groupBy(*keys, "day").agg(
        F.array_sort(F.collect_list(F.struct("cloud_cover", "scene_id", "acquired_at"))).alias("sources"))


def calibrated_indices(scene_pixels: DataFrame) -> DataFrame:
    """Reflectance from digital numbers, then indices of clear land inside the footprint.

    Expects quantification and one offset per band already joined on scene
    (a dimension of four rows per scene). A pixel is valid only when all four
    bands and all three indices are.
    """
    clear = F.col("in_footprint") & F.col("scl").isin(*C.CLEAR_LAND_CLASSES)
    bands = {role: R.calibrated(F.col(name.lower()), F.col("quantification"), F.col(f"{name.lower()}_offset"))
             for role, name in C.SCENE_BANDS.items()}
    counted = F.least(*[F.col(name.lower()) for name in C.SCENE_BANDS.values()]) > 0  # DN before the offset
    nir = F.col("nir")
    usable = clear & counted
    for other in ("red", "red_edge", "swir"):
        usable = usable & R.usable_pair(nir, F.col(other))
    staged = scene_pixels.withColumns(bands).withColumn("valid", F.coalesce(usable, F.lit(False)))
    return staged.withColumns({
        name: F.when(F.col("valid"), (nir - F.col(other)) / (nir + F.col(other)))
        for name, other in (("ndvi", "red"), ("ndre", "red_edge"), ("ndmi", "swir"))})


def beyond_bounds() -> Column:
    """A valid cell with a normalised index outside [-1, 1]."""
    return F.col("valid") & (F.greatest(*[F.abs(F.col(n)) for n in C.INDEX_NAMES]) > C.INDEX_BOUND)


def out_of_bounds(indexed: DataFrame) -> DataFrame:
    """Rows whose normalised index leaves [-1, 1]; must be empty."""
    return indexed.where(beyond_bounds())


def first_valid(indexed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per day and cell: the clearest scene with a valid pixel gives all three indices.

    ``min_by`` combines map-side, so overlapping scenes shrink before the shuffle.
    """
    best = F.min_by(F.struct("scene_id", *C.INDEX_NAMES), F.struct("cloud_cover", "scene_id"))
    return indexed.where("valid").groupBy(*keys, "day", "cell_x", "cell_y").agg(best.alias("b")) \
        .select(*keys, "day", "cell_x", "cell_y", "b.*")


def vegetation_statistics(mosaic: DataFrame, keys: list[str], threshold: float = C.VEGETATION_NDVI) -> DataFrame:
    """Long (keys, day, index_name): min, p25, median, p75, max over vegetation."""
    vegetation = mosaic.where(F.col("ndvi") >= threshold)
    long = vegetation.select(*keys, "day", F.explode(F.array(*[
        F.struct(F.lit(n).alias("index_name"), F.col(n).alias("value")) for n in C.INDEX_NAMES])).alias("m")) \
        .select(*keys, "day", "m.index_name", "m.value")
    return exact_quantiles(long, [*keys, "day", "index_name"], "value", {"p25": 0.25, "median": 0.5, "p75": 0.75},
                           also={"min": F.min("value"), "max": F.max("value")}).drop("total")


def source_contributions(indexed: DataFrame, mosaic: DataFrame, keys: list[str],
                         threshold: float = C.VEGETATION_NDVI) -> DataFrame:
    """One row per day and scene: valid, contributing and vegetation pixel counts."""
    offered = indexed.groupBy(*keys, "day", "scene_id", "cloud_cover", "acquired_at").agg(
        F.count_if("valid").alias("valid_in_footprint"))
    given = mosaic.groupBy(*keys, "day", "scene_id").agg(
        F.count(F.lit(1)).alias("contributing"), F.count_if(F.col("ndvi") >= threshold).alias("vegetation"))
    return offered.join(given, [*keys, "day", "scene_id"], "left").fillna(0, subset=["contributing", "vegetation"])


def daily_observations(sources: DataFrame, footprints: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, shares and times of every day; the source list stays its own table.

    ``footprints`` gives (keys, footprint_pixels). The representative time is the
    earliest contributing acquisition, else the earliest of all.
    """
    days = sources.groupBy(*keys, "day").agg(
        F.count(F.lit(1)).alias("scenes"), F.count_distinct("acquired_at").alias("distinct_times"),
        F.min("acquired_at").alias("first_at"), F.max("acquired_at").alias("last_at"),
        F.coalesce(F.min(F.when(F.col("contributing") > 0, F.col("acquired_at"))), F.min("acquired_at")).alias("acquired_at"),
        F.sum("contributing").alias("valid_pixels"), F.sum("vegetation").alias("vegetation_pixels"))
    return join_groups(days, footprints, keys, "inner").withColumns({
        "valid_footprint_percentage": F.col("valid_pixels") * 100.0 / F.col("footprint_pixels"),
        "vegetation_percentage_of_valid": F.when(
            F.col("valid_pixels") > 0, F.col("vegetation_pixels") * 100.0 / F.col("valid_pixels")).otherwise(F.lit(0.0))})


def with_exclusion_reasons(observations: DataFrame, min_valid_fraction: float = C.MIN_VALID_FRACTION,
                           min_vegetation_pixels: int = C.MIN_VEGETATION_PIXELS) -> DataFrame:
    """Days stay in the table with their reasons; an empty list means retained."""
    return observations.withColumn("exclusion_reasons", errors(
        F.when(F.col("valid_footprint_percentage") < 100 * min_valid_fraction, F.lit(C.COVERAGE_REASON)),
        F.when(F.col("vegetation_pixels") < min_vegetation_pixels, F.lit(C.VEGETATION_REASON)))) \
        .withColumn("retained", F.size("exclusion_reasons") == 0)


def median_composite(stack: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median over dates per cell and band; one value per date, so calendar-bounded."""
    return stack.groupBy(*keys).agg(F.percentile(value, 0.5).alias("median"), F.count(value).alias("dates"))


def halve_resolution(pixels: DataFrame, keys: list[str], value: str, factor: int = 2) -> DataFrame:
    """Area average onto a grid ``factor`` times coarser; any missing part voids the cell."""
    cells = {"cell_x": F.floor(F.col("x") / factor), "cell_y": F.floor(F.col("y") / factor)}
    return average_cells(pixels.withColumns(cells), [*keys, *cells], value, factor)


def average_cells(pixels: DataFrame, cell: list[str], value: str, factor: int = 2) -> DataFrame:
    """The same for pixels that carry their coarse cell; rows already dealt by it are not shuffled again."""
    present = F.when(F.col(value) > 0, F.col(value).cast("double"))
    return pixels.groupBy(*cell).agg(F.count(present).alias("parts"), F.avg(present).alias("_mean")) \
        .select(*cell, "parts", F.when(F.col("parts") == factor * factor, F.col("_mean")).alias("mean"))
