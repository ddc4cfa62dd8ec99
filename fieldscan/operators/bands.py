"""Band tables and long spectra: (scene_id, band_index, pixel_id, reflectance)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldscan import constants as C
from fieldscan.functions import reflectance as R
from fieldscan.functions.checks import errors
from fieldscan.operators.lookup import lookup_join
from fieldscan.operators.quantiles import exact_quantiles
from fieldscan.session import checkpointed


def band_table(scenes: DataFrame, asset: str = "asset") -> DataFrame:
    """One row per spectral band of a scene's asset; micrometres become nanometres.

    Entries without a centre wavelength are not spectral bands and are dropped
    before numbering, so band_index counts cube planes.
    """
    spectral = F.filter(F.col(f"{asset}.bands"), lambda b: b["center_wavelength"].isNotNull())
    return scenes.select("scene_id", F.posexplode(spectral).alias("band_index", "band")).select(
        "scene_id", "band_index", (F.col("band.center_wavelength") * 1000.0).alias("wavelength_nm"),
        F.col("band.name").alias("band_name"), F.col("band.nodata").alias("nodata"))


def band_problems(bands: DataFrame) -> DataFrame:
    """(scene_id, bands, in_window, problems): empty, nonfinite or unsorted wavelengths."""
    order = Window.partitionBy("scene_id").orderBy("band_index")
    step = bands.withColumn("rising", F.coalesce(F.col("wavelength_nm") > F.lag("wavelength_nm").over(order), F.lit(True)))
    checked = step.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("bands"), F.count_if(R.in_window(F.col("wavelength_nm"))).alias("in_window"),
        F.count_if(~R.is_finite(F.col("wavelength_nm"))).alias("_bad"), F.count_if(~F.col("rising")).alias("_falls"))
    return checked.select("scene_id", "bands", "in_window", errors(
        F.when(F.col("_bad") > 0, F.lit("nonfinite wavelength")),
        F.when(F.col("_falls") > 0, F.lit("wavelengths not strictly increasing")),
        F.when(F.col("in_window") == 0, F.lit("no band inside the window"))).alias("problems"))


def nearest_bands(bands: DataFrame, targets: dict[str, float] | None = None,
                  window: tuple[float, float] | None = C.ANALYSIS_WINDOW_NM) -> DataFrame:
    """Nearest in-window band per target wavelength; the lower index wins ties."""
    targets = targets or C.TARGET_BANDS_NM
    eligible = bands if window is None else bands.where(R.in_window(F.col("wavelength_nm"), window))
    wanted = F.array(*[F.struct(F.lit(role).alias("role"), F.lit(float(nm)).alias("target_nm"))
                       for role, nm in targets.items()])
    pairs = eligible.select("scene_id", "band_index", "wavelength_nm", F.explode(wanted).alias("t"))
    best = pairs.groupBy("scene_id", F.col("t.role").alias("role"), F.col("t.target_nm").alias("target_nm")).agg(
        F.min_by(F.struct("band_index", "wavelength_nm"),
                 F.struct(F.abs(F.col("wavelength_nm") - F.col("t.target_nm")), F.col("band_index"))).alias("b"))
    return best.select("scene_id", "role", "target_nm", "b.band_index", "b.wavelength_nm")


def scan_bands(spectra: DataFrame, bands: DataFrame, window: tuple[float, float] = C.ANALYSIS_WINDOW_NM) -> DataFrame:
    """In-window spectra with wavelength, nodata and cleaned reflectance attached.

    The band table is a dimension of a few hundred rows per sensor. Its rows are counted: it is
    broadcast while they are few, and else joined with the rows of its most frequent bands salted.
    """
    on = ["scene_id", "band_index"]
    wanted = checkpointed(bands.where(R.in_window(F.col("wavelength_nm"), window)).select(*on, "wavelength_nm", "nodata"))

    def weighed() -> tuple[DataFrame, int]:
        counts = checkpointed(spectra.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")))
        return wanted.join(counts, on), counts.agg(F.sum("_rows")).first()[0] or 0

    return lookup_join(spectra, wanted, on, "_rows", wanted.count(), weighed=weighed).where(F.col("wavelength_nm").isNotNull()) \
        .drop("_rows").withColumn("valid_reflectance", R.valid_reflectance(F.col("reflectance"), None, F.col("nodata")))


def band_audit(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, exclusion reasons and retention of every band over its candidates."""
    value = F.col("valid_reflectance")
    audit = scanned.groupBy(*keys, "band_index", "wavelength_nm").agg(
        F.count(value).alias("valid_count"), F.count_if(value.isNull()).alias("invalid_count"),
        F.count_if(value > 1).alias("above_one_count"),
        (F.min(value) == F.max(value)).alias("_constant"))
    return audit_reasons(audit)


def audit_reasons(audit: DataFrame) -> DataFrame:
    """Exclusion reasons and retention from valid_count, wavelength_nm and _constant."""
    reasons = errors(
        F.when(R.in_caution(F.col("wavelength_nm")), F.lit("atmospheric_caution_1350_1450_nm")),
        F.when(F.col("valid_count") == 0, F.lit("no_valid_candidate_reflectance"))
        .when(F.col("_constant"), F.lit("constant_candidate_reflectance")))
    return audit.withColumn("exclusion_reasons", reasons).drop("_constant") \
        .withColumn("retained", F.size("exclusion_reasons") == 0)


def complete_pixels(scanned: DataFrame, audit: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels valid in every retained band, with the number of bands.

    Excluded bands never disqualify a pixel. Counting valid bands per pixel
    replaces an anti join against the invalid pixels and combines map-side.
    """
    retained = audit.where("retained").select(*keys, "band_index")
    per_pixel = scanned.join(retained, [*keys, "band_index"]).groupBy(*keys, "pixel_id").agg(
        F.count(F.lit(1)).alias("bands"), F.count("valid_reflectance").alias("valid_bands"))
    wanted = audit.groupBy(*keys).agg(F.count_if("retained").alias("retained_bands"))
    return per_pixel.join(wanted, keys).where(
        (F.col("valid_bands") == F.col("retained_bands")) & (F.col("bands") == F.col("retained_bands"))) \
        .select(*keys, "pixel_id", "retained_bands")


def group_profiles(scanned: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Per band and group: counts and P25 / median / P75; empty bands give NULLs."""
    value = F.col("valid_reflectance")
    return exact_quantiles(
        scanned, [*keys, group, "band_index", "wavelength_nm"], "valid_reflectance",
        {"p25": 0.25, "median": 0.5, "p75": 0.75},
        also={"excluded_count": F.count_if(value.isNull()), "above_one_count": F.count_if(value > 1)}) \
        .withColumnRenamed("total", "valid_count")


def group_report(profiles: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Per group: smallest and largest valid count, bands with and without statistics."""
    return profiles.groupBy(*keys, group).agg(
        F.min("valid_count").alias("min_valid_count"), F.max("valid_count").alias("max_valid_count"),
        F.count_if(F.col("valid_count") > 0).alias("bands_with_statistics"),
        F.array_sort(F.collect_list(F.when(F.col("valid_count") == 0, F.col("wavelength_nm")))).alias("bands_without"))


def median_difference(profiles: DataFrame, keys: list[str], group: str, lower: str, higher: str) -> DataFrame:
    """higher - lower median per band; NULL where either median is missing."""
    medians = profiles.groupBy(*keys, "band_index", "wavelength_nm").agg(
        F.max(F.when(F.col(group) == lower, F.col("median"))).alias("lower_median"),
        F.max(F.when(F.col(group) == higher, F.col("median"))).alias("higher_median"))
    return medians.withColumn("difference", F.col("higher_median") - F.col("lower_median"))


def contrast_windows(difference: DataFrame, index_bands: DataFrame, keys: list[str]) -> DataFrame:
    """Eligible fixed half-open windows with their mean and peak contrast."""
    low, high = C.ANALYSIS_WINDOW_NM
    anchors = index_bands.groupBy(*keys).agg(F.collect_list("wavelength_nm").alias("index_nm"))
    near = F.exists("index_nm", lambda nm: F.abs(F.col("wavelength_nm") - nm) <= C.CONTRAST_INDEX_RADIUS_NM)
    placed = difference.where((F.col("wavelength_nm") >= low) & (F.col("wavelength_nm") < high)) \
        .join(anchors, keys, "left") \
        .withColumn("window_start", low + C.CONTRAST_WIDTH_NM * F.floor(
            (F.col("wavelength_nm") - low) / C.CONTRAST_WIDTH_NM)) \
        .withColumn("barred", F.col("difference").isNull() | R.in_caution(F.col("wavelength_nm")) | F.coalesce(near, F.lit(False)))
    strongest = F.max_by(F.struct("wavelength_nm", "difference"),
                         F.struct(F.abs(F.col("difference")), -F.col("wavelength_nm")))
    windows = placed.groupBy(*keys, "window_start").agg(
        F.count(F.lit(1)).alias("band_count"), F.bool_or("barred").alias("_barred"),
        F.min("wavelength_nm").alias("first_nm"), F.max("wavelength_nm").alias("last_nm"),
        F.avg(F.abs(F.col("difference"))).alias("mean_absolute"), F.avg("difference").alias("mean_signed"),
        strongest.alias("_peak"))
    return windows.where((F.col("band_count") >= C.CONTRAST_MIN_BANDS) & ~F.col("_barred")).select(
        *keys, "window_start", (F.col("window_start") + C.CONTRAST_WIDTH_NM).alias("window_end"), "band_count",
        "first_nm", "last_nm", "mean_absolute", "mean_signed",
        F.col("_peak.wavelength_nm").alias("peak_nm"), F.col("_peak.difference").alias("peak_difference"))


def spaced_regions(windows: DataFrame, keys: list[str], separation: float = C.CONTRAST_SEPARATION_NM,
                   limit: int = C.CONTRAST_REGIONS) -> DataFrame:
    """Greedy top-k by contrast with a minimum distance between window starts.

    The window grid bounds a scene to 52 windows, so the greedy pass is a fold
    over one small sorted array per scene.
    """
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("mean_absolute")).alias("order"), F.col("window_start"))))
    empty = F.array().cast("array<double>")

    def take(chosen, item):
        far = F.forall(chosen, lambda start: F.abs(start - item["window_start"]) >= separation)
        return F.when((F.size(chosen) < limit) & far,
                      F.concat(chosen, F.array(item["window_start"]))).otherwise(chosen)

    chosen = windows.groupBy(*keys).agg(F.aggregate(ranked, empty, take).alias("chosen"))
    picks = chosen.select(*keys, F.posexplode("chosen").alias("position", "window_start"))
    return windows.join(picks.withColumn("position", F.col("position") + 1), [*keys, "window_start"])


def mean_spectrum(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """Mean valid reflectance per usable band (troughs and the detector edge removed)."""
    return scanned.where(~R.is_bad_band(F.col("wavelength_nm"))) \
        .groupBy(*keys, "band_index", "wavelength_nm") \
        .agg(F.avg("valid_reflectance").alias("mean_reflectance"), F.count("valid_reflectance").alias("valid_count"))


def strongest_pixels(indices: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, index_name, pixel_id, value): the first pixel holding each maximum."""
    best = indices.groupBy(*keys).agg(*[
        F.max_by(F.struct(F.col("pixel_id"), F.col(n).alias("value")),
                 F.when(F.col(n).isNotNull(), F.struct(F.col(n), -F.col("pixel_id")))).alias(n) for n in names])
    return best.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(n).alias("index_name"), F.col(f"{n}.pixel_id").alias("pixel_id"), F.col(f"{n}.value").alias("value"))
        for n in names])).alias("s")).select(*keys, "s.*").where(F.col("pixel_id").isNotNull())


def with_gaps(curve: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Insert a NULL point at the midpoint wherever consecutive bands are missing."""
    order = Window.partitionBy(*keys).orderBy("band_index")
    stepped = curve.withColumns({"_band": F.lag("band_index").over(order), "_nm": F.lag("wavelength_nm").over(order)})
    here = F.struct(F.col("wavelength_nm"), F.col(value).alias(value))
    gap = F.struct(((F.col("_nm") + F.col("wavelength_nm")) / 2.0).alias("wavelength_nm"),
                   F.lit(None).cast("double").alias(value))
    points = F.when(F.col("band_index") > F.col("_band") + 1, F.array(gap, here)).otherwise(F.array(here))
    return stepped.select(*keys, F.explode(points).alias("p")).select(*keys, "p.*")
