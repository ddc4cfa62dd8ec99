"""Per-pixel screening: indices, vegetation, relative ranks, risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscan import constants as C
from fieldscan.functions import ranking, reflectance
from fieldscan.operators.lookup import lookup_join
from fieldscan.operators.quantiles import exact_quantiles
from fieldscan.operators.ranks import midranks
from fieldscan.session import checkpointed


def with_quality(pixels: DataFrame, masks: list[str]) -> DataFrame:
    """quality_valid: every mask plane is zero."""
    valid = F.lit(True)
    for mask in masks:
        valid = valid & (F.col(mask) == 0)
    return pixels.withColumn("quality_valid", F.coalesce(valid, F.lit(False)))


def with_indices(pixels: DataFrame, nodata: dict[str, Column] | None = None) -> DataFrame:
    """Add ndvi, ndre and ndmi, and null the unusable values of the four index bands."""
    nodata = nodata or {}
    usable = F.col("quality_valid")

    def index(second: str) -> Column:
        keep = usable
        for band in ("nir", second):
            if band in nodata:
                keep = keep & (F.col(band) != nodata[band])
        return reflectance.normalized_difference(F.col("nir").cast("double"), F.col(second).cast("double"), keep)

    return pixels.withColumns({
        "ndvi": index("red"), "ndre": index("red_edge"), "ndmi": index("swir"),
        **{band: reflectance.valid_reflectance(F.col(band), usable, nodata.get(band)) for band in C.TARGET_BANDS_NM}})


def with_vegetation(pixels: DataFrame, threshold: float = C.VEGETATION_NDVI) -> DataFrame:
    """vegetation keeps the boundary; classified also needs all three indices."""
    if not 0 < threshold < 1:
        raise ValueError("vegetation threshold must lie strictly between 0 and 1")
    vegetation = F.coalesce(F.col("ndvi") >= threshold, F.lit(False))  # an index exists only where quality is valid
    complete = F.col("ndre").isNotNull() & F.col("ndmi").isNotNull()
    return pixels.withColumns({"vegetation": vegetation, "classified": vegetation & complete})


def mask_shares(pixels: DataFrame, keys: list[str], masks: list[str]) -> DataFrame:
    """Valid percentage and flagged percentage of each mask plane."""
    return pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_pixels"), F.count_if("quality_valid").alias("valid_pixels"),
        (F.avg(F.col("quality_valid").cast("int")) * 100).alias("valid_percentage"),
        *[(F.avg((F.col(m) != 0).cast("int")) * 100).alias(f"{m}_percentage") for m in masks])


def risk_evidence(screened: DataFrame, keys: list[str]) -> DataFrame:
    """Ranks, conditions, score and class of the classified pixels.

    Ranks are relative to the classified pixels of one ``keys`` population.
    """
    classified = screened.where("classified")
    ranked = midranks(classified, keys, list(C.INDEX_NAMES))
    p = {name: F.col(f"{name}_percentile") for name in C.INDEX_NAMES}
    scored = ranked.withColumns({
        "ndvi_condition": ranking.condition_code(p["ndvi"]),
        "ndre_condition": ranking.condition_code(p["ndre"]),
        "ndmi_condition": ranking.condition_code(p["ndmi"]),
        "ndmi_deficit": ranking.moisture_deficit(p["ndmi"]),
        "support_factor": ranking.support_factor(p["ndvi"], p["ndre"]),
        "risk_score": ranking.risk_score(p["ndvi"], p["ndre"], p["ndmi"])})
    return scored.withColumn("risk_class", ranking.risk_class(F.col("risk_score")))


def rankable(screened: DataFrame, keys: list[str]) -> DataFrame:
    """Populations that can carry a ranking: at least two pixels with NDMI contrast."""
    return screened.groupBy(*keys).agg(
        F.count_if("classified").alias("classified_pixels"),
        (F.max(F.when(F.col("classified"), F.col("ndmi")))
         - F.min(F.when(F.col("classified"), F.col("ndmi")))).alias("ndmi_range")) \
        .withColumn("rankable", (F.col("classified_pixels") >= 2)
                    & F.coalesce(F.col("ndmi_range") > C.MIN_CONTRAST, F.lit(False)))


def class_shares(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """All four classes for every population, zero counts included."""
    counts = evidence.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("classified_pixels"),
        *[F.count_if(F.col("risk_class") == code).alias(f"_{code}") for code in range(1, 5)])
    rows = counts.select(*keys, "classified_pixels", F.explode(F.array(*[
        F.struct(F.lit(code).alias("risk_class"), F.lit(name).alias("class_name"), F.col(f"_{code}").alias("pixels"))
        for code, name in enumerate(C.CLASS_NAMES, 1)])).alias("c"))
    return rows.select(*keys, "c.risk_class", "c.class_name", "c.pixels",
                       (F.col("c.pixels") * 100.0 / F.col("classified_pixels")).alias("percentage"))


def screening_counts(screened: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and percentages, each percentage against its own denominator."""
    counts = screened.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_pixels"), F.count_if("quality_valid").alias("valid_pixels"),
        F.count_if("vegetation").alias("vegetation_pixels"), F.count_if("classified").alias("classified_pixels"))
    return counts.select(
        "*", (F.col("vegetation_pixels") - F.col("classified_pixels")).alias("missing_evidence_pixels"),
        F.when(F.col("valid_pixels") > 0,
               F.col("vegetation_pixels") * 100.0 / F.col("valid_pixels")).alias("vegetation_percentage"),
        (F.col("vegetation_pixels") * 100.0 / F.col("total_pixels")).alias("vegetation_percentage_of_image"))


def risk_groups(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Tag pixels 'lower' / 'higher': quartile tails cut to the extreme classes.

    Quartiles come from the whole classified population, boundary ties included.
    """
    tails = checkpointed(exact_quantiles(evidence, keys, "risk_score", {"score_p25": 0.25, "score_p75": 0.75})
                         .withColumnRenamed("total", "population"))
    size = tails.agg(F.count(F.lit(1)).alias("populations"), F.sum("population").alias("pixels")).first()
    tagged = lookup_join(evidence, tails, keys, "population", size["populations"], size["pixels"] or 0)
    low, _, high = C.CLASS_EDGES
    return tagged.withColumn("risk_group", F.when(
        (F.col("risk_score") <= F.col("score_p25")) & (F.col("risk_score") < low), "lower").when(
        (F.col("risk_score") >= F.col("score_p75")) & (F.col("risk_score") >= high), "higher"))


def group_problems(tagged: DataFrame, keys: list[str]) -> DataFrame:
    """Both groups must be nonempty; they cannot overlap by construction."""
    return tagged.groupBy(*keys).agg(
        F.count_if(F.col("risk_group") == "lower").alias("lower_pixels"),
        F.count_if(F.col("risk_group") == "higher").alias("higher_pixels")) \
        .withColumn("usable", (F.col("lower_pixels") > 0) & (F.col("higher_pixels") > 0))


def on_full_grid(grid: DataFrame, evidence: DataFrame, keys: list[str], codes: list[str]) -> DataFrame:
    """Evidence on every grid pixel: missing numbers stay NULL, missing codes become 0."""
    return grid.join(evidence, keys, "left").fillna(0, subset=codes)
