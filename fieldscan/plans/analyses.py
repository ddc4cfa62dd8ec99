"""Whole analyses: the four entry points composed from the operators."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscan import constants as C
from fieldscan.operators import anomaly, decision, mosaic, screening, spectra, temporal
from fieldscan.operators.lookup import lookup_join
from fieldscan.operators.quantiles import robust_statistics
from fieldscan.session import checkpointed, spread


def screen_scenes(pixels: DataFrame, masks: list[str], keys: list[str],
                  threshold: float = C.VEGETATION_NDVI) -> dict[str, DataFrame]:
    """Pixels to evidence and reports. Evidence is kept because every report reads it."""
    screened = screening.with_vegetation(screening.with_indices(screening.with_quality(pixels, masks)), threshold)
    rankable = checkpointed(screening.rankable(screened, keys))
    size = rankable.agg(F.count(F.lit(1)).alias("populations"), F.sum("classified_pixels").alias("pixels")).first()
    narrow = screened.drop(*masks, *C.TARGET_BANDS_NM)  # ranks need the indices only
    ranked = lookup_join(narrow, rankable, keys, "classified_pixels", size["populations"], size["pixels"] or 0)
    evidence = screening.risk_evidence(ranked.where("rankable").select(*narrow.columns), keys) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    return {"screened": screened, "rankable": rankable, "evidence": evidence,
            "classes": screening.class_shares(evidence, keys), "counts": screening.screening_counts(screened, keys),
            "statistics": robust_statistics(evidence, keys, [*C.INDEX_NAMES, "risk_score"])}


def observe_days(scene_pixels: DataFrame, footprints: DataFrame, keys: list[str],
                 threshold: float = C.VEGETATION_NDVI) -> dict[str, DataFrame]:
    """Scene pixels of all days at once to observations, statistics and sources."""
    indexed = mosaic.calibrated_indices(scene_pixels)
    merged = mosaic.first_valid(indexed, keys).persist(StorageLevel.MEMORY_AND_DISK)
    sources = mosaic.source_contributions(indexed, merged, keys, threshold)
    observed = mosaic.with_exclusion_reasons(mosaic.daily_observations(sources, footprints, keys))
    return {"mosaic": merged, "sources": sources, "observations": observed,
            "statistics": mosaic.vegetation_statistics(merged, keys, threshold)}


def temporal_evidence(days: DataFrame, sources: DataFrame, targets: DataFrame, keys: list[str], value: str, cutoff: Column,
                      tolerance: float = C.STABLE_TOLERANCE, lookback_days: int = C.BASELINE_LOOKBACK_DAYS,
                      minimum_dates: int = C.BASELINE_MIN_DATES,
                      maximum_gap_days: float = C.BASELINE_MAX_GAP_DAYS) -> DataFrame:
    """One row per target: trend, nearest day, baseline and state, as of the cutoff.

    Days with any later acquisition are gone before anything else looks at
    them; sources follow their day, and one that gave no pixel (``contributing`` of
    ``mosaic.source_contributions``) is never the nearest. Targets without an eligible day stay, as
    INSUFFICIENT.
    """
    gated = temporal.at_cutoff(days, cutoff)
    eligible = gated.where("eligible")
    known = sources.where(F.col("contributing") > 0).join(eligible.select(*keys, "day"), [*keys, "day"], "left_semi")
    trend = temporal.theil_sen(eligible, keys, "day", value, tolerance)
    nearest = temporal.nearest_acquisition(targets, known, keys).withColumn("compared_day", F.to_date("acquired_at"))
    base = temporal.baseline(nearest.select(*keys, "target_id", "target_at", "compared_day", "absolute_gap_days"), eligible, keys,
                             value, lookback_days, minimum_dates, maximum_gap_days).withColumnRenamed("available", "baseline_available")
    joined = targets.withColumn("target_id", F.col("target_id").cast("string")).join(trend, keys, "left") \
        .join(base, [*keys, "target_id"], "left") \
        .withColumn("baseline_available", F.coalesce("baseline_available", F.lit(False))) \
        .withColumn("direction", F.coalesce("direction", F.lit("insufficient observations")))
    return joined.withColumns({
        "temporal_state": decision.temporal_state(F.col("percentile"), F.col("direction"), F.col("baseline_available")),
        "baseline_position": decision.baseline_position(F.col("percentile"), F.col("direction"), F.col("baseline_available"))})


def fuse(spectral: DataFrame, temporal_rows: DataFrame, rules: DataFrame, keys: list[str],
         ground: DataFrame | None = None) -> DataFrame:
    """Decisions with their reasoning trace. Without ground rows the state is UNAVAILABLE."""
    states = spectral.join(temporal_rows, keys)
    if ground is None:
        states = states.withColumn("ground_state", F.lit("UNAVAILABLE"))
    else:
        states = states.join(ground.select(*keys, "ground_state"), keys, "left").fillna("UNAVAILABLE", subset=["ground_state"])
    decided = decision.decide(states, rules)
    return decided.withColumn("trace", decision.reasoning_trace(decided))


def score_scenes(cube: DataFrame, band_table: DataFrame, keys: list[str], trees: int = C.FOREST_TREES) -> dict[str, DataFrame]:
    """Candidate spectra (scene_id, pixel_id, reflectance[]) to band audit, model and anomaly scores."""
    cleaned = spectra.cleaned_cube(cube, band_table)
    audit = checkpointed(spectra.cube_audit(cleaned, band_table, keys))
    complete = checkpointed(spread(spectra.complete_vectors(cleaned, audit, keys)))
    model = anomaly.fit_anomaly(complete, keys, trees=trees)
    return {"audit": audit, "spectra": complete, "model": model, "components": anomaly.component_table(model, keys),
            "scores": anomaly.score_anomaly(complete, model, keys)}
