"""Whitelisted exports and the sample package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscan import constants as C
from fieldscan.operators.audit import reconcile, tally
from fieldscan.operators.sampling import exact_sample_by


def curated(document: DataFrame, fields: list[str]) -> DataFrame:
    """Only the named (possibly nested) fields; a missing field is an analysis error."""
    return document.select(*[F.col(f).alias(f.split(".")[-1]) for f in fields])


def cross_document_checks(joined: DataFrame, equalities: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(check, n_bad) over documents already joined on their key."""
    return tally(joined, {name: a.eqNullSafe(b) for name, (a, b) in equalities.items()})


def sample_pixels(pixels: DataFrame, keys: list[str], size: int = C.EXPORT_SAMPLE_SIZE,
                  seed: int = C.MODEL_SEED) -> DataFrame:
    """Quality-valid pixels, uniformly and without replacement, per scene."""
    return exact_sample_by(pixels.where("quality_valid"), keys, "pixel_id", size, seed)


def sample_agrees(sample: DataFrame, full: DataFrame, keys: list[str]) -> DataFrame:
    """Sample rows whose indices differ from the full-scene calculation; must be empty."""
    wanted = full.join(sample.select(*keys), keys, "left_semi")
    return reconcile(sample, wanted, keys, list(C.INDEX_NAMES), absolute=0.0, relative=0.0).where(F.col("status") != "equal")


def sample_summary(screened_sample: DataFrame, keys: list[str]) -> DataFrame:
    """Sample counts and class statistics, labelled as a sample and never as the population."""
    return screened_sample.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_pixels"), F.count_if("vegetation").alias("sample_vegetation"),
        F.count_if("classified").alias("sample_classified"),
        F.avg("ndmi").alias("sample_mean_ndmi"))
