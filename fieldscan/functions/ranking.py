"""Relative conditions, risk score and risk class from percentile ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldscan import constants as C


def condition_code(percentile: Column) -> Column:
    """0 excluded, 1 below 25, 2 in [25, 75), 3 from 75."""
    low, high = C.CONDITION_EDGES
    return (F.when(percentile.isNull(), 0).when(percentile < low, 1)
            .when(percentile < high, 2).otherwise(3))


def risk_class(score: Column) -> Column:
    """0 missing, 1..4 for [0,25) [25,50) [50,75) [75,100]; else an error."""
    low, mid, high = C.CLASS_EDGES
    return (F.when(score.isNull() | F.isnan(score), 0)
            .when((score < 0) | (score > 100), F.raise_error(F.lit("risk score outside 0..100")).cast("int"))
            .when(score < low, 1).when(score < mid, 2).when(score < high, 3).otherwise(4))


def moisture_deficit(ndmi_percentile: Column) -> Column:
    return F.lit(100.0) - ndmi_percentile


def support_factor(ndvi_percentile: Column, ndre_percentile: Column) -> Column:
    """0.8 .. 1.0: greenness ranks strengthen the moisture term, never replace it."""
    return (F.lit(0.8) + F.lit(0.1) * (F.lit(1.0) - ndvi_percentile / F.lit(100.0))
            + F.lit(0.1) * (F.lit(1.0) - ndre_percentile / F.lit(100.0)))


def risk_score(ndvi_percentile: Column, ndre_percentile: Column, ndmi_percentile: Column) -> Column:
    raw = moisture_deficit(ndmi_percentile) * support_factor(ndvi_percentile, ndre_percentile)
    return F.when(raw.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))


def class_name(code: Column) -> Column:
    return F.get(F.array(*[F.lit(name) for name in C.CLASS_NAMES]), code - 1)


def empirical_percentile(below: Column, equal: Column, total: Column) -> Column:
    """100 * (below + half of equal) / total; NULL for an empty population."""
    return F.when(total > 0, F.lit(100.0) * (below + F.lit(0.5) * equal) / total)
