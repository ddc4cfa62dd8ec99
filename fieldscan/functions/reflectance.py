"""Reflectance cleaning, spectral indices and wavelength predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldscan import constants as C


INFINITY = float("inf")


def is_finite(value: Column) -> Column:
    """True for an ordinary number; NULL, NaN and both infinities give False.

    Spark orders NaN above infinity, so one comparison rejects both.
    """
    return F.coalesce(F.abs(value) < F.lit(INFINITY), F.lit(False))


def valid_reflectance(value: Column, usable: Column | None = None, nodata: Column | None = None) -> Column:
    """Keep a finite, nonnegative, non-nodata value; anything else becomes NULL.

    Values above one are kept: they are counted by the statistics, not clipped.
    """
    value = value.cast("double")
    keep = (value >= 0) & (value < F.lit(INFINITY))
    if nodata is not None:
        keep = keep & ~value.eqNullSafe(nodata.cast("double"))
    if usable is not None:
        keep = keep & usable
    return F.when(keep, value)


def usable_pair(first: Column, second: Column, usable: Column | None = None) -> Column:
    """Both bands finite and nonnegative with a positive sum.

    The sum is finite only if both bands are, and NaN never compares below
    infinity, so four comparisons cover it. Filters on an index are pushed
    below its projection and repeat this text, so it is kept short: a
    generated method beyond 8 KB of bytecode is never compiled by the JVM.
    """
    total = first + second
    keep = (first >= 0) & (second >= 0) & (total > 0) & (total < F.lit(INFINITY))
    return keep if usable is None else usable & keep


def normalized_difference(first: Column, second: Column, usable: Column | None = None) -> Column:
    """(first - second) / (first + second) for usable pixels, else NULL; no epsilon.

    Bands need no cleaning first: anything ``valid_reflectance`` would null
    (except nodata, which belongs into ``usable``) gives NULL here too.
    """
    return F.when(usable_pair(first, second, usable), (first - second) / (first + second))


def ndvi(nir: Column, red: Column, usable: Column | None = None) -> Column:
    return normalized_difference(nir, red, usable)


def ndre(nir: Column, red_edge: Column, usable: Column | None = None) -> Column:
    return normalized_difference(nir, red_edge, usable)


def ndmi(nir: Column, swir: Column, usable: Column | None = None) -> Column:
    return normalized_difference(nir, swir, usable)


def epsilon_difference(first: Column, second: Column, epsilon: float = C.NOTEBOOK_EPSILON) -> Column:
    """(first - second) / (first + second + eps); NULL when the divisor is zero."""
    total = first + second + F.lit(epsilon)
    return F.when(total != 0, (first - second) / total)


def bare_soil_index(swir: Column, red: Column, nir: Column, green: Column,
                    epsilon: float = C.NOTEBOOK_EPSILON) -> Column:
    return epsilon_difference(swir + red, nir + green, epsilon)


def water_index(green: Column, nir: Column) -> Column:
    return epsilon_difference(green, nir)


def chlorophyll_index(red_edge_708: Column, red: Column) -> Column:
    return epsilon_difference(red_edge_708, red)


def turbidity_index(red: Column, green: Column) -> Column:
    return epsilon_difference(red, green)


def coastal_ndvi(nir_800: Column, red: Column) -> Column:
    return epsilon_difference(nir_800, red)


def calibrated(dn: Column, quantification: Column, offset: Column) -> Column:
    """(DN + offset) / quantification. DN = 0 means nodata *before* the offset."""
    return (dn.cast("double") + offset) / quantification


def in_window(wavelength: Column, window: tuple[float, float] = C.ANALYSIS_WINDOW_NM) -> Column:
    return wavelength.between(*window)


def in_caution(wavelength: Column) -> Column:
    return wavelength.between(*C.ATMOSPHERIC_CAUTION_NM)


def is_bad_band(wavelength: Column) -> Column:
    """Water-vapour troughs (inclusive) and everything beyond the detector edge."""
    bad = wavelength > C.SWIR_EDGE_NM
    for low, high in C.WATER_VAPOUR_NM:
        bad = bad | wavelength.between(low, high)
    return bad


def pixel_id(row: Column, col: Column, width: int) -> Column:
    return row.cast("bigint") * width + col


def pixel_row(pixel: Column, width: int) -> Column:
    return F.floor(pixel / F.lit(width)).cast("bigint")


def pixel_col(pixel: Column, width: int) -> Column:
    return F.pmod(pixel, F.lit(width)).cast("bigint")


def on_stride(row: Column, col: Column, stride: int = 8) -> Column:
    """Spatial thinning: every stride-th row and column of the grid."""
    return (F.pmod(row, F.lit(stride)) == 0) & (F.pmod(col, F.lit(stride)) == 0)
