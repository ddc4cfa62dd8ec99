"""Spectra as one array per pixel: cleaning, band audit, complete vectors and scaling without exploding bands.

Whatever is needed per band is folded by position inside each task, so what is shuffled grows with
tasks, groups and bands, not with pixels; per-scene tables reach the pixels by broadcast while their
counted size allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fieldscan import constants as C
from fieldscan.functions import reflectance as R
from fieldscan.operators.bands import audit_reasons
from fieldscan.operators.lookup import lookup_join
from fieldscan.session import checkpointed

#: Groups whose partial sums a task keeps before it hands them on.
GROUPS_HELD = 64
#: Bytes of a band in a per-scene array.
BAND_BYTES = 32


def scene_bands(bands: DataFrame, window: tuple[float, float] = C.ANALYSIS_WINDOW_NM) -> DataFrame:
    """(scene_id, bands[]): in-window bands in order; one row per scene, as long as its sensor has bands."""
    entry = F.struct("band_index", "wavelength_nm", "nodata")
    return bands.where(R.in_window(F.col("wavelength_nm"), window)).groupBy("scene_id").agg(F.array_sort(F.collect_list(entry)).alias("bands"))


def attach(rows: DataFrame, table: DataFrame, on: list[str], array: str) -> DataFrame:
    """Left join a table of one row and one array per group; the broadcast is decided by its counted rows and array lengths."""
    table = checkpointed(table)
    size = table.agg(F.count(F.lit(1)).alias("groups"), F.max(F.size(array)).alias("longest")).first()
    row_bytes = 64 + BAND_BYTES * (size["longest"] or 0)

    def weighed() -> tuple[DataFrame, int]:
        counts = checkpointed(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")))
        return table.join(counts, on), counts.agg(F.sum("_rows")).first()[0] or 0

    return lookup_join(rows, table, on, "_rows", size["groups"], row_bytes=row_bytes, weighed=weighed)


def cleaned_cube(cube: DataFrame, bands: DataFrame, window: tuple[float, float] = C.ANALYSIS_WINDOW_NM) -> DataFrame:
    """``cube`` (scene_id, ..., reflectance[]) with ``values``: its in-window bands in order, invalid ones NULL.

    A band that a pixel's array does not reach is invalid. A scene without in-window bands drops out.
    """
    known = attach(cube, scene_bands(bands, window), ["scene_id"], "bands").where(F.col("bands").isNotNull())
    values = F.transform("bands", lambda b: R.valid_reflectance(F.get(F.col("reflectance"), b["band_index"]), None, b["nodata"]))
    return known.withColumn("values", values).drop("bands", "reflectance", "_rows")


def position_statistics(rows: DataFrame, keys: list[str], values: str) -> DataFrame:
    """(keys, position, valid_count, invalid_count, above_one_count, low, high, mean, deviation) of every array position.

    All arrays of a group have one length. Moments are of the valid values, the deviation that of the population.
    """
    key_fields = [rows.schema[k] for k in keys]
    long = ["valid", "invalid", "above"]
    real = ["low", "high", "mean", "square"]
    schema = T.StructType([*key_fields, T.StructField("position", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in long],
                           *[T.StructField(c, T.DoubleType()) for c in real]])
    arrow = to_arrow_schema(schema)

    def rows_of(key: tuple, part: dict[str, np.ndarray]) -> pa.RecordBatch:
        size = len(part["valid"])
        part = {**part, "low": np.where(part["valid"] > 0, part["low"], np.nan), "high": np.where(part["valid"] > 0, part["high"], np.nan)}
        columns = [*[pa.array([k] * size, arrow.field(at).type) for at, k in enumerate(key)], pa.array(range(size), pa.int32()),
                   *[pa.array(part[c]) for c in long], *[pa.array(part[c], from_pandas=True) for c in real]]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict[str, np.ndarray]] = {}
        for batch in batches:
            for key, matrix in matrices(batch, len(keys)):
                part = _position_sums(matrix)
                held[key] = _combined(held[key], part) if key in held else part
            if len(held) > GROUPS_HELD:
                yield from (rows_of(key, part) for key, part in held.items())
                held.clear()
        yield from (rows_of(key, part) for key, part in held.items())

    folded = rows.select(*keys, F.col(values).cast("array<double>").alias(values)).mapInArrow(fold, schema)
    weight = F.sum(F.when(F.col("valid") > 0, F.col("valid") * F.col("mean")))
    mean_square = F.sum(F.when(F.col("valid") > 0, F.col("valid") * F.col("mean") * F.col("mean")))
    n = F.sum("valid")
    spread = F.sum("square") + mean_square - weight * weight / F.nullif(n, F.lit(0))
    return folded.groupBy(*keys, "position").agg(
        n.alias("valid_count"), F.sum("invalid").alias("invalid_count"), F.sum("above").alias("above_one_count"),
        F.min("low").alias("low"), F.max("high").alias("high"), (weight / F.nullif(n, F.lit(0))).alias("mean"),
        F.sqrt(F.greatest(F.lit(0.0), spread / F.nullif(n, F.lit(0)))).alias("deviation"))


def matrices(batch: pa.RecordBatch, n_keys: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key, matrix of its rows' arrays) for the groups of a batch whose column after the keys is a list of doubles."""
    for key, at in places(batch, n_keys).items():
        yield key, matrix_of(batch.column(n_keys), at)


def places(batch: pa.RecordBatch, n_keys: int) -> dict[tuple, np.ndarray]:
    found: dict[tuple, list[int]] = {}
    for at, key in enumerate(zip(*[batch.column(k).to_pylist() for k in range(n_keys)], strict=True)):
        found.setdefault(key, []).append(at)
    return {key: np.asarray(at) for key, at in found.items()}


def matrix_of(column: pa.ListArray, at: np.ndarray) -> np.ndarray:
    """The arrays of the rows ``at`` as a matrix; NULLs become NaN."""
    starts, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return flat[starts[at][:, None] + np.arange(starts[at[0] + 1] - starts[at[0]])]


def _position_sums(matrix: np.ndarray) -> dict[str, np.ndarray]:
    valid = ~np.isnan(matrix)
    count = valid.sum(axis=0)
    filled = np.where(valid, matrix, 0.0)
    mean = filled.sum(axis=0) / np.maximum(count, 1)
    return {"valid": count, "invalid": len(matrix) - count, "above": (filled > 1).sum(axis=0),
            "low": np.where(valid, matrix, np.inf).min(axis=0), "high": np.where(valid, matrix, -np.inf).max(axis=0),
            "mean": mean, "square": (np.where(valid, matrix - mean, 0.0) ** 2).sum(axis=0)}


def _combined(one: dict[str, np.ndarray], two: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    n = one["valid"] + two["valid"]
    apart, safe = two["mean"] - one["mean"], np.maximum(n, 1)
    return {"valid": n, "invalid": one["invalid"] + two["invalid"], "above": one["above"] + two["above"],
            "low": np.minimum(one["low"], two["low"]), "high": np.maximum(one["high"], two["high"]),
            "mean": one["mean"] + apart * two["valid"] / safe,
            "square": one["square"] + two["square"] + apart * apart * one["valid"] * two["valid"] / safe}


def cube_audit(cleaned: DataFrame, bands: DataFrame, keys: list[str], window: tuple[float, float] = C.ANALYSIS_WINDOW_NM) -> DataFrame:
    """The band audit of ``bands.band_audit`` from arrays, with each band's position among the in-window bands."""
    places_of = scene_bands(bands, window).select("scene_id", F.posexplode("bands").alias("position", "b")).select(
        "scene_id", "position", "b.band_index", "b.wavelength_nm")
    found = position_statistics(cleaned, keys, "values").join(places_of, ["scene_id", "position"])
    return audit_reasons(found.withColumn("_constant", F.col("low") == F.col("high"))) \
        .select(*keys, "position", "band_index", "wavelength_nm", "valid_count", "invalid_count", "above_one_count", "exclusion_reasons", "retained")


def complete_vectors(cleaned: DataFrame, audit: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pixel_id, spectrum): the retained bands in order, of pixels valid in all of them."""
    kept = audit.where("retained").groupBy(*keys).agg(F.array_sort(F.collect_list("position")).alias("positions"))
    known = attach(cleaned, kept, keys, "positions").where(F.col("positions").isNotNull())
    return known.select(*keys, "pixel_id", F.transform("positions", lambda p: F.get(F.col("values"), p)).alias("spectrum")) \
        .where(F.forall("spectrum", lambda v: v.isNotNull()))


def fit_scaler(spectra: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fit_rows, mean[], scale[]): population deviation; zero variance fails."""
    found = position_statistics(spectra, keys, "spectrum")
    scale = F.when((F.col("deviation") > 0) & (F.col("low") < F.col("high")), F.col("deviation")).otherwise(
        F.raise_error(F.lit("a fitting band has zero variance")).cast("double"))
    ordered = F.array_sort(F.collect_list(F.struct("position", "mean", scale.alias("scale"))))
    return found.groupBy(*keys).agg(F.max("valid_count").alias("fit_rows"), ordered.alias("b")).select(
        *keys, "fit_rows", F.transform("b", lambda b: b["mean"]).alias("mean"), F.transform("b", lambda b: b["scale"]).alias("scale"))
