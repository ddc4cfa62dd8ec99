"""Radiometric calibration from product XML, one document per scene."""

from __future__ import annotations

from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscan import constants as C
from fieldscan.functions.checks import errors
from fieldscan.functions.reflectance import is_finite
from fieldscan.session import spread


def read_product_xml(spark: SparkSession, path: str) -> DataFrame:
    """(path, xml): product metadata files are a few hundred kilobytes each."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("xml"))


def _product(xml: str | None) -> tuple[list[str], list[str | None]]:
    """Texts of the quantification values, and of each scene band's one offset, at any depth and in any namespace."""
    quants, offsets, ids = [], {}, {}
    for element in ElementTree.fromstring(xml).iter() if xml else ():
        name = element.tag.rpartition("}")[2]
        if name == "BOA_QUANTIFICATION_VALUE" and element.text:
            quants.append(element.text)
        elif name == "BOA_ADD_OFFSET":
            offsets.setdefault(element.get("band_id"), []).append(element.text)
        elif name == "Spectral_Information":
            band = element.get("physicalBand", "")
            digits = band[1:]
            ids.setdefault("B" + digits.zfill(2) if digits.isascii() and digits.isdigit() else band, element.get("bandId"))
    own = [offsets.get(ids[band], ()) if ids.get(band) is not None else () for band in C.SCENE_BANDS.values()]
    return quants, [found[0] if len(found) == 1 else None for found in own]


def _found(xml: pa.Array) -> pa.Array:
    products = [_product(text) for text in xml.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([p[side] for p in products], pa.list_(pa.string())) for side in (0, 1)], ["quants", "offsets"])


def parse_calibration(products: DataFrame, key: str = "scene_id") -> DataFrame:
    """(key, band, quantification, add_offset, problems) for the four bands.

    Exactly one positive quantification value, and an explicit finite offset
    per band: a missing, empty or repeated offset is a problem, never a default of zero.
    A document is parsed once; one that is no XML fails the job.
    """
    found = F.arrow_udf(_found, "struct<quants: array<string>, offsets: array<string>>")("xml")
    parsed = spread(products).select(key, found.alias("found")).select(
        key, F.size("found.quants").alias("_q"), F.get("found.quants", F.lit(0)).try_cast("double").alias("quantification"),
        F.arrays_zip(F.array(*[F.lit(b) for b in C.SCENE_BANDS.values()]).alias("band"), F.col("found.offsets").alias("text")).alias("bands"))
    rows = parsed.select(key, "_q", "quantification", F.inline("bands").alias("band", "text"))
    return rows.select(key, "_q", "band", "quantification", F.col("text").try_cast("double").alias("add_offset")) \
        .select(key, "band", "quantification", "add_offset", errors(
            F.when((F.col("_q") != 1) | ~is_finite(F.col("quantification")) | F.coalesce(F.col("quantification") <= 0, F.lit(True)),
                   F.lit("missing or invalid quantification value")),
            F.when(~is_finite(F.col("add_offset")), F.lit("missing or nonfinite offset"))).alias("problems"))


def per_scene(calibration: DataFrame, key: str = "scene_id") -> DataFrame:
    """One row per scene: quantification and {band}_offset columns."""
    return calibration.groupBy(key).agg(F.max("quantification").alias("quantification"), *[
        F.max(F.when(F.col("band") == b, F.col("add_offset"))).alias(f"{b.lower()}_offset") for b in C.SCENE_BANDS.values()])
