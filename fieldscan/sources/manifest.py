"""File manifests: sizes and digests, verification and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscan.functions.text import canonical_json_hash, canonical_text_hash


def _below(root: str) -> Column:
    """A file's path below ``root``, so that equal names in two folders stay apart; the root itself, if a file, by its name."""
    folder = root.split(":", 1)[-1].rstrip("/") + "/"
    at = F.instr("path", folder)
    return F.when(at > 0, F.substring("path", at + len(folder), F.length("path"))).otherwise(F.substring_index("path", "/", -1))


def file_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size_bytes, sha256) of every file; files are digested in parallel."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(_below(path).alias("path"), F.col("length").alias("size_bytes"),
                        F.sha2("content", 256).alias("sha256"))


def semantic_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) that ignores JSON key order and CRLF line ends."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    text = F.col("content").cast("string")
    digest = (F.when(F.col("path").endswith(".json"), canonical_json_hash(text))
              .when(F.col("path").endswith(".csv"), canonical_text_hash(text)).otherwise(F.sha2("content", 256)))
    return files.select(_below(path).alias("path"), digest.alias("sha256"))


def verify_manifest(actual: DataFrame, expected: DataFrame, key: str = "path") -> DataFrame:
    """(key, status): ok, stale, missing or unexpected."""
    a = actual.select(F.col(key).alias("_a"), F.col("sha256").alias("_actual"))
    e = expected.select(F.col(key).alias("_e"), F.col("sha256").alias("_expected"))
    status = (F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected")
              .when(F.col("_actual") == F.col("_expected"), "ok").otherwise("stale"))
    return a.join(e, F.col("_a") == F.col("_e"), "full_outer").select(F.coalesce("_a", "_e").alias(key), status.alias("status"))


def bundle_problems(found: DataFrame, recorded: DataFrame, keys: list[str], versions: list[int]) -> DataFrame:
    """(keys, problems) of every document of a bundle against what was recorded of it.

    Both sides have ``sha256``, ``schema_version`` and ``shape`` (an array of lengths). Keys are not null.
    A document on one side only is missing or unrecorded; NULL equals NULL in digests and shapes, and is an
    unknown version. Each document is compared on its own; no bundle is gathered.
    """
    fields = ("sha256", "schema_version", "shape")
    both = found.select(*keys, F.struct(*fields).alias("have")).join(recorded.select(*keys, F.struct(*fields).alias("want")), keys, "full_outer")
    have, want = F.col("have"), F.col("want")
    paired = have.isNotNull() & want.isNotNull()
    return both.select(*keys, F.array_compact(F.array(
        F.when(have.isNull(), "missing"), F.when(want.isNull(), "unrecorded"),
        F.when(paired & ~have["sha256"].eqNullSafe(want["sha256"]), "checksum mismatch"),
        F.when(have.isNotNull() & ~F.coalesce(have["schema_version"].isin(*versions), F.lit(False)), "unknown schema version"),
        F.when(paired & ~have["shape"].eqNullSafe(want["shape"]), "shape mismatch"))).alias("problems"))
