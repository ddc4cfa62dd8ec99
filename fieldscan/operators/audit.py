"""Recompute-and-compare checks that end as (check, n_bad) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldscan import constants as C
from fieldscan.functions import ranking
from fieldscan.functions.checks import close_to
from fieldscan.functions.reflectance import is_finite
from fieldscan.functions.text import is_hex_digest, product_id_ok
from fieldscan.operators.ranks import midranks


def tally(frame: DataFrame, checks: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """(keys, check, n_bad) for row predicates that must hold; one pass, map-side combined."""
    keys = keys or []
    counted = frame.groupBy(*keys).agg(*[
        F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"_{i}") for i, ok in enumerate(checks.values())])
    return counted.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(name).alias("check"), F.col(f"_{i}").alias("n_bad")) for i, name in enumerate(checks)])).alias("c")) \
        .select(*keys, "c.check", "c.n_bad")


def reconcile(saved: DataFrame, expected: DataFrame, keys: list[str], values: list[str],
              absolute: float = C.ABS_TOLERANCE, relative: float = C.REL_TOLERANCE) -> DataFrame:
    """Full-outer comparison: one row per key with a status and the differing columns.

    Extra saved keys are allowed and reported as 'extra'; missing ones fail.
    """
    s = saved.select(*[F.col(k).alias(f"s_{k}") for k in keys], *[F.col(v).alias(f"s_{v}") for v in values], F.lit(True).alias("in_saved"))
    e = expected.select(*[F.col(k).alias(f"e_{k}") for k in keys], *[F.col(v).alias(f"e_{v}") for v in values], F.lit(True).alias("in_expected"))
    match = reduce(lambda a, b: a & b, [F.col(f"s_{k}").eqNullSafe(F.col(f"e_{k}")) for k in keys])
    differing = F.array_compact(F.array(*[
        F.when(~close_to(F.col(f"s_{v}"), F.col(f"e_{v}"), absolute, relative), F.lit(v)) for v in values]))
    status = (F.when(F.col("in_saved").isNull(), "missing").when(F.col("in_expected").isNull(), "extra")
              .when(F.size(differing) > 0, "differs").otherwise("equal"))
    return s.join(e, match, "full_outer").select(
        *[F.coalesce(f"s_{k}", f"e_{k}").alias(k) for k in keys], status.alias("status"),
        F.when(status == "differs", differing).otherwise(F.array().cast("array<string>")).alias("differing"))


def reconcile_parts(saved: dict[str, DataFrame], expected: dict[str, DataFrame], keys: list[str], values: dict[str, list[str]],
                    absolute: float = C.ABS_TOLERANCE, relative: float = C.REL_TOLERANCE) -> DataFrame:
    """(part, keys, status, differing): several saved tables against their recomputed ones, in one full-outer join.

    Each part compares its own ``values``: numbers within the tolerance, booleans, dates and texts as
    they are. NULL equals NULL. Keys are compared as text.
    """
    def long(tables: dict[str, DataFrame], side: str) -> DataFrame:
        rows = []
        for part, frame in tables.items():
            numeric = {f.name for f in frame.schema.fields if isinstance(f.dataType, T.NumericType)}
            cells = F.array(*[F.struct(
                F.lit(v).alias("name"), (F.col(v).cast("double") if v in numeric else F.lit(None).cast("double")).alias("number"),
                (F.lit(None).cast("string") if v in numeric else F.col(v).cast("string")).alias("text")) for v in values[part]])
            rows.append(frame.select(F.lit(part).alias("part"), *[F.col(k).cast("string").alias(k) for k in keys], cells.alias(side)))
        return reduce(DataFrame.unionByName, rows)

    def apart(cell: Column) -> Column:
        one, two = cell["saved"], cell["expected"]
        return ~(close_to(one["number"], two["number"], absolute, relative) & one["text"].eqNullSafe(two["text"]))

    both = long(saved, "saved").join(long(expected, "expected"), ["part", *keys], "full_outer")
    pairs = F.filter(F.arrays_zip("saved", "expected"), apart)
    status = (F.when(F.col("saved").isNull(), "missing").when(F.col("expected").isNull(), "extra")
              .when(F.size(pairs) > 0, "differs").otherwise("equal"))
    return both.select("part", *keys, status.alias("status"), F.when(status == "differs", F.transform(pairs, lambda c: c["saved"]["name"]))
                       .otherwise(F.array().cast("array<string>")).alias("differing"))


def evidence_audit(saved: DataFrame, keys: list[str], threshold: float = C.VEGETATION_NDVI) -> DataFrame:
    """Check saved pixel evidence against its own ranks, formula, classes and masks.

    ``saved`` has every grid pixel: quality_valid, vegetation, classified, the
    three indices and percentiles, conditions, deficit, factor, score, class.
    """
    classified = F.col("classified")
    layers = [*C.INDEX_NAMES, *[f"{n}_percentile" for n in C.INDEX_NAMES], "ndmi_deficit", "support_factor", "risk_score"]
    recomputed = saved.withColumns({f"_{n}": F.when(classified, F.col(n)) for n in C.INDEX_NAMES})
    recomputed = midranks(recomputed, keys, [f"_{n}" for n in C.INDEX_NAMES])
    deficit = ranking.moisture_deficit(F.col("ndmi_percentile"))
    factor = ranking.support_factor(F.col("ndvi_percentile"), F.col("ndre_percentile"))

    def implied(ok: Column) -> Column:
        return ~classified | F.coalesce(ok, F.lit(False))

    def near(actual: Column, expected: Column) -> Column:
        return implied(close_to(actual, expected, C.ABS_TOLERANCE, 0.0))

    return tally(recomputed, {
        "masks nested": (~classified | F.col("vegetation")) & (~F.col("vegetation") | F.col("quality_valid")),
        "layers present only when classified": reduce(lambda a, b: a & b, [
            F.when(classified, is_finite(F.col(c))).otherwise(F.col(c).isNull()) for c in layers]),
        "ndvi screen": implied(F.col("ndvi") >= threshold),
        "index bounds": implied(F.greatest(*[F.abs(F.col(n)) for n in C.INDEX_NAMES]) <= C.INDEX_BOUND),
        **{f"{n} ranks": near(F.col(f"{n}_percentile"), F.col(f"_{n}_percentile")) for n in C.INDEX_NAMES},
        "moisture deficit": near(F.col("ndmi_deficit"), deficit),
        "support factor": near(F.col("support_factor"), factor),
        "risk score": near(F.col("risk_score"), deficit * factor),
        "ndvi condition": F.col("ndvi_condition") == F.when(classified, ranking.condition_code(F.col("ndvi_percentile"))).otherwise(0),
        "ndre condition": F.col("ndre_condition") == F.when(classified, ranking.condition_code(F.col("ndre_percentile"))).otherwise(0),
        "risk class": F.col("risk_class") == F.when(classified & F.col("risk_score").between(0, 100),
                                                    ranking.risk_class(F.col("risk_score"))).otherwise(0),
    }, keys)


def eligibility_audit(saved: DataFrame, rebuilt: DataFrame, keys: list[str]) -> DataFrame:
    """Masks saved earlier against masks rebuilt from the source, null-safe."""
    masks = ["quality_valid", "vegetation", "classified"]
    joined = rebuilt.select(*keys, *masks).join(
        saved.select(*keys, *[F.col(m).alias(f"saved_{m}") for m in masks]), keys, "full_outer")
    checks = {f"{m} equal": F.col(m).eqNullSafe(F.col(f"saved_{m}")) for m in masks}
    counts = joined.agg(F.count_if("classified").alias("candidates"))
    return tally(joined, checks).unionByName(counts.select(
        F.lit("at least three candidates").alias("check"),
        F.when(F.col("candidates") >= 3, 0).otherwise(1).cast("bigint").alias("n_bad")))


def observation_audit(observations: DataFrame, sources: DataFrame, keys: list[str], cloud_limit: float,
                      min_valid_fraction: float = C.MIN_VALID_FRACTION,
                      min_vegetation: int = C.MIN_VEGETATION_PIXELS) -> DataFrame:
    """Daily observations against the sources they were made from.

    Sources are folded to one row per day first, so no day's list is collected.
    """
    folded = sources.groupBy(*keys, "day").agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct("scene_id").alias("_ids"),
        F.min("acquired_at").alias("_first"), F.max("acquired_at").alias("_last"),
        F.min(F.when(F.col("contributing") > 0, F.col("acquired_at"))).alias("_earliest"),
        F.sum("contributing").alias("_given"), F.max("valid_in_footprint").alias("_most"),
        F.bool_and((F.col("contributing") >= 0) & (F.col("contributing") <= F.col("valid_in_footprint"))).alias("_within"),
        F.bool_and((F.col("cloud_cover") >= 0) & (F.col("cloud_cover") < cloud_limit)).alias("_clear"),
        F.bool_and(F.to_date("acquired_at") == F.col("day")).alias("_same_day"))
    joined = observations.join(folded, [*keys, "day"], "left")
    valid, vegetation, footprint = F.col("valid_pixels"), F.col("vegetation_pixels"), F.col("footprint_pixels")
    return tally(joined, {
        "has sources": F.col("_n") > 0,
        "times complete": (F.col("first_at") == F.col("_first")) & (F.col("last_at") == F.col("_last")),
        "one UTC day": F.col("_same_day"),
        "unique sources": F.col("_ids") == F.col("_n"),
        "counts ordered": (vegetation > 0) & (vegetation <= valid) & (valid <= footprint),
        "contributions within validity": F.col("_within") & (F.col("_most") <= footprint),
        "contributions sum to valid": F.col("_given") == valid,
        "cloud filter": F.col("_clear"),
        "representative time": F.col("acquired_at") == F.col("_earliest"),
        "valid percentage": close_to(F.col("valid_footprint_percentage"), valid * 100.0 / footprint),
        "vegetation percentage": close_to(F.col("vegetation_percentage_of_valid"),
                                          F.when(valid > 0, vegetation * 100.0 / valid)),
        "coverage filters": (valid >= footprint * min_valid_fraction) & (vegetation >= min_vegetation),
    })


def statistics_audit(statistics: DataFrame, threshold: float = C.VEGETATION_NDVI) -> DataFrame:
    """Ordered quantiles inside the index bounds, and the NDVI screen."""
    ends = ["min", "p25", "median", "p75", "max"]
    ordered = reduce(lambda a, b: a & b, [F.col(a) <= F.col(b) for a, b in zip(ends, ends[1:])])
    return tally(statistics, {
        "finite": reduce(lambda a, b: a & b, [is_finite(F.col(c)) for c in ends]),
        "ordered": ordered,
        "inside bounds": (F.col("min") >= -C.INDEX_BOUND) & (F.col("max") <= C.INDEX_BOUND),
        "ndvi screen": (F.col("index_name") != "ndvi") | (F.col("min") >= threshold)})


def source_identity_audit(sources: DataFrame) -> DataFrame:
    """Product ids against platform and time, and well-formed digests."""
    return tally(sources, {
        "product id": product_id_ok(F.col("scene_id"), F.col("platform"), F.col("acquired_at")),
        "digest": is_hex_digest(F.col("window_sha256"))})


def area_agreement(summary: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Summary and catalogue snapshot must name the same scene, box and instant."""
    joined = summary.join(snapshot.select(
        "scene_id", F.col("bbox").alias("_bbox"), F.col("acquired_at").alias("_at")), "scene_id", "full_outer")
    return tally(joined, {"bbox": F.col("bbox") == F.col("_bbox"), "instant": F.col("acquired_at") == F.col("_at")})


def all_finite(frame: DataFrame) -> DataFrame:
    """(check, n_bad): rows with a nonfinite number, per column that holds floats at any depth; NULL is allowed."""
    checks = {f.name: _finite(F.col(f"`{f.name}`"), f.dataType) for f in frame.schema.fields}
    return tally(frame, {name: ok for name, ok in checks.items() if ok is not None})


def _finite(value: Column, kind: T.DataType) -> Column | None:
    """All floats inside a value are finite; None where its type holds none."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return value.isNull() | is_finite(value)
    if isinstance(kind, T.StructType):
        inner = [ok for f in kind.fields if (ok := _finite(value.getField(f.name), f.dataType)) is not None]
        return reduce(lambda a, b: a & b, inner) if inner else None
    if isinstance(kind, T.ArrayType):
        return None if _finite(value, kind.elementType) is None else \
            value.isNull() | F.forall(value, lambda x: _finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return None if _finite(value, kind.valueType) is None else \
            value.isNull() | F.forall(F.map_values(value), lambda x: _finite(x, kind.valueType))
    return None


def duplicated(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where(F.col("occurrences") > 1)


def same_members(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, members): rows present on one side only; both zero when the sets agree."""
    marked = left.distinct().withColumn("_l", F.lit(1)).join(
        right.distinct().withColumn("_r", F.lit(1)), left.columns, "full_outer")
    return marked.agg(F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"))


def raise_if_bad(checks: DataFrame) -> None:
    """The one action at the edge of a job: fail with the checks that did not hold."""
    bad = checks.where(F.col("n_bad") > 0).orderBy("check").collect()
    if bad:
        raise ValueError("; ".join(f"{row['check']}: {row['n_bad']}" for row in bad))
