"""Screening queries over pixels (line items)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscan import constants as C
from fieldscan.functions import reflectance as R
from fieldscan.operators import audit, decision, quantiles, ranks, sampling, screening
from fieldscan.plans.registry import query
from fieldscan.plans.views import EVIDENCE, INDICES, MASKS, PIXELS, SCREENED, big, midrank, pixels, r, screened
from fieldscan.sources import export

SCENE = ["scene_id"]


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence held in memory and on disk: the reports below read it more than once."""
    narrow = screened(spark, folder).select("scene_id", "pixel_id", "classified", *C.INDEX_NAMES)
    return screening.risk_evidence(narrow, SCENE).persist(StorageLevel.MEMORY_AND_DISK)


@query("risk_class_shares", f"""WITH {EVIDENCE},
classes AS (SELECT * FROM (VALUES (1, 'Low'), (2, 'Moderate'), (3, 'High'), (4, 'Very High')) c(risk_class, class_name)),
scene_sizes AS (SELECT scene_id, count(*) AS n FROM evidence GROUP BY ALL)
SELECT s.scene_id, c.risk_class::BIGINT AS risk_class, c.class_name, count(e.risk_score) AS pixels,
       round(count(e.risk_score) * 1e2 / any_value(s.n), 9) AS percentage
FROM scene_sizes s CROSS JOIN classes c LEFT JOIN evidence e ON e.scene_id = s.scene_id AND e.risk_class = c.risk_class
GROUP BY s.scene_id, c.risk_class, c.class_name""")
def risk_class_shares(spark: SparkSession, folder: str) -> DataFrame:
    shares = screening.class_shares(evidence(spark, folder), SCENE)
    return shares.select("scene_id", big(F.col("risk_class")).alias("risk_class"), "class_name", "pixels",
                         r(F.col("percentage")).alias("percentage"))


@query("pixel_indices", f"""WITH {INDICES}
SELECT scene_id, pixel_id, quality_valid, round(ndvi, 9) + 0e0 AS ndvi, round(ndre, 9) + 0e0 AS ndre,
       round(ndmi, 9) + 0e0 AS ndmi FROM indexed""")
def pixel_indices(spark: SparkSession, folder: str) -> DataFrame:
    indexed = screening.with_indices(screening.with_quality(pixels(spark, folder), MASKS))
    return indexed.select("scene_id", "pixel_id", "quality_valid", *[r(F.col(n)).alias(n) for n in C.INDEX_NAMES])


@query("epsilon_indices", f"""WITH {PIXELS},
named AS (SELECT scene_id, pixel_id,
  ((swir + red) - (nir + red_edge)) / ((swir + red) + (nir + red_edge) + 1e-6) AS bare_soil,
  (red_edge - nir) / (red_edge + nir + 1e-6) AS water, (red_edge - red) / (red_edge + red + 1e-6) AS chlorophyll,
  (red - red_edge) / (red + red_edge + 1e-6) AS turbidity, (nir - red) / (nir + red + 1e-6) AS coastal FROM pixels)
SELECT scene_id, pixel_id, round(bare_soil, 9) + 0e0 AS bare_soil, round(water, 9) + 0e0 AS water,
  round(chlorophyll, 9) + 0e0 AS chlorophyll, round(turbidity, 9) + 0e0 AS turbidity, round(coastal, 9) + 0e0 AS coastal
FROM named""")
def epsilon_indices(spark: SparkSession, folder: str) -> DataFrame:
    red, edge, nir, swir = (F.col(c) for c in ("red", "red_edge", "nir", "swir"))
    return pixels(spark, folder).select(
        "scene_id", "pixel_id", r(R.bare_soil_index(swir, red, nir, edge)).alias("bare_soil"),
        r(R.water_index(edge, nir)).alias("water"), r(R.chlorophyll_index(edge, red)).alias("chlorophyll"),
        r(R.turbidity_index(red, edge)).alias("turbidity"), r(R.coastal_ndvi(nir, red)).alias("coastal"))


@query("mask_shares", f"""WITH {INDICES}
SELECT scene_id, count(*) AS total_pixels, count(*) FILTER (quality_valid) AS valid_pixels,
  round(avg(quality_valid::INT) * 1e2, 9) AS valid_percentage,
  round(avg(nodata_mask) * 1e2, 9) AS nodata_mask_percentage, round(avg(cloud_mask) * 1e2, 9) AS cloud_mask_percentage,
  round(avg(cirrus_mask) * 1e2, 9) AS cirrus_mask_percentage FROM indexed GROUP BY ALL""")
def mask_shares(spark: SparkSession, folder: str) -> DataFrame:
    shares = screening.mask_shares(screening.with_quality(pixels(spark, folder), MASKS), SCENE, MASKS)
    return shares.select("scene_id", "total_pixels", "valid_pixels",
                         *[r(F.col(c)).alias(c) for c in shares.columns if c.endswith("percentage")])


@query("index_summary", f"""WITH {INDICES}
SELECT scene_id, round(min(ndvi), 9) + 0e0 AS min, round(max(ndvi), 9) + 0e0 AS max, round(avg(ndvi), 9) + 0e0 AS mean,
  round(quantile_cont(ndvi, 0.5), 9) + 0e0 AS median, round(stddev_pop(ndvi), 9) AS standard_deviation,
  count(ndvi) AS valid_count, round(count(ndvi) * 1e2 / count(*), 9) AS valid_percentage FROM indexed GROUP BY ALL""")
def index_summary(spark: SparkSession, folder: str) -> DataFrame:
    indexed = screening.with_indices(screening.with_quality(pixels(spark, folder), MASKS))
    summary = quantiles.index_summary(indexed, SCENE, "ndvi")
    return summary.select("scene_id", *[r(F.col(c)).alias(c) for c in (
        "min", "max", "mean", "median", "standard_deviation", "valid_percentage")], "valid_count")


@query("screening_counts", f"""WITH {SCREENED}
SELECT scene_id, count(*) AS total_pixels, count(*) FILTER (quality_valid) AS valid_pixels,
  count(*) FILTER (vegetation) AS vegetation_pixels, count(*) FILTER (classified) AS classified_pixels,
  count(*) FILTER (vegetation) - count(*) FILTER (classified) AS missing_evidence_pixels,
  round(count(*) FILTER (vegetation) * 1e2 / count(*) FILTER (quality_valid), 9) AS vegetation_percentage,
  round(count(*) FILTER (vegetation) * 1e2 / count(*), 9) AS vegetation_percentage_of_image
FROM screened GROUP BY ALL""")
def screening_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = screening.screening_counts(screened(spark, folder), SCENE)
    return counts.select("scene_id", *[c for c in counts.columns if c.endswith("pixels")],
                         *[r(F.col(c)).alias(c) for c in ("vegetation_percentage", "vegetation_percentage_of_image")])


@query("rankable_scenes", f"""WITH {SCREENED}
SELECT scene_id, count(*) FILTER (classified) AS classified_pixels,
  round(max(ndmi) FILTER (classified) - min(ndmi) FILTER (classified), 9) AS ndmi_range,
  count(*) FILTER (classified) >= 2
    AND coalesce(max(ndmi) FILTER (classified) - min(ndmi) FILTER (classified) > 1e-12, false) AS rankable
FROM screened GROUP BY ALL""")
def rankable_scenes(spark: SparkSession, folder: str) -> DataFrame:
    return screening.rankable(screened(spark, folder), SCENE).withColumn("ndmi_range", r(F.col("ndmi_range")))


@query("midrank_percentiles", f"""WITH ranked AS (SELECT l_returnflag AS scene_id, l_extendedprice AS price,
  {midrank('l_extendedprice', 'l_returnflag')} AS percentile FROM lineitem)
SELECT scene_id, price, count(*) AS pixels, round(any_value(percentile), 9) AS percentile FROM ranked GROUP BY scene_id, price""")
def midrank_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    from fieldscan.plans.views import table
    rows = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("scene_id"), F.col("l_extendedprice").alias("price"))
    ranked = ranks.midranks(rows, SCENE, ["price"])
    return ranked.groupBy("scene_id", "price").agg(F.count(F.lit(1)).alias("pixels"), r(F.first("price_percentile")).alias("percentile"))


@query("pixel_evidence", f"""WITH {EVIDENCE}
SELECT s.scene_id, s.pixel_id, s.quality_valid, s.vegetation, s.classified, round(e.ndvi_percentile, 9) AS ndvi_percentile,
  round(e.ndre_percentile, 9) AS ndre_percentile, round(e.ndmi_percentile, 9) AS ndmi_percentile,
  round(e.ndmi_deficit, 9) AS ndmi_deficit, round(e.support_factor, 9) AS support_factor,
  round(e.risk_score, 9) AS risk_score, coalesce(e.risk_class, 0)::BIGINT AS risk_class,
  coalesce(e.ndvi_condition, 0)::BIGINT AS ndvi_condition, coalesce(e.ndre_condition, 0)::BIGINT AS ndre_condition
FROM screened s LEFT JOIN evidence e ON s.scene_id = e.scene_id AND s.pixel_id = e.pixel_id""")
def pixel_evidence(spark: SparkSession, folder: str) -> DataFrame:
    floats = [*[f"{n}_percentile" for n in C.INDEX_NAMES], "ndmi_deficit", "support_factor", "risk_score"]
    codes = ["risk_class", "ndvi_condition", "ndre_condition"]
    screen = screened(spark, folder)
    found = evidence(spark, folder).select("scene_id", "pixel_id", *floats, *codes)
    grid = screen.select("scene_id", "pixel_id", "quality_valid", "vegetation", "classified")
    full = screening.on_full_grid(grid, found, ["scene_id", "pixel_id"], codes)
    return full.select(*grid.columns, *[r(F.col(c)).alias(c) for c in floats], *[big(F.col(c)).alias(c) for c in codes])


@query("condition_counts", f"""WITH {EVIDENCE}
SELECT scene_id, ndvi_condition::BIGINT AS ndvi_condition, ndre_condition::BIGINT AS ndre_condition, count(*) AS pixels
FROM evidence GROUP BY ALL""")
def condition_counts(spark: SparkSession, folder: str) -> DataFrame:
    return evidence(spark, folder).groupBy("scene_id", big(F.col("ndvi_condition")).alias("ndvi_condition"),
                                           big(F.col("ndre_condition")).alias("ndre_condition")).agg(F.count(F.lit(1)).alias("pixels"))


LEVELS = {"p05": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


@query("robust_statistics", f"""WITH {EVIDENCE},
long AS (SELECT scene_id, 'ndmi' AS measure, ndmi AS v FROM evidence UNION ALL SELECT scene_id, 'risk_score', risk_score FROM evidence),
centred AS (SELECT *, quantile_cont(v, 0.5) OVER (PARTITION BY scene_id, measure) AS m FROM long)
SELECT scene_id, measure, count(*) AS count, round(min(v), 9) + 0e0 AS min, round(max(v), 9) + 0e0 AS max,
  round(avg(v), 9) + 0e0 AS mean, round(quantile_cont(v, 0.5), 9) + 0e0 AS median, round(stddev_pop(v), 9) AS standard_deviation,
  round(quantile_cont(abs(v - m), 0.5), 9) AS median_absolute_deviation,
  round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 9) AS interquartile_range,
  {', '.join(f'round(quantile_cont(v, {p}), 9) + 0e0 AS {n}' for n, p in LEVELS.items())}
FROM centred GROUP BY scene_id, measure""")
def robust_statistics(spark: SparkSession, folder: str) -> DataFrame:
    stats = quantiles.robust_statistics(evidence(spark, folder), SCENE, ["ndmi", "risk_score"])
    return stats.select("scene_id", "measure", "count", *[r(F.col(c)).alias(c) for c in stats.columns
                                                           if c not in ("scene_id", "measure", "count")])


GROUPS_SQL = EVIDENCE + """,
tails AS (SELECT scene_id, quantile_cont(risk_score, 0.25) AS p25, quantile_cont(risk_score, 0.75) AS p75,
    count(*) AS population FROM evidence GROUP BY ALL),
tagged AS (SELECT e.*, p25, p75, population, CASE WHEN risk_score <= p25 AND risk_score < 25 THEN 'lower'
    WHEN risk_score >= p75 AND risk_score >= 75 THEN 'higher' END AS risk_group FROM evidence e JOIN tails USING (scene_id))"""


@query("risk_groups", f"""WITH {GROUPS_SQL}
SELECT scene_id, risk_group, count(*) AS pixels, any_value(population) AS population, round(any_value(p25), 9) AS score_p25,
  round(any_value(p75), 9) AS score_p75, round(min(risk_score), 9) AS min_score, round(max(risk_score), 9) AS max_score
FROM tagged GROUP BY scene_id, risk_group""")
def risk_groups(spark: SparkSession, folder: str) -> DataFrame:
    tagged = screening.risk_groups(evidence(spark, folder), SCENE)
    return tagged.groupBy("scene_id", "risk_group").agg(
        F.count(F.lit(1)).alias("pixels"), F.first("population").alias("population"),
        r(F.first("score_p25")).alias("score_p25"), r(F.first("score_p75")).alias("score_p75"),
        r(F.min("risk_score")).alias("min_score"), r(F.max("risk_score")).alias("max_score"))


@query("strided_pixels", f"""WITH {INDICES}
SELECT scene_id, grid_index // 776 AS row, grid_index % 776 AS col, count(*) AS pixels, round(avg(ndvi), 9) + 0e0 AS mean_ndvi
FROM indexed WHERE (grid_index // 776) % 8 = 0 AND (grid_index % 776) % 8 = 0 GROUP BY ALL""")
def strided_pixels(spark: SparkSession, folder: str) -> DataFrame:
    indexed = screening.with_indices(screening.with_quality(pixels(spark, folder), MASKS))
    placed = indexed.withColumns({"row": R.pixel_row(F.col("grid_index"), 776), "col": R.pixel_col(F.col("grid_index"), 776)})
    return placed.where(R.on_stride(F.col("row"), F.col("col"))).groupBy("scene_id", "row", "col").agg(
        F.count(F.lit(1)).alias("pixels"), r(F.avg("ndvi")).alias("mean_ndvi"))


@query("spectral_states", f"""WITH {EVIDENCE},
dated AS (SELECT l_returnflag AS scene_id, max(l_shipdate) AS acquired_at FROM lineitem GROUP BY ALL),
folded AS (SELECT scene_id, count(*) AS classified_pixels, max(ndmi) - min(ndmi) AS ndmi_range,
  bool_or(risk_class >= 3) AS hotspots_present, max(risk_score) AS max_score FROM evidence GROUP BY ALL)
SELECT scene_id, classified_pixels, round(ndmi_range, 9) AS ndmi_range, hotspots_present, round(max_score, 9) AS max_score,
  CASE WHEN acquired_at > TIMESTAMP '2001-11-03 00:00:00' THEN 'INSUFFICIENT' WHEN ndmi_range <= 1e-12 THEN 'NO_MEASURABLE_CONTRAST'
       WHEN hotspots_present THEN 'RELATIVE_HOTSPOTS_PRESENT' ELSE 'NO_HIGH_RANKED_HOTSPOTS' END AS spectral_state
FROM folded JOIN dated USING (scene_id)""")
def spectral_states(spark: SparkSession, folder: str) -> DataFrame:
    from fieldscan.plans.views import table
    dated = table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("scene_id")).agg(
        F.max(F.col("l_shipdate").cast("timestamp")).alias("acquired_at"))
    states = decision.spectral_evidence(evidence(spark, folder), dated, SCENE, F.lit("2001-11-03 00:00:00").cast("timestamp"))
    return states.select("scene_id", "classified_pixels", r(F.col("ndmi_range")).alias("ndmi_range"), "hotspots_present",
                         r(F.col("max_score")).alias("max_score"), "spectral_state")


DEFECT = "l_linenumber = 7 AND l_quantity >= 49"


def saved_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Full-grid evidence with defects planted in bright pixels: a wrong score and a wrong class."""
    layers = ["ndvi", "ndre", "ndmi", *[f"{n}_percentile" for n in C.INDEX_NAMES], "ndmi_deficit", "support_factor", "risk_score"]
    codes = ["risk_class", "ndvi_condition", "ndre_condition"]
    screen = screened(spark, folder)
    found = evidence(spark, folder).select("scene_id", "pixel_id", *layers, *codes)
    grid = screen.select("scene_id", "pixel_id", F.col("nir").alias("brightness"), "quality_valid", "vegetation", "classified")
    full = screening.on_full_grid(grid, found, ["scene_id", "pixel_id"], codes)
    bright = F.col("brightness") >= 0.99
    return full.withColumns({
        "risk_score": F.when(bright, F.least(F.lit(100.0), F.col("risk_score") + 0.5)).otherwise(F.col("risk_score")),
        "ndvi_condition": F.when(bright & F.col("classified"), F.lit(0)).otherwise(F.col("ndvi_condition"))})


@query("evidence_audit", f"""WITH {EVIDENCE},
bad AS (SELECT scene_id, nir >= 99e-2 AS bright, risk_score, risk_class, least(1e2, risk_score + 5e-1) AS shown FROM evidence),
totals AS (SELECT scene_id, count(*) FILTER (bright) AS n_condition,
  count(*) FILTER (bright AND abs(shown - risk_score) > 1e-9) AS n_score,
  count(*) FILTER (bright AND risk_class <> CASE WHEN shown < 25 THEN 1 WHEN shown < 50 THEN 2 WHEN shown < 75 THEN 3 ELSE 4 END) AS n_class
  FROM bad GROUP BY ALL),
names AS (SELECT unnest(['masks nested', 'layers present only when classified', 'ndvi screen', 'index bounds', 'ndvi ranks',
  'ndre ranks', 'ndmi ranks', 'moisture deficit', 'support factor', 'risk score', 'ndvi condition', 'ndre condition', 'risk class']) AS "check")
SELECT scene_id, "check", CASE "check" WHEN 'risk score' THEN n_score WHEN 'ndvi condition' THEN n_condition
  WHEN 'risk class' THEN n_class ELSE 0 END AS n_bad FROM totals CROSS JOIN names""")
def evidence_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.evidence_audit(saved_evidence(spark, folder), SCENE)


@query("eligibility_audit", f"""WITH {SCREENED}
SELECT 'quality_valid equal' AS "check", 0::BIGINT AS n_bad FROM (SELECT count(*) FROM screened)
UNION ALL SELECT 'vegetation equal', 0 UNION ALL
SELECT 'classified equal', count(*) FILTER (classified AND nir >= 99e-2) FROM screened
UNION ALL SELECT 'at least three candidates', CASE WHEN count(*) FILTER (classified) >= 3 THEN 0 ELSE 1 END FROM screened""")
def eligibility_audit(spark: SparkSession, folder: str) -> DataFrame:
    rebuilt = screened(spark, folder)
    saved = rebuilt.withColumn("classified", F.col("classified") & (F.coalesce(F.col("nir"), F.lit(0.0)) < 0.99))
    return audit.eligibility_audit(saved, rebuilt, ["scene_id", "pixel_id"])


@query("reconciled_summaries", """WITH saved AS (SELECT l_suppkey AS site, avg(l_discount) + CASE WHEN max(l_quantity) >= 50 THEN 1e-6 ELSE 0 END AS value
  FROM lineitem GROUP BY ALL), expected AS (SELECT s_suppkey AS site, avg(l_discount) AS value FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY ALL)
SELECT coalesce(s.site, e.site) AS site, CASE WHEN s.site IS NULL THEN 'missing' WHEN e.site IS NULL THEN 'extra'
  WHEN abs(s.value - e.value) <= greatest(1e-9, 1e-10 * greatest(abs(s.value), abs(e.value))) THEN 'equal' ELSE 'differs' END AS status
FROM saved s FULL OUTER JOIN expected e ON s.site = e.site""")
def reconciled_summaries(spark: SparkSession, folder: str) -> DataFrame:
    from fieldscan.plans.views import table
    li = table(spark, folder, "lineitem")
    saved = li.groupBy(F.col("l_suppkey").alias("site")).agg(
        (F.avg("l_discount") + F.when(F.max("l_quantity") >= 50, 1e-6).otherwise(0.0)).alias("value"))
    known = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    expected = li.join(known, "l_suppkey", "left_semi").groupBy(F.col("l_suppkey").alias("site")).agg(F.avg("l_discount").alias("value"))
    return audit.reconcile(saved, expected, ["site"], ["value"]).select("site", "status")


@query("exact_sample", f"""WITH {SCREENED},
placed AS (SELECT scene_id, pixel_id, row_number() OVER (PARTITION BY scene_id ORDER BY md5('813:' || pixel_id), pixel_id) AS place
  FROM screened WHERE quality_valid)
SELECT scene_id, pixel_id FROM placed WHERE place <= 2048""")
def exact_sample(spark: SparkSession, folder: str) -> DataFrame:
    return export.sample_pixels(screened(spark, folder), SCENE).select("scene_id", "pixel_id")


@query("sample_summary", f"""WITH {SCREENED},
placed AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY md5('813:' || pixel_id), pixel_id) AS place
  FROM screened WHERE quality_valid)
SELECT scene_id, count(*) AS sample_pixels, count(*) FILTER (vegetation) AS sample_vegetation,
  count(*) FILTER (classified) AS sample_classified, round(avg(ndmi), 9) + 0e0 AS sample_mean_ndmi
FROM placed WHERE place <= 2048 GROUP BY ALL""")
def sample_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = export.sample_summary(export.sample_pixels(screened(spark, folder), SCENE), SCENE)
    return summary.withColumn("sample_mean_ndmi", r(F.col("sample_mean_ndmi")))


@query("sample_reconciliation", f"""WITH {SCREENED},
placed AS (SELECT scene_id, quality_valid, row_number() OVER (PARTITION BY scene_id ORDER BY md5('813:' || pixel_id), pixel_id) AS place
  FROM screened WHERE quality_valid)
SELECT 'equal' AS status, count(*) AS pixels FROM placed WHERE place <= 2048""")
def sample_reconciliation(spark: SparkSession, folder: str) -> DataFrame:
    full = screened(spark, folder)
    sample = export.sample_pixels(full, SCENE)
    keys = ["scene_id", "pixel_id"]
    wanted = full.join(sample.select(*keys), keys, "left_semi")
    return audit.reconcile(sample, wanted, keys, list(C.INDEX_NAMES), 0.0, 0.0).groupBy("status").agg(F.count(F.lit(1)).alias("pixels"))


def _levels(source: str, fan: int = 65536) -> str:
    return f"""l0 AS (SELECT DISTINCT scene_id, id FROM {source}),
l1 AS (SELECT scene_id, id // {fan} AS b, sha256(string_agg(id::VARCHAR, ',' ORDER BY id)) AS h, count(*) AS n FROM l0 GROUP BY ALL),
l2 AS (SELECT scene_id, b // {fan} AS b2, sha256(string_agg(h, ',' ORDER BY b)) AS h, sum(n) AS n FROM l1 GROUP BY ALL),
l3 AS (SELECT scene_id, b2 // {fan} AS b3, sha256(string_agg(h, ',' ORDER BY b2)) AS h, sum(n) AS n FROM l2 GROUP BY ALL),
l4 AS (SELECT scene_id, b3 // {fan} AS b4, sha256(string_agg(h, ',' ORDER BY b3)) AS h, sum(n) AS n FROM l3 GROUP BY ALL)
SELECT scene_id, sum(n)::BIGINT AS members, sha256(string_agg(h, ',' ORDER BY b4)) AS digest FROM l4 GROUP BY ALL"""


@query("membership_digest", f"""WITH {SCREENED}, ids AS (SELECT scene_id, grid_index AS id FROM screened WHERE classified),
{_levels('ids')}""")
def membership_digest(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.membership_digest(screened(spark, folder).where("classified"), SCENE, "grid_index")


@query("risk_vs_index_spearman", f"""WITH {EVIDENCE},
r AS (SELECT scene_id, rank() OVER (PARTITION BY scene_id ORDER BY ndvi) + (count(*) OVER (PARTITION BY scene_id, ndvi) - 1) / 2e0 AS x,
  rank() OVER (PARTITION BY scene_id ORDER BY risk_score) + (count(*) OVER (PARTITION BY scene_id, risk_score) - 1) / 2e0 AS y FROM evidence)
SELECT scene_id, count(*) AS population, round(corr(x, y), 6) + 0e0 AS rho FROM r GROUP BY ALL""")
def risk_vs_index_spearman(spark: SparkSession, folder: str) -> DataFrame:
    found = ranks.spearman(evidence(spark, folder), SCENE, "ndvi", "risk_score")
    return found.withColumn("rho", r(F.col("rho"), 6))


@query("statistics_by_class", f"""WITH {EVIDENCE},
scene_list AS (SELECT DISTINCT scene_id FROM evidence), classes AS (SELECT unnest([1, 2, 3, 4]) AS risk_class)
SELECT s.scene_id, c.risk_class::BIGINT AS risk_class, count(e.ndvi) AS count, round(avg(ndvi), 9) + 0e0 AS mean,
  round(quantile_cont(ndvi, 0.5), 9) + 0e0 AS median, round(stddev_pop(ndvi), 9) AS standard_deviation
FROM scene_list s CROSS JOIN classes c LEFT JOIN evidence e ON e.scene_id = s.scene_id AND e.risk_class = c.risk_class GROUP BY ALL""")
def statistics_by_class(spark: SparkSession, folder: str) -> DataFrame:
    found = evidence(spark, folder)
    stats = quantiles.robust_statistics(found, ["scene_id", "risk_class"], ["ndvi"])
    classes = found.select("scene_id").distinct().withColumn("risk_class", F.explode(F.array(*[F.lit(c) for c in range(1, 5)])))
    full = quantiles.join_groups(classes, stats, ["scene_id", "risk_class"]).fillna(0, subset=["count"])
    return full.select("scene_id", big(F.col("risk_class")).alias("risk_class"), "count",
                       *[r(F.col(c)).alias(c) for c in ("mean", "median", "standard_deviation")])
