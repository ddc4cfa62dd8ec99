"""Band and spectrum queries over embeddings read as 64-band spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscan import constants as C
from fieldscan.functions import reflectance as R
from fieldscan.operators import anomaly, bands, screening, spectra as spectra_ops
from fieldscan.operators.ranks import spearman
from fieldscan.plans.registry import query
from fieldscan.plans.views import EVIDENCE, MASKS, PIXELS, SPECTRA, big, cube, r, spectra, spectra_bands, table
from fieldscan.session import checkpointed, spread

GROUP = ["scene_id", "group_id"]


def scanned(spark: SparkSession, folder: str, step: float = 20.0, shift: float = 0.0) -> DataFrame:
    return bands.scan_bands(spectra(spark, folder, shift), spectra_bands(spark, folder, step))


@query("window_bands", f"""WITH {SPECTRA}
SELECT DISTINCT scene_id, band_index::BIGINT AS band_index, round(wavelength_nm, 6) AS wavelength_nm,
  wavelength_nm BETWEEN 400 AND 1700 AS in_window,
  (wavelength_nm BETWEEN 1350 AND 1450) OR (wavelength_nm BETWEEN 1800 AND 1950) OR wavelength_nm > 2450 AS bad_band FROM spectra""")
def window_bands(spark: SparkSession, folder: str) -> DataFrame:
    w = F.col("wavelength_nm")
    return spectra_bands(spark, folder).select("scene_id", big(F.col("band_index")).alias("band_index"), r(w, 6).alias("wavelength_nm"),
                                               R.in_window(w).alias("in_window"), R.is_bad_band(w).alias("bad_band"))


@query("nearest_bands", f"""WITH {SPECTRA},
b AS (SELECT DISTINCT scene_id, band_index, wavelength_nm FROM spectra WHERE wavelength_nm BETWEEN 400 AND 1700),
t AS (SELECT * FROM (VALUES ('red', 665e0), ('red_edge', 705e0), ('nir', 86e1), ('swir', 165e1)) t(role, target_nm)),
placed AS (SELECT *, row_number() OVER (PARTITION BY scene_id, role ORDER BY abs(wavelength_nm - target_nm), band_index) AS place FROM b, t)
SELECT scene_id, role, target_nm, band_index::BIGINT AS band_index, wavelength_nm FROM placed WHERE place = 1""")
def nearest_bands(spark: SparkSession, folder: str) -> DataFrame:
    return bands.nearest_bands(spectra_bands(spark, folder)).withColumn("band_index", big(F.col("band_index")))


@query("band_order_check", f"""WITH {SPECTRA},
b AS (SELECT pixel_id AS scene_id, band_index, CASE WHEN band_index = pixel_id % 64 AND pixel_id % 5 = 0 THEN 'NaN'::DOUBLE
  WHEN band_index = pixel_id % 64 AND pixel_id % 3 = 0 THEN wavelength_nm - 3e1 ELSE wavelength_nm END AS wavelength_nm FROM spectra),
s AS (SELECT *, coalesce(wavelength_nm > lag(wavelength_nm) OVER (PARTITION BY scene_id ORDER BY band_index), true) AS rising FROM b)
SELECT scene_id, count(*) AS bands, count(*) FILTER (wavelength_nm BETWEEN 400 AND 1700) AS in_window,
  concat_ws(';', CASE WHEN count(*) FILTER (isnan(wavelength_nm)) > 0 THEN 'nonfinite wavelength' END,
    CASE WHEN count(*) FILTER (NOT rising) > 0 THEN 'wavelengths not strictly increasing' END,
    CASE WHEN count(*) FILTER (wavelength_nm BETWEEN 400 AND 1700) = 0 THEN 'no band inside the window' END) AS problems FROM s GROUP BY ALL""")
def band_order_check(spark: SparkSession, folder: str) -> DataFrame:
    """One band table per vector; every fifth has a band without a finite wavelength, every third one out of order."""
    at, nm = F.col("pixel_id"), 400.0 + 20.0 * F.col("band_index")
    here = F.col("band_index") == at % 64
    tables = spectra(spark, folder).select(at.alias("scene_id"), "band_index", F.when(here & (at % 5 == 0), float("nan"))
                                           .when(here & (at % 3 == 0), nm - 30.0).otherwise(nm).alias("wavelength_nm"))
    return bands.band_problems(tables).withColumn("problems", F.array_join("problems", ";"))


@query("band_group_profiles", f"""WITH {SPECTRA}
SELECT scene_id, group_id, band_index::BIGINT AS band_index, count(valid_reflectance) AS valid_count,
  count(*) - count(valid_reflectance) AS excluded_count, count(*) FILTER (valid_reflectance > 1) AS above_one_count,
  round(quantile_cont(valid_reflectance, 0.25), 9) AS p25, round(quantile_cont(valid_reflectance, 0.5), 9) AS median,
  round(quantile_cont(valid_reflectance, 0.75), 9) AS p75 FROM spectra GROUP BY scene_id, group_id, band_index""")
def band_group_profiles(spark: SparkSession, folder: str) -> DataFrame:
    profiles = bands.group_profiles(scanned(spark, folder), ["scene_id"], "group_id")
    return profiles.select("scene_id", "group_id", big(F.col("band_index")).alias("band_index"), "valid_count", "excluded_count",
                           "above_one_count", *[r(F.col(c)).alias(c) for c in ("p25", "median", "p75")])


@query("group_report", f"""WITH {SPECTRA},
p AS (SELECT scene_id, group_id, band_index, count(valid_reflectance) AS n FROM spectra GROUP BY ALL)
SELECT scene_id, group_id, min(n) AS min_valid_count, max(n) AS max_valid_count, count(*) FILTER (n > 0) AS bands_with_statistics,
  count(*) FILTER (n = 0) AS bands_without FROM p GROUP BY ALL""")
def group_report(spark: SparkSession, folder: str) -> DataFrame:
    profiles = bands.group_profiles(scanned(spark, folder), ["scene_id"], "group_id")
    return bands.group_report(profiles, ["scene_id"], "group_id").withColumn("bands_without", big(F.size("bands_without")))


AUDIT_SQL = f"""WITH {SPECTRA}
SELECT scene_id, group_id, band_index::BIGINT AS band_index, count(valid_reflectance) AS valid_count,
  count(*) - count(valid_reflectance) AS invalid_count, count(*) FILTER (valid_reflectance > 1) AS above_one_count,
  concat_ws(';', CASE WHEN wavelength_nm BETWEEN 1350 AND 1450 THEN 'atmospheric_caution_1350_1450_nm' END,
    CASE WHEN count(valid_reflectance) = 0 THEN 'no_valid_candidate_reflectance'
         WHEN min(valid_reflectance) = max(valid_reflectance) THEN 'constant_candidate_reflectance' END) AS reasons,
  NOT (wavelength_nm BETWEEN 1350 AND 1450) AND count(valid_reflectance) > 0
    AND min(valid_reflectance) <> max(valid_reflectance) AS retained
FROM spectra GROUP BY scene_id, group_id, band_index, wavelength_nm"""


def audit_rows(audit: DataFrame) -> DataFrame:
    return audit.select(*GROUP, big(F.col("band_index")).alias("band_index"), "valid_count", "invalid_count", "above_one_count",
                        F.array_join("exclusion_reasons", ";").alias("reasons"), F.coalesce("retained", F.lit(False)).alias("retained"))


@query("cube_audit", AUDIT_SQL)
def cube_audit(spark: SparkSession, folder: str) -> DataFrame:
    bands_of = spectra_bands(spark, folder)
    return audit_rows(spectra_ops.cube_audit(spectra_ops.cleaned_cube(cube(spark, folder), bands_of), bands_of, GROUP))


@query("band_audit", AUDIT_SQL)
def band_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit_rows(bands.band_audit(scanned(spark, folder), GROUP))


COMPLETE = """
shifted AS (SELECT *, CASE WHEN reflectance + 3e-1 >= 0 AND reflectance + 3e-1 <> 25e-2 THEN reflectance + 3e-1 END AS v FROM spectra),
kept AS (SELECT group_id, band_index FROM shifted WHERE NOT wavelength_nm BETWEEN 1350 AND 1450 GROUP BY ALL
  HAVING count(v) > 0 AND min(v) <> max(v)),
complete AS (SELECT s.scene_id, s.group_id, pixel_id, count(*) AS retained_bands FROM shifted s JOIN kept USING (group_id, band_index)
  GROUP BY ALL HAVING count(v) = count(*))"""


@query("complete_pixels", f"""WITH {SPECTRA}, {COMPLETE} SELECT scene_id, group_id, pixel_id, retained_bands FROM complete""")
def complete_pixels(spark: SparkSession, folder: str) -> DataFrame:
    return complete_vectors(spark, folder, 0.3).select(*GROUP, "pixel_id", F.size("spectrum").cast("bigint").alias("retained_bands"))


def complete_vectors(spark: SparkSession, folder: str, shift: float) -> DataFrame:
    """Complete vectors of the shifted spectra; kept where they are read more than once."""
    bands_of = spectra_bands(spark, folder)
    cleaned = spectra_ops.cleaned_cube(cube(spark, folder, shift), bands_of)
    return spectra_ops.complete_vectors(cleaned, spectra_ops.cube_audit(cleaned, bands_of, GROUP), GROUP)


@query("scaler_statistics", f"""WITH {SPECTRA}, {COMPLETE},
rows AS (SELECT s.group_id, s.band_index, v FROM shifted s JOIN complete c USING (group_id, pixel_id) JOIN kept USING (group_id, band_index)),
placed AS (SELECT *, dense_rank() OVER (PARTITION BY group_id ORDER BY band_index) - 1 AS position FROM rows)
SELECT group_id, position::BIGINT AS position, count(*) AS fit_rows, round(avg(v), 8) AS mean, round(stddev_pop(v), 8) AS scale
FROM placed GROUP BY ALL""")
def scaler_statistics(spark: SparkSession, folder: str) -> DataFrame:
    scaler = spectra_ops.fit_scaler(complete_vectors(spark, folder, 0.3), GROUP)
    return scaler.select("group_id", "fit_rows", F.posexplode(F.arrays_zip("mean", "scale")).alias("position", "b")).select(
        "group_id", big(F.col("position")).alias("position"), "fit_rows", r(F.col("b.mean"), 8).alias("mean"), r(F.col("b.scale"), 8).alias("scale"))


def difference(spark: SparkSession, folder: str, step: float) -> DataFrame:
    """Two opposed groups: low labels against high labels."""
    two = scanned(spark, folder, step).withColumn("side", F.when(F.col("group_id") < 5, "lower").otherwise("higher"))
    return bands.median_difference(bands.group_profiles(two, ["scene_id"], "side"), ["scene_id"], "side", "lower", "higher")


def difference_sql(step: str) -> str:
    return f"""{SPECTRA},
placed AS (SELECT scene_id, band_index, 4e2 + {step} * band_index AS nm, group_id < 5 AS is_lower, valid_reflectance FROM spectra),
d AS (SELECT scene_id, band_index, nm, quantile_cont(valid_reflectance, 0.5) FILTER (is_lower) AS lower_median,
  quantile_cont(valid_reflectance, 0.5) FILTER (NOT is_lower) AS higher_median,
  quantile_cont(valid_reflectance, 0.5) FILTER (NOT is_lower) - quantile_cont(valid_reflectance, 0.5) FILTER (is_lower) AS diff
  FROM placed WHERE nm BETWEEN 400 AND 1700 GROUP BY ALL)"""


@query("median_difference", f"""WITH {difference_sql('2e1')}
SELECT scene_id, band_index::BIGINT AS band_index, round(lower_median, 9) AS lower_median, round(higher_median, 9) AS higher_median,
  round(diff, 9) + 0e0 AS difference FROM d""")
def median_difference(spark: SparkSession, folder: str) -> DataFrame:
    d = difference(spark, folder, 20.0)
    return d.select("scene_id", big(F.col("band_index")).alias("band_index"),
                    *[r(F.col(c)).alias(c) for c in ("lower_median", "higher_median", "difference")])


WINDOWS_SQL = difference_sql('8e0') + """,
near AS (SELECT min_by(nm, (abs(nm - t), band_index)) AS nm FROM d, (SELECT unnest([665e0, 705e0, 86e1, 165e1]) AS t) GROUP BY t),
b AS (SELECT *, 4e2 + 25e0 * floor((nm - 4e2) / 25e0) AS window_start,
  diff IS NULL OR nm BETWEEN 1350 AND 1450 OR EXISTS (SELECT 1 FROM near WHERE abs(near.nm - d.nm) <= 15) AS barred FROM d WHERE nm < 1700),
windows AS (SELECT scene_id, window_start, window_start + 25e0 AS window_end, count(*) AS band_count, min(nm) AS first_nm, max(nm) AS last_nm,
  avg(abs(diff)) AS mean_absolute, avg(diff) AS mean_signed, arg_max(nm, (abs(diff), -nm)) AS peak_nm, arg_max(diff, (abs(diff), -nm)) AS peak_difference
  FROM b GROUP BY scene_id, window_start HAVING count(*) >= 3 AND NOT bool_or(barred))"""


def windows(spark: SparkSession, folder: str) -> DataFrame:
    d = difference(spark, folder, 8.0)
    return bands.contrast_windows(d, bands.nearest_bands(spectra_bands(spark, folder, 8.0)), ["scene_id"])


@query("contrast_windows", f"""WITH {WINDOWS_SQL}
SELECT scene_id, window_start, window_end, band_count, first_nm, last_nm, round(mean_absolute, 9) AS mean_absolute,
  round(mean_signed, 9) + 0e0 AS mean_signed, peak_nm, round(peak_difference, 9) + 0e0 AS peak_difference FROM windows""")
def contrast_windows(spark: SparkSession, folder: str) -> DataFrame:
    return windows(spark, folder).withColumns({c: r(F.col(c)) for c in ("mean_absolute", "mean_signed", "peak_difference")})


@query("spaced_contrast_regions", f"""WITH RECURSIVE {WINDOWS_SQL},
ranked AS (SELECT *, row_number() OVER (ORDER BY mean_absolute DESC, window_start) AS place FROM windows),
pick AS (SELECT 0::BIGINT AS place, []::DOUBLE[] AS chosen UNION ALL
  SELECT r.place, CASE WHEN len(chosen) < 3 AND len(list_filter(chosen, lambda x: abs(x - r.window_start) < 100)) = 0
    THEN list_append(chosen, r.window_start) ELSE chosen END FROM pick JOIN ranked r ON r.place = pick.place + 1),
final AS (SELECT chosen FROM pick ORDER BY place DESC LIMIT 1),
listed AS (SELECT unnest(chosen) AS window_start, generate_subscripts(chosen, 1) AS position FROM final)
SELECT scene_id, position::BIGINT AS position, window_start, round(mean_absolute, 9) AS mean_absolute FROM listed JOIN windows USING (window_start)""")
def spaced_contrast_regions(spark: SparkSession, folder: str) -> DataFrame:
    regions = bands.spaced_regions(windows(spark, folder), ["scene_id"])
    return regions.select("scene_id", big(F.col("position")).alias("position"), "window_start", r(F.col("mean_absolute")).alias("mean_absolute"))


@query("mean_spectrum", f"""WITH {SPECTRA}
SELECT scene_id, group_id, band_index::BIGINT AS band_index, round(avg(valid_reflectance), 9) AS mean_reflectance,
  count(valid_reflectance) AS valid_count FROM spectra
WHERE NOT ((wavelength_nm BETWEEN 1350 AND 1450) OR (wavelength_nm BETWEEN 1800 AND 1950) OR wavelength_nm > 2450) GROUP BY ALL""")
def mean_spectrum(spark: SparkSession, folder: str) -> DataFrame:
    mean = bands.mean_spectrum(scanned(spark, folder), GROUP)
    return mean.select(*GROUP, big(F.col("band_index")).alias("band_index"), r(F.col("mean_reflectance")).alias("mean_reflectance"), "valid_count")


STRONGEST_SQL = SPECTRA + """,
per AS (SELECT group_id, pixel_id, max(reflectance) FILTER (band_index = 13) AS red, max(reflectance) FILTER (band_index = 23) AS nir,
  max(reflectance) FILTER (band_index = 62) AS swir FROM spectra GROUP BY ALL),
idx AS (SELECT *, (nir - red) / (abs(nir) + abs(red) + 1e-6) AS greenness, (nir - swir) / (abs(nir) + abs(swir) + 1e-6) AS moisture FROM per),
best AS (SELECT group_id, 'greenness' AS index_name, arg_max(pixel_id, (greenness, -pixel_id)) AS pixel_id, max(greenness) AS value FROM idx GROUP BY ALL
  UNION ALL SELECT group_id, 'moisture', arg_max(pixel_id, (moisture, -pixel_id)), max(moisture) FROM idx GROUP BY ALL)"""


def strongest(spark: SparkSession, folder: str) -> DataFrame:
    """The three needed bands straight from each vector; no explode, no shuffle before the maximum."""
    e = table(spark, folder, "embeddings")
    red, nir, swir = (F.get("embedding", F.lit(i)).cast("double") for i in (13, 23, 62))
    indices = e.select(F.col("label").cast("bigint").alias("group_id"), F.col("vec_id").alias("pixel_id"),
                       ((nir - red) / (F.abs(nir) + F.abs(red) + 1e-6)).alias("greenness"),
                       ((nir - swir) / (F.abs(nir) + F.abs(swir) + 1e-6)).alias("moisture"))
    return bands.strongest_pixels(indices, ["group_id"], ["greenness", "moisture"])


@query("strongest_pixels", f"""WITH {STRONGEST_SQL} SELECT group_id, index_name, pixel_id, round(value, 9) + 0e0 AS value FROM best""")
def strongest_pixels(spark: SparkSession, folder: str) -> DataFrame:
    return strongest(spark, folder).withColumn("value", r(F.col("value")))


@query("strongest_spectra_with_gaps", f"""WITH {STRONGEST_SQL},
curve AS (SELECT b.group_id, b.index_name, s.band_index, s.wavelength_nm, s.valid_reflectance AS v FROM best b JOIN spectra s
  ON s.pixel_id = b.pixel_id WHERE NOT s.wavelength_nm BETWEEN 1350 AND 1450),
stepped AS (SELECT *, lag(band_index) OVER w AS pb, lag(wavelength_nm) OVER w AS pn FROM curve WINDOW w AS (PARTITION BY group_id, index_name ORDER BY band_index))
SELECT group_id, index_name, wavelength_nm, round(v, 9) AS reflectance FROM stepped
UNION ALL SELECT group_id, index_name, (pn + wavelength_nm) / 2e0, NULL FROM stepped WHERE band_index > pb + 1""")
def strongest_spectra_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen pixels first, at most two a group; only their vectors are exploded."""
    best = strongest(spark, folder).select(F.col("pixel_id").alias("vec_id"), "index_name")
    chosen = table(spark, folder, "embeddings").join(best, "vec_id") \
        .select("label", "vec_id", "index_name", F.posexplode("embedding").alias("band_index", "v")) \
        .select(F.lit("S").alias("scene_id"), F.col("label").cast("bigint").alias("group_id"), "index_name", "band_index",
                F.col("v").cast("double").alias("reflectance"))
    curve = bands.scan_bands(chosen, spectra_bands(spark, folder)).where(~R.is_bad_band(F.col("wavelength_nm"))) \
        .select("group_id", "index_name", "band_index", "wavelength_nm", F.col("valid_reflectance").alias("reflectance"))
    return bands.with_gaps(curve, ["group_id", "index_name"], "reflectance").withColumn("reflectance", r(F.col("reflectance")))


@query("band_covariance", f"""WITH {SPECTRA}, {COMPLETE},
rows AS (SELECT s.group_id, s.pixel_id, s.band_index, v FROM shifted s JOIN complete c USING (group_id, pixel_id) JOIN kept USING (group_id, band_index)),
placed AS (SELECT *, dense_rank() OVER (PARTITION BY group_id ORDER BY band_index) - 1 AS position FROM rows)
SELECT a.group_id, a.position::BIGINT AS i, b.position::BIGINT AS j, count(*) AS fit_rows, round(covar_pop(a.v, b.v), 8) + 0e0 AS covariance
FROM placed a JOIN placed b ON a.group_id = b.group_id AND a.pixel_id = b.pixel_id AND b.position <= a.position GROUP BY ALL""")
def band_covariance(spark: SparkSession, folder: str) -> DataFrame:
    matrix = anomaly.band_covariance(complete_vectors(spark, folder, 0.3), GROUP)
    return matrix.select("group_id", big(F.col("i")).alias("i"), big(F.col("j")).alias("j"), F.col("n").alias("fit_rows"),
                         r(F.col("covariance"), 8).alias("covariance"))


def model_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """All-positive spectra, so every vector is complete; kept, as fitting and scoring both read them."""
    return checkpointed(spread(complete_vectors(spark, folder, 1.0)))


@query("component_residuals", f"""WITH {SPECTRA},
per AS (SELECT group_id, band_index, stddev_pop(reflectance) AS sd FROM spectra WHERE NOT wavelength_nm BETWEEN 1350 AND 1450 GROUP BY ALL)
SELECT group_id, count(*) AS bands, true AS solves, true AS unit_length, true AS fewest_above FROM per WHERE sd > 0 GROUP BY ALL""")
def component_residuals(spark: SparkSession, folder: str) -> DataFrame:
    """Every component solves its eigenvalue equation, has length 1, and one fewer would not reach the share."""
    inputs = model_inputs(spark, folder)
    cells = checkpointed(anomaly.band_covariance(inputs, GROUP))
    model = checkpointed(anomaly.fit_components(inputs, anomaly.fit_scaler(inputs, GROUP), GROUP))
    residuals = anomaly.component_residuals(cells, model, GROUP).groupBy(*GROUP).agg(
        (F.max("residual") < 1e-9).alias("solves"), (F.max(F.abs(F.col("length") - 1)) < 1e-9).alias("unit_length"))
    total, last = F.aggregate("ratios", F.lit(0.0), lambda a, v: a + v), F.element_at("ratios", -1)
    return residuals.join(model, GROUP).select("group_id", big(F.size("mean")).alias("bands"), "solves", "unit_length", (
        (total > C.PCA_VARIANCE) & (total - last <= C.PCA_VARIANCE)).alias("fewest_above"))


TREES, TREE_ROWS, TREE_HEIGHT = 4, 16, 4


def forest_sql() -> str:
    """The trees and scores of ``anomaly.fit_forest`` on raw bands, level by level."""
    factors = ", ".join(str(f) for f in anomaly.tree_factors(C.MODEL_SEED, TREES))
    number = lambda at: f"(CAST('0x' || substr(md5(pixel_id::VARCHAR), {at}, 13) AS BIGINT) % {anomaly.DRAW_PRIME})"
    unit = lambda at: f"CAST('0x' || substr(md5('{C.MODEL_SEED}:' || tree || ':' || node), {at}, 8) AS BIGINT) / 4294967296e0"
    steps = []
    for depth in range(TREE_HEIGHT):
        steps.append(f"""range{depth} AS (SELECT group_id, tree, node, band_index, min(v) AS low, max(v) AS high FROM at{depth} JOIN bands USING (group_id, pixel_id) GROUP BY ALL),
vary{depth} AS (SELECT *, row_number() OVER (PARTITION BY group_id, tree, node ORDER BY band_index) - 1 AS place, count(*) OVER (PARTITION BY group_id, tree, node) AS n
  FROM range{depth} WHERE high > low),
split{depth} AS (SELECT group_id, tree, node, band_index, low + {unit(9)} * (high - low) AS threshold FROM vary{depth} WHERE place = floor({unit(1)} * n)),
at{depth + 1} AS (SELECT group_id, tree, pixel_id, 2 * node + (v > threshold)::INT AS node FROM at{depth} JOIN split{depth} USING (group_id, tree, node) JOIN bands USING (group_id, pixel_id, band_index)),
go{depth + 1} AS (SELECT group_id, tree, pixel_id, 2 * node + (v > threshold)::INT AS node FROM go{depth} JOIN split{depth} USING (group_id, tree, node) JOIN bands USING (group_id, pixel_id, band_index))""")
    reached = " UNION ALL ".join(f"SELECT *, {d} AS depth FROM go{d}" for d in range(TREE_HEIGHT + 1))
    sized = " UNION ALL ".join(f"SELECT group_id, tree, node, count(*) AS size FROM at{d} GROUP BY ALL" for d in range(TREE_HEIGHT + 1))
    path = lambda n: f"CASE WHEN {n} <= 1 THEN 0e0 WHEN {n} = 2 THEN 1e0 ELSE 2e0 * (ln({n} - 1e0) + {anomaly.EULER_GAMMA}::DOUBLE) - 2e0 * ({n} - 1e0) / {n} END"
    return f"""WITH {SPECTRA},
bands AS (SELECT group_id, pixel_id, band_index, reflectance + 1e0 AS v FROM spectra WHERE NOT wavelength_nm BETWEEN 1350 AND 1450),
pixels AS (SELECT DISTINCT group_id, pixel_id FROM bands),
drawn AS (SELECT group_id, pixel_id, tree, (a * {number(1)} + b * {number(14)} + c) % {anomaly.DRAW_PRIME} AS draw FROM pixels, (VALUES {factors}) f(tree, a, b, c)),
at0 AS (SELECT group_id, tree, pixel_id, 1 AS node FROM (SELECT *, row_number() OVER (PARTITION BY group_id, tree ORDER BY draw, pixel_id) AS place FROM drawn) WHERE place <= {TREE_ROWS}),
go0 AS (SELECT group_id, tree, pixel_id, 1 AS node FROM pixels, (SELECT DISTINCT tree FROM at0)),
{','.join(chr(10) + s for s in steps)},
sizes AS ({sized}), visits AS ({reached}),
leaves AS (SELECT group_id, tree, pixel_id, max_by(node, depth) AS node, max(depth) AS depth FROM visits GROUP BY ALL),
lengths AS (SELECT group_id, pixel_id, sum(depth + {path('size')}) AS total FROM leaves JOIN sizes USING (group_id, tree, node) GROUP BY ALL),
expected AS (SELECT group_id, least({TREE_ROWS}, count(*)) AS n FROM pixels GROUP BY ALL)
SELECT 'S' AS scene_id, group_id, pixel_id, round(pow(2e0, -total / {TREES} / ({path('n')})), 9) AS anomaly_score FROM lengths JOIN expected USING (group_id)"""


@query("forest_scores", forest_sql())
def forest_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Few small trees on the bands themselves, so that SQL can grow the same ones."""
    inputs = model_inputs(spark, folder)
    forest = anomaly.fit_forest(inputs, GROUP, TREES, TREE_ROWS)
    return anomaly.score_anomaly(inputs, forest, GROUP).withColumn("anomaly_score", r(F.col("anomaly_score"), 9))


@query("anomaly_components")
def anomaly_components(spark: SparkSession, folder: str) -> DataFrame:
    spectra_in = model_inputs(spark, folder)
    model = anomaly.fit_components(spectra_in, anomaly.fit_scaler(spectra_in, GROUP), GROUP)
    return anomaly.component_table(model, GROUP).select(
        *GROUP, big(F.col("component")).alias("component"), r(F.col("ratio"), 6).alias("ratio"), r(F.col("cumulative"), 6).alias("cumulative"))


@query("anomaly_scores")
def anomaly_scores(spark: SparkSession, folder: str) -> DataFrame:
    spectra_in = model_inputs(spark, folder)
    scores = anomaly.score_anomaly(spectra_in, anomaly.fit_anomaly(spectra_in, GROUP), GROUP)
    return scores.withColumn("anomaly_score", r(F.col("anomaly_score"), 9))


@query("anomaly_vs_index")
def anomaly_vs_index(spark: SparkSession, folder: str) -> DataFrame:
    spectra_in = model_inputs(spark, folder)
    scores = anomaly.score_anomaly(spectra_in, anomaly.fit_anomaly(spectra_in, GROUP), GROUP)
    paired = scores.join(spectra_in.select(*GROUP, "pixel_id", F.get("spectrum", F.lit(0)).alias("first_band")), [*GROUP, "pixel_id"])
    return spearman(paired, GROUP, "anomaly_score", "first_band").withColumn("rho", r(F.col("rho"), 6))


RISK_SQL = EVIDENCE.replace(PIXELS, f"""
{SPECTRA.strip()},
deviations AS (SELECT group_id, pixel_id, reflectance, avg(reflectance) OVER (PARTITION BY group_id, band_index) AS mean FROM spectra),
given AS (SELECT group_id, pixel_id, avg(abs(reflectance - mean)) AS anomaly_score FROM deviations GROUP BY ALL),
pixels AS (SELECT group_id AS scene_id, pixel_id, 0 AS nodata_mask, 0 AS cloud_mask, 0 AS cirrus_mask, max(reflectance + 6e-1) FILTER (band_index = 13) AS red,
  max(reflectance + 6e-1) FILTER (band_index = 15) AS red_edge, max(reflectance + 9e-1) FILTER (band_index = 23) AS nir,
  max(reflectance + 6e-1) FILTER (band_index = 62) AS swir FROM spectra GROUP BY ALL)""")
PAIRED_SQL = RISK_SQL + ", paired AS (SELECT e.scene_id, e.pixel_id, anomaly_score, risk_score, risk_class FROM evidence e JOIN given g ON g.group_id = e.scene_id AND g.pixel_id = e.pixel_id)"


def scores_and_evidence(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A given score (mean distance from the group's mean spectrum) of every pixel, and the risk evidence of the same pixels' four bands."""
    pixels_of = cube(spark, folder)
    means = spectra_ops.position_statistics(pixels_of, GROUP, "reflectance").groupBy(*GROUP).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "mean"))), lambda p: p["mean"]).alias("means"))
    known = spectra_ops.attach(pixels_of, means, GROUP, "means")
    apart = F.zip_with("reflectance", "means", lambda v, m: F.abs(v - m))
    scores = known.select(F.col("group_id").alias("scene_id"), "pixel_id", (F.aggregate(apart, F.lit(0.0), lambda a, v: a + v) / F.size(apart)).alias("anomaly_score"))
    band = lambda at, shift: F.get("reflectance", F.lit(at)) + shift
    rows = pixels_of.select(F.col("group_id").alias("scene_id"), "pixel_id", *[F.lit(0).alias(m) for m in MASKS], band(13, 0.6).alias("red"),
                            band(15, 0.6).alias("red_edge"), band(23, 0.9).alias("nir"), band(62, 0.6).alias("swir"))
    screened = screening.with_vegetation(screening.with_indices(screening.with_quality(rows, MASKS)))
    return scores, screening.risk_evidence(screened, ["scene_id"])


@query("anomaly_risk_correlation", f"""WITH {PAIRED_SQL},
r AS (SELECT scene_id, rank() OVER (PARTITION BY scene_id ORDER BY anomaly_score) + (count(*) OVER (PARTITION BY scene_id, anomaly_score) - 1) / 2e0 AS x,
  rank() OVER (PARTITION BY scene_id ORDER BY risk_score) + (count(*) OVER (PARTITION BY scene_id, risk_score) - 1) / 2e0 AS y FROM paired)
SELECT scene_id, count(*) AS population, round(CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END, 8) + 0e0 AS rho FROM r GROUP BY ALL""")
def anomaly_risk_correlation(spark: SparkSession, folder: str) -> DataFrame:
    rho, _ = anomaly.compare_with_risk(*scores_and_evidence(spark, folder), ["scene_id"])
    return rho.withColumn("rho", r(F.col("rho"), 8))


@query("anomaly_by_risk_class", f"""WITH {PAIRED_SQL},
centred AS (SELECT *, quantile_cont(anomaly_score, 0.5) OVER (PARTITION BY scene_id, risk_class) AS m FROM paired),
classes AS (SELECT scene_id, unnest([1, 2, 3, 4]) AS risk_class FROM (SELECT DISTINCT group_id AS scene_id FROM given)),
s AS (SELECT scene_id, risk_class, count(*) AS n, min(anomaly_score) AS low, max(anomaly_score) AS high, avg(anomaly_score) AS mean,
  quantile_cont(anomaly_score, 0.5) AS median, quantile_cont(abs(anomaly_score - m), 0.5) AS mad FROM centred GROUP BY ALL)
SELECT c.scene_id, c.risk_class::BIGINT AS risk_class, coalesce(n, 0) AS count, round(low, 9) AS min, round(high, 9) AS max, round(mean, 9) AS mean,
  round(median, 9) AS median, round(mad, 9) AS median_absolute_deviation FROM classes c LEFT JOIN s ON c.scene_id = s.scene_id AND c.risk_class = s.risk_class""")
def anomaly_by_risk_class(spark: SparkSession, folder: str) -> DataFrame:
    _, by_class = anomaly.compare_with_risk(*scores_and_evidence(spark, folder), ["scene_id"])
    return by_class.select("scene_id", big(F.col("risk_class")).alias("risk_class"), "count",
                           *[r(F.col(c)).alias(c) for c in ("min", "max", "mean", "median", "median_absolute_deviation")])
