import math

import pytest
from pyspark.sql import functions as F

from fieldscan.functions import ranking, reflectance as R
from fieldscan.operators import screening


def test_class_edges(spark):
    scores = [0, 24.999, 25, 49.999, 50, 74.999, 75, 100, math.nan]
    rows = spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "i int, s double")
    got = [r["c"] for r in rows.select("i", ranking.risk_class(F.col("s")).alias("c")).orderBy("i").collect()]
    assert got == [1, 1, 2, 2, 3, 3, 4, 4, 0]


def test_score_outside_range_fails(spark):
    with pytest.raises(Exception, match="0..100"):
        spark.createDataFrame([(101.0,)], "s double").select(ranking.risk_class(F.col("s"))).collect()


def test_condition_edges(spark):
    rows = spark.createDataFrame([(24.999,), (25.0,), (74.999,), (75.0,), (None,)], "p double")
    assert [r[0] for r in rows.select(ranking.condition_code(F.col("p"))).collect()] == [1, 2, 2, 3, 0]


def test_normalized_difference_rules(spark):
    rows = spark.createDataFrame([(0.5, 0.1, True), (0.0, 0.0, True), (0.5, 0.1, False), (math.nan, 0.1, True), (math.inf, 0.1, True)],
                                 "a double, b double, ok boolean")
    got = [r[0] for r in rows.select(R.normalized_difference(F.col("a"), F.col("b"), F.col("ok"))).collect()]
    assert got[0] == pytest.approx(0.4 / 0.6) and got[1:] == [None] * 4


def pixels(spark):
    rows = [("s", i, 0, 0, 0, 0.65, 0.3, 0.2 + i / 100, 0.3 + i / 100) for i in range(8)]
    rows += [("s", 90, 1, 0, 0, 0.9, 0.1, 0.1, 0.1), ("s", 91, 0, 0, 0, 0.2, 0.2, 0.2, 0.2), ("s", 92, 0, 0, 0, 0.65, 0.35, None, 0.2)]
    return spark.createDataFrame(rows, "scene_id string, pixel_id int, m1 int, m2 int, m3 int, nir double, red double, red_edge double, swir double")


def test_boundary_threshold_and_missing_index(spark):
    screened = screening.with_vegetation(screening.with_indices(screening.with_quality(pixels(spark), ["m1", "m2", "m3"])))
    by_id = {r["pixel_id"]: r for r in screened.collect()}
    assert by_id[90]["quality_valid"] is False and by_id[90]["ndvi"] is None
    assert by_id[92]["vegetation"] and not by_id[92]["classified"]  # 0.3 exactly stays in; NDRE missing
    assert not by_id[91]["vegetation"]
    counts = screening.screening_counts(screened, ["scene_id"]).first()
    assert (counts["total_pixels"], counts["valid_pixels"], counts["vegetation_pixels"], counts["missing_evidence_pixels"]) == (11, 10, 9, 1)


def test_threshold_is_checked(spark):
    with pytest.raises(ValueError):
        screening.with_vegetation(pixels(spark), 1.0)


def test_all_classes_listed_and_ranks_average_fifty(spark):
    screened = screening.with_vegetation(screening.with_indices(screening.with_quality(pixels(spark), ["m1", "m2", "m3"])))
    evidence = screening.risk_evidence(screened, ["scene_id"])
    shares = screening.class_shares(evidence, ["scene_id"]).collect()
    assert [r["class_name"] for r in sorted(shares, key=lambda r: r["risk_class"])] == ["Low", "Moderate", "High", "Very High"]
    assert sum(r["pixels"] for r in shares) == 8 and sum(r["percentage"] for r in shares) == pytest.approx(100)
    assert evidence.agg(F.avg("ndmi_percentile")).first()[0] == pytest.approx(50)


def test_tie_groups(spark):
    scores = [5, 5, 5, 50, 50, 95, 95, 95]
    rows = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(scores)] + [("flat", 100 + i, 50.0) for i in range(8)],
                                 "scene_id string, pixel_id int, risk_score double")
    got = {r["scene_id"]: r for r in screening.group_problems(screening.risk_groups(rows, ["scene_id"]), ["scene_id"]).collect()}
    assert (got["s"]["lower_pixels"], got["s"]["higher_pixels"], got["s"]["usable"]) == (3, 3, True)
    assert got["flat"]["usable"] is False


def test_flat_scene_is_not_rankable(spark):
    rows = spark.createDataFrame([("s", True, 0.5), ("s", True, 0.5)], "scene_id string, classified boolean, ndmi double")
    assert screening.rankable(rows, ["scene_id"]).first()["rankable"] is False
