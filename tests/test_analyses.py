"""The composed analyses run end to end and agree with their parts."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from fieldscan import constants as C
from fieldscan.plans import analyses, views
from fieldscan.plans.band_queries import scanned
from tests.helpers import approx_rows

FOLDER = "/root/testdata/sf0.001"


def test_screening_analysis(spark):
    pixels = views.pixels(spark, FOLDER)
    result = analyses.screen_scenes(pixels, views.MASKS, ["scene_id"])
    assert approx_rows(result["classes"].select("scene_id", "risk_class", "percentage")) == approx_rows(
        __spark_entry__.entry(spark).select("scene_id", "risk_class", "percentage"))
    counts = {r["scene_id"]: r for r in result["counts"].collect()}
    assert sum(r["total_pixels"] for r in counts.values()) == pixels.count()
    stats = result["statistics"].collect()
    assert len(stats) == 3 * 4 and all(r["count"] == counts[r["scene_id"]]["classified_pixels"] for r in stats)
    result["evidence"].unpersist()


def test_flat_scenes_get_no_ranking(spark):
    flat = views.pixels(spark, FOLDER).withColumns({b: F.lit(0.1 if b != "nir" else 0.9) for b in C.TARGET_BANDS_NM})
    result = analyses.screen_scenes(flat, views.MASKS, ["scene_id"])
    assert result["evidence"].count() == 0 and {r["rankable"] for r in result["rankable"].collect()} == {False}


def test_anomaly_analysis(spark):
    result = analyses.score_scenes(views.cube(spark, FOLDER, 1.0), views.spectra_bands(spark, FOLDER), ["scene_id"], trees=20)
    scores = result["scores"]
    assert scores.count() == result["spectra"].count() == 500
    assert scores.where("anomaly_score <= 0 OR anomaly_score >= 1").count() == 0
    components = result["components"].orderBy("component").collect()
    assert components[-1]["cumulative"] > 0.99 and (len(components) < 2 or components[-2]["cumulative"] <= 0.99)


@pytest.mark.parametrize("name", ["queries", "oracle_sql"])
def test_entry_points(name):
    found = getattr(__spark_entry__, name)()
    assert len(found) >= 100 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
