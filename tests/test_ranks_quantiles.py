"""Ranks and quantiles: vectors, brute force, partition invariance, large-population paths."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldscan.operators import lookup, quantiles, ranks

VALUES = [float(v) for v in np.random.default_rng(5).integers(0, 40, 400)] + [7.0] * 200


def frame(spark, parts):
    rows = [("a", i, v) for i, v in enumerate(VALUES)] + [("b", 1000 + i, v * 2) for i, v in enumerate(VALUES[:50])] \
        + [("c", 2000, None), (None, 3000, 5.0), (None, 3001, 6.0)]
    return spark.createDataFrame(rows, "g string, id int, v double").repartition(parts)


def brute_midranks(values):
    values = np.asarray(values)
    return [100 * ((values < v).sum() + 0.5 * (values == v).sum()) / len(values) for v in values]


@pytest.fixture(params=["small", "large"])
def path(request, monkeypatch):
    """Run each test on the one-window path and on the range-partitioned, salted path."""
    if request.param == "large":
        monkeypatch.setattr(ranks, "WINDOW_VALUES", 0)
        monkeypatch.setattr(quantiles, "WINDOW_ROWS", 0)
        monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(lookup, "HOT_SHARE", 10)
    return request.param


@pytest.mark.parametrize("parts", [1, 17])
def test_midranks_equal_brute_force(spark, path, parts):
    rows = ranks.midranks(frame(spark, parts), ["g"], ["v"]).collect()
    got = {r["id"]: r["v_percentile"] for r in rows}
    assert len(rows) == 653
    for i, expected in enumerate(brute_midranks(VALUES)):
        assert got[i] == pytest.approx(expected, abs=1e-12)
    assert got[2000] is None and (got[3000], got[3001]) == (25.0, 75.0)
    assert np.mean([got[i] for i in range(len(VALUES))]) == pytest.approx(50)


@pytest.mark.parametrize("parts", [1, 17])
def test_quantiles_equal_numpy(spark, path, parts):
    levels = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    rows = {r["g"]: r for r in quantiles.exact_quantiles(frame(spark, parts), ["g"], "v", levels).collect()}
    for name, level in levels.items():
        assert rows["a"][name] == pytest.approx(np.percentile(VALUES, level * 100), abs=1e-12)
    assert rows["c"]["total"] == 0 and rows["c"]["p50"] is None
    assert rows[None]["p50"] == 5.5


def test_sketch_brackets_are_exact(spark, path):
    """A coarse sketch forces brackets narrower than the population."""
    values = np.random.default_rng(9).normal(size=5000)
    rows = spark.createDataFrame([("x", float(v)) for v in values], "g string, v double").repartition(5)
    got = quantiles.exact_quantiles(rows, ["g"], "v", {"a": 0.05, "b": 0.5, "c": 0.95}, accuracy=200).first()
    for name, level in (("a", 5), ("b", 50), ("c", 95)):
        assert got[name] == pytest.approx(np.percentile(values, level), abs=1e-12)


def test_band_quantile_vector(spark):
    from fieldscan.functions.reflectance import valid_reflectance
    cells = [math.nan, math.inf, -math.inf, -0.1, 999.0, 0.0, 0.2, 0.4, 1.2]
    rows = spark.createDataFrame([("g", v) for v in cells] + [("e", v) for v in (math.nan, -1.0, math.inf)], "g string, v double") \
        .withColumn("c", valid_reflectance(F.col("v"), None, F.lit(999.0)))
    got = {r["g"]: r for r in quantiles.exact_quantiles(rows, ["g"], "c", {"p25": .25, "p50": .5, "p75": .75}, also={
        "bad": F.count_if(F.col("c").isNull()), "above": F.count_if(F.col("c") > 1)}).collect()}
    assert (got["g"]["total"], got["g"]["bad"], got["g"]["above"]) == (4, 5, 1)
    assert [round(got["g"][k], 12) for k in ("p25", "p50", "p75")] == [0.15, 0.3, 0.6]
    assert got["e"]["total"] == 0 and got["e"]["p50"] is None


def test_robust_statistics_equal_numpy(spark):
    got = quantiles.robust_statistics(frame(spark, 3), ["g"], ["v"]).where("g = 'a'").first()
    v = np.asarray(VALUES)
    assert got["median"] == np.median(v) and got["standard_deviation"] == pytest.approx(v.std())
    assert got["median_absolute_deviation"] == np.median(np.abs(v - np.median(v)))
    assert got["interquartile_range"] == pytest.approx(np.percentile(v, 75) - np.percentile(v, 25))


def test_spearman_and_constant_side(spark, path):
    rows = spark.createDataFrame([("a", float(i), float((i * 7) % 10)) for i in range(10)] + [("k", float(i), 3.0) for i in range(5)],
                                 "g string, x double, y double")
    got = {r["g"]: r["rho"] for r in ranks.spearman(rows, ["g"], "x", "y").collect()}
    x, y = np.arange(10), (np.arange(10) * 7) % 10
    assert got["a"] == pytest.approx(np.corrcoef(x, y)[0, 1]) and got["k"] is None


def test_lookup_join_keeps_every_row(spark, path):
    rows = frame(spark, 5)
    table = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).withColumn("tag", F.concat(F.lit("t"), "g"))
    joined = lookup.lookup_join(rows, table, ["g"], "n", table.count(), rows.count())
    assert joined.count() == rows.count()
    assert joined.where("g = 'a' AND tag = 'ta'").count() == 600
