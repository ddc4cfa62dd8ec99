import datetime as dt
import itertools
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldscan import constants as C
from fieldscan.operators import decision, temporal
from fieldscan.plans import analyses, registry
from tests.helpers import normalized

KEYS = ["site"]
registry.load()


def series(spark, rows):
    return spark.createDataFrame([(s, dt.date(2025, m, d), float(v)) for s, m, d, v in rows], "site string, day date, v double")


def test_trend_vectors(spark):
    days = (1, 3, 11, 21)
    rows = [(name, 4, d, v) for name, values in (("up", (.1, .12, .2, .3)), ("down", (.7, .68, .6, .5)), ("flat", (.4,) * 4))
            for d, v in zip(days, values)]
    rows += [("outlier", 4, d, v) for d, v in zip((1, 2, 4, 7, 11, 16, 22), (.1, .11, .13, .99, .2, .25, .31))]
    rows += [("single", 4, 1, .5), ("pair", 4, 1, .5), ("pair", 4, 2, .9)]
    got = {r["site"]: r for r in temporal.theil_sen(series(spark, rows).repartition(9), KEYS, "day", "v").collect()}
    assert [round(got[k]["slope_per_day"], 12) for k in ("up", "down", "flat", "outlier")] == [.01, -.01, 0, .01]
    assert [got[k]["direction"] for k in ("up", "down", "flat", "outlier")] == ["increasing", "decreasing", "broadly stable", "increasing"]
    assert got["single"]["slope_per_day"] is None and got["pair"]["direction"] == "insufficient observations"


@pytest.mark.parametrize("name", ["tile_trends", "theil_sen_trend"])
def test_trends_at_the_limits_equal_sql(spark, tmp_path, name):
    """Changes of nearly the tolerance from a day's median of two values, and slopes with a tie at the last digit shown."""
    near = [(5.5, 19.48, 14.49), (5.13, 21.73, 15.43), (13.33, 64.27, 40.8), (2.07, 107.84, 56.955)]
    rows = [(i, 1 + day, v) for i, (low, high, end) in enumerate(near) for day, v in ((0, low), (0, high), (1, end - 1), (2, end))]
    slopes = np.random.default_rng(2).integers(1, 10**10, 150) * 2 + 1
    rows += [(10 + i, 1 + day, s / 2e10 * day) for i, s in enumerate(slopes.tolist()) for day in range(3)]
    events = spark.createDataFrame([(k, dt.datetime(2024, 1, day, 12), i, f"site{i}", v, "") for k, (i, day, v) in enumerate(rows)],
                                   "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got, wanted = registry.QUERIES[name](spark, str(tmp_path)).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert normalized(got) == normalized(wanted)


def test_bad_series_fail(spark):
    with pytest.raises(Exception, match="repeated day"):
        temporal.theil_sen(series(spark, [("s", 4, 1, 1), ("s", 4, 1, 2)]), KEYS, "day", "v").collect()
    with pytest.raises(Exception, match="nonfinite"):
        temporal.theil_sen(series(spark, [("s", 4, 1, math.nan)]), KEYS, "day", "v").collect()
    bad = temporal.series_problems(series(spark, [("s", 4, 1, 1), ("s", 4, 1, math.inf)]), KEYS, "day", "v").first()
    assert len(bad["problems"]) == 2


def test_median_slope_without_the_pair_matrix(monkeypatch):
    rng = np.random.default_rng(1)
    for n, values in ((60, rng.normal(size=60)), (61, np.round(rng.normal(size=61), 1)), (40, np.zeros(40))):
        days = np.sort(rng.choice(500, n, replace=False)).astype(float)
        direct = temporal.median_slope(days, values)
        monkeypatch.setattr(temporal, "DIRECT_PAIRS", 10)
        narrowed = temporal.median_slope(days, values)
        monkeypatch.undo()
        assert narrowed == pytest.approx(direct, abs=1e-15)


def at(text):
    return dt.datetime.fromisoformat(text)


@pytest.mark.parametrize("parts, width", [(1, 86_400), (17, 86_400), (3, 3_600), (3, 10_000_000)])
def test_nearest_equals_brute_force(spark, parts, width):
    rng = np.random.default_rng(2)
    start = at("2025-01-01T00:00:00")
    sources = [(s, int(i), start + dt.timedelta(seconds=int(x) * 600)) for s in ("a", "b") for i, x in enumerate(rng.integers(0, 3000, 60))]
    targets = [(s, f"t{i}", start + dt.timedelta(seconds=int(x) * 300)) for s in ("a", "b", "none") for i, x in enumerate(rng.integers(-500, 7000, 50))]
    got = temporal.nearest_acquisition(
        spark.createDataFrame(targets, "site string, target_id string, target_at timestamp").repartition(parts),
        spark.createDataFrame(sources, "site string, scene_id bigint, acquired_at timestamp").repartition(parts), KEYS, width).collect()
    found = {(r["site"], r["target_id"]): (r["acquired_at"], r["scene_id"]) for r in got}
    assert len(found) == 100
    for site, target, when in targets:
        options = [(abs((t - when).total_seconds()), t, i) for s, i, t in sources if s == site]
        if options:
            _, t, i = min(options)
            assert found[site, target] == (t, i)


def observed(spark, rows):
    frame = spark.createDataFrame([("s", d, float(v), first, last) for d, v, first, last in rows],
                                  "site string, day string, v double, first_at timestamp, last_at timestamp")
    return frame.withColumn("day", F.col("day").cast("date"))


def test_baseline_window_edges(spark):
    target = at("2025-06-10T08:00:00")
    rows = [("2025-04-11", 1, at("2025-04-11T08:00:00"), at("2025-04-11T09:00:00")),   # exactly at the start: in
            ("2025-04-10", 9, at("2025-04-10T07:00:00"), at("2025-04-10T09:00:00")),   # before the start: out
            ("2025-05-01", 2, at("2025-05-01T08:00:00"), at("2025-05-01T08:00:00")),
            ("2025-05-02", 2, at("2025-05-02T08:00:00"), at("2025-05-02T08:00:00")),
            ("2025-05-03", 2, at("2025-05-03T08:00:00"), at("2025-05-03T08:00:00")),
            ("2025-05-04", 4, at("2025-05-04T08:00:00"), at("2025-05-04T08:00:00")),
            ("2025-06-10", 9, at("2025-06-10T07:00:00"), at("2025-06-10T08:00:00")),   # ends at the target: out
            ("2025-06-11", 2, at("2025-06-11T08:00:00"), at("2025-06-11T08:00:00"))]
    targets = spark.createDataFrame([("s", "t", target, "2025-06-11", 1.0), ("s", "far", target, "2025-06-11", 7.5)],
                                    "site string, target_id string, target_at timestamp, compared_day string, absolute_gap_days double") \
        .withColumn("compared_day", F.col("compared_day").cast("date"))
    got = {r["target_id"]: r for r in temporal.baseline(targets, observed(spark, rows), KEYS, "v").collect()}
    assert got["t"]["baseline_dates"] == 5 and got["t"]["available"]
    assert (got["t"]["baseline_median"], got["t"]["baseline_mad"], got["t"]["mad_distance"]) == (2.0, 0.0, None)
    assert got["t"]["percentile"] == pytest.approx(100 * (1 + 1.5) / 5)
    assert not got["far"]["available"] and got["far"]["baseline_median"] is None and got["far"]["baseline_reason"]


def test_cutoff_edges(spark):
    cutoff = F.lit("2025-06-09 08:35:59.024").cast("timestamp")
    rows = [("2025-06-07", 1, at("2025-06-07T08:00:00"), at("2025-06-07T08:00:00")),
            ("2025-06-09", 1, at("2025-06-09T08:00:00"), at("2025-06-09T08:35:59.024000")),   # exactly: in
            ("2025-06-08", 1, at("2025-06-08T08:00:00"), at("2025-06-09T08:35:59.024001"))]   # one later source: whole day out
    audit = temporal.cutoff_audit(temporal.at_cutoff(observed(spark, rows), cutoff), KEYS).first()
    assert (audit["used"], audit["strictly_before"], audit["excluded"]) == (2, 1, 1)
    assert audit["excluded_days"] == [dt.date(2025, 6, 8)]


def test_temporal_state_edges(spark):
    cases = [(0, "decreasing"), (24.999, "decreasing"), (25, "decreasing"), (50, "increasing"), (75, "increasing"), (75.001, "increasing"), (100, "increasing")]
    rows = spark.createDataFrame([(i, float(p), t, True) for i, (p, t) in enumerate(cases)] + [(7, None, "increasing", False)],
                                 "i int, p double, t string, ok boolean")
    got = [r[0] for r in rows.orderBy("i").select(decision.temporal_state(F.col("p"), F.col("t"), F.col("ok"))).collect()]
    assert got == ["DECLINE_SUPPORT"] * 2 + ["NEUTRAL_OR_MIXED"] * 3 + ["RECOVERY_OR_WETTER"] * 2 + ["INSUFFICIENT"]
    for p, t, error in ((101.0, "increasing", "percentile"), (50.0, "sideways", "direction")):
        with pytest.raises(Exception, match=error):
            spark.createDataFrame([(p, t, True)], "p double, t string, ok boolean") \
                .select(decision.temporal_state(F.col("p"), F.col("t"), F.col("ok"))).collect()


def test_every_state_triple_is_decided(spark):
    triples = list(itertools.product(C.SPECTRAL_STATES, C.TEMPORAL_STATES, C.GROUND_STATES))
    frame = spark.createDataFrame(triples, "spectral_state string, temporal_state string, ground_state string")
    got = decision.decide(frame, decision.rule_table(spark)).collect()
    assert len(got) == 48 and {r["rule_id"] for r in got} == {f"D0{i}" for i in range(1, 9)}
    assert not any(r["automation_allowed"] for r in got)
    one = {(r["spectral_state"], r["temporal_state"], r["ground_state"]): r["rule_id"] for r in got}
    assert one["RELATIVE_HOTSPOTS_PRESENT", "DECLINE_SUPPORT", "VERIFIED_LOW"] == "D02"
    assert one["RELATIVE_HOTSPOTS_PRESENT", "NEUTRAL_OR_MIXED", "UNAVAILABLE"] == "D06"
    assert one["NO_MEASURABLE_CONTRAST", "RECOVERY_OR_WETTER", "UNAVAILABLE"] == "D08"


def test_unknown_state_fails(spark):
    frame = spark.createDataFrame([("X", "INSUFFICIENT", "UNAVAILABLE")], "spectral_state string, temporal_state string, ground_state string")
    with pytest.raises(Exception, match="unknown evidence state"):
        decision.decide(frame, decision.rule_table(spark)).collect()


def decided(spark, later_value):
    """A site with ten early days, and one day after the cutoff whose value varies."""
    rows = [(f"2025-05-{d:02d}", 0.5 - d / 100, at(f"2025-05-{d:02d}T08:00:00"), at(f"2025-05-{d:02d}T08:00:00")) for d in range(1, 11)]
    rows.append(("2025-05-20", later_value, at("2025-05-20T08:00:00"), at("2025-05-20T08:00:00")))
    days = observed(spark, rows)
    sources = days.select("site", "day", F.lit(1).alias("scene_id"), F.col("first_at").alias("acquired_at"), F.lit(5).alias("contributing"))
    blind = sources.where("day = '2025-05-09'").withColumns({"acquired_at": F.lit("2025-05-10 11:59:00").cast("timestamp"), "contributing": F.lit(0)})
    sources = sources.union(blind)  # nearer, but it gave no pixel
    targets = spark.createDataFrame([("s", "t", at("2025-05-10T12:00:00"))], "site string, target_id string, target_at timestamp")
    cutoff = F.lit("2025-05-11 00:00:00").cast("timestamp")
    temporal_rows = analyses.temporal_evidence(days, sources, targets, KEYS, "v", cutoff)
    spectral = spark.createDataFrame([("s", 12, "RELATIVE_HOTSPOTS_PRESENT")], "site string, classified_pixels bigint, spectral_state string")
    return analyses.fuse(spectral, temporal_rows, decision.rule_table(spark), KEYS).first()


def test_future_rows_cannot_change_the_decision(spark):
    calm, wild = decided(spark, 0.1), decided(spark, 99.0)
    assert calm.asDict(True) == wild.asDict(True)
    assert calm["temporal_state"] == "DECLINE_SUPPORT" and calm["rule_id"] == "D06" and calm["observations"] == 10
    assert [e["rule_id"] for e in calm["trace"]] == [
        "SPECTRAL_RELATIVE_HOTSPOTS_PRESENT", "TEMPORAL_BASELINE_RELATIVELY_LOW", "TEMPORAL_TREND", "TEMPORAL_DECLINE_SUPPORT",
        "GROUND_UNAVAILABLE", "D06", "AUTOMATION_DISABLED"]
    assert "percentile 0.00 of 9 prior daily medians" in calm["trace"][1]["explanation"]


def test_baseline_equals_a_loop_over_all_days(spark):
    """Several targets a day, two measures, days whose acquisitions lie on either side of the window's ends."""
    rng = np.random.default_rng(8)
    start = dt.datetime(2024, 3, 1)
    days, targets = [], []
    for site in ("p", "q"):
        for measure in ("m", "n"):
            for d in range(0, 40, 1 if site == "p" else 3):
                first = start + dt.timedelta(days=d, hours=int(rng.integers(0, 12)))
                days.append((site, measure, first.date(), first, first + dt.timedelta(hours=int(rng.integers(0, 12))), float(rng.integers(0, 9))))
        known = sorted({d[2] for d in days if d[0] == site})
        for t in range(60):
            at = start + dt.timedelta(days=int(rng.integers(0, 45)), hours=int(rng.integers(0, 24)))
            targets.append((site, f"{site}{t}", at, known[int(rng.integers(0, len(known)))], 1.0))
    frame = spark.createDataFrame(days, "site string, measure string, day date, first_at timestamp, last_at timestamp, v double")
    wanted = spark.createDataFrame(targets, "site string, target_id string, target_at timestamp, compared_day date, absolute_gap_days double")
    found = temporal.baseline(wanted, frame, ["site"], "v", lookback_days=10, measure=["measure"])
    assert "sequence(" not in found._jdf.queryExecution().toString()
    got = {(r.target_id, r.measure): (r.baseline_dates, r.baseline_median, r.percentile) for r in found.collect()}
    assert len(got) == 2 * len(targets)
    for site, target, at, compared, _ in targets:
        for measure in ("m", "n"):
            own = [d for d in days if d[:2] == (site, measure)]
            base = [d[5] for d in own if d[3] >= at - dt.timedelta(days=10) and d[4] < at and d[2] != compared]
            value = next(d[5] for d in own if d[2] == compared)
            share = 100 * (sum(b < value for b in base) + 0.5 * sum(b == value for b in base)) / len(base) if len(base) >= 5 else None
            assert got[(target, measure)] == (len(base), float(np.median(base)) if len(base) >= 5 else None, share)
