import itertools

import pytest
from pyspark.sql import functions as F

from fieldscan import constants as C
from fieldscan.functions import checks, text as T, timestamps as TS
from fieldscan.operators import audit, contract
from fieldscan import schemas


def test_levels_over_all_masks(spark):
    """All 2**7 availability masks, level by precedence."""
    rows = [tuple("AVAILABLE" if bit else "UNAVAILABLE" for bit in bits) for bits in itertools.product((0, 1), repeat=7)]
    frame = spark.createDataFrame(rows, ", ".join(f"{s} string" for s in C.EVIDENCE_SOURCES))
    got = frame.withColumn("level", contract.analysis_level({s: F.col(s) for s in C.EVIDENCE_SOURCES})).collect()
    for row in got:
        have = {s for s in C.EVIDENCE_SOURCES if row[s] == "AVAILABLE"}
        expected = (None if "sentinel" not in have else "SITE_MONITORED" if "iot" in have else "GROUND_INFORMED" if "ground" in have
                    else "EO_ENHANCED" if have & {"temporal", "hyperspectral", "weather", "ml"} else "PRELIMINARY_EO")
        assert row["level"] == expected
    assert len(got) == 128


def test_result_scenarios(spark):
    """Every use case, mode, decision and mask: 3 x 2 x 3 x 128 rows, one error only where the foundation is missing."""
    masks = spark.range(128).select(*[F.when(F.shiftright("id", i).bitwiseAND(1) == 1, "AVAILABLE").otherwise("UNAVAILABLE").alias(s)
                                      for i, s in enumerate(C.EVIDENCE_SOURCES)])
    frame = masks.withColumn("use_case", F.explode(F.array(*[F.lit(u) for u in C.USE_CASE_PURPOSE]))) \
        .withColumn("presentation_mode", F.explode(F.array(*[F.lit(m) for m in C.PRESENTATION_MODES]))) \
        .withColumn("decision_state", F.explode(F.array(*[F.lit(d) for d in ("MONITOR", "REVIEW_RECOMMENDED", "INSUFFICIENT_DATA")]))) \
        .withColumns({"next_action": F.lit("x"), "ground_records": F.when(F.col("ground") == "AVAILABLE", 1).otherwise(0),
                      "sensor_records": F.when(F.col("iot") == "AVAILABLE", 1).otherwise(0)}) \
        .withColumn("usable_sensor_records", F.col("sensor_records"))
    checked = frame.withColumn("errors", contract.result_errors())
    assert checked.count() == 2304
    assert checked.where("size(errors) > 0").count() == 3 * 2 * 2 * 64
    assert checked.where("size(errors) > 0 AND sentinel = 'AVAILABLE'").count() == 0


def sensor(spark, **changes):
    row = dict(sensor_id="s", lon=32.0, lat=37.0, timestamp="2025-06-09T08:00:00Z", soil_moisture=0.2, air_temperature=20.0, relative_humidity=40.0,
               soil_temperature=None, ec=None, ph=None, leaf_wetness=None, state="CALIBRATED", quality_valid=True, cal_state="CALIBRATED",
               cal_reference="lab", cal_site_reference="site", calibrated_at="2025-01-01T00:00:00Z", valid_until="2025-12-31T00:00:00Z")
    row.update(changes)
    return spark.createDataFrame([row], schemas.SENSORS)


def test_sensor_freshness(spark):
    as_of = F.lit("2025-06-09 08:35:59.024").cast("timestamp")
    ok = lambda seconds, **c: sensor(spark, **c).select(contract.usable_at(as_of, seconds)).first()[0]
    assert ok(3600) and not ok(60) and not ok(3600, state="CONNECTED") and not ok(3600, quality_valid=False)
    assert not ok(3600, timestamp="2025-06-09T08:36:00Z") and not ok(3600, valid_until="2025-06-09T08:00:00Z")


@pytest.mark.parametrize("change, text", [
    ({"soil_moisture": 1.01}, "soil_moisture"), ({"air_temperature": float("inf")}, "air_temperature"), ({"ph": 15.0}, "ph"), ({"lon": 181.0}, "location"),
    ({"timestamp": "2025-06-09T08:00:00"}, "timestamp"), ({"cal_site_reference": " "}, "both references"), ({"valid_until": None}, "interval"),
    ({"calibrated_at": "2026-01-01T00:00:00Z"}, "reversed"), ({"cal_state": "UNCALIBRATED"}, "without calibrated"), ({"state": "UNCALIBRATED"}, "with calibrated"), ({"state": "BROKEN"}, "state")])
def test_sensor_defects(spark, change, text):
    found = sensor(spark, **change).select(contract.sensor_errors()).first()[0]
    assert any(text in e for e in found)
    assert sensor(spark).select(contract.sensor_errors()).first()[0] == []


def test_ground_observation_defects(spark):
    base = dict(observation_id="o", lon=1.0, lat=1.0, timestamp="2025-06-08T10:00:00Z", crop_type="wheat", observer_type="FARMER", plant_condition="NORMAL",
                soil_condition="DRY", recent_irrigation="YES", verification_state="SELF_REPORTED", recent_irrigation_timestamp="2025-06-08T10:00:00+00:00",
                symptoms=None, notes=None, photo_reference=None, verification_reference=None)
    cases = [({}, 0), ({"crop_type": " "}, 1), ({"recent_irrigation": "NO"}, 1), ({"recent_irrigation_timestamp": "2025-06-08T10:00:00.000001Z"}, 1),
             ({"verification_state": "EXPERT_VERIFIED"}, 1), ({"notes": ""}, 1), ({"plant_condition": None}, 1), ({"timestamp": None}, 1)]
    frame = spark.createDataFrame([{**base, **c} for c, _ in cases], schemas.GROUND)
    got = [len(r[0]) for r in frame.select(contract.ground_errors()).collect()]
    assert got == [n for _, n in cases]
    late = frame.limit(1).select(contract.ground_errors(F.lit("2025-06-08 09:00:00").cast("timestamp"))).first()[0]
    assert late == ["observation lies in the future"]
    valid, held = contract.split_by_errors(frame, contract.ground_errors())
    assert (valid.count(), held.count()) == (1, 7)


def test_required_limitations_keep_first_occurrence(spark):
    texts = spark.range(1).select(contract.required_limitations(
        F.array(F.lit("own"), F.lit(C.PRODUCT_LIMITATIONS[1])), F.lit(True), F.lit(False), F.lit(True))).first()[0]
    assert texts == [*C.PRODUCT_LIMITATIONS, C.GROUND_LIMITATION, C.ML_LIMITATION, "own"]


def test_zone_is_mandatory(spark):
    texts = ["2025-06-08T10:00:00Z", "2025-06-08T12:00:00+02:00", "2025-06-08T10:00:00", "2025-06-08Z", "nonsenseTZ", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
           .select(TS.iso_utc(TS.zoned_timestamp(F.col("t")))).collect()]
    assert got == ["2025-06-08T10:00:00.000000Z"] * 2 + [None] * 4
    dates = ["2025-02-28T10:00", "2025-02-31T10:00", "2025-02-28T10:00:59", "2025-02-28 10:00", "2025-02-28T10:00Z"]
    got = [r[0] is not None for r in spark.createDataFrame([(i, t) for i, t in enumerate(dates)], "i int, t string").orderBy("i")
           .select(TS.calendar_utc(F.col("t"))).collect()]
    assert got == [True, False, True, False, False]


def test_identifiers_and_text(spark):
    at = F.lit("2025-06-08 08:26:11").cast("timestamp")
    one = spark.range(1)
    ok = lambda scene, platform: one.select(T.product_id_ok(F.lit(scene), F.lit(platform), at)).first()[0]
    assert ok("S2B_MSIL2A_20250608T082611_N0511", "Sentinel-2B")
    assert not ok("S2B_MSIL2A_20250608T082612_N0511", "Sentinel-2B") and not ok("S2B_MSIL2A_20250608T082611_N0511", "Sentinel-2A")
    scrubbed = one.select(T.scrub_credentials(F.lit("x https://a.b/c?sig=1&t=2 y 'http://d/e?f' z"))).first()[0]
    assert scrubbed == "x https://a.b/c?[credentials omitted] y 'http://d/e?[credentials omitted]' z"
    same = one.select(T.canonical_json_hash(F.lit('{"b": 1, "a": "x"}')) == T.canonical_json_hash(F.lit('{"a":"x","b":1}'))).first()[0]
    assert same


def test_reconciliation_statuses_and_tolerance(spark):
    saved = spark.createDataFrame([("a", 1.0), ("b", 1.0 + 5e-10), ("c", 2.0), ("d", None), ("x", 1.0)], "k string, v double")
    expected = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0), ("d", None), ("m", 1.0)], "k string, v double")
    got = {r["k"]: r["status"] for r in audit.reconcile(saved, expected, ["k"], ["v"]).collect()}
    assert got == {"a": "equal", "b": "equal", "c": "differs", "d": "equal", "x": "extra", "m": "missing"}


def evidence(spark):
    from fieldscan.operators import screening
    rows = [("s", i, 0, 0.9, 0.2 + i / 100, 0.3 + i / 90, 0.3 + ((i * 7) % 20) / 80) for i in range(20)] + [("s", 20, 1, 0.9, 0.1, 0.1, 0.1)]
    pixels = spark.createDataFrame(rows, "scene_id string, pixel_id int, m int, nir double, red double, red_edge double, swir double")
    screened = screening.with_vegetation(screening.with_indices(screening.with_quality(pixels, ["m"])))
    found = screening.risk_evidence(screened, ["scene_id"])
    wanted = [*C.INDEX_NAMES, *[f"{n}_percentile" for n in C.INDEX_NAMES], "ndmi_deficit", "support_factor", "risk_score", "risk_class", "ndvi_condition", "ndre_condition"]
    return screening.on_full_grid(screened.select("scene_id", "pixel_id", "quality_valid", "vegetation", "classified"),
                                  found.select("scene_id", "pixel_id", *wanted), ["scene_id", "pixel_id"], ["risk_class", "ndvi_condition", "ndre_condition"])


@pytest.mark.parametrize("column, value, check", [
    ("ndvi_percentile", 1.0, "ndvi ranks"), ("ndmi_deficit", 1.0, "moisture deficit"), ("support_factor", 0.5, "support factor"),
    ("risk_class", 9, "risk class"), ("ndre_condition", 0, "ndre condition"), ("vegetation", False, "masks nested"),
    ("risk_score", None, "layers present only when classified")])
def test_seeded_defect_is_reported(spark, column, value, check):
    good = evidence(spark)
    assert {r["n_bad"] for r in audit.evidence_audit(good, ["scene_id"]).collect()} == {0}
    bad = good.withColumn(column, F.when(F.col("pixel_id") == 5, F.lit(value).cast(good.schema[column].dataType)).otherwise(F.col(column)))
    found = {r["check"]: r["n_bad"] for r in audit.evidence_audit(bad, ["scene_id"]).collect()}
    assert found[check] == 1
    with pytest.raises(ValueError, match=check):
        audit.raise_if_bad(audit.evidence_audit(bad, ["scene_id"]))


def test_several_saved_tables_reconcile_in_one_pass(spark):
    two = lambda rows: spark.createDataFrame(rows, "site string, v double, label string")
    saved = {"a": two([("x", 1.0, "p"), ("y", 2.0, "p"), ("z", None, None)]), "b": spark.createDataFrame([("x", True, 5)], "site string, ok boolean, n int")}
    expected = {"a": two([("x", 1.0 + 1e-12, "p"), ("y", 2.1, "q"), ("w", 0.0, "p"), ("z", None, None)]),
                "b": spark.createDataFrame([("x", False, 5)], "site string, ok boolean, n int")}
    got = {(r["part"], r["site"]): (r["status"], r["differing"]) for r in
           audit.reconcile_parts(saved, expected, ["site"], {"a": ["v", "label"], "b": ["ok", "n"]}).collect()}
    assert got == {("a", "x"): ("equal", []), ("a", "y"): ("differs", ["v", "label"]), ("a", "w"): ("missing", []), ("a", "z"): ("equal", []),
                   ("b", "x"): ("differs", ["ok"])}


def test_scrubbing_keeps_everything_but_queries(spark):
    texts = {"a http://b?c=1 d\nhttps://e/f?g": "a http://b?[credentials omitted] d\nhttps://e/f?[credentials omitted]", "why? no address": "why? no address",
             "http://x?": "http://x?", '"https://q?k=\'v"': '"https://q?[credentials omitted]"', "": "", "(http://a?b)": "(http://a?[credentials omitted]"}
    rows = spark.createDataFrame([(k, v) for k, v in texts.items()], "t string, want string")
    assert all(r[0] == r[1] for r in rows.select(T.scrub_credentials(F.col("t")), "want").collect())
    assert spark.range(1).select(T.scrub_credentials(F.lit(None).cast("string"))).first()[0] is None
