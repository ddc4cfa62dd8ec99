import json

import pytest
from pyspark.sql import functions as F

from fieldscan import schemas
from fieldscan.operators import audit, mosaic
from fieldscan.operators.contract import usable_at
from fieldscan.sources import calibration, catalog, export, manifest, tables
from fieldscan.streaming import sensors
from tests.test_mosaic_spatial import KEYS, scene_rows


def item(scene, key="ortho_sr_hdf5", **properties):
    bands = [{"name": "mask"}, {"name": "b1", "eo:center_wavelength": 0.665, "nodata": -9999.0}, {"name": "b2", "eo:center_wavelength": 0.86, "nodata": "none"}]
    assets = {key: {"href": f"{scene}.h5", "bands": bands}}
    for band, nm in (("B04", 0.665), ("B05", 0.704), ("B8A", 0.865), ("B11", 1.71)):
        assets[band] = {"href": band, "gsd": 20.0, "eo:bands": [{"name": band, "center_wavelength": nm, "full_width_half_max": 0.03}]}
    return {"id": scene, "bbox": [32.0, 37.0, 33.0, 38.0], "assets": assets,
            "properties": {"datetime": "2025-06-08T09:16:05Z", "platform": "Sentinel-2B", "eo:cloud_cover": 3.5, "s2:mgrs_tile": "36SVH", **properties}}


def test_items_search_and_bands(spark, tmp_path):
    for name, doc in (("a", item("a")), ("b", item("b", "basic_sr_hdf5", **{"eo:cloud_cover": 30.0})), ("c", item("c", **{"datetime": "2025-08-01T00:00:00Z"}))):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    items = catalog.read_items(spark, str(tmp_path))
    assets = {r["scene_id"]: r["asset_key"] for r in catalog.surface_reflectance(items).collect()}
    assert assets == {"a": "ortho_sr_hdf5", "b": "basic_sr_hdf5", "c": "ortho_sr_hdf5"}
    from fieldscan.operators.bands import band_table
    rows = band_table(catalog.surface_reflectance(items)).where("scene_id = 'a'").orderBy("band_index").collect()
    assert [(r["band_index"], r["wavelength_nm"], r["nodata"]) for r in rows] == [(0, 665.0, -9999.0), (1, 860.0, None)]
    scenes = catalog.scenes_of(items)
    found = catalog.search(scenes, (32.9, 37.9, 40.0, 40.0), "2025-04-01", "2025-07-31", 30.0)
    assert [r["scene_id"] for r in found.collect()] == ["a"]
    assert catalog.search(scenes, (34.0, 37.9, 40.0, 40.0), "2025-04-01", "2025-07-31", 30.0).count() == 0
    asked = spark.createDataFrame([("a",), ("z",)], "scene_id string")
    assert {(r["requested"], r["returned"]) for r in catalog.identity_mismatch(items, asked).collect()} == {("z", None), (None, "b"), (None, "c")}
    outside = catalog.multispectral_bands(items).where(~F.col("inside_window"))
    assert {r["band"] for r in outside.collect()} == {"B11"}


def test_zoneless_item_fails(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps(item("x", **{"datetime": "2025-06-08T09:16:05"})))
    with pytest.raises(Exception, match="lacks a zone"):
        catalog.scenes_of(catalog.read_items(spark, str(tmp_path))).collect()


XML = """<n1:Level xmlns:n1="https://x"><BOA_QUANTIFICATION_VALUE unit="none">10000</BOA_QUANTIFICATION_VALUE><L>
<BOA_ADD_OFFSET band_id="3">-1000</BOA_ADD_OFFSET><BOA_ADD_OFFSET band_id="4">-1000</BOA_ADD_OFFSET><BOA_ADD_OFFSET band_id="8">-1000</BOA_ADD_OFFSET>{last}</L>
<Spectral_Information bandId="3" physicalBand="B4"/><Spectral_Information bandId="4" physicalBand="B5"/>
<Spectral_Information bandId="8" physicalBand="B8A"/><Spectral_Information bandId="11" physicalBand="B11"/></n1:Level>"""


def test_calibration_xml(spark):
    docs = spark.createDataFrame([("ok", XML.format(last='<BOA_ADD_OFFSET band_id="11">-900</BOA_ADD_OFFSET>')), ("no", XML.format(last=""))], "scene_id string, xml string")
    rows = {(r["scene_id"], r["band"]): r for r in calibration.parse_calibration(docs).collect()}
    assert rows["ok", "B11"]["add_offset"] == -900 and rows["ok", "B04"]["quantification"] == 10000 and not rows["ok", "B8A"]["problems"]
    assert rows["no", "B11"]["problems"] == ["missing or nonfinite offset"]
    wide = calibration.per_scene(calibration.parse_calibration(docs)).where("scene_id = 'ok'").first()
    assert (wide["b04_offset"], wide["b11_offset"]) == (-1000, -900)


def test_calibration_xml_with_empty_or_repeated_offset(spark):
    """An element without text takes no other's value; a repeated one is a problem; entities and other prefixes are read."""
    offset = '<BOA_ADD_OFFSET band_id="11">{}</BOA_ADD_OFFSET>'.format
    docs = {"empty": '<BOA_ADD_OFFSET band_id="11"/>', "twice": offset(-900) + offset(-800), "entity": "<a><m:BOA_ADD_OFFSET xmlns:m='y' band_id='11'>&#45;900</m:BOA_ADD_OFFSET></a>",
            "two": offset(-900) + "<BOA_QUANTIFICATION_VALUE>1</BOA_QUANTIFICATION_VALUE>"}
    frame = spark.createDataFrame([*[(k, XML.format(last=last)) for k, last in docs.items()], ("blank", ""), ("null", None)], "scene_id string, xml string")
    rows = {(r["scene_id"], r["band"]): (r["add_offset"], r["problems"]) for r in calibration.parse_calibration(frame).collect()}
    missing, bad = "missing or nonfinite offset", "missing or invalid quantification value"
    assert rows["empty", "B11"] == rows["twice", "B11"] == (None, [missing]) and rows["empty", "B04"] == (-1000, [])
    assert rows["entity", "B11"] == (-900, []) and rows["two", "B11"] == (-900, [bad])
    assert rows["blank", "B11"] == rows["null", "B11"] == (None, [bad, missing]) and len(rows) == 24
    with pytest.raises(Exception, match="ParseError"):
        calibration.parse_calibration(spark.createDataFrame([("x", "<a>")], "scene_id string, xml string")).collect()


def test_time_series_round_trip(spark, tmp_path):
    indexed = mosaic.calibrated_indices(scene_rows(spark))
    best = mosaic.first_valid(indexed, KEYS)
    sources = mosaic.source_contributions(indexed, best, KEYS)
    days = mosaic.daily_observations(sources, spark.createDataFrame([("f", 4)], "area string, footprint_pixels bigint"), KEYS)
    rows = tables.with_cutoff_flags(tables.series_rows(days, sources, mosaic.vegetation_statistics(best, KEYS)), "2025-06-08 07:30:00")
    tables.write_series(rows, str(tmp_path / "csv"))
    tables.write_series(rows, str(tmp_path / "json"), as_json=True)
    back = tables.read_series(spark, str(tmp_path / "csv"))
    row = back.first()
    assert row["scene_ids"] == ["clear", "hazy"] and row["acquisition_datetimes"][0] == "2025-06-08T08:00:00.000000Z"
    assert row["eligible_at_decision_cutoff"] is False and back.count() == 1
    assert tables.flag_mismatches(back, "2025-06-08 07:30:00").count() == 0
    assert tables.flag_mismatches(back, "2025-06-08 09:00:00").count() == 1


def test_layouts_prune(spark, tmp_path):
    spectra = spark.range(200).select(F.lit("s").alias("scene_id"), (F.col("id") % 4).cast("int").alias("band_index"), F.col("id").alias("pixel_id"), F.lit(0.5).cast("float").alias("reflectance"))
    tables.write_spectra(spectra, str(tmp_path / "spectra"), 4)
    read = tables.read_spectra(spark, str(tmp_path / "spectra"), [2]).where("scene_id = 's'").select("reflectance")
    assert read.count() == 50
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "In(band_index, [2])" in plan or "EqualTo(band_index,2)" in plan
    assert "PartitionFilters: [isnotnull(scene_id" in plan and "pixel_id" not in plan.split("ReadSchema")[1]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_pixel_layouts_round_trip_and_prune(spark, tmp_path):
    """Written, read back equal, and the wanted scene or day reaches the scan as a partition filter."""
    pixels = spark.range(300).select(
        F.when(F.col("id") < 200, "s").otherwise("t").alias("scene_id"), F.concat(F.lit("p"), "id").alias("pixel_id"), (F.col("id") / 300).alias("red"), (F.col("id") / 150).alias("nir"))
    tables.write_pixels(pixels, str(tmp_path / "text_ids"))
    assert spark.read.parquet(str(tmp_path / "text_ids")).select(*pixels.columns).exceptAll(pixels).count() == 0
    numbered = pixels.withColumn("pixel_id", F.substring("pixel_id", 2, 9).cast("bigint"))
    tables.write_pixels(numbered, str(tmp_path / "pixels"))
    read = tables.read_pixels(spark, str(tmp_path / "pixels"))
    assert sorted(read.select(*numbered.columns).collect()) == sorted(numbered.collect())
    one = read.where("scene_id = 't'").select("nir")
    assert one.count() == 100 and "(scene_id" in plan_of(one).split("PartitionFilters")[1].split("]")[0] and "red" not in plan_of(one).split("ReadSchema")[1]

    cells = spark.range(400).select(
        F.concat(F.lit("s"), (F.col("id") % 8).cast("string")).alias("scene_id"), (F.col("id") % 10).cast("int").alias("cell_x"), (F.col("id") / 10).cast("int").alias("cell_y"),
        *[(F.col("id") * n).cast("float").alias(b) for n, b in enumerate(("b04", "b05", "b8a", "b11"), 1)], F.lit(4).cast("tinyint").alias("scl"),
        F.date_add(F.lit("2025-06-01").cast("date"), (F.col("id") % 4).cast("int")).alias("day"))
    tables.write_scene_pixels(cells, str(tmp_path / "cells"))
    assert sorted(tables.read_scene_pixels(spark, str(tmp_path / "cells")).select(*cells.columns).collect()) == sorted(cells.collect())
    days = tables.read_scene_pixels(spark, str(tmp_path / "cells"), ("2025-06-02", "2025-06-03")).select("b04")
    assert days.count() == 200 and "(day" in plan_of(days).split("PartitionFilters")[1].split("]")[0] and len(days.inputFiles()) > 0

    evidence = pixels.select("scene_id", "pixel_id", F.when(F.col("red") > 0.5, F.col("nir")).alias("risk_score"), F.lit(0).alias("risk_class"))
    tables.write_evidence(evidence, str(tmp_path / "evidence"))
    back = tables.read_evidence(spark, str(tmp_path / "evidence"), "scene_id string, pixel_id string, risk_score double, risk_class int")
    assert sorted(map(str, back.select(*evidence.columns).collect())) == sorted(map(str, evidence.collect()))
    wanted = tables.read_evidence(spark, str(tmp_path / "evidence"), "scene_id string, pixel_id string, risk_score double, risk_class int", ["s"]).select("risk_class")
    assert wanted.count() == 200 and "scene_id" in plan_of(wanted).split("PartitionFilters")[1].split("]")[0]


def test_bundle_problems(spark):
    schema = "bundle string, name string, sha256 string, schema_version int, shape array<int>"
    found = spark.createDataFrame([("a", "ok", "1", 1, [2, 3]), ("a", "sum", "1", 1, [2]), ("a", "old", "1", 9, [2]), ("a", "none", None, None, None),
                                   ("a", "shape", "1", 1, [2, 4]), ("a", "more", "1", 1, [1])], schema)
    recorded = spark.createDataFrame([("a", "ok", "1", 1, [2, 3]), ("a", "sum", "2", 1, [2]), ("a", "old", "1", 1, [2]), ("a", "none", None, 1, None),
                                      ("a", "shape", "1", 1, [4, 2]), ("b", "ok", "1", 1, [1])], schema)
    rows = manifest.bundle_problems(found, recorded, ["bundle", "name"], [1, 2]).collect()
    assert {(r["bundle"], r["name"]): r["problems"] for r in rows} == {
        ("a", "ok"): [], ("a", "sum"): ["checksum mismatch"], ("a", "old"): ["unknown schema version"], ("a", "none"): ["unknown schema version"],
        ("a", "shape"): ["shape mismatch"], ("a", "more"): ["unrecorded"], ("b", "ok"): ["missing"]}
    assert manifest.bundle_problems(found.limit(0), recorded.limit(0), ["bundle", "name"], [1]).count() == 0


def test_manifest_statuses(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"b":1,"a":2}')
    (tmp_path / "b.csv").write_bytes(b"x\r\ny\r\n")
    (tmp_path / "c.bin").write_bytes(b"123")
    actual = manifest.file_manifest(spark, str(tmp_path))
    assert {r["path"]: r["size_bytes"] for r in actual.collect()} == {"a.json": 13, "b.csv": 6, "c.bin": 3}
    expected = actual.where("path <> 'c.bin'").withColumn("sha256", F.when(F.col("path") == "b.csv", "0").otherwise(F.col("sha256"))) \
        .unionByName(spark.createDataFrame([("gone", 0, "1")], "path string, size_bytes bigint, sha256 string"))
    assert {r["path"]: r["status"] for r in manifest.verify_manifest(actual, expected).collect()} == {
        "a.json": "ok", "b.csv": "stale", "c.bin": "unexpected", "gone": "missing"}
    before = {r["path"]: r["sha256"] for r in manifest.semantic_manifest(spark, str(tmp_path)).collect()}
    (tmp_path / "a.json").write_text('{ "a": 2,\n "b": 1 }')
    (tmp_path / "b.csv").write_bytes(b"x\ny\n")
    assert {r["path"]: r["sha256"] for r in manifest.semantic_manifest(spark, str(tmp_path)).collect()} == before


def test_manifest_keeps_folders_apart(spark, tmp_path):
    for folder, text in (("one", "1"), ("two", "22")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.csv").write_text(text)
    sizes = {r["path"]: r["size_bytes"] for r in manifest.file_manifest(spark, f"file:{tmp_path}/").collect()}
    assert sizes == {"one/same.csv": 1, "two/same.csv": 2}
    assert {r["path"] for r in manifest.semantic_manifest(spark, str(tmp_path)).collect()} == sizes.keys()
    assert [r["path"] for r in manifest.file_manifest(spark, str(tmp_path / "one/same.csv")).collect()] == ["same.csv"]


def test_documents_must_be_finite(spark, tmp_path):
    tables.write_document(spark.createDataFrame([(1.0, "x")], "v double, t string"), str(tmp_path / "ok"))
    with pytest.raises(ValueError, match="v: 1"):
        tables.write_document(spark.createDataFrame([(float("nan"), "x")], "v double, t string"), str(tmp_path / "bad"))


def test_export_whitelist_and_sample(spark):
    doc = spark.createDataFrame([((1, "secret"), 2)], "inner struct<kept:int,hidden:string>, other int")
    assert export.curated(doc, ["inner.kept", "other"]).columns == ["kept", "other"]
    full = spark.createDataFrame([("s", i, True, i / 10, i / 20, i / 30) for i in range(50)], "scene_id string, pixel_id int, quality_valid boolean, ndvi double, ndre double, ndmi double")
    sample = export.sample_pixels(full, ["scene_id"], 20)
    assert sample.count() == 20 and export.sample_agrees(sample, full, ["scene_id", "pixel_id"]).count() == 0
    tampered = sample.withColumn("ndvi", F.col("ndvi") + 1e-12)
    assert export.sample_agrees(tampered, full, ["scene_id", "pixel_id"]).count() == 20


def test_sensor_rule_on_a_stream(spark, tmp_path):
    from tests.test_contract_audit import sensor
    readings = sensor(spark).unionByName(sensor(spark, state="STALE")).unionByName(sensor(spark, ph=20.0))
    readings.write.json(str(tmp_path / "in"))
    as_of = F.lit("2025-06-09 08:30:00").cast("timestamp")
    marked = sensors.mark_usable(sensors.read_readings(spark, str(tmp_path / "in")), as_of)
    query = marked.writeStream.format("memory").queryName("usable").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    streamed = sorted(r["usable"] for r in spark.table("usable").collect())
    assert streamed == [False, False, True]
    assert sorted(r["usable"] for r in sensors.mark_usable(readings, as_of).collect()) == streamed


def test_json_digest_sorts_every_depth_and_keeps_types(spark):
    from pyspark.sql import functions as F

    from fieldscan.functions.text import canonical_json_hash
    texts = ['{"a":{"x":1,"y":[2,3]},"b":1}', '{"b": 1, "a": {"y": [2, 3], "x": 1}}', '{"a":{"x":1,"y":[2,3]},"b":"1"}', '{"a":{"x":1,"y":[3,2]},"b":1}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", canonical_json_hash(F.col("t")).alias("h")).collect()
    digest = {r.i: r.h for r in rows}
    assert digest[0] == digest[1]
    assert len(set(digest.values())) == 3


def test_series_time_without_zone_fails(spark):
    rows = spark.sql("SELECT '2025-06-08T08:00:00' AS acquisition_datetimes")
    with pytest.raises(Exception, match="lacks a zone"):
        tables.with_cutoff_flags(rows, "2025-06-09 00:00:00").collect()


def test_nested_numbers_must_be_finite(spark):
    frame = spark.sql("SELECT array(named_struct('v', double('NaN'))) AS a, map('k', double(1)) AS m, 'x' AS t, CAST(NULL AS DOUBLE) AS d")
    assert {r["check"]: r["n_bad"] for r in audit.all_finite(frame).collect()} == {"a": 1, "m": 0, "d": 0}
