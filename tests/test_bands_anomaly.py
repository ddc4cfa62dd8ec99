import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldscan.operators import anomaly, bands, lookup, sampling, spectra

KEYS = ["scene_id"]


def band_frame(spark, wavelengths, nodata=None):
    return spark.createDataFrame([("s", i, float(w), f"b{i}", nodata) for i, w in enumerate(wavelengths)],
                                 "scene_id string, band_index int, wavelength_nm double, band_name string, nodata double")


def test_window_and_tie(spark):
    frame = band_frame(spark, [399.99, 400, 665, 1700, 1700.01])
    assert bands.band_problems(frame).first()["in_window"] == 3
    near = {r["role"]: r["band_index"] for r in bands.nearest_bands(band_frame(spark, [600, 655, 675, 900])).collect()}
    assert near["red"] == 1  # 655 and 675 are equally far; the lower index wins


def test_band_order_problems(spark):
    assert bands.band_problems(band_frame(spark, [500, 450])).first()["problems"] == ["wavelengths not strictly increasing"]
    assert bands.band_problems(band_frame(spark, [100, 200])).first()["problems"] == ["no band inside the window"]
    assert "nonfinite wavelength" in bands.band_problems(band_frame(spark, [math.nan, 500])).first()["problems"]


def rule_cube(spark):
    """Nine bands over a 3 x 4 grid with every exclusion reason present once."""
    table = band_frame(spark, [399, 400, 500, 600, 700, 1365, 1450, 1700, 1701], 999.0)
    rows = []
    for b in range(9):
        for i in range(10):  # the last two of twelve cells are masked out before
            value = i / 10 + b / 100
            if b == 2 and i < 4:
                value = (math.nan, -math.inf, -0.1, 999.0)[i]
            if b == 3:
                value = 0.2
            if b in (4, 5):
                value = math.nan
            rows.append(("s", b, i, value))
    return table, spark.createDataFrame(rows, "scene_id string, band_index int, pixel_id bigint, reflectance double")


@pytest.mark.parametrize("parts", [1, 17])
def test_rule_cube(spark, parts):
    table, spectra = rule_cube(spark)
    scanned = bands.scan_bands(spectra.repartition(parts), table)
    audit = bands.band_audit(scanned, KEYS)
    rows = {r["band_index"]: r for r in audit.collect()}
    assert len(rows) == 7 and sorted(b for b, r in rows.items() if r["retained"]) == [1, 2, 7]
    assert rows[5]["exclusion_reasons"] == ["atmospheric_caution_1350_1450_nm", "no_valid_candidate_reflectance"]
    assert rows[3]["exclusion_reasons"] == ["constant_candidate_reflectance"]
    kept = sorted(r["pixel_id"] for r in bands.complete_pixels(scanned, audit, KEYS).collect())
    assert kept == [4, 5, 6, 7, 8, 9]
    vectors = anomaly.complete_spectra(scanned, audit, KEYS).orderBy("pixel_id").collect()
    assert [v["pixel_id"] for v in vectors] == kept and len(vectors[0]["spectrum"]) == 3


@pytest.mark.parametrize("parts", [1, 7])
def test_rule_cube_as_arrays(spark, parts, monkeypatch):
    """The same audit and vectors as from long rows, through the broadcast and through the salted join."""
    table, long = rule_cube(spark)
    length = long.agg(F.max("band_index")).first()[0] + 1
    filled = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.get(F.map_values(F.map_filter("m", lambda k, _: k == i)), F.lit(0)))
    cube = long.groupBy("scene_id", "pixel_id").agg(F.map_from_entries(F.collect_list(F.struct("band_index", "reflectance"))).alias("m")) \
        .select("scene_id", "pixel_id", filled.alias("reflectance")).repartition(parts)
    scanned = bands.scan_bands(long, table)
    want_audit = {r["band_index"]: r for r in bands.band_audit(scanned, KEYS).collect()}
    want = {r["pixel_id"]: r["spectrum"] for r in anomaly.complete_spectra(scanned, bands.band_audit(scanned, KEYS), KEYS).collect()}
    for most in (lookup.BROADCAST_BYTES, 0):
        monkeypatch.setattr(lookup, "BROADCAST_BYTES", most)
        cleaned = spectra.cleaned_cube(cube, table)
        audit = spectra.cube_audit(cleaned, table, KEYS)
        got = {r["band_index"]: r for r in audit.collect()}
        for band, row in want_audit.items():
            assert all(got[band][c] == row[c] for c in ("valid_count", "above_one_count", "exclusion_reasons", "retained"))
        assert {r["pixel_id"]: r["spectrum"] for r in spectra.complete_vectors(cleaned, audit, KEYS).collect()} == want


def test_position_statistics_equal_numpy(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [("abc"[i % 3], i, [None if rng.random() < 0.2 else float(x) for x in rng.normal(1e3, 1, 4 + i % 3)]) for i in range(300)]
    rows += [("d", 900, [None, None])]
    frame = spark.createDataFrame(rows, "g string, pixel_id long, v array<double>").repartition(5)
    monkeypatch.setattr(spectra, "GROUPS_HELD", 1)
    found = {(r["g"], r["position"]): r for r in spectra.position_statistics(frame, ["g"], "v").collect()}
    assert found[("d", 0)]["valid_count"] == 0 and found[("d", 0)]["mean"] is None and found[("d", 0)]["low"] is None
    for (g, position), r in found.items():
        own = [v[position] for k, _, v in rows if k == g]
        good = np.array([x for x in own if x is not None])
        assert (r["valid_count"], r["invalid_count"]) == (len(good), len(own) - len(good))
        if len(good):
            assert r["mean"] == pytest.approx(good.mean(), rel=1e-12) and r["deviation"] == pytest.approx(good.std(), rel=1e-6)
            assert (r["low"], r["high"]) == (good.min(), good.max())


def test_atmospheric_edges(spark):
    rows = spark.createDataFrame([("s", i, p, float(p)) for i in range(5) for p in (1, 2)],
                                 "scene_id string, band_index int, pixel_id bigint, reflectance double")
    audit = bands.band_audit(bands.scan_bands(rows, band_frame(spark, [1349.99, 1350, 1400, 1450, 1450.01])), KEYS)
    assert [r["retained"] for r in audit.orderBy("band_index").collect()] == [True, False, False, False, True]


def test_contrast_windows_exclusions_and_spacing(spark):
    wavelengths = [400 + 5 * i for i in range(261)]
    rows = [("s", i, float(w), 0.0, 0.0, (-1) ** i * (1 + (w % 97) / 100)) for i, w in enumerate(wavelengths)]
    difference = spark.createDataFrame(rows, "scene_id string, band_index int, wavelength_nm double, lower_median double, higher_median double, difference double")
    anchors = spark.createDataFrame([("s", 665.0), ("s", 860.0)], "scene_id string, wavelength_nm double")
    windows = bands.contrast_windows(difference, anchors, KEYS)
    starts = sorted(r["window_start"] for r in windows.collect())
    expected = []
    for start in range(400, 1700, 25):
        inside = [w for w in wavelengths if start <= w < start + 25]
        if len(inside) >= 3 and not any(1350 <= w <= 1450 or abs(w - 665) <= 15 or abs(w - 860) <= 15 for w in inside):
            expected.append(start)
    assert starts == expected
    ranked = sorted(windows.collect(), key=lambda r: (-r["mean_absolute"], r["window_start"]))
    chosen = []
    for r in ranked:
        if len(chosen) < 3 and all(abs(r["window_start"] - c) >= 100 for c in chosen):
            chosen.append(r["window_start"])
    got = [r["window_start"] for r in bands.spaced_regions(windows, KEYS).orderBy("position").collect()]
    assert got == chosen


def test_gap_marker(spark):
    curve = spark.createDataFrame([("s", 1, 500.0, 0.1), ("s", 2, 510.0, 0.2), ("s", 5, 540.0, 0.3)],
                                  "scene_id string, band_index int, wavelength_nm double, v double")
    got = sorted(map(tuple, bands.with_gaps(curve, KEYS, "v").collect()), key=lambda r: r[1])
    assert got == [("s", 500.0, 0.1), ("s", 510.0, 0.2), ("s", 525.0, None), ("s", 540.0, 0.3)]


# --- anomaly ------------------------------------------------------------------

def cloud(spark, parts=3, scenes=("a", "b")):
    rng = np.random.default_rng(3)
    rows = []
    for scene in scenes:
        base = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 6)) + 10
        base[0] += 40  # planted outlier
        rows += [(scene, i, [float(x) for x in v]) for i, v in enumerate(base)]
    return spark.createDataFrame(rows, "scene_id string, pixel_id bigint, spectrum array<double>").repartition(parts)


def test_components_equal_numpy(spark):
    frame = cloud(spark)
    model = {r["scene_id"]: r for r in anomaly.fit_components(frame, anomaly.fit_scaler(frame, KEYS), KEYS).collect()}
    for scene in ("a", "b"):
        x = np.asarray([r["spectrum"] for r in frame.where(F.col("scene_id") == scene).orderBy("pixel_id").collect()])
        assert np.allclose(model[scene]["mean"], x.mean(axis=0)) and np.allclose(model[scene]["scale"], x.std(axis=0))
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        _, s, vt = np.linalg.svd(z, full_matrices=False)
        share = s ** 2 / (s ** 2).sum()
        k = int(np.searchsorted(np.cumsum(share), 0.99, side="right")) + 1
        assert len(model[scene]["ratios"]) == k and np.allclose(model[scene]["ratios"], share[:k])
        assert np.allclose(np.abs(np.asarray(model[scene]["components"])), np.abs(vt[:k]), atol=1e-7)


def test_scores_rank_outlier_first_and_ignore_partitioning(spark, monkeypatch):
    def scores(parts):
        frame = cloud(spark, parts)
        model = anomaly.fit_anomaly(frame, KEYS, trees=40)
        return {(r["scene_id"], r["pixel_id"]): r["anomaly_score"] for r in anomaly.score_anomaly(frame, model, KEYS).collect()}

    first = scores(1)
    monkeypatch.setattr(anomaly, "CHUNK_ROWS", 64)
    monkeypatch.setattr(anomaly, "MODEL_BYTES", 0)  # models meet chunks by key instead of being sent
    second = scores(17)
    assert len(first) == 800 and first.keys() == second.keys()
    assert all(abs(first[k] - second[k]) < 1e-12 for k in first)
    assert all(0 < v < 1 for v in first.values())
    for scene in ("a", "b"):
        assert max((v, k) for k, v in first.items() if k[0] == scene)[1] == (scene, 0)


def test_trees_split_rows_as_their_nodes_say():
    points = np.random.default_rng(6).integers(0, 4, (200, 3)).astype(float)
    tree = anomaly.grow_tree(points, 1, 2, 8)

    def walk(node, rows, depth):
        assert tree["size"][node] == len(rows)
        if tree["feature"][node] < 0:
            assert depth == 8 or len(rows) == 1 or (points[rows] == points[rows][0]).all()
            return
        left = points[rows, tree["feature"][node]] <= tree["threshold"][node]
        assert 0 < left.sum() < len(rows)
        walk(tree["left"][node], rows[left], depth + 1)
        walk(tree["right"][node], rows[~left], depth + 1)

    walk(0, np.arange(200), 0)
    assert anomaly.grow_tree(np.ones((5, 2)), 1, 2, 3)["feature"] == [-1]


def test_zero_variance_band_fails(spark):
    frame = spark.createDataFrame([("s", i, [1.0, float(i)]) for i in range(5)], "scene_id string, pixel_id bigint, spectrum array<double>")
    with pytest.raises(Exception, match="zero variance"):
        anomaly.fit_scaler(frame, KEYS).collect()


def test_average_path_constants():
    assert list(anomaly.average_path(np.array([0, 1, 2]))) == [0.0, 0.0, 1.0]
    assert anomaly.average_path(256)[0] == pytest.approx(10.244770920119917, rel=1e-9)


def test_comparison_lists_every_class(spark):
    scores = spark.createDataFrame([("s", i, i / 10) for i in range(6)], "scene_id string, pixel_id bigint, anomaly_score double")
    evidence = spark.createDataFrame([("s", i, float(i), 1 + i // 4) for i in range(6)], "scene_id string, pixel_id bigint, risk_score double, risk_class int")
    rho, by_class = anomaly.compare_with_risk(scores, evidence, KEYS)
    assert rho.first()["rho"] == pytest.approx(1.0)
    assert {r["risk_class"]: r["count"] for r in by_class.collect()} == {1: 4, 2: 2, 3: 0, 4: 0}


# --- sampling -----------------------------------------------------------------

@pytest.mark.parametrize("size", [10, 500])
def test_sample_is_exact_and_partition_free(spark, size):
    frame = spark.range(300).withColumn("g", F.col("id") % 2)
    one = {r["id"] for r in sampling.exact_sample(frame.repartition(3), "id", size).collect()}
    two = {r["id"] for r in sampling.exact_sample(frame.repartition(17), "id", size).collect()}
    assert one == two and len(one) == min(size, 300)
    grouped = sampling.exact_sample_by(frame.repartition(7), ["g"], "id", size).groupBy("g").count().collect()
    assert {r["count"] for r in grouped} == {min(size, 150)}


def test_membership_digest_depends_on_members_only(spark):
    ids = [1, 2, 70_000, 2 ** 40, 2 ** 62]
    frame = spark.createDataFrame([("s", i) for i in ids], "g string, id bigint")
    a = sampling.membership_digest(frame.repartition(1), ["g"], "id").first()
    b = sampling.membership_digest(frame.repartition(17).union(frame), ["g"], "id").first()
    c = sampling.membership_digest(frame.where("id > 1"), ["g"], "id").first()
    assert (a["members"], a["digest"]) == (5, b["digest"]) and c["digest"] != a["digest"]
