import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldscan import constants as C
from fieldscan.functions import geometry as G
from fieldscan.operators import audit, mosaic, spatial
from fieldscan.plans import analyses, scene_queries  # noqa: F401
from fieldscan.plans.registry import QUERIES
from fieldscan.session import dealt_by

KEYS = ["area"]


def scene_rows(spark, parts=3):
    """Two scenes on one day over four cells, and a third on the next day."""
    def row(scene, day, cloud, x, scl, dn, hour=8, inside=True):
        b04, b05, b8a, b11 = dn
        return ("f", scene, cloud, dt.datetime(2025, 6, day, hour), f"2025-06-{day:02d}", x, 0, float(b04), float(b05), float(b8a), float(b11), scl, inside)
    good, better = (1100, 1200, 4000, 2000), (1200, 1300, 5000, 2500)
    rows = [row("clear", 8, 1.0, 0, 4, good), row("clear", 8, 1.0, 1, 9, good), row("clear", 8, 1.0, 2, 4, (0, 1200, 4000, 2000)),
            row("clear", 8, 1.0, 3, 5, good, inside=False),
            row("hazy", 8, 7.0, 0, 4, better, 7), row("hazy", 8, 7.0, 1, 5, better, 7), row("hazy", 8, 7.0, 2, 4, better, 7), row("hazy", 8, 7.0, 3, 4, better, 7),
            row("next", 9, 2.0, 0, 8, good), row("next", 9, 2.0, 1, 8, good), row("next", 9, 2.0, 2, 8, good)]
    frame = spark.createDataFrame(rows, "area string, scene_id string, cloud_cover double, acquired_at timestamp, day string, cell_x int, cell_y int, "
                                        "b04 double, b05 double, b8a double, b11 double, scl int, in_footprint boolean").withColumn("day", F.col("day").cast("date"))
    return frame.withColumns({"quantification": F.lit(10000.0), **{f"{b}_offset": F.lit(-1000.0) for b in ("b04", "b05", "b8a", "b11")}}).repartition(parts)


@pytest.mark.parametrize("parts", [1, 17])
def test_first_valid_wins_and_counts_add_up(spark, parts):
    result = analyses.observe_days(scene_rows(spark, parts), spark.createDataFrame([("f", 4)], "area string, footprint_pixels bigint"), KEYS)
    cells = {(r["day"].day, r["cell_x"]): r["scene_id"] for r in result["mosaic"].collect()}
    assert cells == {(8, 0): "clear", (8, 1): "hazy", (8, 2): "hazy", (8, 3): "hazy"}
    sources = {(r["day"].day, r["scene_id"]): (r["valid_in_footprint"], r["contributing"]) for r in result["sources"].collect()}
    assert sources == {(8, "clear"): (1, 1), (8, "hazy"): (4, 3), (9, "next"): (0, 0)}
    days = {r["day"].day: r for r in result["observations"].collect()}
    assert days[8]["valid_pixels"] == 4 and days[8]["acquired_at"].hour == 7 and days[8]["distinct_times"] == 2
    assert days[9]["valid_pixels"] == 0 and days[9]["vegetation_percentage_of_valid"] == 0.0 and days[9]["acquired_at"].hour == 8
    assert days[9]["exclusion_reasons"] == [C.COVERAGE_REASON, C.VEGETATION_REASON]
    assert days[8]["exclusion_reasons"] == [C.VEGETATION_REASON]
    stats = {(r["day"].day, r["index_name"]): r for r in result["statistics"].collect()}
    assert set(stats) == {(8, n) for n in C.INDEX_NAMES}
    assert stats[8, "ndvi"]["min"] <= stats[8, "ndvi"]["p25"] <= stats[8, "ndvi"]["median"] <= stats[8, "ndvi"]["max"]
    checks = {r["check"]: r["n_bad"] for r in audit.observation_audit(result["observations"], result["sources"], KEYS, 30.0).collect()}
    assert checks["contributions sum to valid"] == 0 and checks["representative time"] == 1 and checks["counts ordered"] == 1
    assert mosaic.out_of_bounds(mosaic.calibrated_indices(scene_rows(spark))).count() == 0


def test_latest_version_with_missing_orbit(spark):
    at = dt.datetime(2025, 6, 8, 8)
    rows = [("a", "P", at, "T", None, "2025-01-01"), ("b", "P", at, "T", None, "2025-02-01"), ("c", "P", at, "T", 5, None), ("d", "P", at, "T", 5, None), ("e", "P", at, "U", 5, None)]
    frame = spark.createDataFrame(rows, "scene_id string, platform string, acquired_at timestamp, tile string, relative_orbit int, generation_time string")
    assert {r["scene_id"] for r in mosaic.latest_versions(frame).where("dropped").collect()} == {"a", "c"}


def test_downsampling_needs_full_coverage(spark):
    rows = [("s", x, y, float(1 + x + y)) for x in range(4) for y in range(2)]
    frame = spark.createDataFrame(rows, "s string, x int, y int, v double").withColumn("v", F.when(F.expr("x = 3 AND y = 1"), 0.0).otherwise(F.col("v")))
    got = {(r["cell_x"], r["cell_y"]): r["mean"] for r in mosaic.halve_resolution(frame, ["s"], "v").collect()}
    assert got == {(0, 0): 2.0, (1, 0): None}


def test_fold_of_distinct_keys_takes_tasks_by_rows(spark):
    rows = spark.range(1000).select((F.col("id") % 700).alias("k"))
    assert dealt_by(rows, "k").rdd.getNumPartitions() == 4
    dealt = dealt_by(rows, "k", rows_per_task=90)
    parts = dealt.select("k", F.spark_partition_id().alias("p")).distinct()
    assert dealt.rdd.getNumPartitions() == 12 and dealt.count() == 1000 and parts.count() == 700


def test_halving_deals_rows_once(spark):
    """One shuffle, by the coarse cell: no task folds the keys of a whole scan split."""
    plan = QUERIES["halved_resolution"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan


SQUARE = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
RING = "array<struct<lon:double,lat:double>>"


def test_point_in_square(spark):
    rows = [(i, x, y, SQUARE) for i, (x, y) in enumerate([(1.0, 1.0), (0.0, 0.0), (2.0, 1.0), (3.0, 1.0)])]
    frame = spark.createDataFrame(rows, f"i int, lon double, lat double, ring {RING}")
    got = [r[0] for r in frame.orderBy("i").select(G.ring_contains(F.col("ring"), F.col("lon"), F.col("lat"))).collect()]
    assert got == [True, True, True, False]


def test_bad_polygons_are_rejected(spark):
    rings = [SQUARE, [], SQUARE[:4], [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (0.0, 0.0)],
             [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 3.0), (0.0, 0.0)], [(-179.0, 0.0), (179.0, 0.0), (179.0, 1.0), (-179.0, 1.0), (-179.0, 0.0)]]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rings)], f"i int, ring {RING}")
    got = [r[0] for r in frame.orderBy("i").select(G.ring_problems(F.col("ring"))).collect()]
    assert got[0] == [] and all(got[1:]) and "self-intersection" in got[4] and "spans 180 degrees" in got[5] and "zero area" in got[3]


def test_grid_join_equals_pairwise_test(spark):
    rings = spark.createDataFrame([(k, [(k + x, y) for x, y in SQUARE]) for k in range(5)], f"area_id int, ring {RING}")
    points = spark.createDataFrame([(i, i * 0.5, 1.0) for i in range(14)], "p int, lon double, lat double")
    got = {(r["p"], r["area_id"]) for r in spatial.points_in_rings(points, rings).collect()}
    assert got == {(i, k) for i in range(14) for k in range(5) if k <= i * 0.5 <= k + 2}


def test_world_wide_and_tiny_areas_with_a_crowded_cell(spark):
    """Half of the points coincide; areas from a dot to the whole world, on cell borders and with one null ring."""
    box = lambda w, s, e, n: [(w, s), (e, s), (e, n), (w, n), (w, s)]
    sides = [(-180.0, -90.0, 180.0, 90.0), (0.0, 0.0, 0.0, 0.0), (-45.0, -45.0, 45.0, 45.0), (11.2, 11.2, 11.3, 11.3), (90.0, -22.5, 180.0, 22.5),
             (11.25, 11.25, 11.25, 30.0), (-400.0, -400.0, 400.0, 400.0)]
    areas = spark.createDataFrame([(k, box(*b)) for k, b in enumerate(sides)] + [(99, None)], f"area_id int, ring {RING}")
    places = [(i, 11.25, 11.25) for i in range(300)] + [(300 + i, (i * 37 % 3600) / 10 - 180, (i * 53 % 1800) / 10 - 90) for i in range(300)]
    points = spark.createDataFrame(places + [(900, None, 1.0), (901, 0.0, 0.0)], "p int, lon double, lat double").withColumn("level", F.lit("x")).drop("level")
    cells = spatial.area_cells(areas).groupBy("area_id").count().collect()
    assert max(r["count"] for r in cells) <= 4
    want = {(p, k) for p, x, y in [*places, (901, 0.0, 0.0)] for k, (w, s, e, n) in enumerate(sides) if w <= x <= e and s <= y <= n}
    for crowded in (1, 50, 10**9):
        found = [(r["p"], r["area_id"]) for r in spatial.points_in_rings(points.repartition(3), areas, crowded).collect()]
        assert len(found) == len(want) and set(found) == want
    assert spatial.points_in_rings(points, areas.limit(0)).count() == 0


def test_copies_of_places_and_rings_are_tested_once(spark, monkeypatch):
    rings = spark.createDataFrame([(k, [(k % 2 + x, y) for x, y in SQUARE]) for k in range(40)] + [(99, None)], f"area_id int, ring {RING}")
    points = spark.createDataFrame([(i, (i % 3) + 0.5, 1.0) for i in range(60)] + [(99, None, 1.0)], "p int, lon double, lat double")
    met = []
    plain = spatial._places_in_shapes
    monkeypatch.setattr(spatial, "_places_in_shapes", lambda p, s, n: met.append((p.count(), s.count())) or plain(p, s, n))
    for crowded in (1, 50_000):
        found = [(r["p"], r["area_id"]) for r in spatial.points_in_rings(points, rings, crowded).collect()]
        want = {(i, k) for i in range(60) for k in range(40) if k % 2 <= i % 3 + 0.5 <= k % 2 + 2}
        assert len(found) == len(want) and set(found) == want
    assert met == [(3, 2), (3, 2)]


@pytest.mark.parametrize("crowded", [1, 50_000])
def test_totals_equal_pairwise_sums(spark, crowded):
    """Rings with a notch, crossing themselves, left open, clockwise, as a dot, a line and the world; none meets no point."""
    star = [(0.0, 3.0), (2.0, -3.0), (-3.0, 1.0), (3.0, 1.0), (-2.0, -3.0), (0.0, 3.0)]
    notch = [(-4.0, -4.0), (4.0, -4.0), (4.0, 4.0), (0.0, -3.5), (-4.0, 4.0), (-4.0, -4.0)]
    rings = [star, notch, notch[:-1], notch[::-1], [(1.0, 1.0)] * 4, [(0.0, 0.0), (4.0, 0.0), (0.0, 0.0)], [(x * 90 - 90, y * 90 - 90) for x, y in SQUARE], star,
             [(50.0, 50.0), (51.0, 50.0), (51.0, 51.0), (50.0, 50.0)], None]
    areas = spark.createDataFrame(list(enumerate(rings)), f"area_id int, ring {RING}")
    places = [(i, (i * 7 % 83) / 8 - 5, (i * 5 % 83) / 8 - 5) for i in range(900)] + [(900 + i, 0.0, -0.0) for i in range(300)] + [(2000, None, 1.0)]
    points = spark.createDataFrame(places, "p int, lon double, lat double")
    west, south, east, north = spatial.ring_bounds(F.col("ring"))  # an open ring holds points beyond its bounds by the crossing rule alone
    bounded = F.col("lon").between(west, east) & F.col("lat").between(south, north)
    want = points.join(areas, bounded & G.ring_contains(F.col("ring"), F.col("lon"), F.col("lat"))).groupBy("area_id").agg(F.count("p"), F.sum("p"))
    got = spatial.totals_in_rings(points, areas, {"n": F.lit(1).cast("bigint"), "s": F.col("p")}, crowded)
    assert {tuple(r) for r in got.select("area_id", "n", "s").collect()} == {tuple(r) for r in want.collect()}
    assert spatial.totals_in_rings(points, areas.limit(0), {"n": F.lit(1)}).count() == 0


def test_footprint_uses_cell_centres(spark):
    area = spark.createDataFrame([(1, 5.0, 5.0, 95.0, 55.0, [(5.0, 5.0), (95.0, 5.0), (95.0, 55.0), (5.0, 55.0), (5.0, 5.0)])],
                                 f"area_id int, west double, south double, east double, north double, ring {RING}")
    grid = spatial.snapped_grid(area)
    assert tuple(grid.select("width", "height").first()) == (5, 3)
    assert spatial.footprint_cells(grid).count() == 15


def test_map_projection_and_boxes(spark):
    x, y = G.mercator_xy(F.lit(0.0), F.lit(0.0))
    _, top = G.mercator_xy(F.lit(0.0), F.lit(90.0))
    row = spark.range(1).select(x, y, top).first()
    assert row[0] == 0.5 and row[1] == pytest.approx(0.5) and row[2] == pytest.approx(0, abs=1e-9)
    texts = ["1,2,3,4", "1,2,3", "1,2,3,x", "3,2,1,4", "1e1,2,3,4", None, "-200,2,3,4"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(G.parse_bbox(F.col("t"))).collect()]
    assert tuple(got[0]) == (1, 2, 3, 4) and got[1:] == [None] * 6
