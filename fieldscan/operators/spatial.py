"""Containment joins and regular grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscan import constants as C
from fieldscan.functions import geometry as G
from fieldscan.functions.reflectance import is_finite
from fieldscan.session import checkpointed, spread as dealt_out


def area_contains(area: str, lon: Column, lat: Column) -> Column:
    """Containment for an area struct: kind plus lon/lat, west..north or ring."""
    a = F.col(area)
    return (F.when(a["kind"] == "Point", (a["lon"] == lon) & (a["lat"] == lat))
            .when(a["kind"] == "BoundingBox", G.bbox_contains(a["west"], a["south"], a["east"], a["north"], lon, lat))
            .when(a["kind"] == "Polygon", G.ring_contains(a["ring"], lon, lat)))


def ring_bounds(ring: Column) -> tuple[Column, Column, Column, Column]:
    lons, lats = F.transform(ring, lambda v: v["lon"]), F.transform(ring, lambda v: v["lat"])
    return F.array_min(lons), F.array_min(lats), F.array_max(lons), F.array_max(lats)


BOUNDS = ("west", "south", "east", "north")
#: Degrees of a cell of level 0; a cell of level n is 2**n times narrower.
ROOT_DEGREES = 360.0
FINEST_LEVEL = 20
#: Levels below that of its bounds at which an area is cut into cells to be summed.
FINER = 4
#: Cells along one side of a crowded cell that is cut.
CUT = 4
#: A cell is crowded if it holds more than this share (1 / HOT_SHARE) of the points, and at least CROWDED_POINTS.
HOT_SHARE = 1_000
CROWDED_POINTS = 50_000


def cell_degrees(level: Column) -> Column:
    return F.lit(ROOT_DEGREES) / F.pow(F.lit(2.0), level)


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / cell_degrees(level))


def area_cells(areas: DataFrame, finer: int = 0) -> DataFrame:
    """``areas`` with bounds and their cells (level, cx, cy), at most four for an area of any size.

    An area's level is the finest whose cells are as wide and as high as its bounds, plus ``finer``.
    """
    west, south, east, north = ring_bounds(F.col("ring"))
    boxed = areas.withColumns({"west": west, "south": south, "east": east, "north": north})
    extent = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"))
    guess = F.when(extent > 0, F.least(F.floor(F.log2(F.lit(ROOT_DEGREES) / extent)), F.lit(FINEST_LEVEL))).otherwise(F.lit(FINEST_LEVEL))
    levelled = boxed.withColumn("level", guess.cast("int")).withColumn(
        "level", F.when(extent > cell_degrees(F.col("level")), F.col("level") - 1).otherwise(F.col("level")) + finer)  # rounding of the logarithm
    sides = {c: _cell(F.col(side), F.col("level")) for c, side in (("x0", "west"), ("x1", "east"), ("y0", "south"), ("y1", "north"))}
    return levelled.withColumn("cx", F.explode(F.sequence(sides["x0"], sides["x1"]))) \
        .withColumn("cy", F.explode(F.sequence(sides["y0"], sides["y1"])))


def _part(value: Column, cell: Column, level: Column) -> Column:
    """Which of the CUT parts of a cell, along one side, holds the value; beyond its ends the outermost."""
    return F.greatest(F.lit(0), F.least(F.lit(CUT - 1), F.floor((value / cell_degrees(level) - cell) * CUT)))


def _places_in_shapes(points: DataFrame, areas: DataFrame, crowded_points: int) -> DataFrame:
    """Inner join of places (lon, lat) to rings (shape, ring) that contain them, without the ring.

    Both sides meet on cells, so the join is an equi join: an area lies in at most four cells of its
    own level, a point in one cell of every level in use, and the exact test runs on what meets. Points
    per cell are counted. A crowded cell is cut into parts, to which only the areas reaching them are
    copied, and a part that is still crowded into salts by its count, so no task
    gets more than about a HOT_SHARE of the points. At most HOT_SHARE cells a level can be crowded,
    which bounds the broadcast table of parts.
    """
    placed = area_cells(areas)
    levels = [r["level"] for r in placed.select("level").distinct().collect()]  # FINEST_LEVEL + 1 and a few coarser
    if not levels:
        levels = [0]
    columns = points.columns
    level = F.col("level")
    spread = points.withColumn("level", F.explode(F.array(*[F.lit(n) for n in sorted(levels)]))).withColumns(
        {"cx": _cell(F.col("lon"), level), "cy": _cell(F.col("lat"), level)})
    cell = ["level", "cx", "cy"]
    total = points.count()
    crowded = spread.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")) \
        .where((F.col("_n") >= crowded_points) & (F.col("_n") * HOT_SHARE > total)).drop("_n")
    parts = (_part(F.col("lon"), F.col("cx"), level) * CUT + _part(F.col("lat"), F.col("cy"), level)).cast("int")
    salts = F.least(F.lit(HOT_SHARE), F.ceil(F.col("_n") * HOT_SHARE / F.lit(max(total, 1)))).cast("int")
    cut = checkpointed(spread.join(F.broadcast(crowded), cell).groupBy(*cell, parts.alias("part"))
                       .agg(F.count(F.lit(1)).alias("_n")).select(*cell, "part", salts.alias("salts")))

    keyed_points = spread.withColumn("part", parts).join(F.broadcast(cut), [*cell, "part"], "left").withColumns({
        "part": F.when(F.col("salts").isNotNull(), F.col("part")).otherwise(F.lit(-1)),
        "salt": F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64(*columns), F.col("salts"))).otherwise(F.lit(0)).cast("int")})
    keyed = placed.join(F.broadcast(cut), cell, "left")
    x, y = F.floor(F.col("part") / CUT), F.col("part") % CUT
    reaches = F.col("part").isNull() | (x.between(_part(F.col("west"), F.col("cx"), level), _part(F.col("east"), F.col("cx"), level))
                                        & y.between(_part(F.col("south"), F.col("cy"), level), _part(F.col("north"), F.col("cy"), level)))
    keyed_areas = keyed.where(reaches).withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))) \
        .withColumn("part", F.coalesce("part", F.lit(-1))).select("shape", G.ring_edges(F.col("ring")).alias("edges"), *BOUNDS, *cell, "part", "salt")
    lon, lat = F.col("lon"), F.col("lat")
    in_bounds = lon.between(F.col("west"), F.col("east")) & lat.between(F.col("south"), F.col("north"))  # cheap, and first
    return keyed_points.drop("salts").join(keyed_areas, [*cell, "part", "salt"]) \
        .where(in_bounds & G.edges_contain(F.col("edges"), lon, lat)).select(*columns, "shape")


def _shapes(areas: DataFrame) -> DataFrame:
    """(shape, ring): the distinct rings, numbered once."""
    return checkpointed(areas.where(F.col("ring").isNotNull()).select("ring").distinct()
                        .withColumn("shape", F.monotonically_increasing_id()))


def _members(areas: DataFrame, shapes: DataFrame) -> DataFrame:
    """``areas`` with the shape that each of them has."""
    return areas.join(shapes, "ring").select(*areas.columns, "shape")


def points_in_rings(points: DataFrame, areas: DataFrame, crowded_points: int = CROWDED_POINTS) -> DataFrame:
    """Inner join of points (lon, lat) to areas (area_id, ring) that contain them.

    Only distinct places are tested, and only against distinct rings; points that share a place and
    areas that share a ring come back by equi joins, whose work is that of the rows they put out. Points
    of a place that holds more than a HOT_SHARE of them are dealt to salts, and its areas copied to each;
    at most HOT_SHARE places can be so crowded, which bounds that broadcast table.
    """
    shapes = _shapes(areas)
    place = ["lon", "lat"]
    places = checkpointed(points.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
                          .groupBy(*place).agg(F.count(F.lit(1)).alias("_n")))
    total = places.agg(F.sum("_n")).first()[0] or 0
    salts = F.least(F.lit(HOT_SHARE), F.ceil(F.col("_n") * HOT_SHARE / F.lit(max(total, 1)))).cast("int")
    hot = places.where((F.col("_n") >= crowded_points) & (F.col("_n") * HOT_SHARE > total)).select(*place, salts.alias("_salts"))
    found = _places_in_shapes(places.select(*place), shapes, crowded_points).join(_members(areas, shapes), "shape").drop("shape")
    copied = found.join(F.broadcast(hot), place, "left") \
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    dealt = points.join(F.broadcast(hot), place, "left").select(
        *points.columns, F.coalesce(F.pmod(F.xxhash64(*points.columns), F.col("_salts")).cast("int"), F.lit(0)).alias("_salt"))
    return dealt.join(copied, [*place, "_salt"]).select(*points.columns, *areas.columns)


def _covering_cells(shapes: DataFrame) -> DataFrame:
    """(shape, bounds, level, cx, cy, inside, edges): the cells a ring covers, cut FINER levels below its bounds.

    A cell that no edge comes near lies inside as a whole or is left out, for a closed ring of finite vertices. Any
    other cell keeps the edges that reach its latitudes; no others decide about its points.
    """
    level, ring = F.col("level"), F.col("ring")
    plain = (F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1)) & F.forall(ring, lambda v: is_finite(v["lon"]) & is_finite(v["lat"]))
    cells = area_cells(shapes.withColumns({"edges": G.ring_edges(ring), "plain": F.coalesce(plain, F.lit(False))}), FINER)
    size = cell_degrees(level)
    margin = size * 1e-6  # far above the rounding of a point's cell
    west, south = F.col("cx") * size - margin, F.col("cy") * size - margin
    east, north = (F.col("cx") + 1) * size + margin, (F.col("cy") + 1) * size + margin
    near = F.exists("edges", lambda e: G.segment_nears_box(e["a"], e["b"], west, south, east, north))
    whole = cells.withColumn("whole", F.col("plain") & F.coalesce(~near, F.lit(False)))
    inside = F.col("whole") & G.edges_contain(F.col("edges"), (F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size)
    reaching = F.filter("edges", lambda e: (F.least(e["a"]["lat"], e["b"]["lat"]) <= north) & (F.greatest(e["a"]["lat"], e["b"]["lat"]) >= south))
    return whole.withColumn("inside", inside).where(~F.col("whole") | F.col("inside")).select(
        "shape", *BOUNDS, "level", "cx", "cy", "inside", F.when(~F.col("inside"), reaching).alias("edges"))


def totals_in_rings(points: DataFrame, areas: DataFrame, totals: dict[str, Column],
                    crowded_points: int = CROWDED_POINTS) -> DataFrame:
    """(areas, totals) of every area that holds a point; each total is a column of ``points`` to be summed.

    Points are summed by place, and places by cell. A distinct ring takes the sums of the cells that lie
    inside it and tests only the places of cells that its edges come near, so no pair of a point and an
    area is made. The places of a cell are dealt to salts of about ``crowded_points``.
    """
    shapes = _shapes(areas)
    places = checkpointed(points.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
                          .groupBy("lon", "lat").agg(*[F.sum(c).alias(n) for n, c in totals.items()]))
    cells = checkpointed(_covering_cells(dealt_out(shapes)))
    levels = sorted(r["level"] for r in cells.select("level").distinct().collect()) or [FINER]
    level, cell = F.col("level"), ["level", "cx", "cy"]
    lon, lat = F.col("lon"), F.col("lat")
    spread = places.withColumn("level", F.explode(F.array(*[F.lit(n) for n in levels]))).withColumns(
        {"cx": _cell(lon, level), "cy": _cell(lat, level)})
    sums = spread.groupBy(*cell).agg(*[F.sum(n).alias(n) for n in totals], F.count(F.lit(1)).alias("_n"))
    whole = cells.where("inside").select("shape", *cell).join(sums, cell).select("shape", *totals)

    salts = F.ceil(F.col("_n") / F.lit(crowded_points)).cast("int")
    crowded = F.broadcast(sums.where(F.col("_n") > crowded_points).select(*cell, salts.alias("salts")))
    cut = cells.where("NOT inside").join(crowded, cell, "left") \
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))).drop("salts", "inside")
    dealt = spread.join(crowded, cell, "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64("lon", "lat"), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
    in_bounds = lon.between(F.col("west"), F.col("east")) & lat.between(F.col("south"), F.col("north"))
    tested = dealt.join(cut, [*cell, "salt"]).where(in_bounds & G.edges_contain(F.col("edges"), lon, lat)).select("shape", *totals)
    summed = whole.union(tested).groupBy("shape").agg(*[F.sum(n).alias(n) for n in totals])
    return _members(areas, shapes).join(summed, "shape").drop("shape")


def snapped_grid(areas: DataFrame, metres: int = C.GRID_METRES) -> DataFrame:
    """Outward-snapped bounds and size of each projected bounding box."""
    return areas.withColumns({
        "grid_west": F.floor(F.col("west") / metres) * metres, "grid_south": F.floor(F.col("south") / metres) * metres,
        "grid_east": F.ceil(F.col("east") / metres) * metres, "grid_north": F.ceil(F.col("north") / metres) * metres}) \
        .withColumns({"width": ((F.col("grid_east") - F.col("grid_west")) / metres).cast("bigint"),
                      "height": ((F.col("grid_north") - F.col("grid_south")) / metres).cast("bigint")})


def footprint_cells(grids: DataFrame, metres: int = C.GRID_METRES) -> DataFrame:
    """Cells whose centre lies in the area's ring: (area_id, cell_x, cell_y).

    Rows are generated first and columns after a repartition, so one large area
    spreads over all tasks instead of exploding in one.
    """
    rows = grids.where((F.col("width") > 0) & (F.col("height") > 0)) \
        .withColumn("cell_y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("height") - 1))) \
        .repartition("area_id", "cell_y")
    cells = rows.withColumn("cell_x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("width") - 1)))
    x = F.col("grid_west") + (F.col("cell_x") + 0.5) * metres
    y = F.col("grid_north") - (F.col("cell_y") + 0.5) * metres
    return cells.where(G.ring_contains(F.col("ring"), x.cast("double"), y.cast("double"))) \
        .select("area_id", "cell_x", "cell_y")
