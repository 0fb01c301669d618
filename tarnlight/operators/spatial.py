"""Nearest body, creation on miss, escalating radius, points in polygons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlight.functions import fixed as K
from tarnlight.functions import rules as R
from tarnlight.scratch import drop, materialize, temporary

METRES = math.pi * K.EARTH_RADIUS / 180


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """great-circle metres on a sphere of the mean radius, at most 0.56% from the spheroid."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * K.EARTH_RADIUS) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def cell_row(lat: Column, size: float) -> Column:
    return F.floor(lat * F.lit(METRES / size)).cast("bigint")


def _columns(row: Column, size: float) -> Column:
    """How many cells a row has: each at least ``size`` metres wide where the row is widest in degrees."""
    edge = F.least(F.lit(89.0), F.greatest(F.abs(row), F.abs(row + 1)) * F.lit(size / METRES))
    width = F.lit(size / METRES) / F.cos(F.radians(edge))
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) / width))


def cell_column(row: Column, lon: Column, size: float) -> Column:
    n = _columns(row, size)
    return F.pmod(F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * n), n).cast("bigint")


def _cells(row: Column, lon: Column, radius: float, around: bool) -> Column:
    """The cell of a row that a longitude lies in; around: with its neighbours."""
    n, at = _columns(row, radius), cell_column(row, lon, radius)
    columns = F.array(*[F.pmod(at + d, n) for d in ((-1, 0, 1) if around else (0,))])
    return F.transform(F.array_distinct(columns), lambda c: F.struct(row.cast("bigint").alias("row"), c.cast("bigint").alias("col")))


def with_cells(df: DataFrame, radius: float, around: bool = False) -> DataFrame:
    """A row for each cell: the own one, or those that anything within ``radius`` metres can lie in."""
    lat, lon = F.col("latitude"), F.col("longitude")
    rows = F.array(*[cell_row(lat, radius) + d for d in ((-1, 0, 1) if around else (0,))])
    return df.withColumn("cell", F.explode(F.array_distinct(F.flatten(F.transform(rows, lambda r: _cells(r, lon, radius, around))))))


#: A cell is dense with more points than this, and than a share of all points that at most ``DENSE_CELLS`` cells can have.
DENSE, DENSE_CELLS = 100_000, 4096


def dense_cells(points: DataFrame, radius: float, dense: int = DENSE) -> DataFrame:
    """(cell, parts) of the cells with more points than a task should have, each to be cut in parts; at most ``DENSE_CELLS`` rows."""
    counts = with_cells(points.select("latitude", "longitude"), radius).groupBy("cell").agg(F.count("*").alias("n"))
    limit = counts.agg(F.greatest(F.lit(dense), F.ceil(F.sum("n") / DENSE_CELLS)).alias("most"))
    found = counts.crossJoin(F.broadcast(limit)).where("n > most")  # one row
    return found.select("cell", F.ceil(F.col("n") / F.col("most")).cast("int").alias("parts"))


def within_radius(points: DataFrame, others: DataFrame, radius: float, dense: int | None = None) -> DataFrame:
    """All pairs within ``radius`` metres: ``points``, ``others`` under o_ names, distance. An equi-join on grid cells.

    The smaller side should be ``others``, whose rows are repeated for nine cells. With ``dense``, cells are counted first;
    points of a cell with more than so many are dealt over parts by a hash of the row, and the others that they may meet are
    repeated for each part. Points that lie at one place are dealt too, as no finer grid could.
    """
    left, right = with_cells(points, radius), with_cells(others, radius, around=True)
    right = right.select(F.col("cell").alias("_cell"), *[F.col(c).alias(f"o_{c}") for c in others.columns])
    on = F.col("cell") == F.col("_cell")
    if dense is not None:
        cut = F.broadcast(dense_cells(points, radius, dense).toDF("_dense", "_parts"))  # at most DENSE_CELLS rows
        plain = [F.col(f"`{n}`") for n, kind in points.dtypes if not kind.startswith(("map", "variant"))]
        left = left.join(cut, F.col("cell") == F.col("_dense"), "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*plain), F.col("_parts")), F.lit(0)).cast("int")).drop("_dense", "_parts")
        right = right.join(cut, F.col("_cell") == F.col("_dense"), "left").withColumn("_of", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_dense", "_parts")
        on &= F.col("_part") == F.col("_of")
    met = left.join(right, on).drop("cell", "_cell", "_part", "_of")
    met = met.withColumn("distance", haversine(F.col("latitude"), F.col("longitude"), F.col("o_latitude"), F.col("o_longitude")))
    return met.where(F.col("distance") <= radius)


def nearest_within(reports: DataFrame, bodies: DataFrame, radius: float = K.MATCH_RADIUS, key: str | tuple[str, ...] = "report_id", dense: int | None = DENSE) -> DataFrame:
    """(key, body_id, distance) of the nearest body, of equally near ones the smallest id. No match: no row. Dense cells are dealt."""
    keys = [key] if isinstance(key, str) else list(key)
    met = within_radius(reports.select(*dict.fromkeys([*keys, "latitude", "longitude"])), bodies.select("id", "latitude", "longitude"), radius, dense)
    best = met.groupBy(*keys).agg(F.min(F.struct("distance", F.col("o_id").alias("id"))).alias("m"))
    return best.select(*keys, F.col("m.id").alias("body_id"), F.col("m.distance").alias("distance"))


def _turn(age: int, created_at: Column, report_id: Column) -> Column:
    """The order in which places found bodies: those made before all of these, then by time and report."""
    return F.struct(F.lit(age).alias("age"), created_at.alias("created_at"), report_id.alias("report_id"), F.col("latitude"), F.col("longitude"))


def create_on_miss(misses: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """(latitude, longitude, founder, founder_latitude, founder_longitude, distance), a row for each distinct place of ``misses``.

    In the order of created_at and report_id, each miss joins the nearest body made before it within the radius, or makes
    one; ``founder`` is the report that made it. ``made`` (founder, latitude, longitude) are bodies that were made before all
    of these. Misses at one place are led by the earliest.
    """
    from tarnlight.operators.founders import choose

    with temporary(misses.sparkSession):
        led = misses.groupBy("latitude", "longitude").agg(F.min(F.struct("created_at", "report_id")).alias("first"))
        places = materialize(led.select("latitude", "longitude", _turn(1, F.col("first.created_at"), F.col("first.report_id")).alias("at")), "places")
        if made is not None:
            kinds = dict(places.select("at.created_at", "at.report_id").dtypes)
            made = made.select("latitude", "longitude", _turn(0, F.lit(None).cast(kinds["created_at"]), F.col("founder").cast(kinds["report_id"])).alias("at"))
        founders, _ = choose(places, made)
        met = within_radius(places, founders, K.MATCH_RADIUS).where(F.col("o_at") <= F.col("at"))
        best = met.groupBy("latitude", "longitude").agg(F.min(F.struct("distance", "o_at")).alias("m"))
        best = best.select("latitude", "longitude", F.col("m.o_at").alias("o"), F.col("m.distance").alias("distance"))
        out = best.select("latitude", "longitude", F.col("o.report_id").alias("founder"), F.col("o.latitude").alias("founder_latitude"), F.col("o.longitude").alias("founder_longitude"), "distance")
        return materialize(out, "made", keep=True)


def resolve_bodies(reports: DataFrame, bodies: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """J1 then J2: ``reports`` with body_id, body_name, distance, founder_latitude and founder_longitude; a row for each row.

    New bodies have the id ``new-`` and their founder's report id, and their founder's place; known ones no such place. Places
    are matched once, however many reports lie at one. Reports without a place on earth stay, without a body. Of reports that
    repeat an id each is matched by its own place. ``made`` (founder, latitude, longitude) are bodies made from earlier reports.
    """
    on_earth = F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)
    at = ["latitude", "longitude"]
    led = reports.where(on_earth).groupBy(*at).agg(F.min(F.struct("created_at", "report_id")).alias("first")).select(*at, "first.*")
    led = materialize(led, "places", keep=True)
    hit = nearest_within(led, bodies, key=("latitude", "longitude")).join(bodies.select(F.col("id").alias("body_id"), F.col("name").alias("body_name")), "body_id")
    hit = materialize(hit.select(*at, F.col("body_id").cast("string").alias("body_id"), "body_name", "distance"), "hits", keep=True)
    new = create_on_miss(led.join(hit, at, "left_anti"), made)
    new = new.select(
        *at, F.concat(F.lit("new-"), F.col("founder").cast("string")).alias("body_id"), R.unnamed(F.col("founder_latitude"), F.col("founder_longitude")).alias("body_name"),
        "distance", "founder_latitude", "founder_longitude",
    )
    drop(led)
    return reports.join(hit.unionByName(new, allowMissingColumns=True), at, "left").select(*reports.columns, "body_id", "body_name", "distance", "founder_latitude", "founder_longitude")


def point_metrics(points: DataFrame, pixels: DataFrame, as_of: str, lookback: int = K.LOOKBACK_DAYS, max_cloud: float = 80) -> DataFrame:
    """For each point (id, latitude, longitude) the water index around it at the first radius with enough water.

    pixels: latitude, longitude, pixel_id, scene_id, sensed_date, cloudy_pct, b3, b4, b5, b8, scl. Per-pixel band medians of
    the unmasked scenes of the lookback, then water (NDWI > 0), then the mean index, for all radii in one pass. Points
    without a good radius have no index and a reason. What lies around a place is counted once, however many points are there.
    """
    from tarnlight.operators.satellite import composite, scenes

    end = F.lit(as_of).cast("timestamp").cast("date")
    seen = scenes(pixels, max_cloud).where((F.col("sensed_date") >= F.date_sub(end, lookback)) & (F.col("sensed_date") < end))
    at, radii = ["o_latitude", "o_longitude"], F.lit(list(K.BUFFERS))
    met = within_radius(seen, points.select("latitude", "longitude").distinct(), float(K.BUFFERS[-1]), DENSE)
    met = met.withColumn("radii", F.filter(radii, lambda b: b >= F.col("distance")))
    # a scene counts in each radius from the least that has a pixel of it
    first = met.groupBy(*at, "scene_id").agg(F.min(F.col("radii")[0]).alias("first")).groupBy(*at, "first").agg(F.count("scene_id").alias("n"))
    counts = first.select(*at, "n", F.explode(F.filter(radii, lambda b: b >= F.col("first"))).alias("buffer_m")).groupBy(*at, "buffer_m").agg(F.sum("n").alias("n_scenes"))
    clear = met.where(~F.col("scl").isin(*K.MASKED_SCL)).withColumn("buffer_m", F.explode("radii"))
    water = composite(clear, *at, "buffer_m", "pixel_id").where("ndwi > 0")
    stats = water.groupBy(*at, "buffer_m").agg(F.avg("ndci").alias("ndci"), F.count("ndci").alias("px"))
    stats = counts.join(stats, [*at, "buffer_m"], "left")
    enough = (F.col("px") >= K.MIN_WATER_PIXELS) & F.col("ndci").isNotNull()
    good = F.min(F.when(enough, F.struct("buffer_m", "ndci", "px", "n_scenes"))).alias("m")
    places = stats.groupBy(F.col("o_latitude").alias("latitude"), F.col("o_longitude").alias("longitude")).agg(good, F.max("n_scenes").alias("most"))
    out = points.select("id", "latitude", "longitude").join(places, ["latitude", "longitude"], "left")
    return out.select(
        "id", F.col("m").isNotNull().alias("available"), F.round("m.ndci", 4).alias("live_ndci"), F.col("m.px").alias("water_pixel_count"),
        F.col("m.buffer_m").alias("buffer_m"), R.spatial_confidence(F.col("m.buffer_m")).alias("spatial_confidence"), F.col("m.n_scenes").alias("scenes_used"),
        F.when(F.col("m").isNull(), R.unavailable_reason(F.col("most"))).alias("reason"),
    )


#: Rows and columns of a region's own grid at most, and the edges that it has for each of them: a triangle is one cell.
GRID, EDGES = 32, 8
#: Regions are found by squares of a side of 2^level degrees, the least that is no shorter than their box.
LEVELS = (-20, 9)


def _crosses(e: Column, lon: Column, lat: Column) -> Column:
    """Whether an edge crosses the ray from a point to the right."""
    rise = (e["x2"] - e["x1"]) * F.try_divide(lat - e["y1"], e["y2"] - e["y1"])
    return F.coalesce(((e["y1"] > lat) != (e["y2"] > lat)) & (lon < rise + e["x1"]), F.lit(False))


def _odd(n: Column) -> Column:
    return n % 2 == 1


def region_cells(regions: DataFrame, grid: int = GRID) -> tuple[DataFrame, DataFrame]:
    """Regions (region, name, category, their box w, s, e, n, and the side of their cells) and cells (region, row, col, inside, base, edges) of their grids.

    A point is inside a region if a ray to the right crosses an odd number of edges of all its rings, so holes and parts need
    no treatment of their own. A region has a row and a column for every ``EDGES`` edges, up to ``grid``, so that small ones
    don't cost a thousand cells. Of a region's grid only cells inside, without edges, and border cells are kept. A border cell
    has the edges that touch it and those that end in its row further right; edges further right that cross its whole row
    are crossed by each ray of the cell and are only counted (``base``).
    """
    named = regions.where("rings is not null").withColumn("region", F.monotonically_increasing_id())
    named = materialize(named.select("region", "name", "category", "rings"), "regions", keep=True)
    ring = named.select("region", F.explode("rings").alias("r")).where(F.size("r") > 2)
    after = F.concat(F.slice("r", 2, F.size("r")), F.slice("r", 1, 1))
    edge = ring.select("region", F.explode(F.zip_with("r", after, lambda p, q: F.struct(p[0].alias("x1"), p[1].alias("y1"), q[0].alias("x2"), q[1].alias("y2")))).alias("e"))
    box = edge.groupBy("region").agg(F.min("e.x1").alias("w"), F.max("e.x1").alias("e_"), F.min("e.y1").alias("s"), F.max("e.y1").alias("n"), F.least(F.lit(grid), F.ceil(F.count("*") / EDGES)).cast("int").alias("grid"))
    box = box.select("region", "w", "s", "e_", "n", "grid", (F.greatest(F.col("e_") - F.col("w"), F.col("n") - F.col("s"), F.lit(1e-9)) / F.col("grid")).alias("side"))
    c, slack = F.col, F.lit(1e-6)
    place = lambda v, start, by: F.floor((v - start) / c("side") + by).cast("int")
    low, high = F.least("e.y1", "e.y2"), F.greatest("e.y1", "e.y2")
    rows = edge.join(box, "region").withColumn("row", F.explode(F.sequence(place(low, c("s"), -slack), place(high, c("s"), slack))))
    bottom, top = c("s") + c("row") * c("side"), c("s") + (c("row") + 1) * c("side")
    at = lambda y: c("e.x1") + (c("e.x2") - c("e.x1")) * F.try_divide(y - c("e.y1"), c("e.y2") - c("e.y1"))
    xa, xb = F.coalesce(at(F.greatest(low, bottom)), c("e.x1")), F.coalesce(at(F.least(high, top)), c("e.x2"))
    eps = c("side") * slack
    reach = F.struct(
        *[c(f"e.{k}").alias(k) for k in ("x1", "y1", "x2", "y2")], place(F.least(xa, xb), c("w"), -slack).alias("first"), place(F.greatest(xa, xb), c("w"), slack).alias("last"),
        ((low < bottom - eps) & (high > top + eps)).alias("whole"),
    )
    held = rows.groupBy("region", "row", "w", "s", "side", "grid").agg(F.collect_list(reach).alias("all"))
    cells = held.withColumn("col", F.explode(F.sequence(F.lit(-1), F.col("grid") + 1)))
    own = F.filter("all", lambda e: (e["first"] <= c("col")) & (e["last"] >= c("col")))
    right = F.filter("all", lambda e: e["first"] > c("col"))
    cells = cells.withColumns({"own": own, "right": right})
    x, y = c("w") + (c("col") + 0.5) * c("side"), c("s") + (c("row") + 0.5) * c("side")
    inside = (F.size("own") == 0) & _odd(F.size(F.filter("right", lambda e: _crosses(e, x, y))))
    cells = cells.withColumn("inside", inside).where(c("inside") | (F.size("own") > 0))
    edges = F.concat("own", F.filter("right", lambda e: ~e["whole"]))
    edges = F.transform(edges, lambda e: F.struct(*[e[k].alias(k) for k in ("x1", "y1", "x2", "y2")]))
    cells = cells.select("region", "row", "col", "inside", F.size(F.filter("right", lambda e: e["whole"])).alias("base"), F.when(~c("inside"), edges).alias("edges"))
    return named.select("region", "name", "category").join(box.withColumnRenamed("e_", "e").drop("grid"), "region"), materialize(cells, "cells", keep=True)


def in_region(pixels: DataFrame, regions: DataFrame, most: int = 500_000, grid: int = GRID) -> DataFrame:
    """Pixels with the name and category of each region (name, category, rings) that they lie in.

    Pixels meet regions by squares about as large as the region's box (a pixel looks in one square of each size that occurs), then
    look up their cell of the region's own grid: inside needs no edge, outside has no cell, and only on the border the cell's edges
    are counted (``region_cells``). Both tables are broadcast if they have at most ``most`` rows and edges together (some 20 MB).
    """
    boxed, cells = region_cells(regions, grid)
    extent = F.greatest(F.col("e") - F.col("w"), F.col("n") - F.col("s"))
    boxed = boxed.withColumn("level", F.greatest(F.lit(LEVELS[0]), F.least(F.lit(LEVELS[1]), F.coalesce(F.ceil(F.log2(extent)), F.lit(LEVELS[0])))).cast("int"))
    boxed = materialize(boxed, "boxes", keep=True)
    levels = F.broadcast(boxed.select(F.col("level").alias("size")).distinct())  # thirty rows at most
    at = lambda c, level: F.floor(F.col(c) / F.pow(F.lit(2.0), level)).cast("bigint")
    boxed = boxed.withColumn("cx", F.explode(F.sequence(at("w", F.col("level")), at("e", F.col("level"))))).withColumn("cy", F.explode(F.sequence(at("s", F.col("level")), at("n", F.col("level")))))
    size = cells.agg(F.coalesce(F.sum(F.coalesce(F.size("edges"), F.lit(0)) + 1), F.lit(0))).first()[0] + boxed.count()
    boxed, cells = (F.broadcast(boxed), F.broadcast(cells)) if size <= most else (boxed, cells)
    # the caller's columns travel in a struct, so that none of them is taken for one of a region's
    row = pixels.select(F.struct(*[F.col(f"`{c}`") for c in pixels.columns]).alias("pixel"), F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    row = row.crossJoin(levels).withColumns({"px": at("x", F.col("size")), "py": at("y", F.col("size"))})
    met = row.join(boxed, (F.col("size") == F.col("level")) & (F.col("px") == F.col("cx")) & (F.col("py") == F.col("cy"))).where(F.col("x").between(F.col("w"), F.col("e")) & F.col("y").between(F.col("s"), F.col("n")))
    met = met.withColumns({"row": F.floor((F.col("y") - F.col("s")) / F.col("side")).cast("int"), "col": F.floor((F.col("x") - F.col("w")) / F.col("side")).cast("int")})
    met = met.join(cells, ["region", "row", "col"])
    found = met.where(F.col("inside") | _odd(F.col("base") + F.size(F.filter("edges", lambda e: _crosses(e, F.col("x"), F.col("y"))))))
    return found.select(*[F.col("pixel")[c].alias(c) for c in pixels.columns], "name", "category")
