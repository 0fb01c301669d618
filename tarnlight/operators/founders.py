"""Which places found a body, each in its turn: a greedy choice in order, settled tile by tile."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.functions import fixed as K
from tarnlight.operators.spatial import METRES, cell_column, cell_row
from tarnlight.scratch import materialize

#: Metres of a tile's side. Rounds follow the tiles that a chain of places crosses, tasks hold one tile's open places.
TILE = 20_000.0
_OWN, _NEAR, _FOUND = 1, 2, 0
_WAITS, _FOUNDS = 1, 2


def _tiles(df: DataFrame, radius: float, tile: float) -> DataFrame:
    """A row for each tile within ``radius`` of a place, with its own one marked: the tiles of the corners of a box around it."""
    lat, lon = F.col("latitude"), F.col("longitude")
    dy = F.lit(radius / METRES)
    dx = dy / F.cos(F.radians(F.least(F.lit(89.0), F.abs(lat) + dy)))
    at = lambda y, x: F.struct(cell_row(y, tile).alias("row"), cell_column(cell_row(y, tile), x, tile).alias("col"))
    corners = F.array(at(lat, lon), *[at(lat + sy * dy, lon + sx * dx) for sy in (-1, 1) for sx in (-1, 1)])
    return df.withColumn("own", at(lat, lon)).withColumn("tile", F.explode(F.array_distinct(corners)))


def _settle(radius: float, tile: float):
    """What one round does with the rows of its tiles, which come in order: founders, places that wait for a neighbouring tile's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, {}
        lat0 = lon0 = dlat = dlon = 0.0

        def near(y: float, x: float) -> tuple[tuple[int, int], bool, bool]:
            """The place's cell, and whether a founder or a waiting place lies within the radius; a founder settles it."""
            dx = (x - lon0 + 180.0) % 360.0 - 180.0
            i, j = math.floor((y - lat0) / dlat), math.floor(dx / dlon)
            waits = False
            for a in (i, i - 1, i + 1):
                for b in (j, j - 1, j + 1):
                    for founds, points in enumerate(held.get((a, b), ())):
                        if founds or not waits:
                            for v, u in points:
                                h = math.sin(math.radians(y - v) / 2) ** 2 + math.cos(math.radians(v)) * math.cos(math.radians(y)) * math.sin(math.radians(x - u) / 2) ** 2
                                if 2 * K.EARTH_RADIUS * math.asin(min(1.0, math.sqrt(h))) <= radius:
                                    if founds:
                                        return (i, j), True, waits
                                    waits = True
                                    break
            return (i, j), False, waits

        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            status = []
            for row, col, kind, y, x in zip(*(column(c).to_pylist() for c in ("row", "col", "kind", "latitude", "longitude")), strict=True):
                if (row, col) != here:
                    here, held, lat0, lon0 = (row, col), {}, y, x
                    widest = min(89.0, (max(abs(row), abs(row + 1)) * tile + radius) / METRES)
                    dlat = radius / METRES
                    dlon = dlat / math.cos(math.radians(widest))
                cell, founded, waits = near(y, x)
                if kind == _FOUND or (not founded and not waits and kind == _OWN):
                    held.setdefault(cell, ([], []))[1].append((y, x))
                    status.append(_FOUNDS if kind == _OWN else 0)
                elif founded:
                    status.append(0)
                else:
                    # a place of another tile may be a founder there; what is near it has to wait
                    held.setdefault(cell, ([], []))[0].append((y, x))
                    status.append(_WAITS if kind == _OWN else 0)
            kept = pa.RecordBatch.from_arrays([column(c) for c in ("latitude", "longitude", "at")] + [pa.array(status, pa.int32())], ["latitude", "longitude", "at", "status"])
            yield kept.filter(pa.array([s > 0 for s in status], pa.bool_()))

    return run


def choose(places: DataFrame, made: DataFrame | None = None, radius: float = K.MATCH_RADIUS, tile: float = TILE) -> tuple[DataFrame, int]:
    """The founders among ``places`` (latitude, longitude, at), with those of ``made``, and the number of rounds.

    In the order of ``at``, a place becomes a founder if no founder before it lies within the radius. Each round settles in
    each tile all places whose earlier neighbours are settled, one task a tile; only places that wait for another tile's go
    into the next round. The earliest place left never waits, so the rounds end. A task streams through its tile's rows in
    order and holds founders, of which a tile has few, and waiting places.
    """
    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(made if made is not None else places.limit(0), "founders")
    open_, rounds = places, 0
    while True:
        rounds += 1
        dealt = _tiles(open_, radius, tile).withColumn("kind", F.when(F.col("tile") == F.col("own"), _OWN).otherwise(_NEAR))
        before = _tiles(found, radius, tile).withColumn("kind", F.lit(_FOUND)).join(dealt.select("tile").distinct(), "tile", "left_semi")
        rows = dealt.unionByName(before).select("tile.row", "tile.col", "kind", "latitude", "longitude", "at")
        ordered = rows.repartition(n, "row", "col").sortWithinPartitions("row", "col", "at")
        out = materialize(ordered.mapInArrow(_settle(radius, tile), places.select("latitude", "longitude", "at").schema.add("status", "integer")), "settled")
        found = materialize(found.unionByName(out.where(F.col("status") == _FOUNDS).drop("status")), "founders")
        open_ = out.where(F.col("status") == _WAITS).drop("status")
        if open_.isEmpty():
            return found, rounds
