"""The tiles of many extents, of any size: boxes, and rings around a centre.

A box is parted in stages like a quadtree: into blocks of tiles, these into blocks STEP times as fine, down to
tiles. A row never holds more than about STEP * STEP parts, and the parts of a large extent are dealt over
tasks before the next stage, so that an extent of millions of tiles is the work of many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import tile_x, tile_y, wrap_longitude
from .crowds import numbered

STEP = 32


def _tiles(extents: DataFrame, key: str, z: int, *more: str) -> DataFrame:
    """(key, more, x, y): x counts on beyond the last column of the map, of extents with x0, x1, y0, y1."""
    side = 1
    while side < 1 << z:
        side *= STEP
    rows = extents.select(key, *more, "x0", "x1", "y0", "y1", F.lit(0).cast("long").alias("_bx"), F.lit(0).cast("long").alias("_by"), F.lit(True).alias("_whole"))
    while True:
        # The parts of this side that lie in the extent and in the block that is parted.
        outer = side * STEP
        spans = []
        for b, low, high in (("_bx", "x0", "x1"), ("_by", "y0", "y1")):
            first = F.when(F.col("_whole"), F.col(low)).otherwise(F.greatest(F.col(low), F.col(b) * outer))
            last = F.when(F.col("_whole"), F.col(high)).otherwise(F.least(F.col(high), (F.col(b) + 1) * outer - 1))
            spans.append(F.sequence(F.floor(first / side), F.floor(last / side)))
        rows = rows.select(key, *more, "x0", "x1", "y0", "y1", F.explode(spans[0]).alias("_bx"), F.col("_by").alias("_old"), F.col("_whole"), spans[1].alias("_ys"))
        rows = rows.select(key, *more, "x0", "x1", "y0", "y1", "_bx", F.explode("_ys").alias("_by"), F.lit(False).alias("_whole"))
        if side == 1:
            return rows.select(key, *more, F.col("_bx").alias("x"), F.col("_by").alias("y"))
        rows = rows.repartition(key, "_bx", "_by")
        side //= STEP


def box_tiles(boxes: DataFrame, key: str, z: int = 14) -> DataFrame:
    """(key, x, y, distance, rank) of boxes (key, west, south, east, north): every tile of the level that meets
    the box, nearest to the middle's tile first (rank from 1; of equal distances the western, then the northern
    one). Boxes with west > east go over the date line; boxes without all four sides, or with south > north,
    have no tiles."""
    n = 1 << z
    ok = "west IS NOT NULL AND east IS NOT NULL AND south <= north"
    wraps = F.col("west") > F.col("east")
    middle = wrap_longitude(F.col("west") + (F.col("east") - F.col("west") + F.when(wraps, 360.0).otherwise(0.0)) / 2)
    x0 = tile_x("west", z).cast("long")
    rows = boxes.where(ok).select(key, x0.alias("x0"), (tile_x("east", z).cast("long") + F.when(wraps, n).otherwise(0)).alias("x1"), tile_y("north", z).cast("long").alias("y0"), tile_y("south", z).cast("long").alias("y1"), tile_x(middle, z).cast("long").alias("_cx"), tile_y((F.col("south") + F.col("north")) / 2, z).cast("long").alias("_cy"))
    # Once round the map at most; the middle lies between both ends.
    rows = rows.withColumns({"x1": F.least(F.col("x1"), F.col("x0") + n - 1), "_cx": F.col("_cx") + F.when(F.col("_cx") < F.col("x0"), n).otherwise(0)})
    tiles = _tiles(rows, key, z, "_cx", "_cy")
    dx, dy = F.col("x") - F.col("_cx"), F.col("y") - F.col("_cy")
    ranked = numbered(tiles.select(key, "x", "y", (dx * dx + dy * dy).alias("_far")), key, ["_far", "x", "y"], "rank")
    return ranked.select(key, F.pmod("x", F.lit(n)).alias("x"), "y", F.sqrt("_far").alias("distance"), (F.col("rank") + 1).alias("rank"))


def ring_tiles(centers: DataFrame, key: str, radius: str = "radius", z: int = 14) -> DataFrame:
    """(key, x, y, ring, rank) of centres (key, lon, lat, radius): the centre's tile and the rings around it, in
    the order of a spiral (rank from 1): each ring eastward along its north side, then south, west and north.
    Tiles beyond the poles are left out, those beyond the date line are on its other side."""
    n = 1 << z
    reach = F.least(F.greatest(F.col(radius).cast("long"), F.lit(0)), F.lit(n // 2 - 1))
    rows = centers.where("lon IS NOT NULL AND lat IS NOT NULL").select(key, tile_x("lon", z).cast("long").alias("_cx"), tile_y("lat", z).cast("long").alias("_cy"), reach.alias("_r"))
    rows = rows.select(key, "_cx", "_cy", (F.col("_cx") - F.col("_r")).alias("x0"), (F.col("_cx") + F.col("_r")).alias("x1"), F.greatest(F.col("_cy") - F.col("_r"), F.lit(0)).alias("y0"), F.least(F.col("_cy") + F.col("_r"), F.lit(n - 1)).alias("y1"))
    tiles = _tiles(rows, key, z, "_cx", "_cy")
    dx, dy = F.col("x") - F.col("_cx"), F.col("y") - F.col("_cy")
    r = F.greatest(F.abs(dx), F.abs(dy))
    along = F.when((dy == -r) & (dx < r), dx + r).when((dx == r) & (dy < r), dy + 3 * r).when((dy == r) & (dx > -r), 5 * r - dx).otherwise(7 * r - dy)
    rank = F.when(r == 0, F.lit(1)).otherwise((2 * r - 1) * (2 * r - 1) + along + 1)
    return tiles.select(key, F.pmod("x", F.lit(n)).alias("x"), "y", r.alias("ring"), rank.cast("long").alias("rank"))
