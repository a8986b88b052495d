"""Polygons of any size and shape met by points, through cells of a quadtree.

A polygon is covered in stages: first by the cells about as large as its box (at most nine), then each cell
that its boundary crosses is parted in four, LEAST_DEPTH times at least and on while more than EDGES edges
cross it, or, DENSE_DEPTH times at most, while it holds many positions. Cells that no edge crosses are inside as a whole, or dropped; so a point inside a large polygon is
found by one key, whatever the number of vertices. A cell on the boundary keeps those edges that the even-odd
rule needs for points in it: the ones in its range of latitudes that aren't left of it; of those that every ray
from it crosses only their parity is kept. Nothing ever holds
more than one polygon's edges in a row, and a stage's rows lie along the boundaries.

Positions, each once however many points lie there, look their cell up on each level that covers have, and points
take what their position found. Positions with many points, and cells with many positions, are dealt over several
tasks, in a number that isn't cut down where rows are few bytes but meet many others.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import edge_crosses, on_edge, pairs, vertices
from ..functions.inputs import spread
from ..scratch import Scratch, stored
from .crowds import split_keys

EDGES, LEAST_DEPTH, DENSE_DEPTH, MOST_DEPTH, FINEST = 8, 2, 6, 14, 28
#: Positions that a cell on a boundary may well hold.
FEW_POSITIONS = 16
#: Positions of a cell that one task tests.
POSITIONS = 500
#: Numbers below this have a cross product of a point with an edge that it lies on.
ON_EDGE = 1e-12


def _side(z: Column) -> Column:
    return F.lit(360.0) / F.pow(F.lit(2.0), z)


def cell_of(degrees: Column, z: Column) -> Column:
    """The number of the cell of a level in which a longitude or latitude lies."""
    return F.floor((degrees + 180.0) / _side(z))


def _box(x: Column, y: Column, z: Column) -> dict[str, Column]:
    side = _side(z)
    return {"west": x * side - 180.0, "south": y * side - 180.0, "east": (x + 1) * side - 180.0, "north": (y + 1) * side - 180.0}


def _in_band(s: Column) -> Column:
    """Whether an edge may be crossed by a ray to the east from a point of the cell."""
    a, b = s["a"], s["b"]
    return (F.greatest(a["lat"], b["lat"]) >= F.col("south")) & (F.least(a["lat"], b["lat"]) <= F.col("north")) & (F.greatest(a["lon"], b["lon"]) >= F.col("west"))


def _crosses_cell(s: Column) -> Column:
    """Whether an edge meets the closed cell: their boxes do, and the corners aren't all on one side of it."""
    a, b = s["a"], s["b"]
    corners = [(b["lon"] - a["lon"]) * (F.col(y) - a["lat"]) - (b["lat"] - a["lat"]) * (F.col(x) - a["lon"]) for x in ("west", "east") for y in ("south", "north")]
    boxes = (F.least(a["lon"], b["lon"]) <= F.col("east")) & _in_band(s)
    return boxes & (F.least(*corners) <= ON_EDGE) & (F.greatest(*corners) >= -ON_EDGE)


def _beyond(s: Column) -> Column:
    """Whether every ray to the east from the cell crosses an edge, by more than rounding."""
    a, b = s["a"], s["b"]
    return (F.greatest(a["lat"], b["lat"]) > F.col("north") + 1e-9) & (F.least(a["lat"], b["lat"]) < F.col("south") - 1e-9) & (F.least(a["lon"], b["lon"]) > F.col("east") + 1e-9)


def _with_edges(cells: DataFrame) -> DataFrame:
    """cells with the edges of their band, how many of them cross the cell, and whether the number of those that
    all rays cross, which are left out, is odd."""
    boxed = cells.withColumns(_box(F.col("x"), F.col("y"), F.col("z")))
    banded = boxed.withColumn("edges", F.filter("edges", _in_band))
    banded = banded.withColumn("odd", F.col("odd") != (F.size(F.filter("edges", _beyond)) % 2 == 1)).withColumn("edges", F.filter("edges", lambda s: ~_beyond(s)))
    return banded.withColumn("crossing", F.size(F.filter("edges", _crosses_cell)))


def _odd(lon: Column, lat: Column, edges: Column) -> Column:
    return F.aggregate(edges, F.lit(False), lambda acc, s: acc != edge_crosses(lon, lat, s))


def _state(lon: Column, lat: Column, odd: Column, edges: Column) -> Column:
    """0 outside, 1 inside, 2 on an edge."""
    step = lambda acc, s: F.when((acc == 2) | on_edge(lon, lat, s), 2).when(edge_crosses(lon, lat, s), 1 - acc).otherwise(acc)
    return F.aggregate(edges, odd.cast("int"), step)


def _dense_level(positions: DataFrame) -> int:
    """The first level whose cells hold FEW_POSITIONS on average, if positions are even over their extent."""
    n, wide, high = positions.agg(F.count("*"), F.max("lon") - F.min("lon"), F.max("lat") - F.min("lat")).first()
    if n <= FEW_POSITIONS or not 0 < max(wide, high) < 720:
        return 0
    return math.ceil(math.log2(360 / max(wide, high) * math.sqrt(n / FEW_POSITIONS)))


def covers(polygons: DataFrame, key: str, dense: int = 0) -> DataFrame:
    """(key, z, x, y, inside, odd, edges) of polygons (key, parts): the cells of their covers, written. Cells that
    are inside as a whole have no edges. Polygons without an edge have no cells. Cells of levels before `dense`
    hold many positions."""
    scratch = Scratch(polygons.sparkSession)
    edges = F.flatten(F.flatten(F.transform("parts", lambda polygon: F.transform(polygon, pairs))))
    whole = polygons.select(F.col(key), edges.alias("edges"), vertices("parts").alias("all")).where(F.size("edges") > 0)
    whole = whole.withColumns({f"{m}_{c}": f(F.col("all")[c]) for c in ("lon", "lat") for m, f in (("low", F.array_min), ("high", F.array_max))}).drop("all")
    span = F.greatest(F.col("high_lon") - F.col("low_lon"), F.col("high_lat") - F.col("low_lat"), F.lit(360.0 / 2**FINEST))
    whole = whole.withColumn("z", F.greatest(F.lit(0), F.floor(F.log2(F.lit(360.0) / span)).cast("int")))
    along = lambda c: F.explode(F.sequence(cell_of(F.col(f"low_{c}"), F.col("z")), cell_of(F.col(f"high_{c}"), F.col("z"))))
    first = whole.select(key, "z", "edges", "low_lat", "high_lat", along("lon").alias("x")).select(key, "z", "edges", "x", along("lat").alias("y"))
    open_cells, done = _with_edges(first.withColumns({"depth": F.lit(0), "odd": F.lit(False)})), []
    for stage in range(MOST_DEPTH + 1):
        cells = scratch.written(open_cells, f"cells-{stage}")
        middle = (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2
        divided = (F.col("crossing") > 0) & (F.col("depth") < MOST_DEPTH) & (F.col("z") < FINEST) & ((F.col("depth") < LEAST_DEPTH) | (F.col("crossing") > EDGES) | ((F.col("z") < dense) & (F.col("depth") < DENSE_DEPTH)))
        none = F.array().cast(cells.schema["edges"].dataType)
        kept = cells.where(~divided).withColumn("inside", F.when(F.col("crossing") == 0, F.col("odd") != _odd(*middle, F.col("edges"))).otherwise(False)).where("inside OR crossing > 0")
        done.append(kept.select(key, "z", "x", "y", "inside", "odd", F.when(F.col("inside"), none).otherwise(F.col("edges")).alias("edges")))
        todo = cells.where(divided)
        if todo.isEmpty():
            break
        quarter = F.explode(F.sequence(F.lit(0), F.lit(3)))
        children = todo.select(key, (F.col("z") + 1).alias("z"), (F.col("depth") + 1).alias("depth"), "odd", "edges", "x", "y", quarter.alias("q"))
        open_cells = _with_edges(children.select(key, "z", "depth", "odd", "edges", (F.col("x") * 2 + F.col("q") % 2).alias("x"), (F.col("y") * 2 + F.floor(F.col("q") / 2)).alias("y")))
    out = scratch.written(reduce(DataFrame.unionByName, done), "covers")
    scratch.remove(*(f"cells-{k}" for k in range(stage + 1)))
    return out


def in_polygons(points: DataFrame, polygons: DataFrame, key: str, boundary: bool = False) -> DataFrame:
    """points (lon, lat, ...) with the key of each polygon (key, parts) that they lie in, and on_boundary.
    Points on an edge, of an outer ring or of a hole, count only if asked for. Longitudes are compared as they
    are; parts of one polygon mustn't overlap. A point in no polygon gives no row, nor does a null position."""
    known = points.where("lon IS NOT NULL AND lat IS NOT NULL")
    at = stored(known.select("lon", "lat").distinct())
    cells = covers(polygons.select(key, "parts"), key, _dense_level(at))
    levels = [r.z for r in cells.select("z").distinct().collect()]  # at most FINEST + 1 numbers
    name = f"_{key}"
    cells = cells.withColumnsRenamed({key: name, "z": "_z", "x": "_x", "y": "_y", "edges": "_edges", "inside": "_inside", "odd": "_odd"})
    if not levels:
        return points.crossJoin(cells.select(F.col(name).alias(key)).limit(0)).withColumn("on_boundary", F.lit(False))
    z, keys = F.col("_z"), ["_z", "_x", "_y"]
    at = at.withColumn("_z", F.explode(F.array(*map(F.lit, sorted(levels))))).withColumns({"_x": cell_of(F.col("lon"), z), "_y": cell_of(F.col("lat"), z)})
    left, right = split_keys(at, cells, keys, POSITIONS, F.xxhash64("lon", "lat"))
    met = spread(left, *keys, "_split").join(spread(right, *keys, "_split"), [*keys, "_split"])
    # As a generator the state is worked out once, where a filter would be worked out again.
    state = F.when(F.col("_inside"), F.lit(1)).otherwise(_state(F.col("lon"), F.col("lat"), F.col("_odd"), F.col("_edges")))
    found = F.explode(F.filter(F.array(state), lambda v: (v == 1) | (v == 2) & F.lit(boundary))).alias("_state")
    met = met.select("lon", "lat", name, found).withColumn("_on", F.col("_state") == 2)
    # All that a position found meets its points, which are the side that is held.
    place = F.xxhash64(*(c for c, t in points.dtypes if "map" not in t and "variant" not in t))
    left, right = split_keys(known, met.select("lon", "lat", name, "_on"), ["lon", "lat"], by=place, hint=None)
    out = spread(left, "lon", "lat", "_split").hint("shuffle_hash").join(spread(right, "lon", "lat", "_split"), ["lon", "lat", "_split"])
    return out.select(*points.columns, F.col(name).alias(key), F.col("_on").alias("on_boundary"))
