"""Geometries as arrays, and expressions over them.

A geometry is a type name and `parts`: an array of polygons (or lines, or points), each an array of rings
(or paths), each an array of struct<lon, lat>. A point is one part of one path of one vertex; ring 0 of a
polygon is the outer one, the others are holes. All functions are higher-order expressions; none needs
Python. Rings are moved to their first vertex before products are summed, which keeps the digits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import EARTH_RADIUS, _c, longitude_delta, wrap_longitude

VERTEX = "struct<lon:double,lat:double>"
PARTS = f"array<array<array<{VERTEX}>>>"


def vertex(lon, lat) -> Column:
    return F.struct(_c(lon).cast("double").alias("lon"), _c(lat).cast("double").alias("lat"))


def ring_of(west, south, east, north) -> Column:
    """The closed ring of a box."""
    w, s, e, n = map(_c, (west, south, east, north))
    return F.array(vertex(w, s), vertex(e, s), vertex(e, n), vertex(w, n), vertex(w, s))


def point_parts(lon, lat) -> Column:
    return F.array(F.array(F.array(vertex(lon, lat))))


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def vertices(parts) -> Column:
    return F.flatten(F.flatten(_c(parts)))


def pairs(path: Column) -> Column:
    """struct<a, b> of consecutive vertices."""
    n = F.size(path)
    return F.when(n > 1, F.arrays_zip(F.slice(path, 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(path, 2, F.greatest(n - 1, F.lit(0))).alias("b"))).otherwise(F.array().cast(f"array<struct<a:{VERTEX},b:{VERTEX}>>"))


def _sum(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + value(x))


def outer_metrics(ring: Column) -> Column:
    """struct<area, perimeter, lon, lat> of an outer ring on a plane local to it; null for fewer than four
    vertices. A ring without area has its middle vertex as its centre."""
    n = F.size(ring)
    ky = F.lit(math.pi * EARTH_RADIUS / 180)
    plane = F.struct((ky * F.cos(F.radians(_sum(ring, lambda p: p["lat"]) / n))).alias("kx"), ring[0]["lon"].alias("lon"), ring[0]["lat"].alias("lat"))
    zero = F.struct(*(F.lit(0.0).alias(k) for k in ("twice", "cx", "cy", "length")))

    def on(o: Column) -> Column:
        flat = lambda p: vertex((p["lon"] - o["lon"]) * o["kx"], (p["lat"] - o["lat"]) * ky)

        def step(acc: Column, s: Column) -> Column:
            x1, y1, x2, y2 = s["a"]["lon"], s["a"]["lat"], s["b"]["lon"], s["b"]["lat"]
            c = x1 * y2 - x2 * y1
            return F.struct((acc["twice"] + c).alias("twice"), (acc["cx"] + (x1 + x2) * c).alias("cx"), (acc["cy"] + (y1 + y2) * c).alias("cy"), (acc["length"] + F.hypot(x2 - x1, y2 - y1)).alias("length"))

        def done(acc: Column) -> Column:
            middle = F.element_at(ring, F.floor(n / 2).cast("int") + 1)
            has = acc["twice"] != 0
            return F.struct(
                (F.abs(acc["twice"]) / 2).alias("area"),
                acc["length"].alias("perimeter"),
                F.when(has, o["lon"] + acc["cx"] / (3 * acc["twice"]) / o["kx"]).otherwise(middle["lon"]).alias("lon"),
                F.when(has, o["lat"] + acc["cy"] / (3 * acc["twice"]) / ky).otherwise(middle["lat"]).alias("lat"),
            )

        return _let(F.transform(ring, flat), lambda path: F.aggregate(pairs(path), zero, step, done))

    return F.when(n >= 4, _let(plane, on))


def metrics(parts) -> Column:
    """struct<area, perimeter, lon, lat> of polygons: outer rings only, at least 1 each; the centre is
    weighted by area."""
    each = F.filter(F.transform(_c(parts), lambda polygon: outer_metrics(polygon[0])), lambda m: m.isNotNull())
    weight = lambda m: F.greatest(m["area"], F.lit(1.0))

    def of(each: Column) -> Column:
        total = F.greatest(_sum(each, lambda m: m["area"]), F.lit(1.0))
        return F.struct(total.alias("area"), F.greatest(_sum(each, lambda m: m["perimeter"]), F.lit(1.0)).alias("perimeter"), (_sum(each, lambda m: m["lon"] * weight(m)) / total).alias("lon"), (_sum(each, lambda m: m["lat"] * weight(m)) / total).alias("lat"))

    return _let(each, of)


def ring_area(ring: Column) -> Column:
    """Square metres on the sphere, edges going the short way round."""
    way = lambda d: F.when(F.abs(d) < 180, d).otherwise(F.pmod(d + 540, F.lit(360.0)) - 180)
    turn = lambda s: F.radians(way(s["b"]["lon"] - s["a"]["lon"]))
    total = _sum(pairs(ring), lambda s: turn(s) * (2 + F.sin(F.radians(s["a"]["lat"])) + F.sin(F.radians(s["b"]["lat"]))))
    return F.abs(total) * (EARTH_RADIUS**2 / 2)


def without_area(ring: Column) -> Column:
    """Whether a ring encloses nothing: its area is 0, or its vertices lie in a row but for the rounding of
    coordinates, which leaves sums of some digits."""
    away = lambda p: F.struct(F.hypot(p["lon"] - ring[0]["lon"], p["lat"] - ring[0]["lat"]).alias("d"), p["lon"].alias("lon"), p["lat"].alias("lat"))
    off = lambda p, q: (q["lon"] - ring[0]["lon"]) * (p["lat"] - ring[0]["lat"]) - (q["lat"] - ring[0]["lat"]) * (p["lon"] - ring[0]["lon"])
    in_row = _let(F.array_max(F.transform(ring, away)), lambda q: ~F.exists(ring, lambda p: F.abs(off(p, q)) > 1e-13 * q["d"]))
    return (ring_area(ring) <= 0) | in_row


def polygon_area(polygon: Column) -> Column:
    """The outer ring's area without the holes'."""
    holes = F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0)))
    return F.greatest(F.lit(0.0), ring_area(polygon[0]) - _sum(holes, ring_area))


def on_edge(lon: Column, lat: Column, s: Column) -> Column:
    a, b = s["a"], s["b"]
    c = (b["lon"] - a["lon"]) * (lat - a["lat"]) - (b["lat"] - a["lat"]) * (lon - a["lon"])
    return (F.abs(c) < 1e-12) & lon.between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"])) & lat.between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))


def edge_crosses(lon: Column, lat: Column, s: Column) -> Column:
    """Whether the ray to the east from a position crosses an edge."""
    a, b = s["a"], s["b"]
    return F.when((a["lat"] > lat) != (b["lat"] > lat), lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]).otherwise(False)


def point_in_ring(lon, lat, ring: Column, boundary: bool = False) -> Column:
    """Even-odd rule; points on the boundary are inside or outside as asked for."""
    lon, lat = _c(lon), _c(lat)
    odd = F.aggregate(pairs(ring), F.lit(False), lambda acc, s: acc != edge_crosses(lon, lat, s))
    return F.when(F.exists(pairs(ring), lambda s: on_edge(lon, lat, s)), F.lit(boundary)).otherwise(odd)


def point_in_polygon(lon, lat, polygon: Column, boundary: bool = False) -> Column:
    holes = F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0)))
    return point_in_ring(lon, lat, polygon[0], boundary) & ~F.exists(holes, lambda h: point_in_ring(lon, lat, h, not boundary))


def _cut(s: Column, west, south, east, north) -> Column:
    """struct<a, b> of the part of a segment in a box, null if there is none (Liang-Barsky)."""
    a, b = s["a"], s["b"]
    west, south, east, north = map(_c, (west, south, east, north))
    dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
    lows, highs, fine = [F.lit(0.0)], [F.lit(1.0)], F.abs(dx) <= 180
    for p, q in ((-dx, a["lon"] - west), (dx, east - a["lon"]), (-dy, a["lat"] - south), (dy, north - a["lat"])):
        lows.append(F.when(p < 0, q / p))  # nulls don't count in greatest and least
        highs.append(F.when(p > 0, q / p))
        fine &= (p != 0) | (q >= 0)
    at = lambda t: vertex(F.least(east, F.greatest(west, F.when(t == 1, b["lon"]).otherwise(a["lon"] + t * dx))), F.least(north, F.greatest(south, F.when(t == 1, b["lat"]).otherwise(a["lat"] + t * dy))))
    ends = lambda r: F.struct(_let(r["low"], at).alias("a"), _let(r["high"], at).alias("b"))
    piece = lambda r: F.when(r["low"] <= r["high"], _let(ends(r), lambda v: F.when(v["a"] != v["b"], v)))
    return F.when(fine, _let(F.struct(F.greatest(*lows).alias("low"), F.least(*highs).alias("high")), piece))


def valid_vertex(p: Column) -> Column:
    return F.coalesce(p["lon"].between(-180, 180) & p["lat"].between(-90, 90) & ~F.isnan(p["lon"]) & ~F.isnan(p["lat"]), F.lit(False))


def clip_line(path, box: tuple[float, float, float, float]) -> Column:
    """array<array<vertex>>: the parts of a path in a box. Parts go on only at an original vertex in the
    box; null and invalid vertices and steps of over 180 degrees break them."""
    west, south, east, north = map(float, box)
    line = f"array<{VERTEX}>"
    start = F.struct(F.array().cast(f"array<{line}>").alias("done"), F.array().cast(line).alias("now"))

    def cut(s: Column) -> Column:
        ok = valid_vertex(s["a"]) & valid_vertex(s["b"])
        inside = s["a"]["lon"].between(west, east) & s["a"]["lat"].between(south, north)
        return F.struct(F.when(ok, _cut(s, west, south, east, north)).alias("piece"), inside.alias("inside"), (ok & (s["a"] == s["b"])).alias("same"))

    def step(acc: Column, x: Column) -> Column:
        now, piece = acc["now"], x["piece"]
        closed = F.when(F.size(now) > 0, F.array_append(acc["done"], now)).otherwise(acc["done"])
        goes_on = (F.size(now) > 0) & (F.try_element_at(now, F.lit(-1)) == piece["a"]) & x["inside"]
        made = F.when(piece.isNull(), F.struct(closed.alias("done"), F.array().cast(line).alias("now")))
        made = made.when(F.coalesce(goes_on, F.lit(False)), F.struct(acc["done"].alias("done"), F.array_append(now, piece["b"]).alias("now")))
        made = made.otherwise(F.struct(closed.alias("done"), F.array(piece["a"], piece["b"]).alias("now")))
        return F.when(F.coalesce(x["same"], F.lit(False)), acc).otherwise(made)

    return F.aggregate(F.transform(pairs(_c(path)), cut), start, step, lambda acc: F.when(F.size(acc["now"]) > 0, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]))


def _length(s: Column) -> Column:
    a, b = s["a"], s["b"]
    return F.hypot(longitude_delta(a["lon"], b["lon"]) * F.cos(F.radians((a["lat"] + b["lat"]) / 2)), b["lat"] - a["lat"])


def line_midpoint(parts) -> Column:
    """The vertex half way along the paths."""
    steps = F.flatten(F.transform(F.flatten(_c(parts)), pairs))

    def step(acc: Column, s: Column) -> Column:
        def by(n: Column) -> Column:
            t = F.when(n > 0, acc["left"] / n).otherwise(0.0)
            here = vertex(wrap_longitude(s["a"]["lon"] + longitude_delta(s["a"]["lon"], s["b"]["lon"]) * t), s["a"]["lat"] + (s["b"]["lat"] - s["a"]["lat"]) * t)
            return F.when(acc["left"] <= n, F.struct(acc["left"].alias("left"), here.alias("found"))).otherwise(F.struct((acc["left"] - n).alias("left"), F.lit(None).cast(VERTEX).alias("found")))

        return F.when(acc["found"].isNotNull(), acc).otherwise(_let(_length(s), by))

    def along(steps: Column) -> Column:
        start = F.struct((_sum(steps, _length) / 2).alias("left"), F.lit(None).cast(VERTEX).alias("found"))
        return F.aggregate(steps, start, step, lambda acc: acc["found"])

    return F.coalesce(_let(steps, along), vertices(parts)[0])


def polygon_centroid(parts) -> Column:
    """Of all polygons, holes subtracted; null where no area is left."""

    def of_ring(ring: Column, sign: Column) -> Column:
        o = ring[0]
        moved = F.transform(ring, lambda p: vertex(longitude_delta(o["lon"], p["lon"]), p["lat"] - o["lat"]))
        zero = F.struct(*(F.lit(0.0).alias(k) for k in ("w", "x", "y")))

        def step(acc: Column, s: Column) -> Column:
            x1, y1, x2, y2 = s["a"]["lon"], s["a"]["lat"], s["b"]["lon"], s["b"]["lat"]
            c = x1 * y2 - x2 * y1
            return F.struct((acc["w"] + c).alias("w"), (acc["x"] + (x1 + x2) / 3 * c).alias("x"), (acc["y"] + (y1 + y2) / 3 * c).alias("y"))

        def done(acc: Column) -> Column:
            w = F.abs(acc["w"]) * sign
            return F.struct(w.alias("w"), F.when(acc["w"] != 0, (o["lon"] + acc["x"] / acc["w"]) * w).otherwise(0.0).alias("x"), F.when(acc["w"] != 0, (o["lat"] + acc["y"] / acc["w"]) * w).otherwise(0.0).alias("y"))

        return _let(moved, lambda path: F.aggregate(pairs(path), zero, step, done))

    rings = F.flatten(F.transform(_c(parts), lambda polygon: F.transform(polygon, lambda ring, i: of_ring(ring, F.when(i == 0, 1.0).otherwise(-1.0)))))
    at = lambda rings, total: F.when(total > 0, vertex(wrap_longitude(_sum(rings, lambda r: r["x"]) / total), _sum(rings, lambda r: r["y"]) / total))
    return _let(rings, lambda rings: _let(_sum(rings, lambda r: r["w"]), lambda total: at(rings, total)))


def representative(geom_type, parts) -> Column:
    """The point that stands for a geometry (MultiPoint: the first; explode its parts for all)."""
    t = _c(geom_type)
    return F.when(t.isin("Polygon", "MultiPolygon"), polygon_centroid(parts)).when(t.isin("LineString", "MultiLineString"), line_midpoint(parts)).otherwise(vertices(parts)[0])


def sub_line(path, share) -> Column:
    """The path up to a share of its length; null for no share or fewer than two vertices."""
    path, share = _c(path), F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(share)))
    steps = pairs(path)
    length = lambda s: F.hypot((s["b"]["lon"] - s["a"]["lon"]) * F.cos(F.radians((s["a"]["lat"] + s["b"]["lat"]) / 2)), s["b"]["lat"] - s["a"]["lat"])
    target = _sum(steps, length) * share
    start = F.struct(F.lit(0.0).alias("gone"), F.slice(path, 1, 1).alias("out"), F.lit(False).alias("over"))

    def step(acc: Column, s: Column) -> Column:
        n = length(s)
        t = F.when(n > 0, (target - acc["gone"]) / n).otherwise(0.0)
        cut = vertex(s["a"]["lon"] + (s["b"]["lon"] - s["a"]["lon"]) * t, s["a"]["lat"] + (s["b"]["lat"] - s["a"]["lat"]) * t)
        whole = F.struct((acc["gone"] + n).alias("gone"), F.array_append(acc["out"], s["b"]).alias("out"), F.lit(False).alias("over"))
        return F.when(acc["over"], acc).when(acc["gone"] + n <= target, whole).otherwise(F.struct(target.alias("gone"), F.array_append(acc["out"], cut).alias("out"), F.lit(True).alias("over")))

    made = F.aggregate(steps, start, step, lambda acc: acc["out"])
    return F.when((F.size(path) < 2) | (share == 0), None).when(share == 1, path).when(target == 0, F.slice(path, 1, 2)).otherwise(made)


def thin(path, most: int) -> Column:
    """At most so many vertices, spread evenly over the indices, both ends kept."""
    path = _c(path)
    n = F.size(path)
    chosen = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.element_at(path, F.floor(i * (n - 1) / (most - 1) + 0.5).cast("int") + 1))
    return F.when(n <= most, path).otherwise(chosen)


def circle(lon, lat, metres, corners: int = 64) -> Column:
    """A closed ring on the sphere around a centre."""
    lon, lat, r = F.radians(_c(lon)), F.radians(_c(lat)), _c(metres) / EARTH_RADIUS
    fixed = F.struct(lon.alias("lon"), F.sin(lat).alias("sl"), F.cos(lat).alias("cl"), F.sin(r).alias("sr"), F.cos(r).alias("cr"))

    def corner(o: Column, bearing: Column) -> Column:
        def at(y: Column) -> Column:
            x = o["lon"] + F.atan2(F.sin(bearing) * o["sr"] * o["cl"], o["cr"] - o["sl"] * F.sin(y))
            return vertex(wrap_longitude(F.degrees(x)), F.degrees(y))

        return _let(F.asin(o["sl"] * o["cr"] + o["cl"] * o["sr"] * F.cos(bearing)), at)

    around = F.transform(F.sequence(F.lit(0), F.lit(corners)), lambda k: 2 * math.pi * (k % corners) / corners)
    return _let(fixed, lambda o: F.transform(around, lambda bearing: corner(o, bearing)))


def split_ring(ring) -> Column:
    """Rings of a ring that may cross the antimeridian, at most two, each within -180..180: the vertices
    are unrolled, and what lies beyond a seam is cut off and moved by a turn."""

    def halves(unrolled: Column) -> Column:
        east = F.exists(unrolled, lambda p: p["lon"] > 180)
        seam = F.when(east, F.lit(180.0)).otherwise(-180.0)

        def half(low: bool) -> Column:
            inside = lambda p: (p["lon"] <= seam) if low else (p["lon"] >= seam)
            shift = F.when(east, 0.0 if low else -360.0).otherwise(360.0 if low else 0.0)

            def step(acc: Column, s: Column) -> Column:
                x, y = s["a"], s["b"]
                meet = vertex(seam, x["lat"] + (y["lat"] - x["lat"]) * (seam - x["lon"]) / F.when(y["lon"] != x["lon"], y["lon"] - x["lon"]))
                new = F.filter(F.array(F.when(inside(x) != inside(y), meet), F.when(inside(y), y)), lambda v: v.isNotNull())
                return F.concat(acc, new)

            cut = F.aggregate(pairs(unrolled), F.filter(F.slice(unrolled, 1, 1), inside), step)
            return _let(cut, lambda c: F.transform(F.concat(c, F.when(c[0] != F.try_element_at(c, F.lit(-1)), F.slice(c, 1, 1)).otherwise(F.slice(c, 1, 0))), lambda p: vertex(p["lon"] + shift, p["lat"])))

        crosses = east | F.exists(unrolled, lambda p: p["lon"] < -180)
        return F.when(crosses, F.filter(F.array(half(True), half(False)), lambda r: F.size(r) >= 4)).otherwise(F.array(unrolled))

    def unroll(r: Column) -> Column:
        return F.transform(r, lambda p: vertex(r[0]["lon"] + longitude_delta(r[0]["lon"], p["lon"]), p["lat"]))

    return _let(_c(ring), lambda r: _let(unroll(r), halves))


def meets_box(geom_type, parts, box: tuple[float, float, float, float]) -> Column:
    """The geometry itself meets a box (not merely its extent): a vertex in it, an edge through it, or the
    box within a polygon and not within one of its holes. Boxes may wrap: west > east."""
    west, south, east, north = map(float, box)
    pieces = [(west, east)] if west <= east else [(west, 180.0), (-180.0, east)]
    t, parts, out = _c(geom_type), _c(parts), F.lit(False)
    for w, e in pieces:
        has_vertex = _vertex_in(parts, w, south, e, north)
        edges = F.flatten(F.transform(F.flatten(parts), pairs))
        has_edge = F.exists(edges, _edge_in(w, south, e, north))
        covers = F.exists(parts, _covers(w, south))
        out |= has_vertex | (~t.isin("Point", "MultiPoint") & has_edge) | (t.isin("Polygon", "MultiPolygon") & covers)
    return out


def _vertex_in(parts: Column, west: float, south: float, east: float, north: float) -> Column:
    return F.exists(vertices(parts), lambda p: p["lon"].between(west, east) & p["lat"].between(south, north))


def _edge_in(west: float, south: float, east: float, north: float):
    return lambda s: _cut(s, F.lit(west), F.lit(south), F.lit(east), F.lit(north)).isNotNull()


def _covers(lon: float, lat: float):
    return lambda polygon: point_in_polygon(F.lit(lon), F.lit(lat), polygon, boundary=True)
