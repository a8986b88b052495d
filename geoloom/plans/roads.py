"""Queries over roads, made of orders as short ways on a lattice, and over rasters made of line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fn
from ..functions import geometry as g
from ..functions.columns import DRIVE_SPEED
from ..functions.inputs import LAT, LON, OBS, observations, placed, spread, table
from ..operators import areas, raster, roads

SIDE = 40
#: Keys of a block of SIDE by SIDE nodes.
BLOCK = 4000


def _block(b):
    """(x, y) of the first node of block b: blocks lie in a square, whose side grows with their number."""
    s = F.floor(F.sqrt(b))
    r = b - s * s
    return F.least(r, s) * SIDE, F.least(2 * s - r, s) * SIDE


def _ways(spark, sf):
    """A street a customer order: from a lattice node to the one east or north of it."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    x0, y0 = _block(F.floor(F.col("k") / BLOCK))
    i = F.col("k") % BLOCK
    x, y = x0 + i % SIDE, y0 + F.floor(i / SIDE) % SIDE
    at = lambda dx, dy: g.vertex(77.0 + (x + dx) / 1000.0, 28.5 + (y + dy) / 1000.0)
    east = F.floor(i / (SIDE * SIDE)) % 2 == 0
    klass = F.element_at(F.array(*map(F.lit, ("residential", "primary", "footway", "service"))), (F.floor(F.col("k") / 7) % 4 + 1).cast("int"))
    tags = F.map_filter(F.create_map(F.lit("highway"), klass, F.lit("name"), F.concat(F.lit("Street No "), (F.col("k") % 50).cast("string")), F.lit("oneway"), F.when(F.col("k") % 9 == 0, "yes").when(F.col("k") % 10 == 0, "-1"), F.lit("access"), F.when(F.col("k") % 11 == 0, "private")), lambda k, v: v.isNotNull())
    return o.select(F.col("k").alias("way_id"), tags.alias("tags"), F.when(east, F.array(at(0, 0), at(1, 0))).otherwise(F.array(at(0, 0), at(0, 1))).alias("geometry"))


_W = f"""b AS (SELECT o_orderkey AS k, o_orderkey % {BLOCK} AS i, floor(sqrt(o_orderkey // {BLOCK}))::BIGINT AS s, o_orderkey // {BLOCK} AS b FROM orders),
w AS (SELECT k, least(b - s * s, s) * {SIDE} + i % {SIDE} AS x, least(2 * s - (b - s * s), s) * {SIDE} + (i // {SIDE}) % {SIDE} AS y, (i // {SIDE * SIDE}) % 2 = 0 AS east, ['residential','primary','footway','service'][((k // 7) % 4 + 1)::INT] AS highway, 'Street No ' || (k % 50) AS name FROM b),
v AS (SELECT *, 77.0::DOUBLE + x / 1000.0::DOUBLE AS lon1, 28.5::DOUBLE + y / 1000.0::DOUBLE AS lat1, 77.0::DOUBLE + (x + CASE WHEN east THEN 1 ELSE 0 END) / 1000.0::DOUBLE AS lon2, 28.5::DOUBLE + (y + CASE WHEN east THEN 0 ELSE 1 END) / 1000.0::DOUBLE AS lat2 FROM w)"""
_EDGES = f"""{_W}, d AS (SELECT *, round(lon1 * 1e7)::BIGINT || ',' || round(lat1 * 1e7)::BIGINT AS a, round(lon2 * 1e7)::BIGINT || ',' || round(lat2 * 1e7)::BIGINT AS b, 6371008.8 * sqrt(pow(radians(lon2 - lon1) * cos(radians((lat1 + lat2) / 2)), 2) + pow(radians(lat2 - lat1), 2)) AS m FROM v WHERE highway <> 'footway' AND k % 11 <> 0),
ee AS (SELECT a AS src, b AS dst, m FROM d WHERE NOT (k % 9 <> 0 AND k % 10 = 0) UNION ALL SELECT b, a, m FROM d WHERE k % 9 <> 0), edges AS (SELECT src, dst, min(m) AS metres FROM ee GROUP BY ALL)"""


def pipe7_graph(spark, sf):
    return roads.driving_graph(_ways(spark, sf))[1].select("src", "dst", F.round("metres", 4).alias("metres"))


def pipe8_routes(spark, sf):
    """A route a supplier, of three waypoints, in the block of the supplier's share of the orders (150 each)."""
    nodes, edges = roads.driving_graph(_ways(spark, sf))
    nodes, edges = roads.stored(nodes), roads.stored(edges)
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("route_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos"))
    x, y = (F.col("route_id") * 7 + F.col("pos") * 3) % (SIDE - 1), (F.col("route_id") * 5 + F.col("pos") * 2) % (SIDE - 1)
    x0, y0 = _block(F.floor(F.col("route_id") * 150 / BLOCK))
    w = s.withColumns({"lon": 77.0003 + (x0 + x) / 1000.0, "lat": 28.5002 + (y0 + y) / 1000.0})
    return roads.routes(w, nodes, edges).select("route_id", F.round("metres", 3).alias("metres"), F.round("seconds", 3).alias("seconds"), "legs")


#: Distances from each leg's start fall until none falls any more.
PIPE8 = f"""WITH RECURSIVE {_EDGES}, n AS (SELECT DISTINCT a AS id, lon1 AS lon, lat1 AS lat FROM d UNION SELECT DISTINCT b, lon2, lat2 FROM d),
r AS (SELECT s_suppkey AS k, pos, s_suppkey * 150 // {BLOCK} AS b, floor(sqrt(s_suppkey * 150 // {BLOCK}))::BIGINT AS s FROM supplier, range(3) t(pos)),
p AS (SELECT k, pos, 77.0003::DOUBLE + (least(b - s * s, s) * {SIDE} + (k * 7 + pos * 3) % {SIDE - 1}) / 1000.0::DOUBLE AS lon, 28.5002::DOUBLE + (least(2 * s - (b - s * s), s) * {SIDE} + (k * 5 + pos * 2) % {SIDE - 1}) / 1000.0::DOUBLE AS lat FROM r),
h AS (SELECT k, pos, p.lon, p.lat, id, 6371008.8 * sqrt(pow(radians(n.lon - p.lon) * cos(radians((p.lat + n.lat) / 2)), 2) + pow(radians(n.lat - p.lat), 2)) AS m FROM p LEFT JOIN n ON n.lat BETWEEN p.lat - 0.003 AND p.lat + 0.003 AND n.lon BETWEEN p.lon - 0.003 AND p.lon + 0.003),
near AS (SELECT k, pos, lon, lat, min({{'m': m, 'id': id}}) FILTER (m <= 250) AS v FROM h GROUP BY ALL),
leg AS (SELECT a.k, a.pos, a.v.id AS start, b.v.id AS goal, a.v.m + b.v.m AS off, 6371008.8 * sqrt(pow(radians(b.lon - a.lon) * cos(radians((a.lat + b.lat) / 2)), 2) + pow(radians(b.lat - a.lat), 2)) AS across FROM near a JOIN near b ON b.k = a.k AND b.pos = a.pos + 1),
x AS MATERIALIZED (SELECT * FROM edges), y AS MATERIALIZED (SELECT * FROM leg WHERE start IS NOT NULL AND goal IS NOT NULL),
t(k, pos, node, m) USING KEY (k, pos, node) AS (SELECT k, pos, start, 0::DOUBLE FROM y
UNION SELECT t.k, t.pos, e.dst, min(t.m + e.metres) FROM t JOIN x e ON e.src = t.node JOIN y ON y.k = t.k AND y.pos = t.pos LEFT JOIN recurring.t o ON o.k = t.k AND o.pos = t.pos AND o.node = e.dst LEFT JOIN recurring.t g ON g.k = t.k AND g.pos = t.pos AND g.node = goal WHERE (o.m IS NULL OR t.m + e.metres < o.m) AND (g.m IS NULL OR t.m + e.metres < g.m) GROUP BY ALL)
SELECT leg.k AS route_id, round(sum(t.m + off), 3) AS metres, round(sum(t.m + off) / {DRIVE_SPEED!r}::DOUBLE, 3) AS seconds, count(*) AS legs FROM leg LEFT JOIN t ON t.k = leg.k AND t.pos = leg.pos AND t.node = goal GROUP BY leg.k HAVING count(t.m) = count(*) AND max(across) BETWEEN 1e-9 AND 30000"""


def join10_snap(spark, sf):
    nodes, _ = roads.driving_graph(_ways(spark, sf))
    o = observations(spark, sf).select(F.col("feature_id").alias("point_id"), "lon", "lat")
    return roads.snapped(o, nodes, 40).select("point_id", F.round("metres", 4).alias("metres"))


BOX = (77.0053, 28.5027, 77.0218, 28.5204)


def pipe6_roads(spark, sf):
    r = roads.extract_roads(_ways(spark, sf), BOX, ("residential", "primary"), "street  no")
    p = lambda k, c: F.round(F.element_at("path", k)[c], 7)
    return r.select("way_id", "part", "name", p(1, "lon").alias("lon1"), p(1, "lat").alias("lat1"), p(-1, "lon").alias("lon2"), p(-1, "lat").alias("lat2"))


PIPE6 = f"""WITH {_W}, c AS (SELECT k AS way_id, 1 AS part, name, greatest(lon1, 77.0053) AS lon1, greatest(lat1, 28.5027) AS lat1, least(lon2, 77.0218) AS lon2, least(lat2, 28.5204) AS lat2 FROM v WHERE highway IN ('residential', 'primary'))
SELECT way_id, part, name, round(lon1, 7) AS lon1, round(lat1, 7) AS lat1, round(lon2, 7) AS lon2, round(lat2, 7) AS lat2 FROM c WHERE lon1 <= lon2 AND lat1 <= lat2 AND (lon1 < lon2 OR lat1 < lat2)"""


def fn14_clip(spark, sf):
    """Long diagonals across a box."""
    o = observations(spark, sf)
    path = F.array(g.vertex("lon", "lat"), g.vertex(77.2 - (F.col("lon") - 77.0), 28.65 - (F.col("lat") - 28.5)))
    c = o.select("feature_id", F.explode(g.clip_line(path, (77.08, 28.55, 77.12, 28.6))).alias("p"))
    e = lambda k, c_: F.round(F.element_at("p", k)[c_], 6)
    return c.select("feature_id", e(1, "lon").alias("lon1"), e(1, "lat").alias("lat1"), e(-1, "lon").alias("lon2"), e(-1, "lat").alias("lat2"))


FN14 = f"""WITH s AS (SELECT feature_id, lon AS x1, lat AS y1, 154.2::DOUBLE - lon AS x2, 57.15::DOUBLE - lat AS y2 FROM ({OBS})), d AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM s),
t AS (SELECT *, greatest(0, CASE WHEN dx > 0 THEN (77.08 - x1) / dx WHEN dx < 0 THEN (77.12 - x1) / dx ELSE 0 END, CASE WHEN dy > 0 THEN (28.55 - y1) / dy WHEN dy < 0 THEN (28.6 - y1) / dy ELSE 0 END) AS a, least(1, CASE WHEN dx > 0 THEN (77.12 - x1) / dx WHEN dx < 0 THEN (77.08 - x1) / dx ELSE 1 END, CASE WHEN dy > 0 THEN (28.6 - y1) / dy WHEN dy < 0 THEN (28.55 - y1) / dy ELSE 1 END) AS b FROM d)
SELECT feature_id, round(x1 + a * dx, 6) AS lon1, round(y1 + a * dy, 6) AS lat1, round(x1 + b * dx, 6) AS lon2, round(y1 + b * dy, 6) AS lat2 FROM t WHERE a < b"""


def agg15_coverage(spark, sf):
    w = _ways(spark, sf)
    return roads.coverage(w, roads.extract_roads(w, BOX))


def win6_labels(spark, sf):
    w = _ways(spark, sf).select(F.col("way_id").alias("input_pos"), F.element_at("tags", "name").alias("name"))
    return roads.first_labels(w).select("input_pos", "label")


def fn23_phrase(spark, sf):
    w = _ways(spark, sf).select("way_id", F.element_at("tags", "name").alias("name"))
    return w.where(fn.phrase_match("name", "no 1")).select("way_id")


def join12_in_polygon(spark, sf):
    """Points in boxes around suppliers."""
    s = placed(spread(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey"), "s_suppkey")
    ring = g.ring_of(F.col("lon") - 0.004, F.col("lat") - 0.003, F.col("lon") + 0.004, F.col("lat") + 0.003)
    boxes = s.select(F.col("s_suppkey").alias("area_id"), F.array(F.array(ring)).alias("parts"))
    return areas.in_polygons(observations(spark, sf).select("feature_id", "lon", "lat"), boxes, "area_id").select("feature_id", "area_id")


def _shapes(spark, sf):
    """An area a supplier, of 0.0004 to 0.12 degrees, its corners on the grid of the positions: a box, a box
    with a hole, a comb of 3 to 22 teeth, or a triangle and a box apart."""
    s = spread(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")), "k")
    s = s.withColumns({"i": F.col("k") * 7919 % 20000, "j": F.col("k") * 104729 % 15000, "h": F.when(F.col("k") % 25 == 3, F.lit(6000)).otherwise(20 + F.col("k") * F.col("k") % 37 * (F.col("k") % 5 + 1) * 10), "teeth": 3 + F.col("k") % 20})
    i, j, h, half, wide = F.col("i"), F.col("j"), F.col("h"), F.floor(F.col("h") / 2), F.floor(F.col("h") / F.col("teeth"))
    at = lambda x, y: g.vertex(77.0 + x / F.lit(100000.0), 28.5 + y / F.lit(100000.0))
    box = lambda w, so, e, n: F.array(at(w, so), at(e, so), at(e, n), at(w, n), at(w, so))
    tooth = lambda t: F.array(at(i - h + 2 * t * wide, j + h), at(i - h + (2 * t + 1) * wide, j + h), at(i - h + (2 * t + 1) * wide, j), at(i - h + (2 * t + 2) * wide, j))
    comb = F.concat(F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("teeth") - 1), tooth)), F.array(at(i - h + 2 * F.col("teeth") * wide, j - h), at(i - h, j - h), at(i - h, j + h)))
    whole, hole, triangle = box(i - h, j - h, i + h, j + h), box(i - half, j - half, i + half, j + half), F.array(at(i - h, j - h), at(i, j - h), at(i - h, j + h), at(i - h, j - h))
    kind = F.col("k") % 4
    parts = F.when(kind == 0, F.array(F.array(whole))).when(kind == 1, F.array(F.array(whole, hole))).when(kind == 2, F.array(F.array(comb))).otherwise(F.array(F.array(triangle), F.array(box(i + 1, j - h, i + h, j + h))))
    return s.select(F.col("k").alias("area_id"), parts.alias("parts"))


_AT = lambda x, y: f"{{'x': 77.0::DOUBLE + ({x}) / 100000.0::DOUBLE, 'y': 28.5::DOUBLE + ({y}) / 100000.0::DOUBLE}}"
_BOX = lambda w, so, e, n: "[" + ", ".join((_AT(w, so), _AT(e, so), _AT(e, n), _AT(w, n), _AT(w, so))) + "]"
_TOOTH = "[" + ", ".join((_AT("i - h + 2 * t * w", "j + h"), _AT("i - h + (2 * t + 1) * w", "j + h"), _AT("i - h + (2 * t + 1) * w", "j"), _AT("i - h + (2 * t + 2) * w", "j"))) + "]"
JOIN12 = f"""
WITH s0 AS (SELECT s_suppkey AS k, s_suppkey * 7919 % 20000 AS i, s_suppkey * 104729 % 15000 AS j, CASE WHEN s_suppkey % 25 = 3 THEN 6000 ELSE 20 + s_suppkey * s_suppkey % 37 * (s_suppkey % 5 + 1) * 10 END AS h, 3 + s_suppkey % 20 AS teeth FROM supplier),
s AS (SELECT *, h // 2 AS half, h // teeth AS w FROM s0),
r AS (SELECT k, {_BOX("i - h", "j - h", "i + h", "j + h")} AS ring FROM s WHERE k % 4 < 2
  UNION ALL SELECT k, {_BOX("i - half", "j - half", "i + half", "j + half")} FROM s WHERE k % 4 = 1
  UNION ALL SELECT k, list_concat(flatten(list_transform(range(0, teeth), lambda t: {_TOOTH})), [{_AT("i - h + 2 * teeth * w", "j - h")}, {_AT("i - h", "j - h")}, {_AT("i - h", "j + h")}]) FROM s WHERE k % 4 = 2
  UNION ALL SELECT k, [{_AT("i - h", "j - h")}, {_AT("i", "j - h")}, {_AT("i - h", "j + h")}, {_AT("i - h", "j - h")}] FROM s WHERE k % 4 = 3
  UNION ALL SELECT k, {_BOX("i + 1", "j - h", "i + h", "j + h")} FROM s WHERE k % 4 = 3),
e AS (SELECT k, ring[n].x AS x1, ring[n].y AS y1, ring[n + 1].x AS x2, ring[n + 1].y AS y2 FROM (SELECT k, ring, unnest(range(1, len(ring))) AS n FROM r)),
b AS (SELECT k, min(x1) AS w, max(x1) AS ea, min(y1) AS so, max(y1) AS n FROM e GROUP BY k),
p AS (SELECT feature_id, lon, lat, k FROM ({OBS}) JOIN b ON lon BETWEEN w AND ea AND lat BETWEEN so AND n),
t AS (SELECT feature_id, p.k, bool_or(abs((x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1)) < 1e-12 AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2)) AS on_boundary,
      count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) AS crossed FROM p JOIN e USING (k) GROUP BY ALL)
SELECT feature_id, k AS area_id, on_boundary FROM t WHERE on_boundary OR crossed % 2 = 1
"""


def join12_polygons(spark, sf):
    """Points in areas of very unequal sizes, those on a boundary told apart."""
    points = observations(spark, sf).select("feature_id", "lon", "lat")
    return areas.in_polygons(points, _shapes(spark, sf), "area_id", boundary=True).select("feature_id", "area_id", "on_boundary")


# Rasters: line items give a band of 400 columns


def _raster(spark, sf):
    li = table(spark, sf, "lineitem")
    cells = li.groupBy(F.lit("r1").alias("raster_id"), F.floor(F.col("l_orderkey") / 400 % 300).cast("int").alias("row"), (F.col("l_orderkey") % 400).cast("int").alias("col")).agg(F.max("l_quantity").alias("value"))
    meta = spark.range(1).select(F.lit("r1").alias("raster_id"), F.lit(0.0005).alias("a"), F.lit(77.0).alias("c"), F.lit(-0.0005).alias("e"), F.lit(28.65).alias("f"), F.lit(4326).alias("epsg"), F.lit(50.0).alias("nodata"), F.lit(2020).alias("year"), F.lit(True).alias("verified"))
    return cells, meta


_CELLS = "SELECT row, col, max(q) AS value FROM (SELECT floor((l_orderkey / 400.0::DOUBLE) % 300)::INT AS row, (l_orderkey % 400)::INT AS col, l_quantity AS q FROM lineitem) GROUP BY ALL"
_CROP = f"SELECT row, col, value, 77.0::DOUBLE + (col + 0.5) * 0.0005 AS lon, 28.65::DOUBLE - (row + 0.5) * 0.0005 AS lat FROM ({_CELLS}) WHERE value <> 50"


def src10_crop(spark, sf):
    cells, meta = _raster(spark, sf)
    return raster.crop(cells, meta, (77.0501, 28.6301, 77.1203, 28.6498)).select("row", "col", "value", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def pipe10_population(spark, sf):
    """Crop of the last verified year, as a heatmap."""
    from ..operators.layers import weights

    cells, meta = _raster(spark, sf)
    c = raster.crop(cells, raster.latest_year(meta), (77.0, 28.64, 77.2, 28.65), nonnegative=True)
    return weights(c, "value").select("row", "col", F.round("heat_weight", 6).alias("heat_weight"))


def _dem(spark, sf):
    """Tiles of 8 by 8 pixels, keyed like the customers' positions; those of every third customer are missing
    on purpose, as points without a tile are the case under test."""
    c = placed(table(spark, sf, "customer").where("c_custkey % 3 <> 0"), "c_custkey").withColumn("t", raster.tile_point(F.col("lon"), F.col("lat"), 13))
    px = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((F.col("t.x") + F.col("t.y") * 3 + i * 17) % 900 - 5).cast("float"))
    return c.select(F.lit(13).alias("z"), "t.x", "t.y", F.lit(8).alias("width"), F.lit(8).alias("height"), px.alias("data")).dropDuplicates(["x", "y"])


def join9_elevation(spark, sf):
    o = observations(spark, sf).select("feature_id", "lon", "lat")
    return raster.elevations(o, _dem(spark, sf), 13).select("feature_id", "elevation")


_DEM = f"""t AS (SELECT feature_id, (lon + 180) / 360 * 8192 AS wx, (1 - asinh(tan(radians(lat))) / pi()) / 2 * 8192 AS wy FROM ({OBS})), u AS (SELECT feature_id, floor(wx)::INT AS x, floor(wy)::INT AS y, wx - floor(wx) AS u, wy - floor(wy) AS v FROM t),
s AS (SELECT feature_id, CASE WHEN (x, y) IN (SELECT (x, y) FROM u WHERE feature_id % 3 <> 0) THEN ((x + y * 3 + (greatest(0, least(7, floor(v * 8)))::INT * 8 + greatest(0, least(7, floor(u * 8)))::INT) * 17) % 900 - 5)::DOUBLE END AS elevation FROM u)"""


def pipe12_terrain(spark, sf):
    o = observations(spark, sf).select("category", "lon", "lat")
    return raster.terrain_range(raster.elevations(o, _dem(spark, sf), 13), "category")


QUERIES = {
    "pipe6_roads": (pipe6_roads, PIPE6),
    "pipe7_graph": (pipe7_graph, f"WITH {_EDGES} SELECT src, dst, round(metres, 4) AS metres FROM edges"),
    "pipe8_routes": (pipe8_routes, PIPE8),
    "join10_snap": (join10_snap, f"WITH {_EDGES}, n AS (SELECT DISTINCT a AS id, lon1 AS lon, lat1 AS lat FROM d UNION SELECT DISTINCT b, lon2, lat2 FROM d), o AS ({OBS}), m AS (SELECT feature_id, min(6371008.8 * sqrt(pow(radians(n.lon - o.lon) * cos(radians((o.lat + n.lat) / 2)), 2) + pow(radians(n.lat - o.lat), 2))) AS d FROM o JOIN n ON abs(n.lat - o.lat) < 0.003 AND abs(n.lon - o.lon) < 0.003 GROUP BY 1) SELECT feature_id AS point_id, round(d, 4) AS metres FROM m WHERE d <= 250"),
    "join12_in_polygon": (join12_in_polygon, f"SELECT feature_id, s.k AS area_id FROM ({OBS}) o JOIN (SELECT s_suppkey AS k, {LON.format(k='s_suppkey')} AS x, {LAT.format(k='s_suppkey')} AS y FROM supplier) s ON o.lon > x - 0.004 AND o.lon < x + 0.004 AND o.lat > y - 0.003 AND o.lat < y + 0.003"),
    "join12_polygons": (join12_polygons, JOIN12),
    "fn14_clip": (fn14_clip, FN14),
    "agg15_coverage": (agg15_coverage, f"WITH {_W}, c AS (SELECT greatest(lon1, 77.0053) AS lon1, greatest(lat1, 28.5027) AS lat1, least(lon2, 77.0218) AS lon2, least(lat2, 28.5204) AS lat2 FROM v WHERE highway <> 'footway'), r AS (SELECT count(*) AS parts FROM c WHERE lon1 <= lon2 AND lat1 <= lat2 AND (lon1 < lon2 OR lat1 < lat2)) SELECT (SELECT count(*) FROM v) AS source_ways, (SELECT 2 * count(*) FROM v) AS source_positions, 0 AS invalid_positions, parts, 2 * parts AS positions FROM r"),
    "win6_labels": (win6_labels, f"WITH {_W} SELECT k AS input_pos, CASE WHEN row_number() OVER (PARTITION BY name ORDER BY k) = 1 THEN name ELSE '' END AS label FROM w"),
    "fn23_phrase": (fn23_phrase, f"WITH {_W} SELECT k AS way_id FROM w WHERE k % 50 = 1"),
    "src10_crop": (src10_crop, f"SELECT row, col, value, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ({_CROP}) WHERE lon BETWEEN 77.0501 AND 77.1203 AND lat BETWEEN 28.6301 AND 28.6498"),
    "pipe10_population": (pipe10_population, f"WITH c AS (SELECT * FROM ({_CROP}) WHERE lat BETWEEN 28.64 AND 28.65) SELECT row, col, round(value / (SELECT max(value) FROM c), 6) AS heat_weight FROM c"),
    "join9_elevation": (join9_elevation, f"WITH {_DEM} SELECT feature_id, elevation FROM s"),
    "pipe12_terrain": (pipe12_terrain, f"WITH {_DEM} SELECT category, min(elevation) AS lowest, max(elevation) AS highest, count(elevation) AS known FROM s JOIN ({OBS}) o USING (feature_id) GROUP BY category"),
}
