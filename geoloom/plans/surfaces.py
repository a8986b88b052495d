"""Queries over surfaces, hulls, validity, relations and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fn
from ..functions import geometry as g
from ..functions.inputs import BUILDINGS, LAT, OBS, buildings, observations, placed, table
from ..operators import surfaces as op
from ..scratch import Scratch, stored
from ..sources import readers
from ..streaming.places import PlaceStore, ingest


def agg14_hulls(spark, sf):
    h = op.hulls(observations(spark, sf).select("category", "lon", "lat"), "category")
    return h.select("category", F.size("ring").alias("corners"), F.round(g.ring_area(F.concat("ring", F.slice("ring", 1, 1))), 0).alias("area"))


#: An edge of the hull has all points on its left, or between its ends; on the whole numbers that positions are made of.
AGG14 = """WITH p AS (SELECT DISTINCT c_mktsegment AS g, (c_custkey * 7919) % 20000 AS x, (c_custkey * 104729) % 15000 AS y FROM customer),
e AS (SELECT a.g, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM p a JOIN p b ON a.g = b.g AND (a.x <> b.x OR a.y <> b.y)),
o AS (SELECT e.g, ax, ay, bx, by_ FROM e JOIN p ON p.g = e.g GROUP BY ALL HAVING bool_and(CASE sign((bx - ax) * (y - ay) - (by_ - ay) * (x - ax)) WHEN 1 THEN true WHEN 0 THEN x BETWEEN least(ax, bx) AND greatest(ax, bx) AND y BETWEEN least(ay, by_) AND greatest(ay, by_) ELSE false END))
SELECT g AS category, count(*)::INT AS corners, round(6371008.8 * 6371008.8 / 2 * abs(sum(radians((bx - ax) / 100000.0::DOUBLE) * (2 + sin(radians(28.5 + ay / 100000.0::DOUBLE)) + sin(radians(28.5 + by_ / 100000.0::DOUBLE))))), 0) AS area FROM o GROUP BY g"""


#: A node lies outside the hull if the samples' directions from it leave a gap of more than half a turn.
_NODES = f"""WITH s AS (SELECT lon, lat, avg(value) AS v FROM ({OBS}) WHERE value IS NOT NULL GROUP BY ALL), k AS (SELECT k::INT AS k, k / 16.0::DOUBLE AS t FROM range(17) r(k)),
x AS (SELECT min(lon) AS west, max(lon) AS east, min(lat) AS south, max(lat) AS north FROM s),
g AS (SELECT r.k AS row, c.k AS col, west * (1 - c.t) + east * c.t AS x, south * (1 - r.t) + north * r.t AS y, cos(radians((south + north) / 2)) AS c FROM x, k r, k c),
m AS (SELECT row, col, x, y, v, pow((x - lon) * c, 2) + pow(y - lat, 2) AS d, atan2(lat - y, lon - x) AS a FROM g, s),
w AS (SELECT *, a - lag(a) OVER (PARTITION BY row, col ORDER BY a) AS gap FROM m),
n AS (SELECT row, col, x AS lon, y AS lat, coalesce(max(v) FILTER (d < 1e-24), sum(v / d) FILTER (d >= 1e-24) / sum(1 / d) FILTER (d >= 1e-24)) AS value FROM w GROUP BY ALL HAVING bool_or(d < 1e-24) OR greatest(max(gap), min(a) + 2 * pi() - max(a)) <= pi() + 1e-9),
q AS (SELECT a.row, a.col, [a, b, c, d] AS p FROM n a JOIN n b ON (b.row, b.col) = (a.row, a.col + 1) JOIN n c ON (c.row, c.col) = (a.row + 1, a.col + 1) JOIN n d ON (d.row, d.col) = (a.row + 1, a.col))"""


def pipe4_surface(spark, sf):
    n = op.surface_nodes(observations(spark, sf), "value")
    return op.surface_cells(n).select("row", "col", F.round("value", 4).alias("value"))


def pipe5_contours(spark, sf):
    n = op.surface_nodes(observations(spark, sf), "value")
    return op.contours(stored(n)).select("level_index", "row", "col", "part", F.round("level", 4).alias("level"), *(F.round(f"{p}.{c}", 9).alias(f"{p}_{c}") for p in "ab" for c in ("lon", "lat")))


def _crossing(i: int) -> str:
    """SQL of the point where an edge of a cell meets the level."""
    a, b = f"p[{i + 1}]", f"p[{(i + 1) % 4 + 1}]"
    t = f"((level - {a}.value) / ({b}.value - {a}.value))"
    at = ", ".join(f"'{c}': {a}.{c} * (1 - {t}) + {b}.{c} * {t}" for c in ("lon", "lat"))
    return f"CASE WHEN ({a}.value >= level) <> ({b}.value >= level) THEN {{{at}}} END"


PIPE5 = f"""{_NODES}, z AS (SELECT min(value) AS lo, max(value) AS hi FROM n), l AS (SELECT k::INT AS level_index, lo * (1 - (k + 1) / 8.0::DOUBLE) + hi * ((k + 1) / 8.0::DOUBLE) AS level FROM z, range(7) r(k) WHERE lo < hi),
e AS (SELECT row, col, level_index, level, (p[1].value - level) * (p[3].value - level) - (p[2].value - level) * (p[4].value - level) >= 0 AS joined, [{", ".join(map(_crossing, range(4)))}] AS e FROM q, l),
f AS (SELECT *, list_filter(e, lambda v: v IS NOT NULL) AS f FROM e), i AS (SELECT *, CASE WHEN len(f) = 2 THEN [f] WHEN len(f) = 4 AND joined THEN [e[1:2], e[3:4]] WHEN len(f) = 4 THEN [[e[4], e[1]], e[2:3]] END AS parts FROM f),
o AS (SELECT *, unnest(parts) AS s, generate_subscripts(parts, 1)::INT - 1 AS part FROM i)
SELECT level_index, row, col, part, round(level, 4) AS level, {", ".join(f"round({w.format(f's[{k}].{c}')}, 9) AS {'ab'[k - 1]}_{c}" for k in (1, 2) for c, w in (("lon", "(({} + 180) % 360 - 180)"), ("lat", "{}")))}
FROM o WHERE sqrt(pow(s[1].lon - s[2].lon, 2) + pow(s[1].lat - s[2].lat, 2)) >= 1e-14"""


def fil10_valid(spark, sf):
    """Every seventh footprint is a bow tie, every eleventh open, every thirteenth flat; of the others some have
    holes that are nested, meet, or lie outside, and some sound holes, or parts that touch."""
    b = buildings(spark, sf).select(F.col("input_pos").alias("feature_id"), "parts")
    r = F.col("parts")[0][0]
    k = F.col("feature_id")
    bow = F.array(r[0], r[2], r[1], g.vertex(r[3]["lon"], 2 * r[3]["lat"] - r[0]["lat"]), r[0])
    ring = F.when(k % 7 == 0, bow).when(k % 11 == 0, F.slice(r, 1, 4)).when(k % 13 == 0, F.array(r[0], r[1], r[0], r[0])).otherwise(r)
    x, y = (lambda f: r[0]["lon"] + (r[1]["lon"] - r[0]["lon"]) * f), (lambda f: r[0]["lat"] + (r[2]["lat"] - r[0]["lat"]) * f)
    box = lambda low, high: g.ring_of(x(low), y(low), x(high), y(high))
    none = F.array().cast(f"array<array<{g.VERTEX}>>")
    holes = F.when(k % 17 == 0, F.array(box(0.1, 0.9), box(0.2, 0.3))).when(k % 19 == 0, F.array(box(0.1, 0.5), box(0.4, 0.8))).when(k % 23 == 0, F.array(box(0.2, 0.4), box(1.2, 1.4))).when(k % 5 == 0, F.array(box(0.1, 0.3), box(0.5, 0.7))).otherwise(none)
    parts = F.array(F.concat(F.array(ring), F.when((k % 7 == 0) | (k % 11 == 0) | (k % 13 == 0), none).otherwise(holes)))
    more = F.when(k % 3 == 0, F.array(F.array(g.ring_of(r[1]["lon"], r[1]["lat"], r[1]["lon"] + 0.001, r[2]["lat"])))).otherwise(F.array().cast(g.PARTS))
    _, bad = op.validated(b.withColumn("parts", F.concat(parts, more)))
    return bad.select("feature_id", "reason")


def pipe9_rings(spark, sf):
    """Pins around suppliers: of some too few, of some crossing or in a row, of the others a rectangle."""
    s = placed(table(spark, sf, "supplier"), "s_suppkey")
    k, i = F.col("s_suppkey"), F.col("pos")
    pins = s.select("s_suppkey", F.col("lon").alias("x"), F.col("lat").alias("y"), F.explode(F.sequence(F.lit(0), F.when(k % 7 == 0, F.lit(1)).otherwise(3))).alias("pos"))
    east, north = F.when(i.isin(1, 2), 0.01).otherwise(0.0), F.when(i >= 2, 0.01).otherwise(0.0)
    crossing = F.when(i == 1, 0.01).when(i == 3, 0.02).otherwise(0.0)
    lat = F.when(k % 5 == 0, crossing).when(k % 11 == 0, 0.0).otherwise(north)
    pins = pins.select("s_suppkey", "pos", F.concat_ws("-", k, i).alias("pin_id"), (F.col("x") + F.when(k % 11 == 0, i / 1000).otherwise(east)).alias("lon"), (F.col("y") + lat).alias("lat"))
    return op.pin_areas(pins, "s_suppkey").select("s_suppkey", F.round("area", 2).alias("area"), F.array_join("pin_ids", ",").alias("pin_ids"), "reason")


PIPE9 = f"""SELECT k AS s_suppkey, CASE WHEN reason IS NULL THEN round(6371008.8 * 6371008.8 / 2 * abs(radians(0.01) * (2 + 2 * sin(radians(lat))) - radians(0.01) * (2 + 2 * sin(radians(lat + 0.01)))), 2) END AS area, CASE WHEN k % 7 = 0 THEN k || '-0,' || k || '-1' ELSE k || '-0,' || k || '-1,' || k || '-2,' || k || '-3' END AS pin_ids, reason
FROM (SELECT s_suppkey AS k, {LAT.format(k='s_suppkey')} AS lat, CASE WHEN s_suppkey % 7 = 0 THEN 'too few pins' WHEN s_suppkey % 5 = 0 AND s_suppkey % 11 <> 0 THEN 'edges meet' WHEN s_suppkey % 11 = 0 AND s_suppkey % 5 <> 0 THEN 'no area' WHEN s_suppkey % 55 = 0 THEN 'edges meet' END AS reason FROM supplier)"""


def fn18_rings(spark, sf):
    """Footprints cut into two lines each, one of them reversed, stitched again; every sixth has a hole, and
    every tenth has inner lines only."""
    b = buildings(spark, sf)
    r = F.col("parts")[0][0]
    parts = F.array(F.struct(F.lit(1).alias("pos"), F.slice(r, 1, 3).alias("path")), F.struct(F.lit(2).alias("pos"), F.reverse(F.slice(r, 3, 3)).alias("path")))
    k = F.col("relation_id")
    m = b.select(F.col("input_pos").alias("relation_id"), F.explode(parts).alias("m")).select("relation_id", "m.pos", F.when(k % 10 == 0, "inner").otherwise("outer").alias("role"), "m.path")
    holes = m.where(k % 6 == 0).withColumns({"pos": F.col("pos") + 2, "role": F.lit("inner")})
    return readers.assembled_rings(m.unionByName(holes)).select("relation_id", F.size(F.col("parts")[0]).alias("rings"), F.size(F.col("parts")[0][0]).alias("n"), F.round(g.metrics("parts")["area"], 2).alias("area"))


def str1_places(spark, sf):
    """A stream of places: a third of them arrives, and is ingested, before the next one does."""
    c = table(spark, sf, "customer").withColumn("k", F.floor(F.col("c_custkey") / 2))
    p = placed(c, "k").select(F.format_string("p%07d", "c_custkey").alias("place_id"), F.concat(F.lit("Block "), "k").alias("name"), fn.ascii_key(F.concat(F.lit("Block "), "k")).alias("normalized_name"), (F.col("lon") + (F.col("c_custkey") % 2) * 0.0001).alias("lon"), "lat", F.col("c_custkey").alias("created_at"))
    scratch = Scratch(spark)
    store = PlaceStore(spark, scratch.path("store"))
    for k in range(3):
        p.where(F.col("created_at") % 3 == k).write.parquet(scratch.path(f"arrivals/{k}"))
        stream = spark.readStream.schema(p.schema).parquet(scratch.path("arrivals/*"))
        ingest(stream, store, scratch.path("checkpoint")).awaitTermination()
    return store.aliases(2)


QUERIES = {
    "agg14_hulls": (agg14_hulls, AGG14),
    "pipe4_surface": (pipe4_surface, f"{_NODES} SELECT row, col, round((p[1].value + p[2].value + p[3].value + p[4].value) / 4, 4) AS value FROM q"),
    "pipe5_contours": (pipe5_contours, PIPE5),
    "fil10_valid": (fil10_valid, "SELECT k AS feature_id, CASE WHEN k % 7 = 0 THEN 'edges meet' WHEN k % 11 = 0 THEN 'open ring' WHEN k % 13 = 0 THEN 'no area' WHEN k % 17 = 0 THEN 'nested holes' WHEN k % 19 = 0 THEN 'rings meet' ELSE 'hole outside' END AS reason FROM (SELECT p_partkey AS k FROM part) WHERE k % 7 = 0 OR k % 11 = 0 OR k % 13 = 0 OR k % 17 = 0 OR k % 19 = 0 OR k % 23 = 0"),
    "pipe9_rings": (pipe9_rings, PIPE9),
    "fn18_rings": (fn18_rings, f"SELECT k AS relation_id, CASE WHEN k % 6 = 0 THEN 2 ELSE 1 END AS rings, 5 AS n, round((e - w) * (n - so) * pow(pi() * 6371008.8 / 180, 2) * cos(radians((so * 3 + n * 2) / 5)), 2) AS area FROM ({BUILDINGS}) WHERE k % 10 <> 0"),
    "str1_places": (str1_places, f"WITH p AS (SELECT c_custkey AS c, c_custkey // 2 AS k, c_custkey % 3 AS b FROM customer), q AS (SELECT x.c AS a, y.c AS o FROM p x JOIN p y ON x.k = y.k AND x.c <> y.c AND (y.b < x.b OR (y.b = x.b AND y.c < x.c))) SELECT printf('p%07d', a) AS place_id, printf('p%07d', o) AS canonical_id FROM q"),
}
