"""Queries of single functions over whole tables, of sources, and of web pages."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..functions import geometry as g
from ..functions.inputs import BUILDINGS, LAT, LON, OBS, buildings, observations, placed, spread_observations, table
from ..operators import coverage
from ..scratch import Scratch
from ..sources import readers, web

_DIST = "6371008.8 * sqrt(pow(radians({b}.lon - {a}.lon) * cos(radians(({a}.lat + {b}.lat) / 2)), 2) + pow(radians({b}.lat - {a}.lat), 2))"


def fn1_distance(spark, sf):
    o = observations(spark, sf)
    return o.select("feature_id", F.round(fn.distance("lon", "lat", F.lit(77.1), F.lit(28.575)), 4).alias("metres"), F.round(fn.haversine("lon", "lat", F.lit(77.1), F.lit(28.575)), 4).alias("sphere"))


def fn2_tiles(spark, sf):
    o = observations(spark, sf).withColumns({"x": fn.tile_x("lon", 14), "y": fn.tile_y("lat", 14)})
    o = o.withColumn("b", fn.tile_bbox("x", "y", 14))
    return o.select("feature_id", "x", "y", fn.quadkey("x", "y", 14).alias("quadkey"), *(F.round(f"b.{c}", 6).alias(c) for c in ("west", "south", "east", "north")))


_XY = "floor((lon + 180) / 360 * 16384)::INT AS x, floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 16384)::INT AS y"


def fn3_text_key(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", fn.text_key(F.concat(F.lit("  "), F.upper("c_name"), F.lit("   "), "c_mktsegment", F.lit(" "))).alias("key"))


def fn5_length(spark, sf):
    p = table(spark, sf, "part")
    unit = F.element_at(F.array(*map(F.lit, (" m", " ft", "cm", "", " yards", "'", " metres"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    return p.select("p_partkey", F.round(fn.parse_length(F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".5").otherwise(""), F.when(unit == "cm", " cm").otherwise(unit))), 6).alias("metres"))


def fn6_classes(spark, sf):
    p = table(spark, sf, "part")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("p_partkey") % len(xs) + 1).cast("int"))
    lr = fn.level_range(F.concat(F.lit("hbet: "), (F.col("p_size") % 12).cast("string"), F.lit(" - "), (F.col("p_size") % 20).cast("string")))
    return p.select("p_partkey", fn.poi_category({"amenity": pick(("fuel", "school", "bench", "police", "clinic")), "tourism": pick(("hotel", "", "museum")), "shop": F.lit("supermarket")}).alias("category"), lr["lo"].alias("lo"), lr["hi"].alias("hi"))


def fn7_numbers(spark, sf):
    p = table(spark, sf, "part")
    shape = F.col("p_partkey") % 6
    t = F.when(shape == 0, F.concat(F.lit("1,"), F.format_string("%03d", F.col("p_size")))).when(shape == 1, F.concat(F.lit("1,"), F.col("p_size").cast("string"))).when(shape == 2, F.concat(F.col("p_size").cast("string"), F.lit("e2"))).when(shape == 3, F.lit("1e999")).when(shape == 4, F.lit(" ")).otherwise(F.concat(F.lit("-."), F.col("p_size").cast("string")))
    return p.select("p_partkey", fn.strict_number(t).alias("strict"), fn.table_number(t).alias("grouped"))


def fn8_times(spark, sf):
    e = table(spark, sf, "events")
    shape = F.col("event_id") % 5
    day = F.date_format("ts", "yyyy-MM-dd")
    t = F.when(shape == 0, day).when(shape == 1, F.concat(day, F.lit("T10:15:30.250+02:30"))).when(shape == 2, F.concat(day, F.lit("T10:15:30"))).when(shape == 3, F.lit("2024-02-30")).otherwise(F.concat(day, F.lit("T24:00Z")))
    return e.select("event_id", fn.normal_time(t, "observed").alias("time"), fn.normal_time(F.date_format("ts", "yyyy"), "census_year").alias("year"))


def fn12_area(spark, sf):
    b = buildings(spark, sf)
    return b.select(F.col("input_pos").alias("id"), F.round(g.polygon_area(F.col("parts")[0]), 3).alias("area"))


def fn13_representatives(spark, sf):
    b = buildings(spark, sf)
    p, m = g.representative(F.lit("Polygon"), "parts"), g.representative(F.lit("LineString"), F.array(F.array(F.slice(F.col("parts")[0][0], 1, 3))))
    r = b.select(F.col("input_pos").alias("id"), p.alias("p"), m.alias("m"))
    return r.select("id", F.round("p.lon", 7).alias("lon"), F.round("p.lat", 7).alias("lat"), F.round("m.lon", 6).alias("mid_lon"), F.round("m.lat", 6).alias("mid_lat"))


def fn15_sub_line(spark, sf):
    o = observations(spark, sf)
    path = F.array(g.vertex("lon", "lat"), g.vertex(F.col("lon"), F.col("lat") + 0.02), g.vertex(F.col("lon"), F.col("lat") + 0.04))
    cut = g.sub_line(path, F.lit(0.75))
    return o.select("feature_id", F.size(cut).alias("n"), F.round(F.element_at(cut, -1)["lat"], 7).alias("end_lat"))


def fn16_circle(spark, sf):
    o = spread_observations(spark, sf).withColumn("ring", g.circle("lon", "lat", F.lit(500.0)))
    ring = F.col("ring")
    return o.select("feature_id", F.size(ring).alias("n"), F.round(g.ring_area(ring), 0).alias("area"))


FN16 = f"""WITH o AS (SELECT feature_id, radians(lon) AS lo, radians(lat) AS la, 500.0::DOUBLE / 6371008.8 AS r, unnest(range(0, 65)) AS k FROM ({OBS})), b AS (SELECT *, 2 * pi() * (k % 64) / 64 AS t FROM o),
y AS (SELECT *, asin(sin(la) * cos(r) + cos(la) * sin(r) * cos(t)) AS y FROM b), c AS (SELECT feature_id, k, lo + atan2(sin(t) * sin(r) * cos(la), cos(r) - sin(la) * sin(y)) AS x, y FROM y),
s AS (SELECT feature_id, (lead(x) OVER w - x) * (2 + sin(y) + sin(lead(y) OVER w)) AS s FROM c WINDOW w AS (PARTITION BY feature_id ORDER BY k)) SELECT feature_id, count(*)::INT AS n, round(abs(sum(s)) * 6371008.8 * 6371008.8 / 2, 0) AS area FROM s GROUP BY 1"""


def fn19_redact(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", fn.redact(F.concat(F.lit("https://h/p?api_key="), F.col("o_custkey").cast("string"), F.lit("&x="), "o_orderpriority")).alias("text"))


def fn20_hash(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", fn.request_hash(q=F.lower("c_name"), n=F.col("c_nationkey"), provider=F.lit("p")).alias("hash"))


def fn21_coordinates(spark, sf):
    o = observations(spark, sf)
    k = F.col("feature_id") % 4
    a, b = F.format_string("%.5f", F.col("lat")), F.format_string("%.5f", F.col("lon"))
    t = F.when(k == 0, F.concat(a, F.lit(" , "), b)).when(k == 1, F.concat(a, F.lit("° S, "), b, F.lit(" w"))).when(k == 2, F.concat(F.lit("geo:"), a, F.lit(","), b, F.lit("?z=12"))).otherwise(F.concat(F.lit("near "), a, F.lit(","), b))
    c = fn.coordinates(t)
    return o.select("feature_id", c["lon"].alias("lon"), c["lat"].alias("lat"))


def fn22_longitudes(spark, sf):
    o = observations(spark, sf).withColumn("x", F.col("lon") * 7 - 300)
    return o.select("feature_id", F.round(fn.wrap_longitude("x"), 6).alias("wrapped"), F.round(fn.longitude_near("x", F.lit(170.0)), 6).alias("near"), F.round(fn.longitude_delta(fn.wrap_longitude("x"), F.lit(-179.0)), 6).alias("delta"))


def win9_coverage(spark, sf):
    """The tiles within a ring of each supplier's."""
    s = placed(table(spark, sf, "supplier"), "s_suppkey").select("s_suppkey", "lon", "lat", F.lit(1).alias("radius"))
    return coverage.ring_tiles(s, "s_suppkey").select("s_suppkey", "x", "y", "ring")


def win9_extents(spark, sf):
    """The tiles of boxes around suppliers, from one to tens of thousands, some over the date line."""
    k = F.col("s_suppkey")
    s = placed(table(spark, sf, "supplier"), "s_suppkey").withColumns({"lon": F.col("lon") + F.when(k % 10 == 0, 102.9).otherwise(0.0), "hx": F.when(k % 50 == 7, 2.0).otherwise((1 + k % 7) / 100), "hy": F.when(k % 50 == 7, 1.5).otherwise((k % 5) / 125)})
    boxes = s.select("s_suppkey", fn.wrap_longitude(F.col("lon") - F.col("hx")).alias("west"), (F.col("lat") - F.col("hy")).alias("south"), fn.wrap_longitude(F.col("lon") + F.col("hx")).alias("east"), (F.col("lat") + F.col("hy")).alias("north"))
    return coverage.box_tiles(boxes, "s_suppkey").withColumn("distance", F.round("distance", 6))


_WRAP = lambda x: f"(({x} + 180) - 360 * floor(({x} + 180) / 360) - 180)"
_COLUMN = lambda x: f"greatest(0, least(16383, floor(({x} + 180) / 360 * 16384)))::BIGINT"
_ROW = lambda y: f"greatest(0, least(16383, floor((1 - asinh(tan(radians({y}))) / pi()) / 2 * 16384)))::BIGINT"
WIN9 = f"""WITH s AS (SELECT s_suppkey, {LON.format(k='s_suppkey')} + CASE WHEN s_suppkey % 10 = 0 THEN 102.9::DOUBLE ELSE 0.0::DOUBLE END AS lon, {LAT.format(k='s_suppkey')} AS lat, CASE WHEN s_suppkey % 50 = 7 THEN 2.0::DOUBLE ELSE (1 + s_suppkey % 7) / 100.0::DOUBLE END AS hx, CASE WHEN s_suppkey % 50 = 7 THEN 1.5::DOUBLE ELSE (s_suppkey % 5) / 125.0::DOUBLE END AS hy FROM supplier),
b AS (SELECT s_suppkey, {_WRAP("(lon - hx)")} AS w, lat - hy AS so, {_WRAP("(lon + hx)")} AS e, lat + hy AS n FROM s),
m AS (SELECT *, w + (e - w + CASE WHEN w > e THEN 360 ELSE 0 END) / 2 AS mid FROM b),
t AS (SELECT s_suppkey, {_COLUMN("w")} AS x0, {_COLUMN("e")} + CASE WHEN w > e THEN 16384 ELSE 0 END AS x1, {_ROW("n")} AS y0, {_ROW("so")} AS y1, {_COLUMN(_WRAP("mid"))} AS cx, {_ROW("(so + n) / 2")} AS cy FROM m),
u AS (SELECT s_suppkey, x, y, (x - (cx + CASE WHEN cx < x0 THEN 16384 ELSE 0 END)) ** 2 + (y - cy) ** 2 AS d FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM t), LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y))
SELECT s_suppkey, x % 16384 AS x, y, round(sqrt(d), 6) AS distance, row_number() OVER (PARTITION BY s_suppkey ORDER BY d, u.x, y) AS rank FROM u"""


def win11_thin(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("path"))
    return li.select("l_orderkey", F.array_join(g.thin("path", 4), ",").alias("kept"))


def fil5_meets_box(spark, sf):
    b = buildings(spark, sf)
    return b.where(g.meets_box(F.lit("Polygon"), "parts", (77.05, 28.55, 77.0503, 28.5503)) | g.meets_box(F.lit("Polygon"), "parts", (77.1, 28.52, 77.14, 28.56))).select("source_id")


def pipe9_pin_areas(spark, sf):
    """Rings of four pins around every supplier, in the order in which they were set."""
    s = placed(table(spark, sf, "supplier"), "s_suppkey")
    k = F.explode(F.sequence(F.lit(0), F.lit(3)))
    pins = s.select("s_suppkey", "lon", "lat", k.alias("k")).select("s_suppkey", "k", (F.col("lon") + F.when(F.col("k").isin(1, 2), 0.01).otherwise(0.0)).alias("lon"), (F.col("lat") + F.when(F.col("k") >= 2, 0.01).otherwise(0.0)).alias("lat"))
    ring = pins.groupBy("s_suppkey").agg(F.array_sort(F.collect_list(F.struct("k", "lon", "lat"))).alias("p"))
    path = F.transform("p", lambda x: g.vertex(x["lon"], x["lat"]))
    return ring.where(F.size("p") >= 3).select("s_suppkey", F.round(g.ring_area(F.concat(path, F.slice(path, 1, 1))), 2).alias("area"))


# Sources


def _elements(spark, sf):
    p = placed(table(spark, sf, "part"), "p_partkey")
    k = F.col("p_partkey")
    tag = lambda name, cond, v: (F.lit(name), F.when(cond, v))
    tags = F.map_filter(F.create_map(*tag("building", k % 3 == 0, F.lit("yes")), *tag("building:part", k % 7 == 0, F.lit("tower")), *tag("height", k % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" ft"))), *tag("building:levels", k % 4 == 0, F.col("p_size").cast("string")), *tag("amenity", k % 5 == 0, F.lit("fuel")), *tag("shop", k % 5 == 1, F.lit("supermarket")), *tag("name", k % 2 == 1, F.col("p_name")), *tag("brand", k % 2 == 0, F.col("p_brand")), *tag("addr:city", k % 3 == 1, F.lit("Town")), *tag("addr:street", k % 3 < 2, F.lit("Road"))), lambda a, b: b.isNotNull())
    return p.select(F.lit("node").alias("type"), k.alias("id"), tags.alias("tags"), F.when(k % 9 != 0, F.col("lon")).alias("lon"), "lat", F.when(k % 9 == 0, F.struct("lon", "lat")).alias("center"))


_EL = f"SELECT p_partkey AS k, p_size AS s, p_name, p_brand, {LON.format(k='p_partkey')} AS lon, {LAT.format(k='p_partkey')} AS lat FROM part"


def src5_buildings(spark, sf):
    return readers.osm_buildings(_elements(spark, sf)).select("source_id", "building_type", F.round("real_height", 4).alias("real_height"), "levels", "name")


def src6_pois(spark, sf):
    r = readers.osm_pois(_elements(spark, sf))
    v = F.col("parts")[0][0][0]
    return r.select("source_id", "category", "name", F.round(v["lon"], 6).alias("lon"), F.round(v["lat"], 6).alias("lat"))


def src7_places(spark, sf):
    r = readers.osm_places(_elements(spark, sf), "in")
    return r.select("place_id", "name", "address", "country_code", F.round("bbox.w", 6).alias("w"), F.round("bbox.n", 6).alias("n"))


def src8_rows(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("FID"), F.when(F.col("p_partkey") % 2 == 0, F.lit("HBET:2-4")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" m"))).alias("height_m"), F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.col("p_type")).alias("Type"), F.col("p_brand").alias("class"), F.col("p_size").alias("num_floors"), F.col("p_name").alias("label"), F.lit("").alias("Society"), F.col("p_brand").alias("project"))
    return readers.aliased_rows(p, "f.csv").select("source_id", "building_type", "real_height", "lo", "levels", "name", "community")


def src2_geojson(spark, sf):
    """Observations written as GeoJSON features and read again."""
    o = observations(spark, sf).withColumns({"geom_type": F.lit("Point"), "parts": g.point_parts("lon", "lat")})
    features, _ = readers.geojson_features(readers.geojson_rows(o, ["value", "category"], "customers"))
    v = F.col("parts")[0][0][0]
    return features.select(F.col("feature_id").cast("long").alias("feature_id"), "geom_type", v["lon"].alias("lon"), v["lat"].alias("lat"), F.col("props")["value"].cast("double").alias("value"), F.col("props")["layer"].alias("layer"))


def src3_points(spark, sf):
    """Delimited text of all customers, written and read again: every tenth longitude is no number, every
    seventh latitude out of range, every thirteenth row blank."""
    c = placed(table(spark, sf, "customer"), "c_custkey")
    k, there = F.col("c_custkey"), F.col("c_custkey") % 13 != 0
    cells = {"id": F.format_string("%06d", k), "Name": F.col("c_name"), "Longitude": F.when(k % 10 == 0, "x").otherwise(F.format_string("%.5f", "lon")), "LAT": F.when(k % 7 == 0, "95").otherwise(F.format_string("%.5f", "lat")), "people": F.format_number(k * 1003, 0), "mixed": F.when(k % 5 == 0, "12,34").otherwise(k.cast("string"))}
    scratch = Scratch(spark)
    c.select(*(F.when(there, v).alias(n) for n, v in cells.items())).write.option("header", True).csv(scratch.path("points"))
    good, bad = readers.read_points(spark, scratch.path("points"))
    out = good.select("id", "Name", "lon", "lat", "people", "mixed", F.lit("point").alias("state"))
    none = F.lit(None).cast("double")
    return out.unionByName(bad.select("id", "Name", none.alias("lon"), none.alias("lat"), none.alias("people"), F.lit(None).cast("string").alias("mixed"), F.lit("reject").alias("state")))


SRC3 = f"""WITH c AS (SELECT c_custkey AS k, c_name, {LON.format(k='c_custkey')} AS lon, {LAT.format(k='c_custkey')} AS lat, c_custkey % 10 <> 0 AND c_custkey % 7 <> 0 AS ok FROM customer WHERE c_custkey % 13 <> 0)
SELECT printf('%06d', k) AS id, c_name AS Name, CASE WHEN ok THEN round(lon, 5) END AS lon, CASE WHEN ok THEN round(lat, 5) END AS lat, CASE WHEN ok THEN k * 1003::DOUBLE END AS people, CASE WHEN ok THEN CASE WHEN k % 5 = 0 THEN '12,34' ELSE k::VARCHAR END END AS mixed, CASE WHEN ok THEN 'point' ELSE 'reject' END AS state FROM c"""


def src11_export(spark, sf):
    """Two layers merged in one folder of GeoJSON features, each with the id of its layer, and read again."""
    o = observations(spark, sf).withColumns({"geom_type": F.lit("Point"), "parts": g.point_parts("lon", "lat")})
    s = placed(table(spark, sf, "supplier"), "s_suppkey").withColumns({"feature_id": F.concat(F.lit('s "'), "s_suppkey", F.lit('"')), "geom_type": F.lit("LineString"), "parts": F.array(F.array(F.array(g.vertex("lon", "lat"), g.vertex(F.col("lon") + 0.5, F.col("lat")))))})
    scratch = Scratch(spark)
    readers.geojson_rows(o, ["value", "category"], "customers").unionByName(readers.geojson_rows(s, ["s_name"], "suppliers")).write.text(scratch.path("layers"))
    features, _ = readers.geojson_features(spark.read.text(scratch.path("layers")))
    v = F.element_at(F.col("parts")[0][0], -1)
    return features.select(F.col("props")["layer"].alias("layer"), "feature_id", "geom_type", F.round(v["lon"], 6).alias("lon"), F.round(v["lat"], 6).alias("lat"), F.coalesce(F.col("props")["category"], F.col("props")["s_name"]).alias("label"))


SRC11 = f"""SELECT 'customers' AS layer, feature_id::VARCHAR AS feature_id, 'Point' AS geom_type, round(lon, 6) AS lon, round(lat, 6) AS lat, category AS label FROM ({OBS}) UNION ALL
SELECT 'suppliers', 's "' || s_suppkey || '"', 'LineString', round({LON.format(k='s_suppkey')} + 0.5, 6), round({LAT.format(k='s_suppkey')}, 6), s_name FROM supplier"""


def _hex_wkb(order: str):
    """A polygon's ring as hexadecimal WKB, in little or big byte order."""

    def text(paths: pd.Series) -> pd.Series:
        head = lambda n: struct.pack(f"{order}BIII", order == "<", 3, 1, n)
        return paths.map(lambda path: (head(len(path)) + b"".join(struct.pack(f"{order}dd", p["lon"], p["lat"]) for p in path)).hex())

    return F.pandas_udf(text, "string")


def src9_geometries(spark, sf):
    """Footprints as WKT and as hexadecimal WKB of both byte orders, decoded."""
    b = buildings(spark, sf)
    v = F.col("parts")[0][0]
    wkt = F.concat(F.lit("SRID=4326;POLYGON (("), F.array_join(F.transform(v, lambda p: F.concat_ws(" ", p["lon"], p["lat"])), ", "), F.lit("))"))
    rows = b.select(F.col("input_pos").alias("id"), F.when(F.col("input_pos") % 10 == 0, "not a geometry").when(F.col("input_pos") % 10 < 4, _hex_wkb("<")(v)).when(F.col("input_pos") % 10 < 6, F.upper(_hex_wkb(">")(v))).otherwise(wkt).alias("geom"))
    good, _ = readers.decode_geometries(rows, "id", "geom")
    return good.select("id", "geom_type", F.size(F.col("parts")[0][0]).alias("n"), F.round(g.metrics("parts")["area"], 2).alias("area"))


def src12_snapshot(spark, sf):
    b = buildings(spark, sf)
    return b.where("building_type = 'office'").select("source_id", F.lit("buildings").alias("layer"), F.lit("real_height").alias("field"), F.lit("m").alias("unit"))


def src4_pages(spark, sf):
    p = web.extract_pages(table(spark, sf, "pages"))
    return p.select("page_id", "title", F.sha2("text", 256).alias("text_sha256"), F.size("links").alias("n_links"), F.size("tables").alias("n_tables"))


def fil12_links(spark, sf):
    """The pages' own addresses and their links, canonical and once each, by host."""
    pages = web.extract_pages(table(spark, sf, "pages").withColumn("url", web.clean_urls("url")))
    own = pages.select("page_id", F.array(F.struct("url", "title")).alias("links")).where("url IS NOT NULL")
    return web.host_counts(web.link_table(pages.select("page_id", "links").unionByName(own)))


def _candidates(spark, sf, urls: int = 300):
    """A source candidate of each document: its first words and its whole text; every tenth speaks of a check of browsers."""
    d = table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    snippet = F.concat(F.col("text"), F.when(F.col("doc_id") % 10 == 0, "\nPlease wait\nChecking your browser now").otherwise(""))
    return d.select(F.col("doc_id").alias("pos"), F.concat(F.lit("Item "), F.substring_index("text", " ", 2)).alias("title"), F.concat(F.lit("https://"), "source", F.when(F.col("doc_id") % 20 == 0, ".census.gov/").otherwise(".org/"), F.col("doc_id") % urls, F.when(F.col("doc_id") % 7 == 0, ".csv").otherwise("")).alias("url"), snippet.alias("snippet"))


def fil13_useful(spark, sf):
    u = web.useful_sources(_candidates(spark, sf).withColumn("title", F.when(F.col("pos") % 3 == 0, "Just a  moment!").otherwise(F.col("title"))).withColumn("snippet", F.concat("snippet", F.when(F.col("pos") % 6 == 0, "\nPlease wait.").otherwise("\nSome words. Please wait now. More words"))))
    return u.select("pos", "snippet")


def win5_sources(spark, sf):
    r = web.rank_sources(_candidates(spark, sf).withColumn("snippet", F.concat("snippet", F.lit("\nthnd "), F.col("pos") % 40)), "population of thnd 17 csv data in 23", 8)
    return r.select("pos", F.round("score", 6).alias("score"))


#: Titles, URLs and snippets of the candidates; the sentences of boilerplate are lines of their own.
_CAND = """SELECT doc_id AS pos, 'https://' || source || CASE WHEN doc_id % 20 = 0 THEN '.census.gov/' ELSE '.org/' END || (doc_id % 300) || CASE WHEN doc_id % 7 = 0 THEN '.csv' ELSE '' END AS url, 'Item ' || array_to_string(string_split(coalesce(text, ''), ' ')[1:2], ' ') AS title, coalesce(text, '') AS text FROM documents"""
WIN5 = f"""WITH c AS (SELECT pos, url, strip_accents(lower(title || ' ' || text || chr(10) || 'thnd ' || (pos % 40) || ' ' || url)) AS t FROM ({_CAND})),
w AS (SELECT pos, url, {", ".join(f"regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}]){x}($|[^\\p{{L}}\\p{{N}}])') AS {n}" for x, n in (("population", "w1"), ("thnd", "w2"), ("17", "w3"), ("23", "w4"), ("csv", "w5"), ("data", "w6"), ("(geotiff|geojson|geopackage|gridded|raster)", "w7")))} FROM c),
n AS (SELECT count(*) AS n, count(*) FILTER (w1) AS d1, count(*) FILTER (w2) AS d2, count(*) FILTER (w3) AS d3, count(*) FILTER (w4) AS d4 FROM w),
s AS (SELECT pos, url, {" + ".join(f"CASE WHEN w{k} THEN 1 + ln((n + 1) / (1 + d{k})) ELSE 0 END" for k in (1, 2, 3, 4))}
 + 0.1 * (w5::INT + w6::INT) + CASE WHEN pos % 20 = 0 THEN 1.5 ELSE 0 END + CASE WHEN (w1 OR w2 OR w3 OR w4 OR pos % 20 = 0) AND (pos % 7 = 0 OR w7) THEN 0.25 ELSE 0 END AS score FROM w, n),
b AS (SELECT arg_max(pos, (score, -pos)) AS pos, max(score) AS score FROM s GROUP BY url) SELECT pos, round(score, 6) AS score FROM b ORDER BY b.score DESC, pos LIMIT 8"""
_SPLIT = "list_filter(string_split(regexp_replace({s}, '([.!?])[\\s\\x0B]+|\\n+', '\\1' || chr(1), 'g'), chr(1)), lambda x: NOT regexp_matches(x, '(?i)" + web.BOILERPLATE.replace("'", "''") + "'))"
FIL13 = f"""WITH c AS (SELECT pos, text || CASE WHEN pos % 10 = 0 THEN chr(10) || 'Please wait' || chr(10) || 'Checking your browser now' ELSE '' END || chr(10) || CASE WHEN pos % 6 = 0 THEN 'Please wait.' ELSE 'Some words. Please wait now. More words' END AS s FROM ({_CAND})),
p AS (SELECT pos, array_to_string({_SPLIT.format(s='s')}, ' ') AS snippet FROM c) SELECT pos, snippet FROM p WHERE pos % 3 <> 0 OR regexp_matches(snippet, '[\\p{{L}}\\p{{N}}]')"""


def set3_results(spark, sf):
    """Two lists of all documents, some of whose URLs are the same."""
    a, b = (_candidates(spark, sf, n).select("pos", "url", "title") for n in (300, 450))
    return web.joined_results(a, b).select("list", "pos", "url")


QUERIES = {
    "fn1_distance": (fn1_distance, f"SELECT feature_id, round({_DIST.format(a='o', b='c')}, 4) AS metres, round(2 * 6371008.8 * atan2(sqrt(h), sqrt(1 - h)), 4) AS sphere FROM (SELECT *, pow(sin(radians(28.575 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(28.575)) * pow(sin(radians(77.1 - lon) / 2), 2) AS h FROM ({OBS})) o, (SELECT 77.1::DOUBLE AS lon, 28.575::DOUBLE AS lat) c"),
    "fn2_tiles": (fn2_tiles, f"WITH t AS (SELECT feature_id, {_XY} FROM ({OBS})) SELECT feature_id, x, y, (SELECT string_agg(((x >> b) & 1) + 2 * ((y >> b) & 1), '' ORDER BY b DESC) FROM (SELECT unnest(range(0, 14))::INT AS b)) AS quadkey, round(x / 16384 * 360 - 180, 6) AS west, round(degrees(atan((exp(pi() * (1 - 2 * (y + 1) / 16384)) - exp(-pi() * (1 - 2 * (y + 1) / 16384))) / 2)), 6) AS south, round((x + 1) / 16384 * 360 - 180, 6) AS east, round(degrees(atan((exp(pi() * (1 - 2 * y / 16384)) - exp(-pi() * (1 - 2 * y / 16384))) / 2)), 6) AS north FROM t"),
    "fn3_text_key": (fn3_text_key, "SELECT c_custkey, lower(c_name || ' ' || c_mktsegment) AS key FROM customer"),
    "fn5_length": (fn5_length, "WITH p AS (SELECT p_partkey, p_size + CASE WHEN p_partkey % 2 = 0 THEN 0.5 ELSE 0 END AS v FROM part) SELECT p_partkey, round(CASE p_partkey % 7 WHEN 0 THEN v WHEN 1 THEN v * 0.3048 WHEN 2 THEN v / 100 WHEN 3 THEN v WHEN 4 THEN 0 WHEN 5 THEN v * 0.3048 ELSE v END, 6)::DOUBLE AS metres FROM p"),
    "fn6_classes": (fn6_classes, "WITH p AS (SELECT p_partkey, p_size % 12 AS lo, p_size % 20 AS hi, CASE p_partkey % 5 WHEN 0 THEN 'fuel' WHEN 1 THEN 'education' WHEN 3 THEN 'safety' WHEN 4 THEN 'health' ELSE CASE p_partkey % 3 WHEN 0 THEN 'lodging' WHEN 2 THEN 'culture' ELSE 'shopping' END END AS category FROM part) SELECT p_partkey, category, CASE WHEN lo > 0 AND lo <= hi THEN lo::DOUBLE END AS lo, CASE WHEN lo > 0 AND lo <= hi THEN hi::DOUBLE END AS hi FROM p"),
    "fn7_numbers": (fn7_numbers, "SELECT p_partkey, CASE p_partkey % 6 WHEN 2 THEN p_size * 100::DOUBLE WHEN 5 THEN ('-.' || p_size)::DOUBLE END AS strict, CASE p_partkey % 6 WHEN 0 THEN 1000::DOUBLE + p_size WHEN 1 THEN CASE WHEN p_size >= 100 THEN 1000::DOUBLE + p_size END WHEN 2 THEN p_size * 100::DOUBLE WHEN 5 THEN ('-.' || p_size)::DOUBLE END AS grouped FROM part"),
    "fn8_times": (fn8_times, "SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d') || 'T00:00:00.000Z' WHEN 1 THEN strftime(ts, '%Y-%m-%d') || 'T07:45:30.250Z' END AS time, strftime(ts, '%Y') AS year FROM events"),
    "fn12_area": (fn12_area, f"SELECT k AS id, round(6371008.8 * 6371008.8 / 2 * abs(radians(e - w) * (2 + 2 * sin(radians(so))) - radians(e - w) * (2 + 2 * sin(radians(n)))), 3) AS area FROM ({BUILDINGS})"),
    "fn13_representatives": (fn13_representatives, f"WITH b AS (SELECT *, (e - w) * cos(radians(so)) AS dx, n - so AS dy FROM ({BUILDINGS})) SELECT k AS id, round((w + e) / 2, 7) AS lon, round((so + n) / 2, 7) AS lat, round(CASE WHEN (dx + dy) / 2 <= dx THEN w + (e - w) * ((dx + dy) / 2 / dx) ELSE e END, 6) AS mid_lon, round(CASE WHEN (dx + dy) / 2 <= dx THEN so ELSE so + (dx + dy) / 2 - dx END, 6) AS mid_lat FROM b"),
    "fn15_sub_line": (fn15_sub_line, f"SELECT feature_id, 3 AS n, round(lat + 0.03, 7) AS end_lat FROM ({OBS})"),
    "fn16_circle": (fn16_circle, FN16),
    "fn19_redact": (fn19_redact, "SELECT o_orderkey, 'https://h/p?api_key=[redacted]&x=' || o_orderpriority AS text FROM orders"),
    "fn20_hash": (fn20_hash, "SELECT c_custkey, sha256('{\"n\":' || c_nationkey || ',\"provider\":\"p\",\"q\":\"' || lower(c_name) || '\"}') AS hash FROM customer"),
    "fn21_coordinates": (fn21_coordinates, f"SELECT feature_id, CASE feature_id % 4 WHEN 1 THEN -printf('%.5f', lon)::DOUBLE WHEN 3 THEN NULL ELSE printf('%.5f', lon)::DOUBLE END AS lon, CASE feature_id % 4 WHEN 1 THEN -printf('%.5f', lat)::DOUBLE WHEN 3 THEN NULL ELSE printf('%.5f', lat)::DOUBLE END AS lat FROM ({OBS})"),
    "fn22_longitudes": (fn22_longitudes, f"WITH x AS (SELECT feature_id, lon * 7 - 300 AS x FROM ({OBS})), y AS (SELECT *, x - 360 AS wr FROM x) SELECT feature_id, round(CASE WHEN x >= 180 THEN wr ELSE x END, 6) AS wrapped, round(x, 6) AS near, round(CASE WHEN x >= 180 THEN -179 - wr ELSE -179 - x + 360 END, 6) AS delta FROM y"),
    "win9_coverage": (win9_coverage, f"WITH t AS (SELECT s_suppkey, {_XY} FROM (SELECT s_suppkey, {LON.format(k='s_suppkey')} AS lon, {LAT.format(k='s_suppkey')} AS lat FROM supplier)), d AS (SELECT unnest([-1, 0, 1]) AS d) SELECT s_suppkey, x + a.d AS x, y + b.d AS y, greatest(abs(a.d), abs(b.d)) AS ring FROM t, d a, d b"),
    "win9_extents": (win9_extents, WIN9),
    "win11_thin": (win11_thin, "WITH l AS (SELECT l_orderkey, list_sort(list(l_partkey)) AS p, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN n <= 4 THEN array_to_string(p, ',') ELSE array_to_string(list_transform([0, 1, 2, 3], lambda i: p[floor(i * (n - 1) / 3 + 0.5)::INT + 1]), ',') END AS kept FROM l"),
    "fil5_meets_box": (fil5_meets_box, f"SELECT source_id FROM ({BUILDINGS}) WHERE (w <= 77.0503 AND e >= 77.05 AND so <= 28.5503 AND n >= 28.55) OR (w <= 77.14 AND e >= 77.1 AND so <= 28.56 AND n >= 28.52)"),
    "pipe9_pin_areas": (pipe9_pin_areas, f"SELECT k AS s_suppkey, round(6371008.8 * 6371008.8 / 2 * abs(radians(0.01) * (2 + 2 * sin(radians(lat))) - radians(0.01) * (2 + 2 * sin(radians(lat + 0.01)))), 2) AS area FROM (SELECT s_suppkey AS k, {LAT.format(k='s_suppkey')} AS lat FROM supplier)"),
    "src2_geojson": (src2_geojson, f"SELECT feature_id, 'Point' AS geom_type, lon, lat, value, 'customers' AS layer FROM ({OBS})"),
    "src3_points": (src3_points, SRC3),
    "src4_pages": (src4_pages, None),
    "src11_export": (src11_export, SRC11),
    "src5_buildings": (src5_buildings, f"SELECT 'node/' || k AS source_id, CASE WHEN k % 3 = 0 THEN 'yes' ELSE 'tower' END AS building_type, round(CASE WHEN k % 2 = 0 THEN s * 0.3048::DOUBLE ELSE 0 END, 4) AS real_height, CASE WHEN k % 4 = 0 THEN s::DOUBLE ELSE 0 END AS levels, CASE WHEN k % 2 = 1 THEN left(p_name, 160) ELSE '' END AS name FROM ({_EL}) WHERE k % 3 = 0 OR k % 7 = 0"),
    "src6_pois": (src6_pois, f"SELECT 'node/' || k AS source_id, CASE WHEN k % 5 = 0 THEN 'fuel' ELSE 'shopping' END AS category, CASE WHEN k % 2 = 1 THEN p_name ELSE p_brand END AS name, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ({_EL}) WHERE k % 5 < 2"),
    "src7_places": (src7_places, f"SELECT 'openstreetmap:node:' || k AS place_id, CASE WHEN k % 2 = 1 THEN p_name ELSE p_brand END AS name, CASE k % 3 WHEN 0 THEN 'Road' WHEN 1 THEN 'Road, Town' ELSE '' END AS address, 'IN' AS country_code, round(lon, 6) AS w, round(lat, 6) AS n FROM ({_EL})"),
    "src8_rows": (src8_rows, "SELECT 'f.csv:' || p_partkey AS source_id, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type END AS building_type, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE p_size::DOUBLE END AS real_height, CASE WHEN p_partkey % 2 = 0 THEN 2.0::DOUBLE END AS lo, p_size::DOUBLE AS levels, p_name AS name, p_brand AS community FROM part"),
    "src9_geometries": (src9_geometries, f"SELECT k AS id, 'Polygon' AS geom_type, 5 AS n, round((e - w) * (n - so) * pow(pi() * 6371008.8 / 180, 2) * cos(radians((so * 3 + n * 2) / 5)), 2) AS area FROM ({BUILDINGS}) WHERE k % 10 <> 0"),
    "src12_snapshot": (src12_snapshot, f"SELECT source_id, 'buildings' AS layer, 'real_height' AS field, 'm' AS unit FROM ({BUILDINGS}) WHERE building_type = 'office'"),
    "fil12_links": (fil12_links, "SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, count(DISTINCT regexp_replace(url, '#.*', '')) AS urls FROM pages GROUP BY 1"),
    "fil13_useful": (fil13_useful, FIL13),
    "win5_sources": (win5_sources, WIN5),
    "set3_results": (set3_results, f"WITH c AS ({_CAND}), a AS (SELECT 0 AS list, pos, url FROM c UNION ALL SELECT 1, pos, regexp_replace(url, '/[0-9]+', '/' || (pos % 450)) FROM c) SELECT list, pos, url FROM a QUALIFY row_number() OVER (PARTITION BY url ORDER BY list, pos) = 1"),
}
