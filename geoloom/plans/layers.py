"""Queries over layers of observations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..functions import geometry as g
from ..functions.inputs import BUILDINGS, LAT, LON, OBS, buildings, observations, placed, spread_observations, table
from ..operators import layers as op

_R = lambda c, d=6: F.round(c, d).alias(c)


def _events(spark, sf):
    e = table(spark, sf, "events")
    return e.withColumns({"observed": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "day": F.date_format("ts", "yyyy-MM-dd")})


def agg5_density_grid(spark, sf):
    g = op.density_grid(observations(spark, sf).where("value >= 0"))
    return g.select("row", "col", "count", *(_R(c) for c in ("west", "south", "east", "north")))


GRID = f"""WITH p AS ({OBS}), q AS (SELECT * FROM p WHERE value >= 0), b AS (SELECT min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM q),
g AS (SELECT *, greatest(e - w, n - s, 0.024) / 24 AS step FROM b), h AS (SELECT w, s, step, greatest(1, least(24, ceil((e - w) / step - 1e-9))) AS cols, greatest(1, least(24, ceil((n - s) / step - 1e-9))) AS rows FROM g),
c AS (SELECT least(rows - 1, greatest(0, floor((lat - s) / step)))::INT AS row, least(cols - 1, greatest(0, floor((lon - w) / step)))::INT AS col, count(DISTINCT feature_id) AS count FROM q, h GROUP BY ALL)
SELECT row, col, count, round(w + col * step, 6) AS west, round(s + row * step, 6) AS south, round(w + (col + 1) * step, 6) AS east, round(s + (row + 1) * step, 6) AS north FROM c, h"""


def fil1_number_range(spark, sf):
    return op.number_range(observations(spark, sf), "value", 100.0, 5000.0).select("feature_id", "value")


def agg2_summary(spark, sf):
    s = op.summary(observations(spark, sf), "value")
    return s.select("count", "valid_count", "min", "median", "max", F.round("mean", 4).alias("mean"), F.round("sum", 2).alias("sum"))


def agg3_histogram(spark, sf):
    return op.histogram(observations(spark, sf), "value").select("bin", _R("low"), _R("high"), "count")


def agg4_frequencies(spark, sf):
    return op.frequencies(observations(spark, sf), "category")


def agg9_hotspots(spark, sf):
    return op.hotspots(observations(spark, sf), "value").select("feature_id", "value")


def agg10_average_duplicates(spark, sf):
    lines = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 500).alias("lon"), (F.col("l_partkey") % 50).alias("lat"), "l_quantity")
    return op.average_duplicates(lines, "l_quantity").select("lon", "lat", F.round("l_quantity", 6).alias("value"))


def agg11_time_values(spark, sf):
    return op.time_values(_events(spark, sf), "day")


def fil4_observed_time(spark, sf):
    return op.one_time_or(_events(spark, sf), "day", "2024-01-02").select("event_id")


def agg1_fields(spark, sf):
    props = F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("type"), F.col("event_type"), F.lit("observed"), F.col("observed"), F.lit("year"), F.date_format("ts", "yyyy"), F.lit("user"), F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")), F.lit("mixed"), F.when(F.col("event_id") % 3 == 0, F.lit("x")).otherwise(F.col("event_id").cast("string")), F.lit("blank"), F.lit(" "))
    return op.profile_fields(_events(spark, sf).select(props.alias("props")))


_KEYS = "('value', value::VARCHAR), ('type', event_type), ('observed', strftime(ts, '%Y-%m-%dT%H:%M:%SZ')), ('year', strftime(ts, '%Y')), ('user', CASE WHEN user_id % 2 = 0 THEN user_id::VARCHAR END), ('mixed', CASE WHEN event_id % 3 = 0 THEN 'x' ELSE event_id::VARCHAR END), ('blank', ' ')"


def agg8_extent(spark, sf):
    """Segments between the positions of two keys of every customer, moved across the antimeridian."""
    lon = lambda c: fn.wrap_longitude(c + 102.9)
    o = observations(spark, sf).withColumn("k2", F.col("feature_id") + 1)
    arcs = o.select(lon(F.col("lon")).alias("a"), lon(77.0 + (F.col("k2") * 7919 % 20000) / 100000.0).alias("b"), "lat")
    return op.extent(arcs).select(*(_R(c) for c in ("west", "south", "east", "north")))


EXTENT = f"""WITH s AS (SELECT {LON.format(k='c_custkey')} - 77.1 AS a, {LON.format(k='(c_custkey + 1)')} - 77.1 AS b, {LAT.format(k='c_custkey')} AS lat FROM customer),
r AS (SELECT least(min(a), min(b)) AS w, greatest(max(a), max(b)) AS e, min(lat) AS s, max(lat) AS n FROM s)
SELECT round(w + 180, 6) AS west, round(s, 6) AS south, round(e - 180, 6) AS east, round(n, 6) AS north FROM r"""


def agg12_inventory(spark, sf):
    a = observations(spark, sf).select(F.concat(F.lit("customers-"), "category").alias("dataset_id"), F.lit("Point").alias("geom_type"), "lon", "lat")
    b = buildings(spark, sf).select(F.concat(F.lit("buildings-"), "building_type").alias("dataset_id"), F.lit("Polygon").alias("geom_type"), F.explode(F.flatten(F.flatten("parts"))).alias("p")).select("dataset_id", "geom_type", "p.lon", "p.lat")
    return op.inventory(a.unionByName(b)).select("dataset_id", "feature_count", "geometry_types", *(_R(c) for c in ("west", "south", "east", "north")))


INVENTORY = f"""WITH a AS ({OBS}), b AS ({BUILDINGS}), u AS (SELECT 'customers-' || category AS d, 'Point' AS t, lon, lat FROM a
 UNION ALL SELECT 'buildings-' || building_type, 'Polygon', unnest([w, e, e, w, w]), unnest([so, so, n, n, so]) FROM b)
SELECT d AS dataset_id, count(*) AS feature_count, any_value(t) AS geometry_types, round(min(lon), 6) AS west, round(min(lat), 6) AS south, round(max(lon), 6) AS east, round(max(lat), 6) AS north FROM u GROUP BY d"""


def agg12_layers(spark, sf):
    """Layers of customers by segment, one of them over the antimeridian, and of buildings by type, with their
    fields, and how many features have a value above 1000."""
    k = F.col("feature_id")
    o = observations(spark, sf).withColumn("lon", F.when(F.col("category") == "HOUSEHOLD", fn.wrap_longitude(F.col("lon") + 102.9)).otherwise(F.col("lon")))
    props = F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("category"), F.col("category"), F.lit("day"), F.lit("2024-01-01"), F.lit("mixed"), F.when(k % 2 == 0, F.lit("1")).otherwise("one"), F.lit("blank"), F.lit(" "))
    a = o.select(F.concat(F.lit("customers-"), "category").alias("dataset_id"), F.when(k % 4 == 0, "MultiPoint").otherwise("Point").alias("geom_type"), g.point_parts("lon", "lat").alias("parts"), props.alias("props"), "value")
    b = buildings(spark, sf).select(F.concat(F.lit("buildings-"), "building_type").alias("dataset_id"), F.lit("Polygon").alias("geom_type"), "parts", F.create_map(F.lit("levels"), F.col("levels").cast("string")).alias("props"), F.lit(None).cast("double").alias("value"))
    listed = op.layer_inventory(a.unionByName(b), F.col("value") > 1000)
    return listed.select("dataset_id", "feature_count", "matching_count", F.array_join("geometry_types", ",").alias("geometry_types"), *(_R(c) for c in ("west", "south", "east", "north")), F.array_join("numeric_fields", ",").alias("numeric_fields"), F.array_join("categorical_fields", ",").alias("categorical_fields"))


_TURN = lambda x: f"CASE WHEN {x} >= 180 THEN {x} - 360 ELSE {x} END"
AGG12 = f"""WITH a AS (SELECT *, lon + CASE WHEN category = 'HOUSEHOLD' THEN 102.9::DOUBLE ELSE 0.0::DOUBLE END AS x FROM ({OBS})), b AS ({BUILDINGS})
SELECT 'customers-' || category AS dataset_id, count(*) AS feature_count, count(*) FILTER (value > 1000) AS matching_count, string_agg(DISTINCT CASE WHEN feature_id % 4 = 0 THEN 'MultiPoint' ELSE 'Point' END, ',' ORDER BY CASE WHEN feature_id % 4 = 0 THEN 'MultiPoint' ELSE 'Point' END) AS geometry_types,
 round({_TURN("min(x)")}, 6) AS west, round(min(lat), 6) AS south, round({_TURN("max(x)")}, 6) AS east, round(max(lat), 6) AS north, 'value' AS numeric_fields, 'category,mixed' AS categorical_fields FROM a GROUP BY category
UNION ALL SELECT 'buildings-' || building_type, count(*), 0, 'Polygon', round(min(w), 6), round(min(so), 6), round(max(e), 6), round(max(n), 6), 'levels', '' FROM b GROUP BY building_type"""


def win7_category_codes(spark, sf):
    """Codes of texts, of numbers, and of true and false, each in the order of their JSON."""
    p = table(spark, sf, "part").select("p_brand", "p_size", (F.col("p_partkey") % 2 == 0).alias("even"))
    codes = [op.category_codes(p, c, 7).select(F.lit(c).alias("field"), F.col("value").cast("string").alias("value"), "code") for c in p.columns]
    return codes[0].unionByName(codes[1]).unionByName(codes[2])


def win8_weights(spark, sf):
    w = op.weights(observations(spark, sf), "value")
    return w.select("feature_id", _R("weight"), _R("heat_weight"), _R("height", 3))


def fil2_typed_equal(spark, sf):
    """A category that is now text, now a number, now true or false."""
    o = observations(spark, sf)
    json = F.when(F.col("feature_id") % 3 == 0, "false").when(F.col("feature_id") % 3 == 1, '"false"').otherwise("0")
    v = o.withColumn("v", F.parse_json(json))
    return v.select("feature_id", op.typed_equal("v", False).alias("is_false"), op.typed_equal("v", "false").alias("is_text"), op.typed_equal("v", 0).alias("is_zero"))


def fil3_typed_compare(spark, sf):
    o = observations(spark, sf)
    json = F.when(F.col("feature_id") % 4 == 0, F.lit(None)).when(F.col("feature_id") % 4 == 1, F.concat(F.lit('"'), F.col("value").cast("string"), F.lit('"'))).otherwise(F.col("value").cast("string"))
    v = o.withColumn("v", F.try_parse_json(json))
    return v.select("feature_id", op.typed_compare("v", "gte", 1000).alias("at_least"), op.typed_compare("v", "neq", "x").alias("not_x"), op.typed_compare("v", "lt", 0).alias("below"))


def fil6_region_and_view(spark, sf):
    """A view that wraps, and a region given a turn away."""
    return op.in_boxes(observations(spark, sf), (77.05, 28.52, 77.15, 28.6), (437.1, 28.4, 437.5, 28.58)).select("feature_id")


def fil9_contained(spark, sf):
    b = observations(spark, sf)
    inside = op.contained((F.col("lon") - 0.02 + 360, F.col("lat") - 0.01, F.col("lon") + 0.02, F.col("lat") + 0.01), (77.02, 28.51, 77.18, 28.62))
    return b.select("feature_id", inside.alias("inside"))


def fil11_valid_coordinate(spark, sf):
    o = observations(spark, sf)
    lon = F.when(F.col("feature_id") % 5 == 0, "east").when(F.col("feature_id") % 5 == 1, "NaN").when(F.col("feature_id") % 5 == 2, "181").otherwise(F.col("lon").cast("string"))
    return o.select("feature_id", fn.valid_coordinate(lon, F.col("lat").cast("string")).alias("valid"))


def set4_compare(spark, sf):
    o = observations(spark, sf)
    return op.compared(o.where("value < 6000"), o.where("value > 2000").withColumn("value", F.col("value") + 1), "value").withColumn("delta", F.round("delta", 4))


def pipe3_heatmap(spark, sf):
    """Filter, then weights, as one layer."""
    f = op.number_range(observations(spark, sf).where("category <> 'BUILDING'"), "value", 0.0, None)
    return op.weights(f, "value").select("feature_id", "category", _R("heat_weight"), _R("height", 3))


def _mixed(spark, sf):
    """Customers as points, a tenth of them as lines, and buildings with a number of levels, or none."""
    k = F.col("feature_id")
    line = F.array(F.array(F.array(g.vertex("lon", "lat"), g.vertex(F.col("lon") + 0.001, "lat"))))
    o = spread_observations(spark, sf).select(F.concat(F.lit("c"), k).alias("feature_id"), F.when(k % 10 == 0, "LineString").otherwise("Point").alias("geom_type"), F.when(k % 10 == 0, line).otherwise(g.point_parts("lon", "lat")).alias("parts"), "value")
    b = buildings(spark, sf).select(F.concat(F.lit("b"), "input_pos").alias("feature_id"), F.lit("Polygon").alias("geom_type"), "parts", F.nullif("levels", F.lit(0.0)).alias("value"))
    return o.unionByName(b)


def pipe3_modes(spark, sf):
    """Legends of one layer in all modes but the grid's, which agg5_density_grid counts."""
    f = _mixed(spark, sf)
    found = [op.layer_mode(f, m, "value", m == "extrusion")[1] for m in op.MODES if m != "density"]
    return reduce(DataFrame.unionByName, found).withColumn("caveats", F.array_join("caveats", ", ")).withColumns({c: F.round(c, 4) for c in ("min", "mid", "max")})


def pipe3_extrusion(spark, sf):
    """Heights of the buildings, once as metres and once as an index, and of lines as flow."""
    f = _mixed(spark, sf)
    parts = [(n, op.layer_mode(f, m, "value", metres)[0]) for n, m, metres in (("metres", "extrusion", True), ("index", "extrusion", False), ("flow", "flow", False))]
    return reduce(DataFrame.unionByName, (d.select(F.lit(n).alias("layer"), "feature_id", _R("weight"), _R("height", 3)) for n, d in parts))


_MIXED = f"""t AS (SELECT 'c' || feature_id AS id, CASE WHEN feature_id % 10 = 0 THEN 'l' ELSE 'p' END AS kind, value AS v FROM ({OBS}) UNION ALL SELECT 'b' || k, 'a', nullif(levels, 0) FROM ({BUILDINGS}))"""
PIPE3 = f"""WITH {_MIXED}, m AS (SELECT unnest([{{'mode': 'points', 'kinds': 'pla', 'g': 'Point'}}, {{'mode': 'heatmap', 'kinds': 'pla', 'g': 'Point'}}, {{'mode': 'tactical', 'kinds': 'pla', 'g': 'Point'}}, {{'mode': 'choropleth', 'kinds': 'a', 'g': 'Polygon'}}, {{'mode': 'extrusion', 'kinds': 'a', 'g': 'Polygon'}}, {{'mode': 'flow', 'kinds': 'l', 'g': 'LineString'}}], recursive := true)),
c AS (SELECT mode, g, count(*) AS n, count(*) FILTER (NOT contains(kinds, kind)) AS bad, count(*) FILTER (contains(kinds, kind) AND v IS NULL) AS missing, count(v) FILTER (contains(kinds, kind)) AS shown, min(v) FILTER (contains(kinds, kind)) AS lo, max(v) FILTER (contains(kinds, kind)) AS hi FROM m, t GROUP BY ALL)
SELECT mode, g AS geometry_type, 'value' AS title, NULL::VARCHAR AS unit, n AS input_count, bad AS incompatible, missing, shown, round(lo, 4) AS min, round((lo + hi) / 2, 4) AS mid, round(hi, 4) AS max,
 concat_ws(', ', CASE WHEN bad > 0 THEN 'incompatible geometry' END, CASE WHEN missing > 0 THEN 'missing values' END, CASE WHEN mode = 'extrusion' THEN 'metre height' END, CASE WHEN mode = 'heatmap' THEN CASE WHEN lo >= 0 THEN 'scaled by maximum' ELSE 'relative weights' END END, CASE WHEN mode = 'flow' THEN 'given lines only' END, CASE WHEN lo = hi THEN 'constant' END) AS caveats FROM c"""
_SHOWN = f"WITH {_MIXED}, e AS (SELECT kind, min(v) AS lo, max(v) AS hi FROM t GROUP BY kind), w AS (SELECT t.*, CASE WHEN lo = hi THEN 0.5 ELSE (v - lo) / (hi - lo) END AS w FROM t JOIN e USING (kind) WHERE v IS NOT NULL) SELECT l AS layer, id AS feature_id, round(w, 6) AS weight, round(CASE WHEN l = 'metres' THEN greatest(v, 0) ELSE w * 1500 END, 3) AS height FROM w JOIN (VALUES ('metres', 'a'), ('index', 'a'), ('flow', 'l')) x(l, k) ON k = kind"


def pipe11_gate(spark, sf):
    """Checks of a dataset before it is shown."""
    o = observations(spark, sf).withColumn("inside", F.col("lon").between(77.0, 77.1))
    c = o.agg(F.count("value").alias("numbers"), F.count_if("inside").alias("in_scope"), F.count_distinct("category").alias("categories"), F.count("*").alias("points"))
    return c.select(F.explode(F.array(F.struct(F.lit("numeric field").alias("check"), (F.col("numbers") > 0).alias("passed"), F.col("numbers").alias("n")), F.struct(F.lit("in scope").alias("check"), (F.col("in_scope") > 0).alias("passed"), F.col("in_scope").alias("n")), F.struct(F.lit("point geometry").alias("check"), (F.col("points") > 0).alias("passed"), F.col("points").alias("n")))).alias("r")).select("r.*")


def pipe11_datasets(spark, sf):
    """The customers of each nation as a dataset, some with odd geometries, fields or times, and a request for
    each; one for a dataset that isn't there."""
    k, c = F.col("c_nationkey"), F.col("c_custkey")
    p = placed(table(spark, sf, "customer"), "c_custkey").where(k != 24)
    props = F.create_map(F.lit("value"), F.when(k % 7 == 3, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string")), F.lit("gaps"), F.when(F.col("lon") > 77.15, F.col("c_acctbal").cast("string")), F.lit("day"), F.when((k % 5 == 4) & (c % 2 == 0), F.lit("2024-02-01")).otherwise("2024-01-01"))
    shape = F.when((k % 6 == 1) & (c % 5 == 0), "MultiPoint").when(k % 6 == 2, "Polygon").otherwise("Point")
    f = p.select(k.alias("dataset_id"), shape.alias("geom_type"), "lon", "lat", props.alias("props"))
    n = F.col("n_nationkey")
    kind = F.when(n % 6 == 2, "choropleth").when(n % 8 == 3, "chart").when(n % 11 == 10, "choropleth").otherwise("heatmap")
    field = F.when(n % 9 == 8, F.lit(None)).when(n % 9 == 7, "").when(n == 22, "gaps").when(n == 6, "none").otherwise("value")
    west, east = F.when(n % 4 == 0, 77.05).when(n == 5, 10.0).when(n == 22, 77.0).when(n == 18, 77.3), F.when(n % 4 == 0, 77.1).when(n == 5, 20.0).when(n == 22, 77.14).when(n == 18, 77.0)
    scoped = west.isNotNull()
    asked = table(spark, sf, "nation").select(n.alias("dataset_id"), kind.alias("visualization"), field.alias("field"), west.alias("west"), F.when(scoped, F.when(n == 12, 30.0).otherwise(28.0)).alias("south"), east.alias("east"), F.when(scoped, 29.0).alias("north"), F.when(n != 13, "2024-01-01").alias("reference_time"), F.when(n.isin(0, 13, 17), F.when(n == 17, 2023).otherwise(2024)).alias("population_year"))
    return op.gated(f, asked)


PIPE11 = f"""WITH p AS (SELECT c_nationkey AS k, c_custkey AS c, c_acctbal AS v, {LON.format(k='c_custkey')} AS lon, {LAT.format(k='c_custkey')} AS lat FROM customer WHERE c_nationkey <> 24),
r AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 6 = 2 THEN 'choropleth' WHEN n_nationkey % 8 = 3 THEN 'chart' WHEN n_nationkey % 11 = 10 THEN 'choropleth' ELSE 'heatmap' END AS kind, CASE WHEN n_nationkey % 9 IN (7, 8) THEN NULL WHEN n_nationkey = 22 THEN 'gaps' WHEN n_nationkey = 6 THEN 'none' ELSE 'value' END AS field,
 CASE WHEN n_nationkey % 4 = 0 THEN 77.05::DOUBLE WHEN n_nationkey = 5 THEN 10 WHEN n_nationkey = 22 THEN 77 WHEN n_nationkey = 18 THEN 77.3::DOUBLE END AS w, CASE WHEN n_nationkey % 4 = 0 THEN 77.1::DOUBLE WHEN n_nationkey = 5 THEN 20 WHEN n_nationkey = 22 THEN 77.14::DOUBLE WHEN n_nationkey = 18 THEN 77 END AS e FROM nation),
j AS (SELECT r.k, kind, field, c, v, lon, CASE WHEN w IS NULL THEN true WHEN r.k = 12 THEN false WHEN w <= e THEN lon BETWEEN w AND e ELSE lon >= w OR lon <= e END AS inside FROM r LEFT JOIN p USING (k)),
g AS (SELECT k, any_value(kind) AS kind, any_value(field) AS field, count(c) AS features, count(DISTINCT CASE WHEN k % 5 = 4 THEN c % 2 END) AS days, count(*) FILTER (k % 6 = 2 OR (k % 6 = 1 AND c % 5 = 0)) AS others, count(*) FILTER (c IS NOT NULL AND k % 6 = 2) AS polygons, count(*) FILTER (lon > 77.15) AS gaps,
 count(*) FILTER (c IS NOT NULL AND inside) AS in_scope, count(*) FILTER (c IS NOT NULL AND inside AND CASE field WHEN 'value' THEN k % 7 <> 3 WHEN 'gaps' THEN lon > 77.15 WHEN 'none' THEN false ELSE true END) AS shown FROM j GROUP BY k),
h AS (SELECT *, CASE WHEN features = 0 THEN 'no observations' WHEN k = 12 THEN 'invalid scope' WHEN days > 1 THEN 'several times' WHEN field = 'none' OR (field = 'value' AND k % 7 = 3) OR (field = 'gaps' AND gaps = 0) THEN 'no numeric field' WHEN kind = 'chart' THEN 'unknown visualization' WHEN kind = 'heatmap' AND field IS NULL THEN 'no field for a heatmap'
 WHEN kind = 'heatmap' AND others > 0 THEN 'not points' WHEN kind = 'choropleth' AND polygons = 0 THEN 'no polygons' WHEN k IN (13, 17) THEN 'other year' WHEN in_scope = 0 THEN 'nothing in scope' WHEN shown = 0 THEN 'no value in scope' END AS reason FROM g)
SELECT k AS dataset_id, reason IS NULL AS passed, reason, features, in_scope, shown FROM h"""


QUERIES = {
    "pipe11_datasets": (pipe11_datasets, PIPE11),
    "agg5_density_grid": (agg5_density_grid, GRID),
    "fil1_number_range": (fil1_number_range, "SELECT c_custkey AS feature_id, c_acctbal AS value FROM customer WHERE c_acctbal BETWEEN 100 AND 5000"),
    "agg1_fields": (agg1_fields, f"""WITH c AS (SELECT unnest([{_KEYS}]) AS kv FROM events), v AS (SELECT kv[1] AS key, kv[2] AS value FROM c), w AS (SELECT * FROM v WHERE value IS NOT NULL AND trim(value) <> ''),
g AS (SELECT key, bool_and(regexp_full_match(value, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?')) AS numeric,
 bool_and(regexp_full_match(value, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z)?') OR (key = 'year' AND regexp_full_match(value, '[1-9][0-9]{{3}}'))) AS temporal FROM w GROUP BY key)
SELECT key, numeric, temporal, NOT numeric AND NOT temporal AS categorical FROM g""".replace("unnest([(", "unnest([list_value(").replace("), (", "), list_value(")),
    "agg2_summary": (agg2_summary, "SELECT count(*) AS count, count(c_acctbal) AS valid_count, min(c_acctbal) AS min, median(c_acctbal) AS median, max(c_acctbal) AS max, round(avg(c_acctbal), 4) AS mean, round(sum(c_acctbal), 2) AS sum FROM customer"),
    "agg3_histogram": (agg3_histogram, """WITH e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, least(10, ceil(sqrt(count(*))))::INT AS bins FROM customer), b AS (SELECT unnest(range(0, (SELECT bins FROM e)))::INT AS bin),
c AS (SELECT least(bins - 1, floor((c_acctbal - lo) / (hi - lo) * bins))::INT AS bin, count(*) AS n FROM customer, e GROUP BY 1)
SELECT b.bin, round(lo * (1 - b.bin / bins) + hi * (b.bin / bins), 6) AS low, round(lo * (1 - (b.bin + 1) / bins) + hi * ((b.bin + 1) / bins), 6) AS high, coalesce(n, 0) AS count FROM b LEFT JOIN c USING (bin), e"""),
    "agg4_frequencies": (agg4_frequencies, "SELECT c_mktsegment AS value, count(*) AS count FROM customer GROUP BY 1"),
    "agg8_extent": (agg8_extent, EXTENT),
    "agg9_hotspots": (agg9_hotspots, "WITH s AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal) - 1 AS k, count(*) OVER () AS n FROM customer), t AS (SELECT v FROM s WHERE k = floor((n - 1) * 0.9)) SELECT c_custkey AS feature_id, c_acctbal AS value FROM customer, t WHERE c_acctbal >= v"),
    "agg10_average_duplicates": (agg10_average_duplicates, "SELECT l_orderkey % 500 AS lon, l_partkey % 50 AS lat, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY 1, 2"),
    "agg11_time_values": (agg11_time_values, "SELECT DISTINCT strftime(ts, '%Y-%m-%d') || 'T00:00:00.000Z' AS time FROM events"),
    "agg12_layers": (agg12_layers, AGG12),
    "agg12_inventory": (agg12_inventory, INVENTORY),
    "fil2_typed_equal": (fil2_typed_equal, "SELECT c_custkey AS feature_id, c_custkey % 3 = 0 AS is_false, c_custkey % 3 = 1 AS is_text, c_custkey % 3 = 2 AS is_zero FROM customer"),
    "fil3_typed_compare": (fil3_typed_compare, "SELECT c_custkey AS feature_id, c_custkey % 4 >= 2 AND c_acctbal >= 1000 AS at_least, c_custkey % 4 > 0 AS not_x, c_custkey % 4 >= 2 AND c_acctbal < 0 AS below FROM customer"),
    "fil4_observed_time": (fil4_observed_time, "SELECT event_id FROM events WHERE strftime(ts, '%Y-%m-%d') = '2024-01-02'"),
    "fil6_region_and_view": (fil6_region_and_view, f"SELECT feature_id FROM ({OBS}) WHERE lon BETWEEN 77.10000000000002 AND 77.15 AND lat BETWEEN 28.52 AND 28.58"),
    "fil9_contained": (fil9_contained, f"SELECT feature_id, lat - 0.01 >= 28.51 AND lat + 0.01 <= 28.62 AND lon - 0.02 >= 77.02 AND lon + 0.02 <= 77.18 AS inside FROM ({OBS})"),
    "fil11_valid_coordinate": (fil11_valid_coordinate, "SELECT c_custkey AS feature_id, c_custkey % 5 > 2 AS valid FROM customer"),
    "win7_category_codes": (win7_category_codes, "WITH v AS (SELECT DISTINCT 'p_brand' AS field, p_brand AS value FROM part UNION ALL SELECT DISTINCT 'p_size', p_size::VARCHAR FROM part UNION ALL SELECT DISTINCT 'even', (p_partkey % 2 = 0)::VARCHAR FROM part) SELECT field, value, ((dense_rank() OVER (PARTITION BY field ORDER BY value) - 1) % 7)::INT AS code FROM v"),
    "win8_weights": (win8_weights, "WITH e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT c_custkey AS feature_id, round((c_acctbal - lo) / (hi - lo), 6) AS weight, round(CASE WHEN lo >= 0 THEN c_acctbal / hi ELSE (c_acctbal - lo) / (hi - lo) END, 6) AS heat_weight, round((c_acctbal - lo) / (hi - lo) * 1500, 3) AS height FROM customer, e"),
    "set4_compare": (set4_compare, "SELECT c_custkey AS feature_id, CASE WHEN c_acctbal >= 6000 THEN 'b' WHEN c_acctbal <= 2000 THEN 'a' ELSE 'both' END AS side, CASE WHEN c_acctbal > 2000 AND c_acctbal < 6000 THEN 1.0::DOUBLE END AS delta FROM customer"),
    "pipe3_modes": (pipe3_modes, PIPE3),
    "pipe3_extrusion": (pipe3_extrusion, _SHOWN),
    "pipe3_heatmap": (pipe3_heatmap, "WITH f AS (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_acctbal >= 0), e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM f) SELECT c_custkey AS feature_id, c_mktsegment AS category, round(c_acctbal / hi, 6) AS heat_weight, round((c_acctbal - lo) / (hi - lo) * 1500, 3) AS height FROM f, e"),
    "pipe11_gate": (pipe11_gate, f"WITH o AS ({OBS}) SELECT 'numeric field' AS check, count(value) > 0 AS passed, count(value) AS n FROM o UNION ALL SELECT 'in scope', count(*) FILTER (lon BETWEEN 77.0 AND 77.1) > 0, count(*) FILTER (lon BETWEEN 77.0 AND 77.1) FROM o UNION ALL SELECT 'point geometry', count(*) > 0, count(*) FROM o"),
}
