"""Queries over places, made of suppliers and customers at derived positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fn
from ..functions.inputs import LAT, LON, placed, table
from ..operators import places as op


def _places(spark, sf, spread: int = 1):
    """Customers as places; with spread n, n neighbouring keys share a name and lie within metres."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("k", F.floor(F.col("c_custkey") / spread).cast("long"))
    c = placed(c, "k")
    m = F.col("c_custkey") % spread
    name = F.concat(F.lit("Block "), F.col("k").cast("string"), F.when(m % 3 == 1, " Society").when(m % 3 == 2, " Gate").otherwise(""))
    return c.select(
        F.format_string("p%07d", "c_custkey").alias("place_id"),
        F.when(F.col("c_custkey") % 4 == 0, "serpapi").otherwise("openstreetmap").alias("provider"),
        name.alias("name"),
        fn.ascii_key(name).alias("normalized_name"),
        F.concat(F.lit("Ward "), (F.col("k") % 9).cast("string"), F.lit(", "), F.initcap("n_name")).alias("address"),
        F.substring("n_name", 1, 2).alias("country_code"),
        (F.col("lon") + m * 0.0002).alias("lon"),
        F.col("lat").alias("lat"),
        (F.col("c_custkey") * 37 % 1000).alias("updated_at"),
        F.col("c_custkey").alias("created_at"),
        F.col("c_custkey").alias("input_pos"),
        F.col("c_acctbal").alias("value"),
    )


def _sql(spread: int = 1) -> str:
    k = f"(c_custkey // {spread})"
    name = f"'Block ' || {k} || CASE (c_custkey % {spread}) % 3 WHEN 1 THEN ' Society' WHEN 2 THEN ' Gate' ELSE '' END"
    return f"""SELECT printf('p%07d', c_custkey) AS place_id, CASE WHEN c_custkey % 4 = 0 THEN 'serpapi' ELSE 'openstreetmap' END AS provider, {name} AS name, lower({name}) AS normalized_name,
 'Ward ' || ({k} % 9) || ', ' || n_name AS address, left(n_name, 2) AS country_code, {LON.format(k=k)} + (c_custkey % {spread}) * 0.0002::DOUBLE AS lon, {LAT.format(k=k)} AS lat, c_custkey * 37 % 1000 AS updated_at, c_custkey AS created_at, c_acctbal AS value
 FROM customer JOIN nation ON c_nationkey = n_nationkey"""


_DD = "sqrt(pow((a.lat - b.lat) * 111320, 2) + pow((a.lon - b.lon) * 111320 * cos(radians((a.lat + b.lat) / 2)), 2))"
_LOCAL = "('society', 'residency', 'residential', 'apartment', 'apartments', 'housing', 'enclave', 'colony')"
_SAME = f"""(a.normalized_name = b.normalized_name OR (starts_with(a.normalized_name, b.normalized_name || ' ') AND len(string_split(b.normalized_name, ' ')) >= 2 AND split_part(substr(a.normalized_name, length(b.normalized_name) + 2), ' ', 1) IN {_LOCAL})
 OR (starts_with(b.normalized_name, a.normalized_name || ' ') AND len(string_split(a.normalized_name, ' ')) >= 2 AND split_part(substr(b.normalized_name, length(a.normalized_name) + 2), ' ', 1) IN {_LOCAL}))"""
_M = "6371008.8 * sqrt(pow(radians(lon - {lon}) * cos(radians(({lat} + lat) / 2)), 2) + pow(radians(lat - {lat}), 2))"


def join6_same_places(spark, sf):
    return op.same_places(_places(spark, sf, 4), 40)


def win1_canonical_places(spark, sf):
    return op.canonical_places(_places(spark, sf, 4), 40)


#: A round decides the places whose earlier neighbours are all decided.
WIN1 = f"""WITH RECURSIVE p AS ({_sql(4)}), e AS (SELECT a.place_id AS id, b.place_id AS other, b.created_at AS earlier FROM p a JOIN p b ON b.created_at < a.created_at AND {_DD} <= 35 AND {_SAME}),
d(id, canonical) USING KEY (id) AS (SELECT place_id, true FROM p WHERE place_id NOT IN (SELECT id FROM e)
UNION SELECT e.id, NOT bool_or(coalesce(r.canonical, false)) FROM e LEFT JOIN recurring.d r ON r.id = e.other WHERE e.id NOT IN (SELECT id FROM recurring.d) GROUP BY e.id HAVING bool_and(r.id IS NOT NULL))
SELECT p.place_id, coalesce(c.other, p.place_id) AS canonical_id FROM p LEFT JOIN (SELECT e.id, arg_min(other, earlier) AS other FROM e JOIN d ON d.id = e.other AND d.canonical GROUP BY e.id) c ON c.id = p.place_id"""


def join7_aliases(spark, sf):
    p = _places(spark, sf)
    aliases = p.where(F.col("input_pos") % 3 == 0).select("place_id", F.format_string("p%07d", F.col("input_pos") - 1).alias("canonical_id"))
    return op.resolve_aliases(p.select("place_id", "input_pos"), aliases).select("canonical_id", "place_id")


def fil7_in_bounds(spark, sf):
    return op.in_bounds(_places(spark, sf), 77.05, 28.52, 77.12, 28.6, 50).select("place_id", "truncated")


def win10_search(spark, sf):
    return op.search_names(_places(spark, sf), "block 1", 40, "openstreetmap").select("place_id", "name")


def win3_context(spark, sf):
    r = op.rank_by_context(_places(spark, sf), "IN", 77.1, 28.57, 8, by="country_code")
    return r.select("country_code", "place_id", "rank", F.round("metres", 4).alias("metres"))


def win4_saved(spark, sf):
    return op.saved_matches(_places(spark, sf), "block 1, ward 3").select("place_id")


def join14_geocode(spark, sf):
    q = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("Block "), (F.col("o_custkey") % 900).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(", ward "), (F.col("o_custkey") % 9).cast("string"))).otherwise("")).alias("query"))
    return op.geocode(q, _places(spark, sf, 2))


def fil14_category(spark, sf):
    tags = F.element_at(F.array(*map(F.lit, ("cafe", "restaurant", "fuel", "bank", "atm", "museum"))), (F.col("input_pos") % 6 + 1).cast("int"))
    p = _places(spark, sf).withColumns({"tag_key": F.when(tags == "museum", "tourism").otherwise("amenity"), "tag_value": tags})
    return op.category_search(p, "nearest banks", 77.1, 28.57, 9000).select("place_id", "tag_value", F.round("metres", 4).alias("metres"))


def set2_lookup(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("block "), (F.col("o_custkey") % 3000).cast("string")).alias("q"))
    p = _places(spark, sf)
    cached = o.where("query_id % 3 = 0").select("query_id", F.lit("cached").alias("place_id"))
    osm = o.join(p.where("provider = 'openstreetmap'").select("place_id", F.col("normalized_name").alias("q")), "q").select("query_id", "place_id")
    other = o.join(p.where("provider <> 'openstreetmap'").select("place_id", F.col("normalized_name").alias("q")), "q").select("query_id", "place_id")
    return op.lookup(o, ("osm-lookup-cache", "", cached), ("local-osm-cache", "", osm), ("local-serp-cache", "no-usable-osm-result", other))


def join13_boundaries(spark, sf):
    """Every city, against boundaries of every other place: the others are missing on purpose."""
    p = _places(spark, sf)
    cities = p.select(F.col("place_id").alias("city_id"), "name", "country_code", "lon", "lat")
    b = p.where("input_pos % 2 = 0").select(F.concat(F.lit("b-"), "place_id").alias("boundary_id"), F.upper("name").alias("name"), "country_code", F.when(F.col("input_pos") % 6 == 0, "shop").otherwise("administrative").alias("class"), (F.col("lon") - 0.01).alias("west"), (F.col("lat") - 0.01).alias("south"), (F.col("lon") + 0.01).alias("east"), (F.col("lat") + 0.01).alias("north"))
    again = b.where(F.col("boundary_id").endswith("4")).withColumn("boundary_id", F.concat("boundary_id", F.lit("x")))
    return op.verify_boundaries(cities, b.unionByName(again))


def join8_table(spark, sf):
    p = _places(spark, sf, 2).withColumn("place_type", F.when(F.col("input_pos") % 5 == 0, "school").otherwise("village"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_index"), F.concat(F.lit(" BLOCK-"), (F.col("o_orderkey") % 2000).cast("string")).alias("name"), F.concat(F.lit("1,"), F.format_string("%03d", F.col("o_custkey") % 1000)).alias("value_text"), F.concat(F.lit("ward "), (F.col("o_orderkey") % 2000 % 9).cast("string")).alias("region"))
    return op.join_table(rows, p).select("row_index", "place_id", "value", "ambiguous")


def fil8_freshness(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", (F.col("value") + 100).alias("expires_at"))
    best = e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "expires_at"), F.struct("expires_at", "event_id")).alias("b"))
    return best.select("user_id", "b.event_id", F.when(F.col("b.expires_at") > 150, "fresh").otherwise("stale").alias("state"))


def win2_latest(spark, sf):
    e = table(spark, sf, "events")
    latest = e.groupBy("event_type", "user_id").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    return latest.select("event_type", "user_id", "m.event_id")


def prj3_public(spark, sf):
    k = F.col("input_pos")
    json = F.when(k % 4 == 0, '{"types":["point","locality"]}').when(k % 4 == 1, '{"tags":{"place":"hamlet"},"type":"x"}').when(k % 4 == 2, '{"addresstype":"","type":"town"}').otherwise('{"type":"City"}')
    p = _places(spark, sf).withColumn("payload", F.parse_json(json)).select("place_id", "provider", "payload")
    return op.public_places(p)


def join11_pins(spark, sf):
    """Areas whose pins include a deleted one."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("area_id"), F.col("l_partkey").alias("pin"))
    areas = li.groupBy("area_id").agg(F.array_sort(F.collect_list("pin")).alias("pins"))
    gone = table(spark, sf, "part").where("p_partkey % 97 = 0").select(F.col("p_partkey").alias("pin"))
    hit = li.join(gone, "pin", "left_semi").select("area_id").distinct().withColumn("invalid", F.lit(True))
    return areas.join(hit, "area_id", "left").select("area_id", F.size("pins").alias("pin_count"), F.coalesce("invalid", F.lit(False)).alias("invalid"))


def fn4_same_name(spark, sf):
    p = _places(spark, sf, 4)
    other = F.concat(F.col("normalized_name"), F.when(F.col("input_pos") % 2 == 0, " housing two").otherwise(" plaza"))
    return p.select("place_id", fn.same_place_name("normalized_name", other).alias("same"))


QUERIES = {
    "join6_same_places": (join6_same_places, f"WITH p AS ({_sql(4)}) SELECT a.place_id, b.place_id AS other_id FROM p a JOIN p b ON b.created_at < a.created_at AND {_DD} <= 35 AND {_SAME}"),
    "win1_canonical_places": (win1_canonical_places, WIN1),
    "join7_aliases": (join7_aliases, "WITH p AS (SELECT c_custkey AS k, printf('p%07d', c_custkey) AS place_id, printf('p%07d', CASE WHEN c_custkey % 3 = 0 THEN c_custkey - 1 ELSE c_custkey END) AS canonical_id FROM customer) SELECT canonical_id, min_by(place_id, k) AS place_id FROM p GROUP BY canonical_id"),
    "fil7_in_bounds": (fil7_in_bounds, f"WITH p AS (SELECT *, count(*) OVER () > 50 AS truncated FROM ({_sql()}) WHERE lat BETWEEN 28.52 AND 28.6 AND lon BETWEEN 77.05 AND 77.12) SELECT place_id, truncated FROM p ORDER BY updated_at DESC, place_id LIMIT 50"),
    "win10_search": (win10_search, f"SELECT place_id, name FROM ({_sql()}) WHERE contains(normalized_name, 'block 1') AND provider = 'openstreetmap' ORDER BY updated_at DESC, place_id LIMIT 40"),
    "win3_context": (win3_context, f"WITH p AS (SELECT *, {_M.format(lon=77.1, lat=28.57)} AS m FROM ({_sql()})), r AS (SELECT *, row_number() OVER (PARTITION BY country_code ORDER BY country_code <> 'IN', m, name, place_id) AS rank FROM p) SELECT country_code, place_id, rank::INT AS rank, round(m, 4) AS metres FROM r WHERE rank <= 8"),
    "win4_saved": (win4_saved, f"SELECT place_id FROM ({_sql()}) WHERE contains(normalized_name, 'block 1') AND contains(lower(name || ' ' || address || ' ' || country_code), 'ward 3') ORDER BY normalized_name <> 'block 1', provider <> 'openstreetmap', updated_at DESC, place_id"),
    "join14_geocode": (join14_geocode, f"WITH p AS ({_sql(2)}), q AS (SELECT o_orderkey AS query_id, 'block ' || (o_custkey % 900) AS n, CASE WHEN o_orderkey % 2 = 0 THEN 'ward ' || (o_custkey % 9) ELSE '' END AS rest FROM orders), h AS (SELECT query_id, count(*) AS n, min(place_id) AS id FROM q JOIN p ON p.normalized_name = q.n WHERE contains(lower(name || ' ' || address || ' ' || country_code), rest) GROUP BY query_id) SELECT q.query_id, CASE WHEN h.n = 1 THEN 'resolved' WHEN h.n > 1 THEN 'ambiguous' ELSE 'missing' END AS status, CASE WHEN h.n = 1 THEN id END AS place_id FROM q LEFT JOIN h USING (query_id)"),
    "fil14_category": (fil14_category, f"WITH p AS (SELECT place_id, ['cafe','restaurant','fuel','bank','atm','museum'][(created_at % 6 + 1)::INT] AS tag_value, {_M.format(lon=77.1, lat=28.57)} AS m FROM ({_sql()})) SELECT place_id, tag_value, round(m, 4) AS metres FROM p WHERE tag_value IN ('bank', 'atm') AND m <= 9000"),
    "set2_lookup": (set2_lookup, f"WITH o AS (SELECT o_orderkey AS query_id, 'block ' || (o_custkey % 3000) AS q FROM orders), p AS ({_sql()}), c AS (SELECT query_id, 'cached' AS place_id, 'osm-lookup-cache' AS stage, '' AS reason, 0 AS k FROM o WHERE query_id % 3 = 0 UNION ALL SELECT query_id, place_id, 'local-osm-cache', '', 1 FROM o JOIN p ON normalized_name = q AND provider = 'openstreetmap' UNION ALL SELECT query_id, place_id, 'local-serp-cache', 'no-usable-osm-result', 2 FROM o JOIN p ON normalized_name = q AND provider <> 'openstreetmap') SELECT query_id, place_id, stage, reason FROM c QUALIFY k = min(k) OVER (PARTITION BY query_id)"),
    "join13_boundaries": (join13_boundaries, f"WITH p AS ({_sql()}) SELECT place_id AS city_id, CASE WHEN created_at % 2 = 1 OR created_at % 6 = 0 THEN 'missing' WHEN ends_with(place_id, '4') THEN 'ambiguous' ELSE 'resolved' END AS status, CASE WHEN created_at % 2 = 0 AND created_at % 6 <> 0 AND NOT ends_with(place_id, '4') THEN 'b-' || place_id END AS boundary_id FROM p"),
    "join8_table": (join8_table, f"WITH p AS (SELECT * FROM ({_sql(2)}) WHERE created_at % 5 <> 0), r AS (SELECT o_orderkey AS row_index, 'block ' || (o_orderkey % 2000) AS n, 1000.0::DOUBLE + o_custkey % 1000 AS value, 'ward ' || (o_orderkey % 2000 % 9) AS region FROM orders), h AS (SELECT row_index, place_id, r.value FROM r JOIN p ON p.normalized_name = r.n AND contains(' ' || lower(replace(name || ' ' || address, ',', ' ')) || ' ', ' ' || region || ' ')) SELECT row_index, place_id, value, count(*) OVER (PARTITION BY row_index) > 1 OR count(*) OVER (PARTITION BY place_id) > 1 AS ambiguous FROM h"),
    "fil8_freshness": (fil8_freshness, "SELECT user_id, arg_max(event_id, (value + 100, event_id)) AS event_id, CASE WHEN max(value + 100) > 150 THEN 'fresh' ELSE 'stale' END AS state FROM events GROUP BY user_id"),
    "win2_latest": (win2_latest, "SELECT event_type, user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL"),
    "prj3_public": (prj3_public, f"SELECT place_id, provider, CASE created_at % 4 WHEN 0 THEN 'locality' WHEN 1 THEN 'hamlet' WHEN 2 THEN 'town' ELSE 'City' END AS place_type FROM ({_sql()})"),
    "join11_pins": (join11_pins, "SELECT l_orderkey AS area_id, count(*)::INT AS pin_count, bool_or(l_partkey % 97 = 0 AND l_partkey IN (SELECT p_partkey FROM part)) AS invalid FROM lineitem GROUP BY 1"),
    "fn4_same_name": (fn4_same_name, f"SELECT place_id, created_at % 2 = 0 AS same FROM ({_sql(4)})"),
}
