"""Small inputs with known results."""

import math

import pytest
from pyspark.sql import functions as F

from geoloom.functions import columns as fn
from geoloom.functions import geometry as g
from geoloom.operators import buildings, layers, places, raster, roads, surfaces
from geoloom.sources import readers, web


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def ring(*points):
    return F.array(*(g.vertex(F.lit(float(x)), F.lit(float(y))) for x, y in points))


def test_height_rises_to_its_base(spark):
    h, raised = fn.above_base(F.lit(5.0), F.lit(6.0))
    assert tuple(one(spark, h, raised)) == (6.5, True)


def test_levels_are_derived_heights(spark):
    h = one(spark, fn.known_height(F.lit(0.0), F.lit(4.0)).alias("h")).h
    assert (round(h.height, 6), h.source) == (12.4, "levels")
    assert one(spark, fn.known_height(F.lit(1.0), F.lit(200.0)).alias("h")).h is None


@pytest.mark.parametrize(("text", "metres"), [("12 m", 12), ("10 ft", 3.048), ("6'", 1.8288), ("250 cm", 2.5), ("7", 7), ("tall", 0), ("3 yards", 0), (None, 0)])
def test_lengths(spark, text, metres):
    assert one(spark, fn.parse_length(F.lit(text)).alias("m")).m == pytest.approx(metres)


@pytest.mark.parametrize(("a", "b", "same"), [("green park", "green park", True), ("green park", "green park society phase 2", True), ("park", "park society", False), ("green park", "green park gate", False)])
def test_place_names(spark, a, b, same):
    assert one(spark, fn.same_place_name(F.lit(a), F.lit(b)).alias("s")).s is same


def test_phrases_are_whole_words(spark):
    r = one(spark, fn.phrase_match(F.lit("MG  Road East"), "mg road").alias("a"), fn.phrase_match(F.lit("Broadway"), "road").alias("b"), fn.phrase_match(F.lit("a.b"), "a.b").alias("c"))
    assert tuple(r) == (True, False, True)


def test_text_key_beyond_ascii(spark):
    df = spark.createDataFrame([("  Straße ﬁ  ",), ("Plain  TEXT",), (None,)], "t string")
    assert [r[0] for r in df.select(fn.text_key("t")).collect()] == ["strasse fi", "plain text", None]


def test_numbers_and_times(spark):
    df = spark.createDataFrame([("1,234",), ("12,34",), ("1e3",), ("1e999",), ("",), ("0x1",)], "t string")
    assert [tuple(r) for r in df.select(fn.strict_number("t"), fn.table_number("t")).collect()] == [(None, 1234.0), (None, None), (1000.0, 1000.0), (None, None), (None, None), (None, None)]
    t = spark.createDataFrame([("2024-02-29",), ("2023-02-29",), ("2024-01-01T23:00",), ("2024-01-01T23:00-01:30",)], "t string")
    assert [r[0] for r in t.select(fn.normal_time("t", "seen")).collect()] == ["2024-02-29T00:00:00.000Z", None, None, "2024-01-02T00:30:00.000Z"]


def test_summary_of_junk(spark):
    rows = spark.createDataFrame([(v,) for v in ("-5", "0", "5", None, "false", "", "bad", "10")], "v string").withColumn("n", fn.strict_number("v"))
    s = layers.summary(rows, "n").first()
    assert (s["count"], s.valid_count, s.median, s["sum"]) == (8, 4, 2.5, 10)


def test_sum_overflows_to_null(spark):
    rows = spark.createDataFrame([(1.7e308,), (1.7e308,)], "v double")
    s = layers.summary(rows, "v").first()
    assert s["sum"] is None and s["mean"] == pytest.approx(1.7e308)


def test_weights(spark):
    rows = spark.createDataFrame([(1, 0.0), (2, 40.0), (3, 20.0), (4, 10.0)], "feature_id int, v double")
    assert [r.weight for r in layers.weights(rows, "v").orderBy("feature_id").collect()] == [0, 1, 0.5, 0.25]


def test_density_counts_features_once(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 1.0, 1.0), (4, 0.0, 0.0), (4, 1.0, 1.0)], "feature_id int, lon double, lat double")
    assert sorted(r["count"] for r in layers.density_grid(rows).collect()) == [2, 3]


def test_hotspots_rank(spark):
    rows = spark.createDataFrame([(float(v),) for v in range(5)], "v double")
    assert sorted(r.v for r in layers.hotspots(rows, "v").collect()) == [3.0, 4.0]


def test_extent_crosses_the_antimeridian(spark):
    arcs = spark.createDataFrame([(179.0, -179.0, 1.0), (178.0, 178.0, 2.0)], "a double, b double, lat double")
    assert tuple(layers.extent(arcs).first()) == pytest.approx((178, 1, -179, 2))


def test_typed_categories(spark):
    v = spark.createDataFrame([("false",), ('"false"',), (None,), ("0",)], "j string").select(F.try_parse_json("j").alias("v"))
    assert [r[0] for r in v.select(layers.typed_equal("v", False)).collect()] == [True, False, False, False]
    assert [r[0] for r in v.select(layers.typed_compare("v", "neq", "x")).collect()] == [True, True, False, True]


def test_canonical_places_are_not_components(spark):
    """A~B~C with A and C apart: A and C are canonical."""
    step = 30 / 111_320
    rows = [(k, "green park", 0.0, i * step, i) for i, k in enumerate("abc")]
    p = spark.createDataFrame(rows, "place_id string, normalized_name string, lon double, lat double, created_at long")
    assert {r.place_id: r.canonical_id for r in places.canonical_places(p).collect()} == {"a": "a", "b": "a", "c": "c"}


def test_table_join(spark):
    rows = spark.createDataFrame([(0, "Chal", "1,200", "Una"), (1, "Sela", "0", "Una"), (2, "Chal", "5", "Kullu"), (3, "Pura", "about 5", "Una")], "row_index int, name string, value_text string, region string")
    p = spark.createDataFrame([("p1", "Chal", "Una district", "village", 1.0, 2.0), ("p2", "SELA", "Tehsil Una", "village", 1.0, 2.0), ("p3", "Sela", "Una", "school", 1.0, 2.0), ("p4", "Pura", "Una", "village", 1.0, 2.0)], "place_id string, name string, address string, place_type string, lon double, lat double")
    got = {r.row_index: (r.place_id, r.value, r.ambiguous) for r in places.join_table(rows, p).collect()}
    assert got == {0: ("p1", 1200.0, False), 1: ("p2", 0.0, False)}


def test_clipping_leaves_and_enters_again(spark):
    path = ring((0, 1), (5, 1), (5, 9), (3, 9), (3, 1), (0, 1))
    got = one(spark, g.clip_line(path, (2, 0, 4, 4)).alias("p")).p
    assert [[tuple(v) for v in p] for p in got] == [[(2, 1), (4, 1)], [(3, 4), (3, 1), (2, 1)]]


def test_clipping_breaks_at_bad_vertices(spark):
    path = F.array(g.vertex(F.lit(1.0), F.lit(1.0)), g.vertex(F.lit(2.0), F.lit(1.0)), F.lit(None).cast(g.VERTEX), g.vertex(F.lit(3.0), F.lit(1.0)), g.vertex(F.lit(3.0), F.lit(1.0)), g.vertex(F.lit(3.5), F.lit(1.0)), g.vertex(F.lit(200.0), F.lit(1.0)))
    got = one(spark, g.clip_line(path, (0, 0, 4, 4)).alias("p")).p
    assert [[tuple(v) for v in p] for p in got] == [[(1, 1), (2, 1)], [(3, 1), (3.5, 1)]]


def test_point_in_ring_on_its_boundary(spark):
    box = g.ring_of(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    r = one(spark, g.point_in_ring(F.lit(1.0), F.lit(0.5), box).alias("a"), g.point_in_ring(F.lit(1.0), F.lit(0.5), box, True).alias("b"), g.point_in_ring(F.lit(0.5), F.lit(0.5), box).alias("c"))
    assert tuple(r) == (False, True, True)


def test_circle_is_split_at_the_antimeridian(spark):
    r = one(spark, g.split_ring(g.circle(F.lit(179.999), F.lit(0.0), F.lit(1000.0))).alias("r")).r
    assert len(r) == 2
    assert all(-180 <= v.lon <= 180 for part in r for v in part)
    assert {round(max(abs(v.lon) for v in part)) for part in r} == {180}


def test_bow_tie_is_rejected(spark):
    rows = spark.range(2).select(F.col("id").alias("feature_id"), F.when(F.col("id") == 0, ring((0, 0), (2, 0), (1, 2), (0, 0))).otherwise(ring((0, 0), (2, 2), (2, 0), (0, 3), (0, 0))).alias("r"))
    good, bad = surfaces.validated(rows.select("feature_id", F.array(F.array("r")).alias("parts")))
    assert [r.feature_id for r in good.collect()] == [0]
    assert [(r.feature_id, r.reason) for r in bad.collect()] == [(1, "edges meet")]


def test_raster_crop_keeps_zero(spark):
    values = [[9.0, 10.0, 10.25, 11.0], [8.0, 0.0, -9999.0, 7.0], [1.0, 2.0, 3.0, 4.0]]
    cells = spark.createDataFrame([("r", i, j, v) for i, row in enumerate(values) for j, v in enumerate(row)], "raster_id string, row int, col int, value double")
    meta = spark.createDataFrame([("r", 1.0, 0.0, -1.0, 3.0, 4326, -9999.0)], "raster_id string, a double, c double, e double, f double, epsg int, nodata double")
    got = {(r.lon, r.lat): r.value for r in raster.crop(cells, meta, (1, 1, 3, 3)).collect()}
    assert got == {(1.5, 2.5): 10.0, (2.5, 2.5): 10.25, (1.5, 1.5): 0.0}


def test_elevation_zero_is_not_missing(spark):
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 100.0, 0.5)], "id int, lon double, lat double")
    t = one(spark, raster.tile_point(F.lit(0.5), F.lit(0.5), 5).alias("t")).t
    dem = spark.createDataFrame([(5, t.x, t.y, 1, 1, [0.0])], "z int, x int, y int, width int, height int, data array<float>")
    assert {r.id: r.elevation for r in raster.elevations(pts, dem, 5).collect()} == {1: 0.0, 2: None}


def test_shortest_paths_match_dijkstra(spark):
    import heapq
    import random

    rng = random.Random(3)
    edges = {(str(a), str(b)): float(rng.randint(1, 9)) for a in range(12) for b in rng.sample(range(12), 3) if a != b}
    legs = [(k, str(rng.randrange(12)), str(rng.randrange(12))) for k in range(4)]

    def search(start, goal):
        dist, prev, queue, done, seen = {start: 0.0}, {}, [(0.0, start)], set(), 0
        while queue:
            d, n = heapq.heappop(queue)
            if n in done:
                continue
            if n == goal:
                path = [n]
                while path[0] != start:
                    path.insert(0, prev[path[0]])
                return d, path, seen
            done.add(n)
            for (a, b), w in edges.items():
                if a == n:
                    seen += 1
                    if d + w < dist.get(b, math.inf):
                        dist[b], prev[b] = d + w, n
                        heapq.heappush(queue, (d + w, b))
        return None

    e = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, metres double")
    got = {r.leg_id: (r.metres, r.path, r.examined) for r in roads.shortest_paths(e, spark.createDataFrame(legs, "leg_id int, start string, goal string")).collect()}
    want = {k: search(a, b) for k, a, b in legs}
    assert got == {k: v for k, v in want.items() if v}


def test_one_way_streets(spark):
    way = lambda i, tags: (i, tags, [(0.0, 0.0), (0.001, 0.0)])
    kind = "way_id int, tags map<string,string>, geometry array<struct<lon:double,lat:double>>"
    count = lambda tags: roads.driving_graph(spark.createDataFrame([way(1, tags)], kind))[1].count()
    assert [count({"highway": "residential"}), count({"highway": "residential", "oneway": "yes"}), count({"highway": "footway"}), count({"highway": "primary", "access": "private"})] == [2, 1, 0, 0]


def test_geometries_in_text_and_bytes(spark):
    import struct

    wkb = struct.pack("<BIII6d", 1, 3, 1, 3, 0, 0, 2, 0, 1, 2).hex()
    rows = spark.createDataFrame([(1, "SRID=4326;POLYGON((0 0, 2 0, 1 2))"), (2, wkb), (3, "47500003"), (4, "not-a-geometry"), (5, None), (6, "MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))")], "id int, geom string")
    good, bad = readers.decode_geometries(rows, "id", "geom")
    found = {r.id: r for r in good.collect()}
    assert sorted(found) == [1, 2, 6] and sorted(r.id for r in bad.collect()) == [3, 4, 5]
    assert found[1].parts == found[2].parts and len(found[1].parts[0][0]) == 4 and len(found[6].parts) == 2


def test_geojson_documents(spark):
    docs = ['{"type":"Feature","id":"a","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]},"properties":{"n":1,"s":"x"}}', '{"type":"Point","coordinates":[3,4]}', '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[1,200]},"properties":null}]}', '{"type":"FeatureCollection","crs":{"x":1},"features":[]}', "junk"]
    good, bad = readers.geojson_features(spark.createDataFrame([(d,) for d in docs], "value string"))
    assert sorted((r.geom_type, r.props.get("n")) for r in good.collect()) == [("Point", None), ("Polygon", "1")]
    assert sorted(r.reason for r in bad.collect()) == ["crs", "geometry", "json"]


def test_delimited_points(spark, tmp_path):
    (tmp_path / "p.csv").write_text('Name,Longitude,LAT,people,id,mixed\nA,1,2,"1,234",007,"12,34"\nB,3,4,5,8,6\n,,,,,\nC,x,4,1,9,1\nD,200,4,1,9,1\n')
    good, bad = readers.read_points(spark, str(tmp_path / "p.csv"))
    assert [(r.lon, r.people, r.id, r.mixed) for r in good.orderBy("lon").collect()] == [(1.0, 1234.0, "007", "12,34"), (3.0, 5.0, "8", "6")]
    assert bad.count() == 2


def test_page_extraction():
    html = '<html><head><title>T  one</title><style>x</style></head><body><nav><a href="/n">nav</a></nav><p>Hello <b>there</b></p><div hidden>no</div><table><tr><th>a<th>b<tr><td>1<td>2</table><a href="page#x">L</a><a href="http://10.0.0.1/">p</a><a href="/q?token=1">s</a></body></html>'
    page = web.read_page("https://Example.org/dir/", html)
    assert page["title"] == "T one"
    assert "Hello there" in page["text"] and "no" not in page["text"].split() and "nav" not in page["text"]
    assert page["tables"] == [{"headers": ["a", "b"], "rows": [["1", "2"]]}]
    assert page["links"] == [{"url": "https://example.org/dir/page", "title": "L"}]


def test_stitched_rings(spark):
    m = spark.createDataFrame([(1, 1, "outer", [(0.0, 0.0), (1.0, 0.0)]), (1, 2, "outer", [(1.0, 1.0), (1.0, 0.0)]), (1, 3, "outer", [(1.0, 1.0), (0.0, 0.0)]), (2, 1, "inner", [(0.0, 0.0), (1.0, 0.0)])], "relation_id long, pos int, role string, path array<struct<lon:double,lat:double>>")
    got = readers.assembled_rings(m).collect()
    assert [(r.relation_id, len(r.parts[0][0])) for r in got] == [(1, 4)]


def test_surface_is_exact_at_samples_and_constant_has_no_contours(spark):
    p = spark.createDataFrame([(0.0, 0.0, 10.0), (1.0, 0.0, 20.0), (0.0, 1.0, 40.0), (1.0, 1.0, 80.0), (1.0, 1.0, 80.0)], "lon double, lat double, v double")
    n = {(r.row, r.col): r.value for r in surfaces.surface_nodes(p, "v").collect()}
    assert (n[0, 0], n[0, 16], n[16, 0], n[16, 16]) == (10, 20, 40, 80) and len(n) == 289
    assert surfaces.contours(surfaces.surface_nodes(p.withColumn("v", F.lit(1.0)), "v")).count() == 0


def test_quadkey_prefixes(spark):
    t = spark.createDataFrame([("0123",)], "quadkey string")
    f = spark.createDataFrame([("01", "a"), ("0123", "b"), ("2", "c")], "quadkey string, filename string")
    assert [(r.filename, r.rank) for r in buildings.prefix_join(t, f).orderBy("rank").collect()] == [("b", 1), ("a", 2)]


def test_stream_is_resolved_batch_by_batch(spark, tmp_path):
    from geoloom.streaming.places import PlaceStore, ingest

    rows = [("a", "Green Park", "green park", 0.0, 0.0, 1), ("b", "Green Park", "green park", 0.0, 0.0001, 2), ("c", "Other", "other", 0.0, 0.0, 3)]
    schema = "place_id string, name string, normalized_name string, lon double, lat double, created_at long"
    src = str(tmp_path / "in")
    spark.createDataFrame(rows[:1], schema).coalesce(1).write.mode("append").parquet(src)
    store = PlaceStore(spark, str(tmp_path / "store"))
    stream = lambda: ingest(spark.readStream.schema(schema).parquet(src), store, str(tmp_path / "cp")).awaitTermination(120)
    assert stream()
    spark.createDataFrame(rows[1:], schema).coalesce(1).write.mode("append").parquet(src)
    assert stream()
    assert sorted(r.place_id for r in store.places(1).collect()) == ["a", "c"]
    assert [tuple(r) for r in store.aliases(1).collect()] == [("b", "a")]
