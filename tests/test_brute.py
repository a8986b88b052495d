"""Operators without SQL, or that SQL's small inputs don't stretch, against brute force."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom import catalog
from geoloom.functions import columns as fn
from geoloom.operators import buildings, layers, places, raster, surfaces
from geoloom.plans import roads as road_plans
from geoloom.sources import readers, web

METRE = 1 / 111_320


def test_canonical_places_in_long_chains(spark):
    """A street of equal names 30 m apart, longer than any bound on rounds would be, and crowds of places."""
    rng = random.Random(2)
    rows = [(f"c{k:03d}", "green park", 0.0, k * 30 * METRE, k) for k in range(40)]
    rows += [(f"r{k:03d}", f"block {k % 3}", 1 + rng.random() * 200 * METRE, 1 + rng.random() * 200 * METRE, rng.randrange(20)) for k in range(150)]
    order = sorted(rows, key=lambda r: (r[4], r[0]))
    far = lambda a, b: math.hypot((a[3] - b[3]) / METRE, (a[2] - b[2]) / METRE * math.cos(math.radians((a[3] + b[3]) / 2)))
    want, canonical = {}, []
    for r in order:
        to = next((c for c in canonical if c[1] == r[1] and far(c, r) <= 35), None)
        want[r[0]] = to[0] if to else r[0]
        if not to:
            canonical.append(r)
    p = spark.createDataFrame(rows, "place_id string, normalized_name string, lon double, lat double, created_at long")
    assert {r.place_id: r.canonical_id for r in places.canonical_places(p).collect()} == want
    assert 30 < len(canonical) < len(rows)


def test_stored_places_aren_t_written_again(spark, tmp_path):
    from geoloom.streaming.places import PlaceStore

    rng = random.Random(3)
    rows = [(f"p{k:03d}", "n", f"block {k % 4}", rng.random() * 300 * METRE, rng.random() * 300 * METRE, k) for k in range(120)]
    schema = "place_id string, name string, normalized_name string, lon double, lat double, created_at long"
    store = PlaceStore(spark, str(tmp_path / "s"))
    canonical, want = [], {}
    for k in range(3):
        part = rows[k * 40 : k * 40 + 40] + rows[:5]  # known ones come again
        store.add(spark.createDataFrame(part, schema), k)
        for r in part:
            if r[0] in want:
                continue
            to = next((c for c in canonical if c[2] == r[2] and math.hypot((c[4] - r[4]) / METRE, (c[3] - r[3]) / METRE) <= 35), None)
            want[r[0]] = to[0] if to else r[0]
            canonical += [] if to else [r]
    store.add(spark.createDataFrame(rows[80:120] + rows[:5], schema), 2)  # a batch that is run again
    assert {r.place_id for r in store.places(2).collect()} == {c[0] for c in canonical}
    assert {r.place_id: r.canonical_id for r in store.aliases(2).collect()} == {a: b for a, b in want.items() if a != b}


def test_ranks_of_any_spread(spark):
    """One outlier far away, many equal values, and the extremes of doubles."""
    rng = random.Random(5)
    values = [rng.random() for _ in range(3000)] + [1e300, -1e300, 1.7e308, -1.7e308] + [0.5] * 500
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    was = layers.RANGE_VALUES
    layers.RANGE_VALUES = 20
    try:
        ranks = [1, 2, 700, 1752, len(values) - 1, len(values)]
        assert layers.values_of_ranks(rows, F.col("v"), *ranks) == [sorted(values)[r - 1] for r in ranks]
        assert layers.summary(rows.where("abs(v) <= 1"), "v").first().median == pytest.approx(sorted(v for v in values if abs(v) <= 1)[1749] / 2 + sorted(v for v in values if abs(v) <= 1)[1750] / 2)
        assert layers.hotspots(rows, "v", 0.99).count() == len(values) - int((len(values) - 1) * 0.99)
        assert layers.hotspots(rows.where("v IS NULL"), "v").count() == 0
        assert layers.summary(rows.where("v IS NULL"), "v").first().median is None
    finally:
        layers.RANGE_VALUES = was


@pytest.mark.parametrize("seed", range(4))
def test_extent_is_the_complement_of_the_largest_gap(spark, seed):
    """Few arcs, and so many that the largest gap lies inside a hundredth of a degree."""
    rng = random.Random(seed)
    if seed == 3:
        arcs = [(x / 1000 - 180, (x + 0.9) / 1000 - 180, 0.0) for x in range(0, 360_000, 10) for x in (x, x + 1, x + 2, x + 3, x + 4, x + 5, x + 6, x + 7, x + 8) if x != 77_777] + [(x / 1000 + 0.0089 - 180, x / 1000 + 0.01 - 180, 1.0) for x in range(0, 360_000, 10)]
        arcs = arcs[:: 1]
    else:
        arcs = [(a, a + rng.random() * 3, rng.random()) for a in (rng.random() * 300 - 150 for _ in range(40))]
    wrap = lambda x: (x + 180) % 360 - 180
    pieces = []
    for a, b, _ in arcs:
        s = wrap(a) + 180
        e = s + (b - a)
        pieces += [(s, e)] if e <= 360 else [(s, 360.0), (0.0, e - 360)]
    pieces.sort()
    reach, gaps = pieces[0][1], []
    for s, e in pieces[1:]:
        if s > reach:
            gaps.append((s - reach, reach, s))
        reach = max(reach, e)
    gaps.append((pieces[0][0] + 360 - reach, reach, pieces[0][0] + 360))
    gap, left, right = max(gaps)
    rows = spark.createDataFrame([(a, wrap(b), lat) for a, b, lat in arcs], "a double, b double, lat double")
    got = layers.extent(rows).first()
    assert (got.west, got.east) == pytest.approx((wrap(right - 180), wrap(left - 180)), abs=1e-9)


@pytest.mark.parametrize(("kind", "values"), [("long", [123, 200, 31, 9, 1, 10, -5]), ("boolean", [True, False]), ("double", [1.5, 10.25, -0.5, 100.0]), ("string", [f"same beginning {k}" for k in range(300)] + ['a"b', "", "é"])])
def test_codes_are_in_text_order(spark, kind, values):
    import json

    rows = spark.createDataFrame([(v,) for v in values * 2] + [(None,)], f"c {kind}")
    got = {r["value"]: r["code"] for r in layers.category_codes(rows, "c", 1000).collect()}
    text = lambda v: json.dumps(v, ensure_ascii=False)
    assert [v for v, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(values, key=text)


def test_neighbour_pairs_are_neighbours(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(f"t{k % 3}", k, 77 + rng.random() * 0.01, 28.5 + rng.random() * 0.01) for k in range(300)], "tile string, id long, lon double, lat double")
    both = {(r.l.id, r.r.id): round(r.metres, 6) for r in buildings.neighbours(rows, rows, 28.5).collect()}
    once = {(r.l.id, r.r.id): round(r.metres, 6) for r in buildings.neighbour_pairs(rows, 28.5).collect()}
    assert once == {k: v for k, v in both.items() if k[0] < k[1]} and len(once) > 100


def test_hull_by_brute_force(spark):
    rng = random.Random(6)
    points = [(k % 2, rng.randrange(40) / 4, rng.randrange(40) / 4) for k in range(400)] + [(2, 1.0, 1.0), (2, 2.0, 2.0), (2, 3.0, 3.0)]
    got = {r.g: {(p.lon, p.lat) for p in r.ring} for r in surfaces.hulls(spark.createDataFrame(points, "g int, lon double, lat double").repartition(5), "g").collect()}
    for g in (0, 1):
        own = {(x, y) for h, x, y in points if h == g}
        turn = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        edge = {(a, b) for a in own for b in own if a != b and all(turn(a, b, p) > 0 or turn(a, b, p) == 0 and min(a, b) <= p <= max(a, b) for p in own)}
        assert got[g] == {a for a, _ in edge}
    assert got[2] == {(1.0, 1.0), (3.0, 3.0)}


def test_surface_and_contours_by_brute_force(spark):
    rng = random.Random(7)
    samples = [(rng.random(), rng.random() / 2, rng.random() * 10) for _ in range(40)]
    nodes = surfaces.surface_nodes(spark.createDataFrame(samples, "lon double, lat double, v double"), "v")
    got = {(r.row, r.col): (r.lon, r.lat, r.value) for r in nodes.collect()}
    xs, ys = [s[0] for s in samples], [s[1] for s in samples]
    hull = surfaces._hull([(x, y) for x, y, _ in samples])
    c = math.cos(math.radians((min(ys) + max(ys)) / 2))
    want = {}
    for i in range(17):
        for j in range(17):
            x, y = min(xs) + (max(xs) - min(xs)) * j / 16, min(ys) + (max(ys) - min(ys)) * i / 16
            inside = all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= -1e-15 for a, b in zip(hull, hull[1:] + hull[:1], strict=True))
            w = [1 / (((x - sx) * c) ** 2 + (y - sy) ** 2) for sx, sy, _ in samples]
            want[i, j] = sum(k * s[2] for k, s in zip(w, samples, strict=True)) / sum(w) if inside else None
    assert {k for k, v in got.items() if v[2] is not None} == {k for k, v in want.items() if v is not None}
    assert all(got[k][2] == pytest.approx(v, rel=1e-9) for k, v in want.items() if v is not None)
    cells = {(r.row, r.col): r.value for r in surfaces.surface_cells(nodes).collect()}
    corner = lambda i, j: [want[i + a, j + b] for a in (0, 1) for b in (0, 1)]
    whole = {(i, j) for i in range(16) for j in range(16) if None not in corner(i, j)}
    assert set(cells) == whole and all(cells[k] == pytest.approx(sum(corner(*k)) / 4) for k in whole)
    # Contours: a crossing on each side of a cell whose ends lie apart, at the level by straight lines.
    known = [v for v in want.values() if v is not None]
    found = {}
    for r in surfaces.contours(nodes).collect():
        found.setdefault((r.level_index, r.row, r.col), []).extend([(r.a.lon, r.a.lat), (r.b.lon, r.b.lat)])
        assert r.level == pytest.approx(min(known) + (max(known) - min(known)) * (r.level_index + 1) / 8)
    expected = {}
    for k in range(7):
        level = min(known) + (max(known) - min(known)) * (k + 1) / 8
        for i, j in whole:
            ring, ends = [(i, j), (i, j + 1), (i + 1, j + 1), (i + 1, j)], []
            for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
                if (want[a] >= level) != (want[b] >= level):
                    t = (level - want[a]) / (want[b] - want[a])
                    ends.append((got[a][0] * (1 - t) + got[b][0] * t, got[a][1] * (1 - t) + got[b][1] * t))
            if ends:
                expected[k, i, j] = ends
    assert set(found) == set(expected)
    near = lambda p: (round(p[0], 7), round(p[1], 7))
    assert all(sorted(map(near, found[k])) == sorted(map(near, expected[k])) for k in found)


def test_routes_are_dijkstra_s(spark, tmp_path):
    """All suppliers' routes on the whole graph of a table of their own."""
    from geoloom.operators import roads

    small = str(tmp_path)
    spark.range(1, 4000).where("id % 13 <> 0").select(F.col("id").alias("o_orderkey")).write.parquet(f"{small}/orders.parquet")
    spark.range(1, 13).select(F.col("id").alias("s_suppkey")).write.parquet(f"{small}/supplier.parquet")
    nodes, edges = roads.driving_graph(road_plans._ways(spark, small))
    graph, at = {}, {r.node_id: (r.lon, r.lat) for r in nodes.collect()}
    for r in edges.collect():
        graph.setdefault(r.src, []).append((r.dst, r.metres))

    def metres(a, b):
        return 6371008.8 * math.hypot(math.radians(b[0] - a[0]) * math.cos(math.radians((a[1] + b[1]) / 2)), math.radians(b[1] - a[1]))

    def search(start, goal):
        best, queue = {start: 0.0}, [(0.0, start)]
        while queue:
            d, n = heapq.heappop(queue)
            if n == goal:
                return d
            for m, w in graph.get(n, ()) if d <= best[n] else ():
                if d + w < best.get(m, math.inf):
                    best[m] = d + w
                    heapq.heappush(queue, (d + w, m))
        return None

    want = {}
    for (s,) in spark.read.parquet(f"{small}/supplier.parquet").select("s_suppkey").collect():
        b = s * 150 // 4000
        root = math.isqrt(b)
        x0, y0 = min(b - root * root, root) * 40, min(2 * root - (b - root * root), root) * 40
        points = [(77.0003 + (x0 + (s * 7 + p * 3) % 39) / 1000, 28.5002 + (y0 + (s * 5 + p * 2) % 39) / 1000) for p in range(3)]
        total, whole = 0.0, True
        for a, c in zip(points, points[1:], strict=False):
            (da, na), (dc, nc) = (min((metres(p, q), n) for n, q in at.items()) for p in (a, c))
            leg = search(na, nc) if da <= 250 and dc <= 250 else None
            whole &= leg is not None
            total += (leg or 0) + da + dc
        if whole:
            want[s] = total
    got = {r.route_id: r.metres for r in catalog.queries()["pipe8_routes"](spark, small).collect()}
    assert got == pytest.approx(want, abs=2e-3) and got


def test_terms_are_plain(spark):
    texts = ["Népesség 2011%20data", "São Paulo’s ﬁle_name", "हिन्दी शब्द", "ABC abc", None, "100% x"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.array_sort(fn.terms("t"))).collect()]
    assert got[0] == ["2011", "data", "nepesseg"] and got[1] == ["file", "name", "paulo", "s", "sao"] and got[3] == ["abc"] and got[4] is None and got[5] == ["100", "x"]
    assert got[2] and all(fn.plain_terms(t) == g for t, g in zip(texts, got, strict=True) if t)


def test_sources_in_any_script(spark):
    rows = [(0, "Population", "https://a.org/", "x"), (1, "Népesség", "https://b.org/", "x"), (2, "Just a moment", "https://c.org/", "हिन्दी शब्द"), (3, "Please wait…", "https://d.org/", "Please wait")]
    df = spark.createDataFrame(rows, "pos int, title string, url string, snippet string")
    top = web.rank_sources(df, "nepesseg").first()
    assert top.pos == 1 and top.score > 1
    assert [r.pos for r in web.useful_sources(df).orderBy("pos").collect()] == [0, 1, 2]


def test_geocoding_uses_the_normal_form(spark):
    p = spark.createDataFrame([("p1", "Straße ﬁ", "Österreich", "AT")], "place_id string, name string, address string, country_code string").withColumn("normalized_name", fn.text_key("name"))
    q = spark.createDataFrame([(1, "STRASSE  FI, ÖSTERREICH"), (2, "strasse fi," + ",".join(["at"] * 150) + ",nowhere")], "query_id int, query string")
    assert {r.query_id: r.status for r in places.geocode(q, p).collect()} == {1: "resolved", 2: "missing"}
    s = p.withColumns({"provider": F.lit("openstreetmap"), "updated_at": F.lit(1)})
    assert places.saved_matches(s, "STRASSE FI, öSTERREICH").count() == 1


def test_page_limits_are_parameters():
    html = "<title>" + "t" * 300 + "</title>" + "".join(f'<a href="https://h.org/{k}">l</a><table><tr><td>{k}</table>' for k in range(60))
    assert [len(web.read_page("https://h.org/", html)[k]) for k in ("title", "links", "tables")] == [160, 40, 6]
    wide = web.read_page("https://h.org/", html, web.Limits(title=1000, links=100, tables=100))
    assert [len(wide[k]) for k in ("title", "links", "tables")] == [300, 60, 60]


def test_long_ids_are_exported_whole(spark):
    ident = 'a"b' * 400_000
    row = spark.createDataFrame([(ident, "Point", [[[(1.0, 2.0)]]], 5)], "feature_id string, geom_type string, parts array<array<array<struct<lon:double,lat:double>>>>, v int")
    (back,) = readers.geojson_features(readers.geojson_rows(row, ["v"]))[0].collect()
    assert back.feature_id == ident and back.props == {"v": "5"}


def test_utm_by_the_forward_projection(spark):
    """Positions projected by the series of the other direction come back."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    radius = 6_378_137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    def forward(lon, lat, zone):
        e = 2 * math.sqrt(n) / (1 + n)
        t = math.sinh(math.atanh(math.sin(math.radians(lat))) - e * math.atanh(e * math.sin(math.radians(lat))))
        d = math.radians(lon - (zone * 6 - 183))
        xi, eta = math.atan2(t, math.cos(d)), math.atanh(math.sin(d) / math.sqrt(1 + t * t))
        x = 500_000 + 0.9996 * radius * (eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(alpha, 1)))
        y = 0.9996 * radius * (xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(alpha, 1)))
        return x, y

    cases = [(77.2, 28.6, 43), (78.0, 0.5, 44), (-70.0, 60.0, 19), (3.0, 83.0, 31)]
    rows = [(*forward(lon, lat, z), 32600 + z, lon, lat) for lon, lat, z in cases]
    rows += [(x, 10_000_000 - y, epsg + 100, lon, -lat) for x, y, epsg, lon, lat in rows]
    df = spark.createDataFrame(rows, "x double, y double, epsg int, lon double, lat double")
    lon, lat = raster.utm_degrees(F.col("x"), F.col("y"), F.col("epsg"))
    for r in df.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert (r.a, r.b) == pytest.approx((r.lon, r.lat), abs=1e-8)
    x, y = forward(77.2, 28.6, 43)
    cells = spark.createDataFrame([("r", 0, 0, 1.0), ("r", 5000, 0, 2.0)], "raster_id string, row int, col int, value double")
    meta = spark.createDataFrame([("r", 10.0, x - 5, -10.0, y + 5, 32643, -1.0)], "raster_id string, a double, c double, e double, f double, epsg int, nodata double")
    (hit,) = raster.crop(cells, meta, (77.1, 28.5, 77.3, 28.7)).collect()
    assert (hit.value, hit.lon, hit.lat) == (1.0, pytest.approx(77.2, abs=1e-8), pytest.approx(28.6, abs=1e-8))


def test_holes_beyond_the_ten_thousandth_are_checked(spark):
    ring = lambda *p: "array(" + ", ".join(f"struct(double({x}) AS lon, double({y}) AS lat)" for x, y in p) + ")"
    hole = ring(("50 + k * 0.001", 40), ("50.0004 + k * 0.001", 40), ("50 + k * 0.001", 40.0004), ("50 + k * 0.001", 40))
    row = spark.range(1).select(F.lit(1).alias("feature_id"), F.expr(f"array(concat(array({ring((0, 0), (100, 0), (100, 80), (0, 80), (0, 0))}), transform(sequence(1, 10001), k -> {hole}), array({ring((150, 40), (151, 40), (150, 41), (150, 40))})))").alias("parts"))
    _, bad = surfaces.validated(row)
    assert [r.reason for r in bad.collect()] == ["hole outside"]
