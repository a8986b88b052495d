"""The gate of datasets, each reason once; records to show; pin areas."""

import pytest
from pyspark.sql import functions as F

from geoloom.operators import buildings, layers, surfaces

FEATURES = "dataset_id string, geom_type string, lon double, lat double, props map<string,string>"
REQUESTS = "dataset_id string, visualization string, field string, west double, south double, east double, north double, reference_time string, population_year int"


def point(name, props, kind="Point", lon=77.0, lat=28.0):
    return (name, kind, lon, lat, props)


CASES = {
    "shown": ([point("", {"v": "1"}), point("", {"v": ""}), point("", {})], ("heatmap", "v"), None, (3, 3, 1)),
    "without a field": ([point("", {"v": "x"})], ("points", None), None, (1, 1, 1)),
    "over the date line": ([point("", {"v": "1"}, lon=179.5), point("", {"v": "2"}, lon=0.0)], ("points", "v", 179.0, -10.0, -179.0, 40.0), None, (2, 1, 1)),
    "polygons": ([point("", {"v": "1"}, "Polygon"), point("", {"v": "1"})], ("choropleth", "v"), None, (2, 2, 2)),
    "one time": ([point("", {"v": "1", "year": "2020"}), point("", {"v": "1", "year": "2020"})], ("heatmap", "v", None, None, None, None, "2020", 2020), None, (2, 2, 2)),
    "nothing": ([], ("points", None), "no observations", (0, 0, 0)),
    "half a scope": ([point("", {"v": "1"})], ("points", "v", 1.0), "invalid scope", (1, 0, 0)),
    "scope upside down": ([point("", {"v": "1"})], ("points", "v", 1.0, 5.0, 2.0, 4.0), "invalid scope", (1, 0, 0)),
    "times": ([point("", {"v": "1", "day": "2020-01-01"}), point("", {"v": "1", "day": "2020-01-02"})], ("heatmap", "v"), "several times", (2, 2, 2)),
    "text": ([point("", {"v": "1"}), point("", {"v": "two"})], ("heatmap", "v"), "no numeric field", (2, 2, 1)),
    "other field": ([point("", {"v": "1"})], ("heatmap", "w"), "no numeric field", (1, 1, 0)),
    "chart": ([point("", {"v": "1"})], ("chart", "v"), "unknown visualization", (1, 1, 1)),
    "no kind": ([point("", {"v": "1"})], (None, "v"), "unknown visualization", (1, 1, 1)),
    "heatmap of nothing": ([point("", {"v": "1"})], ("heatmap", ""), "no field for a heatmap", (1, 1, 1)),
    "lines": ([point("", {"v": "1"}), point("", {"v": "1"}, "LineString")], ("points", "v"), "not points", (2, 2, 2)),
    "points as areas": ([point("", {"v": "1"})], ("choropleth", "v"), "no polygons", (1, 1, 1)),
    "year": ([point("", {"v": "1"})], ("heatmap", "v", None, None, None, None, "2019-05-01", 2020), "other year", (1, 1, 1)),
    "unknown year": ([point("", {"v": "1"})], ("heatmap", "v", None, None, None, None, None, 2020), "other year", (1, 1, 1)),
    "elsewhere": ([point("", {"v": "1"})], ("heatmap", "v", 1.0, 1.0, 2.0, 2.0), "nothing in scope", (1, 0, 0)),
    "blank in scope": ([point("", {"v": "1"}, lon=10.0), point("", {})], ("heatmap", "v", 76.0, 27.0, 78.0, 29.0), "no value in scope", (2, 1, 0)),
    "no props": ([("", "Point", 77.0, 28.0, None)], ("points", None), None, (1, 1, 1)),
}


@pytest.mark.parametrize("asked", [10_000, 0])
def test_gate(spark, monkeypatch, asked):
    monkeypatch.setattr(layers, "ASKED", asked)
    features = [(k, *f[1:]) for k, (rows, *_) in CASES.items() for f in rows] + [("not asked for", "Point", 1.0, 1.0, {})]
    requests = [(k, *r, *[None] * (8 - len(r))) for k, (_, r, *_) in CASES.items()]
    got = layers.gated(spark.createDataFrame(features, FEATURES), spark.createDataFrame(requests, REQUESTS)).collect()
    assert {r.dataset_id: (r.reason, (r.features, r.in_scope, r.shown)) for r in got} == {k: (reason, n) for k, (_, _, reason, n) in CASES.items()}
    assert all(r.passed == (r.reason is None) for r in got) and len(got) == len(CASES)


def test_rendered_records(spark):
    rows = [
        ("t", 1, "a", "building", "Polygon", "osm", 5.0, "N" * 200, 1.0, 4.0), ("t", 2, "a", "building", "Polygon", "osm", 6.0, "b", None, None), ("t", 3, "a", "poi", "Point", "osm", None, None, None, None),
        ("t", 4, "a", "poi", "Polygon", "osm", None, "no point", None, None), ("t", 5, "b", "building", "Point", "osm", 1.0, "no area", None, None), ("t", 6, None, "building", "LineString", None, float("nan"), "", None, None),
        ("t", 7, None, "building", "LineString", None, 2.0, "", None, None), ("u", 8, "a", "building", "MultiPolygon", "osm", 7.0, "other tile", None, None), ("t", 9, "a", "road", "LineString", "osm", 0.0, "r", None, None),
    ]
    df = spark.createDataFrame(rows, "tile string, input_pos int, source_id string, kind string, geom_type string, data_source string, height double, name string, lo double, hi double")
    got = {r.input_pos: r for r in buildings.rendered(df).collect()}
    assert set(got) == {1, 3, 6, 7, 8, 9}
    assert got[1].name == "N" * 160 and got[1].level_range == [1.0, 4.0] and got[1].inferred == 0 and got[1].road_class == ""
    assert got[6].height == 0.0 and got[6].source == "" and got[6].source_id == "" and got[3].level_range == []


def test_pin_areas(spark):
    square = [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 1.0, 1.0), (3, 0.0, 1.0)]
    areas = {"square": square, "backwards": square[::-1], "crossing": [(0, 0.0, 0.0), (1, 1.0, 1.0), (2, 1.0, 0.0), (3, 0.0, 2.0)], "two": square[:2], "row": [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 2.0, 0.0)], "twice": [*square[:3], (3, 1.0, 0.0)]}
    rows = [(k, p, f"{k}{p}", x, y) for k, pins in areas.items() for p, x, y in pins]
    pins = spark.createDataFrame(rows, "area_id string, pos int, pin_id string, lon double, lat double").orderBy(F.desc("pin_id"))
    got = {r.area_id: r for r in surfaces.pin_areas(pins, "area_id").collect()}
    assert {k: r.reason for k, r in got.items()} == {"square": None, "backwards": None, "crossing": "edges meet", "two": "too few pins", "row": "no area", "twice": "no area"}
    assert got["square"].area == pytest.approx(1.2364e10, rel=1e-3) and got["square"].pin_ids == ["square0", "square1", "square2", "square3"] and got["two"].area is None


def test_layer_inventory(spark):
    """Bounds are narrow over the antimeridian, by dataset; edges count, not only vertices; fields by their values."""
    from geoloom.functions.geometry import PARTS

    at = lambda *ps: [[[{"lon": float(x), "lat": float(y)} for x, y in ps]]]
    rows = [
        ("across", "Point", at((179.5, 1)), {"n": "1", "c": "x", "t": "2020-01-01", "m": "1"}, True), ("across", "Point", at((-179.0, 2)), {"n": "2", "c": "y", "t": "2020-01-02", "m": "one"}, False),
        ("line", "LineString", at((170, 0), (-170, 5)), {}, None), ("line", "LineString", at((-175, 0), (-160, 9)), None, True),
        ("plain", "Polygon", at((0, 0), (10, 0), (10, 10), (0, 0)), {"k" * 129: "1", **{f"f{k:02d}": "1" for k in range(20)}}, True), ("empty", "Point", [], {}, True),
    ]
    df = spark.createDataFrame(rows, f"dataset_id string, geom_type string, parts {PARTS}, props map<string,string>, shown boolean")
    got = {r.dataset_id: r for r in layers.layer_inventory(df, F.col("shown")).collect()}
    assert {k: (r.feature_count, r.matching_count, r.geometry_types) for k, r in got.items()} == {"across": (2, 1, ["Point"]), "line": (2, 1, ["LineString"]), "plain": (1, 1, ["Polygon"]), "empty": (1, 1, ["Point"])}
    bounds = {k: (r.west, r.south, r.east, r.north) for k, r in got.items()}
    assert bounds == {"across": (179.5, 1.0, -179.0, 2.0), "line": (170.0, 0.0, -160.0, 9.0), "plain": (0.0, 0.0, 10.0, 10.0), "empty": (None,) * 4}
    assert (got["across"].numeric_fields, got["across"].categorical_fields) == (["n"], ["c", "m"])
    assert got["plain"].numeric_fields == [f"f{k:02d}" for k in range(16)] and got["line"].categorical_fields == []
    assert {r.dataset_id: r.matching_count for r in layers.layer_inventory(df).collect()} == {"across": 2, "line": 2, "plain": 1, "empty": 1}
