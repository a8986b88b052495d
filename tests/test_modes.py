"""Layer modes: what is shown of each geometry, the legend, and what is said about what isn't."""

import pytest

from geoloom.functions.geometry import PARTS
from geoloom.operators import layers

SCHEMA = f"feature_id string, geom_type string, parts {PARTS}, value double"


def at(*ps):
    return [[[{"lon": float(x), "lat": float(y)} for x, y in ps]]]


POINTS = [("a", "Point", at((0, 0)), 1.0), ("b", "Point", at((1, 1)), None), ("c", "MultiPoint", at((0, 0), (2, 2)), 3.0)]
AREA = ("p", "Polygon", at((0, 0), (4, 0), (4, 2), (0, 2), (0, 0)), -5.0)
LINE = ("l", "LineString", at((0, 0), (2, 0)), 7.0)


def shown(spark, rows, *how):
    out, legend = layers.layer_mode(spark.createDataFrame(rows, SCHEMA), *how)
    return out.collect(), legend.first()


def test_points_stand_for_all_geometries(spark):
    rows, legend = shown(spark, [*POINTS, AREA, LINE], "points", "value")
    assert sorted((r.feature_id, r.lon, r.lat, r.value) for r in rows) == [("a", 0, 0, 1), ("c", 0, 0, 3), ("c", 2, 2, 3), ("l", 1, 0, 7), ("p", 2, 1, -5)]
    assert (legend.input_count, legend.incompatible, legend.missing, legend.shown, legend.min, legend.mid, legend.max, legend.geometry_type, legend.title, legend.unit) == (5, 0, 1, 5, -5, 1, 7, "Point", "value", None)
    assert legend.caveats == ["missing values"]
    rows, legend = shown(spark, POINTS, "tactical")
    assert len(rows) == 4 and {r.weight for r in rows} == {0.5} and (legend.title, legend.unit, legend.missing) == ("Feature count", "features", 0) and legend.caveats == ["constant"]


def test_heat(spark):
    rows, legend = shown(spark, POINTS, "heatmap", "value")
    assert {(r.feature_id, r.heat_weight) for r in rows} == {("a", 1 / 3), ("c", 1.0)} and legend.caveats == ["missing values", "scaled by maximum"]
    assert shown(spark, [POINTS[0], AREA], "heatmap", "value")[1].caveats == ["relative weights"]


def test_polygons_or_counts_of_points(spark):
    rows, legend = shown(spark, [*POINTS, AREA], "choropleth", "value")
    assert [(r.feature_id, r.value, r.weight) for r in rows] == [("p", -5.0, 0.5)] and legend.incompatible == 3 and legend.caveats == ["incompatible geometry", "constant"]
    (r,), legend = shown(spark, [AREA], "extrusion", "value", True)
    assert r.height == 0.0 and legend.caveats == ["metre height", "constant"]
    assert shown(spark, [AREA], "extrusion")[0][0].height == 750.0
    rows, legend = shown(spark, [*POINTS, LINE], "choropleth", "value")
    assert sorted(r.value for r in rows) == [1, 1, 2] and (legend.unit, legend.incompatible, legend.geometry_type) == ("features/cell", 1, "Polygon")
    assert legend.caveats == ["grid counts", "field not encoded", "incompatible geometry"]


def test_density_and_flow(spark):
    rows, legend = shown(spark, [*POINTS, AREA], "density")
    assert sorted(r["count"] for r in rows) == [1, 1, 1, 2] and legend.shown == 4 and legend.caveats == ["grid counts"]
    rows, legend = shown(spark, [*POINTS, LINE], "flow", "value")
    assert [r.feature_id for r in rows] == ["l"] and legend.geometry_type == "LineString" and legend.caveats == ["incompatible geometry", "given lines only", "constant"]


def test_what_is_refused_and_nothing(spark):
    for rows, mode in (([AREA], "flow"), ([LINE], "choropleth"), ([], "extrusion"), (POINTS, "globe")):
        with pytest.raises(ValueError):
            shown(spark, rows, mode)
    rows, legend = shown(spark, [("x", "Point", at((0, 0)), None)], "points", "value")
    assert rows == [] and (legend.shown, legend.min, legend.mid) == (0, None, None) and legend.caveats == ["missing values", "nothing shown"]
    assert shown(spark, [], "density")[0] == []
