"""Close pairs are found at every latitude."""

import math

import pytest

from geoloom.operators import places, roads


@pytest.mark.parametrize("lat", [0.0, 28.5, 59.99, 65.0, 75.0, 84.0, 88.5, -70.0])
def test_near_pairs_are_whole(spark, lat):
    east = math.degrees(34 / 6371008.8) / math.cos(math.radians(lat))
    rows = [(f"{k}{s}", "same name", 10 + k * east * 0.37 * 9 + d, lat + k * 0.0001, k) for k in range(60) for s, d in (("a", 0.0), ("b", east))]
    p = spark.createDataFrame(rows, "place_id string, normalized_name string, lon double, lat double, created_at long")
    got = {frozenset((r.place_id, r.other_id)) for r in places.same_places(p).collect()}
    assert {frozenset((f"{k}a", f"{k}b")) for k in range(60)} <= got


def test_snapped_in_the_north(spark):
    east = math.degrees(245 / 6371008.8) / math.cos(math.radians(75))
    pts = spark.createDataFrame([(str(k), 10 + k * east * 3.3, 75.0) for k in range(40)], "point_id string, lon double, lat double")
    nodes = spark.createDataFrame([(str(k), 10 + k * east * 3.3 + east, 75.0) for k in range(40)], "node_id string, lon double, lat double")
    assert {r.point_id: r.node_id for r in roads.snapped(pts, nodes).collect()} == {str(k): str(k) for k in range(40)}
