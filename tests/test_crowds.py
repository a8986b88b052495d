"""Half of all rows in one cell: dealt over tasks, the same rows; order by many tasks, the same numbers."""

import random

import pytest
from pyspark.sql import functions as F

from geoloom.operators import buildings, crowds, places


@pytest.fixture
def rows(spark):
    dice = random.Random(6)
    at = lambda k: (77.05 + dice.random() * 1e-4, 28.55 + dice.random() * 1e-4) if k % 2 else (77.05 + dice.random() / 50, 28.55 + dice.random() / 50)
    data = [(k, "t" if k % 2 else f"t{k % 3}", *at(k), float(k % 30), 100.0 + k % 7, f"s{k % 11}", ("house", "", "office")[k % 3], "obm", "", *(2.0, 6.0)) for k in range(400)]
    return spark.createDataFrame(data, "id long, tile string, lon double, lat double, height double, area double, source_id string, building_type string, data_source string, community string, lo double, hi double")


def listed(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", ["neighbours", "neighbour_pairs", "matched_reference", "range_heights", "near_pairs"])
def test_same_rows(rows, monkeypatch, name):
    run = {
        "neighbours": lambda: buildings.neighbours(rows, rows, 28.5),
        "neighbour_pairs": lambda: buildings.neighbour_pairs(rows, 28.5),
        "matched_reference": lambda: buildings.matched_reference(rows, rows.withColumn("height_source", F.lit("h"))),
        "range_heights": lambda: buildings.range_heights(rows, rows, 28.5),
        "near_pairs": lambda: places.near_pairs(rows.select("id", "lon", "lat"), rows.select("id", "lon", "lat"), 40),
    }[name]
    want = listed(run())
    monkeypatch.setattr(crowds, "MOST_ROWS", 20)
    assert listed(run()) == want and len(want) > 100
    monkeypatch.setattr(crowds, "BROADCAST_KEYS", 0)
    assert listed(run()) == want


def test_tasks_of_a_crowded_cell_are_even(rows, monkeypatch):
    """By rows of the join for each (key, split)."""
    monkeypatch.setattr(crowds, "MOST_ROWS", 20)
    a = rows.select("id", F.lit(1).alias("cell"))
    left, right = crowds.split_keys(a, a.withColumnRenamed("id", "other"), ["cell"])
    sizes = [r["count"] for r in left.join(right, ["cell", "_split"]).groupBy("_split").count().collect()]
    assert sum(sizes) == 400 * 400 and len(sizes) == 20 and max(sizes) < 2.5 * 400 * 20


def test_numbers_in_order(spark, monkeypatch):
    dice = random.Random(1)
    data = [(None if k % 50 == 0 else "hot" if k % 2 else f"g{k % 5}", dice.randrange(1000), k) for k in range(1500)]
    rows = spark.createDataFrame(data, "g string, x int, id int")
    want = {}
    for g in {d[0] for d in data}:
        want |= {d[2]: n for n, d in enumerate(sorted((d for d in data if d[0] == g), key=lambda d: d[1:]))}
    for most in (100_000, 0):
        monkeypatch.setattr(crowds, "BROADCAST_KEYS", most)
        got = crowds.numbered(rows, "g", ["x", "id"])
        assert {r.id: r["_i"] for r in got.collect()} == want and got.columns == ["g", "x", "id", "_i"]
    assert crowds.numbered(rows.where("false"), "g", ["x"]).count() == 0
