"""Results that rounding mustn't decide: ends on a boundary, rings in a row."""

from pyspark.sql import functions as F

from geoloom.operators import layers, surfaces


def test_box_ends_on_the_boundary(spark):
    outer = (77.02, 28.51, 77.18, 28.62)
    rows = [(1, 77.16, True), (2, 77.04, True), (3, 77.16001, False), (4, 77.03999, False), (5, None, None)]
    for turns in (-360, 0, 360):
        df = spark.createDataFrame(rows, "id int, lon double, inside boolean")
        lon = F.col("lon")
        for west, east in ((lon - 0.02 + turns, lon + 0.02), (lon - 0.02, lon + 0.02 + turns)):
            got = df.select("id", layers.contained((west, F.lit(28.52), east, F.lit(28.6)), outer).alias("x"))
            assert {r.id: r.x for r in got.collect()} == {i: x for i, _, x in rows}


def test_boxes_over_the_seam_and_outside(spark):
    box = lambda w, e: (F.lit(float(w)), F.lit(0.0), F.lit(float(e)), F.lit(1.0))
    asked = [((170, -170), (160, -160), True), ((-175, -170), (160, -160), True), ((150, -170), (160, -160), False), ((-170, 170), (160, -160), False), ((10, 20), (-180, 180), True), ((20, 10), (0, 300), False), ((370, 380), (0, 30), True)]
    got = spark.range(1).select(*(layers.contained(box(*i), (o[0], 0, o[1], 1)).alias(str(k)) for k, (i, o, _) in enumerate(asked))).first()
    assert list(got) == [x for *_, x in asked]


def test_pins_in_a_row_have_no_area(spark):
    """The areas of these rings aren't 0 as summed up: 198 and 264 are suppliers of the tables, 3 lies on a slope."""
    x = {198: 77.0 + 198 * 7919 % 20000 / 100000.0, 264: 77.0 + 264 * 7919 % 20000 / 100000.0, 3: 77.0}
    y = {198: 28.5 + 198 * 104729 % 15000 / 100000.0, 264: 28.5 + 264 * 104729 % 15000 / 100000.0, 3: 28.5}
    pins = [(k, i, f"{k}-{i}", x[k] + i / 1000, y[k] + (i * 0.0007 if k == 3 else 0.0)) for k in x for i in range(4)]
    thin = [(9, i, f"9-{i}", 77.1 + dx, 28.5 + dy) for i, (dx, dy) in enumerate(((0, 0), (0.01, 0), (0.01, 1e-8), (0, 1e-8)))]
    got = surfaces.pin_areas(spark.createDataFrame(pins + thin, "area_id int, pos int, pin_id string, lon double, lat double"), "area_id")
    assert {r.area_id: r.reason for r in got.collect()} == {198: "no area", 264: "no area", 3: "no area", 9: None}
