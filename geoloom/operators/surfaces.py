"""Surfaces and contours by inverse distances, convex hulls, and validity of geometries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import longitude_delta, wrap_longitude
from ..functions.geometry import VERTEX, _let, edge_crosses, on_edge, pairs, point_in_ring, ring_area, valid_vertex, vertex, without_area
from .layers import average_duplicates, plain_extent
from ..scratch import stored

GRID, LEVELS = 16, 7
#: Edges of a feature up to which all pairs are looked at in its row.
ROW_EDGES = 64


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Monotone chain, counter-clockwise, without points that are collinear to within rounding."""
    points = sorted(set(points))

    def turns_left(a: tuple, b: tuple, p: tuple) -> bool:
        bx, by, px, py = b[0] - a[0], b[1] - a[1], p[0] - a[0], p[1] - a[1]
        return bx * py - by * px > 3e-14 * (abs(bx) + abs(by) + abs(px) + abs(py))  # what degrees are rounded to

    def half(items: list) -> list:
        out: list = []
        for p in items:
            while len(out) > 1 and not turns_left(out[-2], out[-1], p):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1]) if len(points) > 1 else points


def hulls(points: DataFrame, by: str) -> DataFrame:
    """(by, ring) for points (by, lon, lat): hulls of batches where the rows are, then of those hulls' corners
    only; a merge is small, however many points a group has."""
    kind = points.schema[by].dataType.simpleString()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, group in batch.groupby("key", dropna=False):
                corners = _hull(list(zip(group.lon, group.lat, strict=True)))
                yield pd.DataFrame({"key": [key] * len(corners), "lon": [c[0] for c in corners], "lat": [c[1] for c in corners]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": [pdf.key.iloc[0]], "ring": [[{"lon": a, "lat": b} for a, b in _hull(list(zip(pdf.lon, pdf.lat, strict=True)))]]})

    merge.__annotations__ = {"pdf": pd.DataFrame, "return": pd.DataFrame}
    some = points.select(F.col(by).alias("key"), "lon", "lat").mapInPandas(partial, f"key {kind}, lon double, lat double")
    salted = some.groupBy("key", F.pmod(F.xxhash64("lon", "lat"), F.lit(32)).alias("s")).applyInPandas(lambda pdf: next(partial(iter([pdf[["key", "lon", "lat"]]]))), f"key {kind}, lon double, lat double")
    return salted.groupBy("key").applyInPandas(merge, f"key {kind}, ring array<{VERTEX}>").withColumnRenamed("key", by)


def surface_nodes(points: DataFrame, field: str, size: int = GRID) -> DataFrame:
    """(row, col, lon, lat, value): nodes of a grid over the extent, with the mean of the samples weighted by
    squared distance (longitudes by the middle latitude); null outside the samples' hull. Samples meet the
    289 nodes where they are and are summed up there before anything is shuffled."""
    samples = average_duplicates(points, field).withColumnRenamed(field, "v").withColumn("_all", F.lit(1))
    samples = stored(samples)
    box = plain_extent(samples)
    hull = hulls(samples, "_all").select("ring")
    side = F.explode(F.sequence(F.lit(0), F.lit(size)))
    nodes = box.select("*", side.alias("row")).select("*", side.alias("col"))
    at = lambda a, b, k: F.col(a) * (1 - F.col(k) / size) + F.col(b) * (F.col(k) / size)
    nodes = nodes.select("row", "col", at("west", "east", "col").alias("x"), at("south", "north", "row").alias("y"), F.cos(F.radians((F.col("south") + F.col("north")) / 2)).alias("c"))
    d = F.pow((F.col("x") - F.col("lon")) * F.col("c"), 2) + F.pow(F.col("y") - F.col("lat"), 2)
    met = samples.crossJoin(F.broadcast(nodes)).withColumn("d", d)
    near = F.col("d") < 1e-24
    sums = met.groupBy("row", "col", "x", "y").agg(F.sum(F.when(~near, F.col("v") / F.col("d"))).alias("n"), F.sum(F.when(~near, 1 / F.col("d"))).alias("w"), F.max(F.when(near, F.col("v"))).alias("exact"))
    out = sums.crossJoin(F.broadcast(hull)).withColumn("inside", point_in_ring("x", "y", F.concat("ring", F.slice("ring", 1, 1)), True))
    value = F.when(F.col("inside") & (F.size("ring") >= 3), F.coalesce("exact", F.col("n") / F.col("w")))
    return out.select("row", "col", F.col("x").alias("lon"), F.col("y").alias("lat"), value.alias("value"))


def _cells(nodes: DataFrame) -> DataFrame:
    """(row, col, p0..p3): cells with their corners, counter-clockwise from the south-west one."""
    n = nodes.where("value IS NOT NULL").select("row", "col", F.struct("lon", "lat", "value").alias("p"))
    out = n.select("row", "col", F.col("p").alias("p0"))
    for k, (dr, dc) in enumerate(((0, 1), (1, 1), (1, 0)), 1):
        out = out.join(n.select((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.col("p").alias(f"p{k}")), ["row", "col"])
    return out


def surface_cells(nodes: DataFrame) -> DataFrame:
    """(row, col, value): the mean of each whole cell's corners."""
    return _cells(nodes).select("row", "col", ((F.col("p0.value") + F.col("p1.value") + F.col("p2.value") + F.col("p3.value")) / 4).alias("value"))


def contours(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(level_index, level, row, col, part, a, b): segments of marching squares; a corner at the level counts
    as above, and saddles are resolved by the asymptotic decider. A constant surface has none."""
    ends = nodes.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo < hi")
    share = (F.col("k") + 1) / (levels + 1)
    lv = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("k")).select("k", (F.col("lo") * (1 - share) + F.col("hi") * share).alias("level"))
    c = _cells(nodes).crossJoin(F.broadcast(lv))
    above = lambda i: F.col(f"p{i}.value") >= F.col("level")

    def crossing(i: int) -> Column:
        a, b = F.col(f"p{i}"), F.col(f"p{(i + 1) % 4}")
        t = (F.col("level") - a["value"]) / (b["value"] - a["value"])
        return F.when(above(i) != above((i + 1) % 4), F.struct((a["lon"] * (1 - t) + b["lon"] * t).alias("lon"), (a["lat"] * (1 - t) + b["lat"] * t).alias("lat")))

    c = c.withColumns({f"e{i}": crossing(i) for i in range(4)})
    found = F.filter(F.array(*(F.col(f"e{i}") for i in range(4))), lambda e: e.isNotNull())
    shifted = [F.col(f"p{i}.value") - F.col("level") for i in range(4)]
    joined = shifted[0] * shifted[2] - shifted[1] * shifted[3] >= 0
    seg = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    e = [F.col(f"e{i}") for i in range(4)]
    parts = F.when(F.size("found") == 2, F.array(seg(F.col("found")[0], F.col("found")[1])))
    parts = parts.when((F.size("found") == 4) & joined, F.array(seg(e[0], e[1]), seg(e[2], e[3]))).when(F.size("found") == 4, F.array(seg(e[3], e[0]), seg(e[1], e[2])))
    rows = c.withColumn("found", found).select(F.col("k").alias("level_index"), "level", "row", "col", F.posexplode(parts).alias("part", "s"))
    apart = F.hypot(F.col("s.a.lon") - F.col("s.b.lon"), F.col("s.a.lat") - F.col("s.b.lat")) >= 1e-14
    wrapped = lambda p: F.struct(wrap_longitude(F.col(f"s.{p}.lon")).alias("lon"), F.col(f"s.{p}.lat").alias("lat")).alias(p)
    return rows.where(apart).select("level_index", "level", "row", "col", "part", wrapped("a"), wrapped("b"))


def _turn(a: Column, b: Column, p: Column) -> Column:
    return (b["lon"] - a["lon"]) * (p["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (p["lon"] - a["lon"])


def _meet(s: Column, t: Column) -> Column:
    """Two segments cross or touch."""
    one, two, three, four = _turn(s["a"], s["b"], t["a"]), _turn(s["a"], s["b"], t["b"]), _turn(t["a"], t["b"], s["a"]), _turn(t["a"], t["b"], s["b"])
    on = lambda o, x, p: (F.abs(o) < 1e-12) & p["lon"].between(F.least(x["a"]["lon"], x["b"]["lon"]), F.greatest(x["a"]["lon"], x["b"]["lon"])) & p["lat"].between(F.least(x["a"]["lat"], x["b"]["lat"]), F.greatest(x["a"]["lat"], x["b"]["lat"]))
    return ((one > 0) != (two > 0)) & ((three > 0) != (four > 0)) | on(one, s, t["a"]) | on(two, s, t["b"]) | on(three, t, s["a"]) | on(four, t, s["b"])


def _unrolled(polygon: Column) -> Column:
    """The rings of a polygon with longitudes beyond 180 degrees where it crosses the antimeridian, holes on
    the exterior's side."""
    near = lambda base, lon: base + longitude_delta(base, lon)
    jumps = lambda r: F.exists(pairs(r), lambda s: F.abs(s["b"]["lon"] - s["a"]["lon"]) > 180)
    roll = lambda r: F.when(jumps(r), F.transform(r, lambda p: vertex(near(r[0]["lon"], p["lon"]), p["lat"]))).otherwise(r)
    base = polygon[0][0]["lon"]
    beside = lambda h: F.when(F.abs(h[0]["lon"] - base) > 180, F.transform(h, lambda p: vertex(p["lon"] + near(base, h[0]["lon"]) - h[0]["lon"], p["lat"]))).otherwise(h)
    holes = F.transform(F.slice(polygon, F.lit(2), F.greatest(F.size(polygon) - 1, F.lit(0))), lambda h: beside(roll(h)))
    return F.concat(F.array(roll(polygon[0])), holes)


def _apart(a: Column, b: Column) -> Column:
    """The boxes of two segments don't touch."""
    ends = lambda s, c: (F.least(s["a"][c], s["b"][c]), F.greatest(s["a"][c], s["b"][c]))
    return reduce(or_, (ends(p, c)[0] > ends(q, c)[1] + 1e-9 for c in ("lon", "lat") for p, q in ((a, b), (b, a))))


def _rank(polygon: Column) -> Column:
    """The number of the first rule on rings that a polygon breaks: 1 edges meet, 2 rings meet, 3 hole outside,
    4 nested holes. All pairs of its edges are looked at."""
    edge = lambda i, n: lambda s, k: F.struct(i.alias("ring"), n.alias("n"), k.alias("k"), s.alias("s"))
    joint = lambda a, b: (b["k"] - a["k"] <= 1) | ((a["k"] == 0) & (b["k"] == a["n"] - 2))
    cross = lambda a, b: ~_apart(a["s"], b["s"]) & _meet(a["s"], b["s"])

    def met(edges: Column, pair) -> Column:
        after = lambda x: F.slice(edges, x + 2, F.size(edges))
        return F.exists(F.transform(edges, lambda a, x: F.exists(after(x), lambda b: pair(a, b) & cross(a, b))), lambda hit: hit)

    def of(rings: Column) -> Column:
        edges = F.flatten(F.transform(rings, lambda r, i: F.transform(pairs(r), edge(i, F.size(r)))))
        own = lambda a, b: (a["ring"] == b["ring"]) & ~joint(a, b)
        other = lambda a, b: a["ring"] != b["ring"]
        holes = F.slice(rings, F.lit(2), F.size(rings))
        held = lambda h, r: point_in_ring(h[0]["lon"], h[0]["lat"], r, True)
        outside = F.exists(holes, lambda h: ~held(h, rings[0]))
        nested = F.exists(F.transform(holes, lambda h, i: F.exists(F.transform(holes, lambda r, j: (i != j) & held(h, r)), lambda v: v)), lambda v: v)
        return _let(edges, lambda e: F.when(met(e, own), 1).when((F.size(rings) > 1) & met(e, other), 2).when(outside, 3).when(nested, 4))

    return _let(_unrolled(polygon), of)


def _ranked(large: DataFrame, key: str) -> DataFrame:
    """(_key, _worst) of features that break a rule on rings, by cells of lattices."""
    each = large.select(key, F.posexplode("parts").alias("part", "rings")).where(F.size("rings") > 0)
    each = each.select(key, "part", F.posexplode(_unrolled(F.col("rings"))).alias("ring", "path"))
    edges = each.select(key, "part", "ring", F.size("path").alias("n"), F.col("path")[0].alias("first"), F.posexplode(pairs(F.col("path"))).alias("k", "s"))
    ends = [f(f"s.a.{c}", f"s.b.{c}") for c in ("lat", "lon") for f in (F.least, F.greatest)]
    spans = edges.groupBy(key, "part").agg(F.min(ends[0]).alias("south"), F.max(ends[1]).alias("north"), F.min(ends[2]).alias("west"), F.max(ends[3]).alias("east"), (4 * F.sqrt(F.count("*"))).alias("side"))
    wide = lambda low, high: F.greatest((F.col(high) - F.col(low)) / F.col("side"), F.lit(1e-12))
    spans = spans.select(F.col(key).alias("_of"), F.col("part").alias("_part"), "south", "west", wide("south", "north").alias("dy"), wide("west", "east").alias("dx"))
    own = (F.col(key) == F.col("_of")) & (F.col("part") == F.col("_part"))
    row, column = (lambda y: F.floor((y - F.col("south")) / F.col("dy"))), (lambda x: F.floor((x - F.col("west")) / F.col("dx")))
    banded = edges.join(spans, own).withColumn("row", F.explode(F.sequence(row(ends[0]), row(ends[1]))))
    banded = stored(banded.select(key, "part", "ring", "n", "k", "s", "row", "west", "dx", "south", "dy"))
    # Where an edge is in a row: the longitudes at the row's ends, as far as the edge reaches.
    slope = F.try_divide(F.col("s.b.lon") - F.col("s.a.lon"), F.col("s.b.lat") - F.col("s.a.lat"))
    low, high = F.greatest(ends[0], F.col("south") + F.col("row") * F.col("dy")), F.least(ends[1], F.col("south") + (F.col("row") + 1) * F.col("dy"))
    at = lambda y: F.least(ends[3], F.greatest(ends[2], F.col("s.a.lon") + slope * (y - F.col("s.a.lat"))))
    level = F.col("s.a.lat") == F.col("s.b.lat")
    first, last = (F.when(level, e).otherwise(f(at(low), at(high))) for f, e in ((F.least, ends[2]), (F.greatest, ends[3])))
    celled = stored(banded.withColumn("column", F.explode(F.sequence(column(first - 1e-9), column(last + 1e-9)))).select(key, "part", "ring", "n", "k", "s", "row", "column", (F.col("ring") * (1 << 32) + F.col("k")).alias("order"), *(e.alias(c) for e, c in zip(ends, ("y1", "y2", "x1", "x2"), strict=True))))
    same = lambda a, b, *on: reduce(and_, (F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in (key, "part", *on)))
    one, other = celled.alias("a"), celled.alias("b")
    gap = F.col("b.k") - F.col("a.k")
    one_ring = F.col("a.ring") == F.col("b.ring")
    joint = one_ring & ((gap <= 1) | ((F.col("a.k") == 0) & (F.col("b.k") == F.col("a.n") - 2)))
    apart = reduce(or_, (F.col(f"{p}.{c}1") > F.col(f"{q}.{c}2") + 1e-9 for c in "xy" for p, q in ("ab", "ba")))
    near = one.join(other, same("a", "b", "row", "column") & (F.col("a.order") < F.col("b.order"))).where(~apart).where(~joint)
    near = stored(near.select(F.col(f"a.{key}").alias("_key"), one_ring.alias("own"), F.col("a.s").alias("s"), F.col("b.s").alias("t")))
    found = near.where(_meet(F.col("s"), F.col("t"))).groupBy("_key").agg(F.bool_or("own").alias("own"))
    found = found.select("_key", F.when(F.col("own"), F.lit(1)).otherwise(F.lit(2)).alias("rank"))
    holes = each.where("ring > 0").withColumn("first", F.col("path")[0]).join(spans, own)
    points = holes.select(key, "part", "ring", "first", row(F.col("first.lat")).alias("row"), column(F.col("first.lon")).alias("column"))
    lon, lat = F.col("p.first.lon"), F.col("p.first.lat")
    met = points.alias("p").join(banded.where("ring = 0").alias("e"), same("p", "e", "row"))
    per = met.groupBy(F.col(f"p.{key}").alias("_key"), F.col("p.part").alias("_p"), F.col("p.ring").alias("_r"))
    within = per.agg(((F.count_if(edge_crosses(lon, lat, F.col("e.s"))) % 2 == 1) | F.bool_or(on_edge(lon, lat, F.col("e.s")))).alias("inside")).where("inside")
    outside = points.join(within, (F.col(key) == F.col("_key")) & (F.col("part") == F.col("_p")) & (F.col("ring") == F.col("_r")), "left_anti").select(F.col(key).alias("_key"), F.lit(3).alias("rank"))
    extent = {f"{m}_{c}": f(F.transform("path", lambda p: p[c])) for c in ("lon", "lat") for m, f in (("low", F.array_min), ("high", F.array_max))}  # noqa: B023
    boxes = holes.withColumns(extent).withColumn("row", F.explode(F.sequence(row(F.col("low_lat")), row(F.col("high_lat"))))).withColumn("column", F.explode(F.sequence(column(F.col("low_lon")), column(F.col("high_lon")))))
    hit = points.alias("p").join(boxes.alias("e"), same("p", "e", "row", "column") & (F.col("p.ring") != F.col("e.ring")) & lon.between(F.col("e.low_lon"), F.col("e.high_lon")) & lat.between(F.col("e.low_lat"), F.col("e.high_lat")))
    hit = stored(hit.select(F.col(f"p.{key}").alias("_key"), F.col("p.first").alias("first"), F.col("e.path").alias("path")))
    nested = hit.where(point_in_ring("first.lon", "first.lat", F.col("path"), True)).select("_key", F.lit(4).alias("rank"))
    return found.unionByName(nested).unionByName(outside).groupBy("_key").agg(F.min("rank").alias("_worst"))


def validated(polygons: DataFrame, key: str = "feature_id") -> tuple[DataFrame, DataFrame]:
    """(valid, rejects with reason) of polygons (key, parts). In this order: vertices in range (`coordinates`),
    four of them at least (`vertices`), rings closed (`open ring`), not once round the globe (`round the globe`)
    and with an area beyond rounding (`no area`); edges of a ring meet at their joint ends only (`edges meet`), those of two
    rings of a polygon nowhere (`rings meet`); holes lie in the exterior (`hole outside`), and not in each other
    (`nested holes`). Polygons of one feature are not compared.

    All pairs of edges of a feature with ROW_EDGES at most are looked at in its row, and nothing is shuffled. Of larger ones
    edges are dealt over the cells of a lattice on their polygon, some sixteen times as many as it has edges, and meet within
    a cell; a hole's first vertex meets the exterior's edges in its row of cells, and other holes whose box
    holds it. No ring is compared with another one wholly, and a polygon of many edges is many keys."""
    rings = F.flatten("parts")
    turned = lambda r: F.aggregate(pairs(r), F.lit(0.0), lambda acc, s: acc + longitude_delta(s["a"]["lon"], s["b"]["lon"]))
    reason = F.when(F.exists(F.flatten(rings), lambda p: ~F.coalesce(valid_vertex(p), F.lit(False))), "coordinates")
    reason = reason.when(F.exists(rings, lambda r: (F.size(r) < 4)), "vertices").when(F.exists(rings, lambda r: r[0] != F.try_element_at(r, F.lit(-1))), "open ring")
    reason = reason.when(F.exists(rings, lambda r: F.abs(turned(r)) > 1e-9), "round the globe").when(F.exists(rings, without_area), "no area")
    few = F.coalesce(F.aggregate(rings, F.lit(0), lambda acc, r: acc + F.size(r)) <= ROW_EDGES, F.lit(True))
    rank = F.array_min(F.transform(F.filter("parts", lambda p: F.size(p) > 0), _rank))
    simple = polygons.withColumn("reason", reason).withColumn("_few", few)
    simple = stored(simple.withColumn("rank", F.when(F.col("reason").isNull() & F.col("_few"), rank)))
    named = F.lit(None).cast("string")
    for at, name in enumerate(("edges meet", "rings meet", "hole outside", "nested holes"), 1):
        named = F.when(F.col("rank") == at, name).otherwise(named)
    large = simple.where("reason IS NULL AND NOT _few")
    if large.isEmpty():
        out = simple
    else:
        out = simple.join(_ranked(large, key), F.col(key) == F.col("_key"), "left").withColumn("rank", F.coalesce("rank", "_worst")).drop("_key", "_worst")
    out = out.withColumn("reason", F.coalesce("reason", named)).drop("rank", "_few")
    return out.where("reason IS NULL").drop("reason"), out.where("reason IS NOT NULL")


def pin_areas(pins: DataFrame, key: str) -> DataFrame:
    """(key, area, pin_ids, reason) of pins (key, pos, pin_id, lon, lat): the square metres inside the ring of
    an area's pins in the order in which they were set, or why it has none: `too few pins` below three, or what
    `validated` finds in the ring (pins that cross when they are joined: `edges meet`)."""
    each = pins.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "pin_id", "lon", "lat"))).alias("_pins"))
    path = F.transform("_pins", lambda p: vertex(p["lon"], p["lat"]))
    ids = F.transform("_pins", lambda p: p["pin_id"]).alias("pin_ids")
    rings = each.select(key, ids, F.array(F.array(F.concat(path, F.slice(path, 1, 1)))).alias("parts"))
    few = rings.where(F.size("pin_ids") < 3).select(key, F.lit(None).cast("double").alias("area"), "pin_ids", F.lit("too few pins").alias("reason"))
    good, bad = validated(rings.where(F.size("pin_ids") >= 3), key)
    measured = good.select(key, ring_area(F.col("parts")[0][0]).alias("area"), "pin_ids", F.lit(None).cast("string").alias("reason"))
    return measured.unionByName(bad.select(key, F.lit(None).cast("double").alias("area"), "pin_ids", "reason")).unionByName(few)
