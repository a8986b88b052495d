"""Roads: clipping to boxes, the driving graph, snapping, shortest paths for many legs at once."""

from __future__ import annotations

import functools
import heapq
import itertools
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import DRIVE_SPEED, distance, phrase_match
from ..functions.geometry import clip_line, pairs, valid_vertex
from ..scratch import Scratch, stored
from .overlay import MARGINS, distances, nearby, overlay
from .places import near_pairs

DRIVABLE = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "living_street", "service")
SNAP_METRES, MOST_EXTENT = 250, 30_000
CELL_DEGREES, LEGS_AT_ONCE = 0.02, 100


def extract_roads(ways: DataFrame, box: tuple[float, float, float, float], classes: tuple[str, ...] = DRIVABLE, name: str | None = None) -> DataFrame:
    """(way_id, name, highway, part, path) of the parts in a box of ways (way_id, tags, geometry) of some
    classes and, if asked for, whose name has a phrase."""
    tag = lambda k: F.element_at("tags", k)
    w = ways.where(tag("highway").isin(*classes) & (F.size("geometry") >= 2))
    if name:
        w = w.where(phrase_match(tag("name"), name))
    parts = w.select("way_id", F.coalesce(tag("name"), F.lit("")).alias("name"), tag("highway").alias("highway"), F.posexplode(clip_line("geometry", box)).alias("part", "path"))
    return parts.withColumn("part", F.col("part") + 1)


def coverage(ways: DataFrame, roads: DataFrame) -> DataFrame:
    """One row: source ways and positions, invalid positions, output parts and positions."""
    bad = F.size(F.filter("geometry", lambda p: ~F.coalesce(valid_vertex(p), F.lit(False))))
    a = ways.agg(F.count("*").alias("source_ways"), F.sum(F.size("geometry")).alias("source_positions"), F.sum(bad).alias("invalid_positions"))
    b = roads.agg(F.count("*").alias("parts"), F.coalesce(F.sum(F.size("path")), F.lit(0)).alias("positions"))
    return a.crossJoin(b)


def first_labels(roads: DataFrame, position: str = "input_pos") -> DataFrame:
    """roads with label: the name on the first road that has it, blank on the others."""
    first = roads.where("name <> ''").groupBy("name").agg(F.min(position).alias(position)).withColumn("label", F.col("name"))
    return roads.join(first, ["name", position], "left").withColumn("label", F.coalesce("label", F.lit("")))


def driving_graph(ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(node_id, lon, lat), edges(src, dst, metres)) of the ways that may be driven; vertices are the
    same within a ten-millionth of a degree, and one-way streets have one direction."""
    tag = lambda k: F.lower(F.coalesce(F.element_at("tags", k), F.lit("")))
    closed = lambda k: tag(k).isin("no", "private")
    w = ways.where(F.element_at("tags", "highway").isin(*DRIVABLE) & ~closed("access") & ~closed("motor_vehicle") & ~closed("motorcar"))
    w = w.select(F.filter("geometry", lambda p: F.coalesce(valid_vertex(p), F.lit(False))).alias("path"), (tag("oneway").isin("yes", "true", "1") | (tag("junction") == "roundabout")).alias("forward"), (tag("oneway") == "-1").alias("backward"))
    node = lambda p: F.struct(F.bround(p["lon"] * 1e7).cast("long").alias("x"), F.bround(p["lat"] * 1e7).cast("long").alias("y"))
    steps = w.select("forward", "backward", F.explode(pairs(F.col("path"))).alias("s")).select("forward", "backward", node(F.col("s.a")).alias("a"), node(F.col("s.b")).alias("b")).where("a <> b")
    place = lambda n: (F.col(f"{n}.x") / 1e7, F.col(f"{n}.y") / 1e7)
    ident = lambda n: F.concat_ws(",", f"{n}.x", f"{n}.y")
    measured = steps.select("forward", "backward", ident("a").alias("a"), ident("b").alias("b"), distance(*place("a"), *place("b")).alias("metres"))
    there = measured.where("NOT backward").select(F.col("a").alias("src"), F.col("b").alias("dst"), "metres")
    back = measured.where("backward OR NOT forward").select(F.col("b").alias("src"), F.col("a").alias("dst"), "metres")
    edges = there.unionByName(back).groupBy("src", "dst").agg(F.min("metres").alias("metres"))
    nodes = steps.select(F.explode(F.array("a", "b")).alias("n")).distinct().select(ident("n").alias("node_id"), *(c.alias(k) for c, k in zip(place("n"), ("lon", "lat"), strict=True)))
    return nodes, edges


def snapped(points: DataFrame, nodes: DataFrame, max_latitude: float | None = None) -> DataFrame:
    """points (point_id, lon, lat) with the nearest node within 250 m (the lowest id among equals)."""
    hit = near_pairs(points.select("point_id", "lon", "lat"), nodes.select("node_id", "lon", "lat"), SNAP_METRES, max_latitude, few=True)
    hit = hit.select(F.col("l.point_id").alias("point_id"), F.col("r.node_id").alias("node_id"), distance("l.lon", "l.lat", "r.lon", "r.lat").alias("metres")).where(F.col("metres") <= SNAP_METRES)
    return hit.groupBy("point_id").agg(F.min(F.struct("metres", "node_id")).alias("m")).select("point_id", "m.node_id", "m.metres")


def grid_cell(node: Column) -> Column:
    """The cell, two hundredths of a degree wide, of a node of driving_graph."""
    at = lambda k: F.floor(F.element_at(F.split(node, ","), k).cast("long") / (CELL_DEGREES * 1e7))
    return F.concat_ws(",", at(1), at(2))


def grid_place(node: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a node of driving_graph."""
    at = lambda k: F.element_at(F.split(node, ","), k).cast("long") / 1e7
    return at(1), at(2)


def _settle(state: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """What falls when the nodes of one cell whose distance fell are relaxed, for each leg: nodes of the cell,
    relaxed in their turn, and nodes next to it, which are open. Distances beyond the leg's goal don't count."""
    out_of, fallen = {}, []
    for src, dst, metres, cell in edges[["src", "dst", "metres", "dst_cell"]].itertuples(index=False):
        out_of.setdefault(src, []).append((dst, metres, cell))
    for leg, rows in state.groupby("leg_id", sort=False):
        goal, here, limit = rows["goal"].iat[0], rows["cell"].iat[0], rows["limit"].iat[0]
        limit = math.inf if pd.isna(limit) else limit
        known = {n: (m, b, p) for n, m, b, p in rows[["node", "metres", "before", "prev"]].itertuples(index=False)}
        queue = [(m, n) for n, m, fell in rows[["node", "metres", "fell"]].itertuples(index=False) if fell]
        heapq.heapify(queue)
        changed = {}
        while queue:
            metres, node = heapq.heappop(queue)
            if metres > known[node][0] or metres >= limit:
                continue
            for dst, step, cell in out_of.get(node, ()):
                offer, inside = (metres + step, metres, node), cell == here
                old = known.get(dst)
                if offer[0] > limit or (old is not None and offer >= old):
                    continue
                known[dst], changed[dst] = offer, cell
                if inside and (old is None or offer[0] < old[0]):
                    heapq.heappush(queue, (offer[0], dst))
                if dst == goal:
                    limit = min(limit, offer[0])
        fallen += [(leg, n, cell, *known[n], goal, cell != here) for n, cell in changed.items()]
    return pd.DataFrame(fallen, columns=["leg_id", "node", "cell", "metres", "before", "prev", "goal", "open"])


def _walk_back(tips: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
    """The part of one leg's path inside a cell that ends at the tip, and the node before it ('' at the start)."""
    if not len(tips):
        return pd.DataFrame({"leg_id": [], "nodes": [], "tip": []})
    prev, nodes = dict(zip(best["node"], best["prev"], strict=True)), [tips["tip"].iat[0]]
    while prev.get(nodes[-1]):
        nodes.append(prev[nodes[-1]])
    outside = nodes.pop() if nodes[-1] not in prev else ""
    return pd.DataFrame({"leg_id": tips["leg_id"].iloc[:1], "nodes": [nodes[::-1]], "tip": [outside]})


def shortest_paths(edges: DataFrame, legs: DataFrame, cell: Callable[[Column], Column] = lambda node: node, with_path: bool = True) -> DataFrame:
    """(leg_id, metres, path, examined) of legs (leg_id, start, goal), all at once. Nodes lie in cells, each
    node in its own unless told otherwise; a round takes every (cell, leg) that an open node lies in, relaxes
    the cell's nodes there, and writes only the distances that fell. So there are as many rounds as cells on
    the way, not edges; a leg goes no further than its goal's distance; and a cell that many legs cross is
    dealt to as many tasks as it has hundreds of legs. Of equal distances the predecessor settled first counts:
    the nearer one, then the lower. Legs without a way are left out. Without with_path there is no path."""
    spark = edges.sparkSession
    scratch = Scratch(spark)
    e = scratch.written(edges.select("src", "dst", "metres", cell(F.col("src")).alias("cell"), cell(F.col("dst")).alias("dst_cell")), "edges")
    first = legs.select("leg_id", F.col("start").alias("node"), cell(F.col("start")).alias("cell"), F.lit(0.0).alias("metres"), F.lit(-1.0).alias("before"), F.lit("").alias("prev"), "goal", F.lit(True).alias("open"))
    columns = [f.name for f in first.schema]
    kind = ", ".join(f"{c} {first.schema[c].dataType.simpleString()}" for c in columns)
    numbered = lambda n: spark.read.schema(kind).parquet(scratch.path(f"fallen-{n}")).withColumn("round", F.lit(n))
    scratch.written(first, "fallen-0")
    everything = newest = numbered(0)
    for n in itertools.count(1):
        limits = everything.where("node = goal").groupBy("leg_id").agg(F.min("metres").alias("limit"))
        active = newest.where("open").select("leg_id", "cell").distinct()
        state = everything.join(active, ["leg_id", "cell"], "left_semi").groupBy("leg_id", "cell", "node", "goal").agg(F.min(F.struct("metres", "before", "prev", "round", "open")).alias("v"))
        state = state.select("leg_id", "cell", "node", "goal", "v.metres", "v.before", "v.prev", (F.col("v.open") & (F.col("v.round") == n - 1)).alias("fell")).join(limits, "leg_id", "left")
        parts = active.groupBy("cell").agg(F.ceil(F.count("*") / LEGS_AT_ONCE).alias("parts"))
        dealt = state.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("leg_id"), "parts")).drop("parts")
        roads = e.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        fallen = dealt.groupBy("cell", "part").cogroup(roads.groupBy("cell", "part")).applyInPandas(_settle, kind)
        scratch.written(fallen, f"fallen-{n}")
        newest = numbered(n)
        if newest.isEmpty():
            break
        everything = everything.unionByName(newest)
    best = scratch.written(everything.groupBy("leg_id", "cell", "node", "goal").agg(F.min(F.struct("metres", "before", "prev")).alias("v")).select("leg_id", "cell", "node", "goal", "v.metres", "v.prev"), "best")
    scratch.remove(*(f"fallen-{k}" for k in range(n + 1)))
    ends = best.where("node = goal").select("leg_id", F.col("metres").alias("total"), "goal")
    settled = best.drop("goal").join(ends, "leg_id").where(F.struct("metres", "node") < F.struct("total", "goal")).select("leg_id", F.col("node").alias("src"))
    examined = settled.join(e.select("src"), "src").groupBy("leg_id").agg(F.count("*").alias("examined"))
    found = ends.join(examined, "leg_id", "left").select("leg_id", F.col("total").alias("metres"), F.coalesce("examined", F.lit(0)).alias("examined"))
    if not with_path:
        return found
    leg = first.schema["leg_id"].dataType.simpleString()
    tips, walked = ends.select("leg_id", F.col("goal").alias("tip")), None
    for n in itertools.count():
        tips = tips.select(F.col("leg_id").alias("leg_id"), "tip", cell(F.col("tip")).alias("cell"))
        near = best.join(tips, ["leg_id", "cell"], "left_semi").select("leg_id", "cell", "node", "prev")
        part = tips.groupBy("leg_id", "cell").cogroup(near.groupBy("leg_id", "cell")).applyInPandas(_walk_back, f"leg_id {leg}, nodes array<string>, tip string")
        part = scratch.written(part, f"walked-{n}")
        walked = part.select("leg_id", F.lit(-n).alias("at"), "nodes") if walked is None else walked.unionByName(part.select("leg_id", F.lit(-n).alias("at"), "nodes"))
        tips = part.where("tip <> ''").select("leg_id", "tip")
        if tips.isEmpty():
            break
    paths = walked.groupBy("leg_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "nodes"))), lambda x: x["nodes"])).alias("path"))
    return found.join(paths, "leg_id").select("leg_id", "metres", "path", "examined")


def _driven(edges: DataFrame, legs: DataFrame) -> DataFrame:
    """(leg_id, metres) of legs (leg_id, start, goal) that have a way: by regions, those left by the overlay."""
    found = []
    for margin in MARGINS:
        near = stored(nearby(edges, legs, grid_place, margin))
        found.append(near.where("sure AND metres IS NOT NULL").select("leg_id", "metres"))
        legs = near.where("NOT sure").drop("sure")
        if legs.isEmpty():
            break
    else:
        found.append(distances(overlay(edges, grid_cell), legs, grid_place))
    return functools.reduce(DataFrame.unionByName, found)


def routes(waypoints: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(route_id, metres, seconds, legs) of waypoints (route_id, pos, lon, lat): consecutive waypoints are
    snapped and joined by shortest paths, with the ways to and from the graph. Routes with a leg that can't
    be driven, with fewer than two different points, or over 30 km across, are left out."""
    from pyspark.sql import Window

    order = Window.partitionBy("route_id").orderBy("pos")  # 2 to 50 points a route
    w = waypoints.withColumn("point_id", F.concat_ws(":", "route_id", "pos"))
    pts = w.join(snapped(w, nodes), "point_id", "left")
    legs = pts.select("route_id", "pos", F.col("node_id").alias("start"), F.col("metres").alias("from_metres"), F.lead("node_id").over(order).alias("goal"), F.lead("metres").over(order).alias("to_metres"), F.lead("pos").over(order).alias("next"), "lon", "lat", F.lead("lon").over(order).alias("lon2"), F.lead("lat").over(order).alias("lat2")).where("next IS NOT NULL").withColumn("leg_id", F.concat_ws(":", "route_id", "pos"))
    legs = stored(legs)
    j = legs.join(_driven(edges, legs.where("start IS NOT NULL AND goal IS NOT NULL")), "leg_id", "left")
    total = F.sum(F.col("metres") + F.col("from_metres") + F.col("to_metres"))
    out = j.groupBy("route_id").agg(total.alias("metres"), F.count("*").alias("legs"), F.count("metres").alias("found"), F.max(distance("lon", "lat", "lon2", "lat2")).alias("across"), F.max((F.col("lon") != F.col("lon2")) | (F.col("lat") != F.col("lat2"))).alias("moves"))
    return out.where((F.col("found") == F.col("legs")) & F.col("moves") & (F.col("across") <= MOST_EXTENT)).select("route_id", "metres", (F.col("metres") / DRIVE_SPEED).alias("seconds"), "legs")
