"""Analytics of a layer of features: typing of fields, filters, statistics, histograms, frequencies,
density grids, hotspots, weights, extents. Layers are DataFrames with a feature_id, lon and lat (or
parts), and value columns; small results that all rows need (extents, minima) are single rows, which are
broadcast."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import longitude_near, normal_time, strict_number, wrap_longitude
from ..functions.geometry import pairs, representative, vertices
from ..scratch import stored

#: Ways to show a layer, besides surfaces and contours.
MODES = ("points", "density", "heatmap", "choropleth", "extrusion", "flow", "tactical")
#: Fields that an inventory names.
LISTED_FIELDS = 16
#: Up to so many requests are sent to all tasks.
ASKED = 10_000

# Fields


def _profiled(features: DataFrame, properties: str, any_numeric: bool, *by: str) -> DataFrame:
    """(by, key, numeric, temporal, first_time, last_time) of a map<string,string> column."""
    cells = features.select(*by, F.explode(F.map_entries(properties)).alias("e")).select(*by, "e.key", "e.value").where("value IS NOT NULL AND trim(value) <> ''")
    is_year = F.regexp_like("key", F.lit(r"(?i)(?:^|[_\s-])year(?:$|[_\s-])|year$"))
    time = F.when(is_year, normal_time("value", "year")).otherwise(normal_time("value", "time"))
    numeric = F.bool_or if any_numeric else F.bool_and
    return cells.groupBy(*by, "key").agg(numeric(strict_number("value").isNotNull()).alias("numeric"), F.bool_and(time.isNotNull()).alias("temporal"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def profile_fields(features: DataFrame, properties: str = "props", any_numeric: bool = False) -> DataFrame:
    """(key, numeric, temporal, categorical) of a map<string,string> column, over all rows. Numeric and
    temporal need every value that isn't missing; with any_numeric one number is enough."""
    per = _profiled(features, properties, any_numeric).select("key", "numeric", "temporal")
    return per.withColumn("categorical", ~F.col("numeric") & ~F.col("temporal"))


def time_values(features: DataFrame, field: str) -> DataFrame:
    """Distinct normalised times, in order."""
    return features.select(normal_time(field, field).alias("time")).where("time IS NOT NULL").distinct().orderBy("time")


def one_time_or(features: DataFrame, field: str, chosen: str | None) -> DataFrame:
    """The rows of the chosen time; a layer with several times needs a choice."""
    if chosen is None:
        found = time_values(features, field).limit(2).collect()
        if len(found) > 1:
            raise ValueError(f"{field} has several times; choose one")
        return features
    return features.where(normal_time(field, field) == normal_time(F.lit(chosen), field))


# Filters


def number_range(features: DataFrame, field: str, low: float | None = None, high: float | None = None, text: bool = False) -> DataFrame:
    """Rows whose field is a number within the bounds; without bounds all rows stay."""
    if low is None and high is None:
        return features
    if low is not None and high is not None and low > high:
        raise ValueError("the minimum exceeds the maximum")
    value = strict_number(field) if text else F.col(field).cast("double")
    if not features.where(value.isNotNull()).limit(1).count():
        raise ValueError(f"{field} has no numbers")
    keep = value.isNotNull()
    if low is not None:
        keep &= value >= low
    if high is not None:
        keep &= value <= high
    return features.where(keep)


def typed_equal(column: str, value: bool | float | str) -> Column:
    """A variant equals a JSON scalar in type and value: false, "false" and 0 differ."""
    v = F.col(column)
    kind = F.schema_of_variant(v)
    if isinstance(value, bool):
        return F.coalesce((kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == value), F.lit(False))
    if isinstance(value, (int, float)):
        return F.coalesce(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)") & (F.try_variant_get(v, "$", "double") == float(value)), F.lit(False))
    return F.coalesce((kind == "STRING") & (F.try_variant_get(v, "$", "string") == value), F.lit(False))


def typed_compare(column: str, op: str, value: bool | float | str) -> Column:
    """eq, neq, gt, gte, lt, lte against a variant; an absent one never holds, ordered ones need numbers."""
    v = F.col(column)
    there = v.isNotNull() & (F.schema_of_variant(v) != "VOID")
    if op in ("eq", "neq"):
        same = typed_equal(column, value)
        return there & (same if op == "eq" else ~same)
    number = F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, "$", "double"))
    test = {"gt": number > value, "gte": number >= value, "lt": number < value, "lte": number <= value}[op]
    return F.coalesce(test, F.lit(False))


def boxes_of(*boxes: tuple[float, float, float, float] | None) -> list[tuple[float, float, float, float]] | None:
    """The pieces of the intersection of boxes, each of which may wrap; None without boxes."""
    out = None
    for box in boxes:
        if box is None:
            continue
        w, s, e, n = map(float, box)
        pieces = [(w, s, e, n)] if w <= e else [(w, s, 180.0, n), (-180.0, s, e, n)]
        if out is None:
            out = pieces
            continue
        shifted = [(a, (b[0] + d, b[1], b[2] + d, b[3])) for a in out for b in pieces for d in (-360.0, 0.0, 360.0)]
        cut = [(max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])) for a, b in shifted]
        out = [c for c in cut if c[0] <= c[2] and c[1] <= c[3]]
    return out


def in_boxes(features: DataFrame, *boxes, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points in the intersection of the boxes."""
    pieces = boxes_of(*boxes)
    if pieces is None:
        return features
    keep = F.lit(False)
    for w, s, e, n in pieces:
        keep |= F.col(lon).between(w, e) & F.col(lat).between(s, n)
    return features.where(keep)


def contained(inner: tuple[Column, Column, Column, Column], outer: tuple[float, float, float, float]) -> Column:
    """A box lies in another one, longitudes taken modulo a turn. Each end is compared with the outer box
    moved by its turns, as differences of longitudes lose the digits that tell an end on the boundary."""
    w, s, e, n = inner
    ow, os_, oe, on = map(float, outer)
    whole = F.lit(oe - ow >= 360)
    while oe < ow:
        oe += 360

    def turn(x: Column) -> Column:
        k = F.floor((x - ow) / 360)
        return F.coalesce(*(F.when(x.between(ow + (k + d) * 360, oe + (k + d) * 360), k + d) for d in (0, 1, -1)))

    in_order = F.coalesce(e - turn(e) * 360 >= w - turn(w) * 360 - 1e-9, F.lit(False))
    return (s >= os_) & (n <= on) & (whole | F.when(w.isNotNull() & e.isNotNull(), in_order))


# Statistics


#: A range of so many distinct values is ordered by one task; larger ones are cut into so many parts first.
RANGE_VALUES, RANGE_PARTS = 50_000, 200


def values_of_ranks(rows: DataFrame, value: Column, *ranks: int) -> list[float]:
    """The values of the given ranks (from 1, in rising order) among those that aren't null. Values are
    counted in ranges, and in ranges of the one that a rank falls into, until few distinct ones are left, so
    that no task orders many, however they are spread."""
    counts = stored(rows.select(value.alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("c")))
    out = []
    for rank in ranks:
        part, before = counts, 0
        while True:
            low, high, n = part.agg(F.min("v"), F.max("v"), F.count("*")).first()
            width = high / RANGE_PARTS - low / RANGE_PARTS
            if n <= RANGE_VALUES or not width > 0:
                break
            place = F.least(F.lit(RANGE_PARTS - 1), F.floor(F.col("v") / width - low / width)).cast("int")
            sizes = {r[0]: r[1] for r in part.groupBy(place.alias("p")).agg(F.sum("c")).collect()}
            for chosen in sorted(sizes):
                if before + sizes[chosen] >= rank:
                    break
                before += sizes[chosen]
            part = part.where(place == chosen)
        for v, c in sorted((r["v"], r["c"]) for r in part.collect()):
            before += c
            if before >= rank:
                out.append(v)
                break
    return out


def summary(features: DataFrame, field: str) -> DataFrame:
    """One row: count, valid_count, min, median, max, mean, sum. Sums are of values divided by the largest
    magnitude, so that they overflow only if the result does; an overflowing sum is null."""
    v = F.col(field).cast("double")
    v = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    ends = features.agg(F.max(F.abs(v)), F.count(v)).first()
    scale, n = ends[0] or 1.0, ends[1]
    middle = values_of_ranks(features, v, *sorted({(n + 1) // 2, n // 2 + 1})) if n else []
    median = F.lit(sum(m / len(middle) for m in middle) if middle else None).cast("double")
    total = F.sum(F.col("_v") / scale)
    out = features.select(v.alias("_v")).agg(F.count("*").alias("count"), F.count("_v").alias("valid_count"), F.min("_v").alias("min"), F.max("_v").alias("max"), (total / F.count("_v") * scale).alias("mean"), (total * scale).alias("sum"))
    out = out.withColumn("sum", F.when(F.abs("sum") < float("inf"), F.col("sum")))
    return out.select("count", "valid_count", "min", median.alias("median"), "max", "mean", "sum")


def histogram(features: DataFrame, field: str, most: int = 10) -> DataFrame:
    """(bin, low, high, count): as many bins as the root of the count, at most `most`, one for a constant;
    empty bins are rows too."""
    v = F.col(field).cast("double")
    ends = F.broadcast(features.where(v.isNotNull()).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count("*").alias("n")))
    ends = ends.where("n > 0").withColumn("bins", F.when(F.col("lo") == F.col("hi"), 1).otherwise(F.least(F.lit(most), F.ceil(F.sqrt("n")))).cast("int"))
    share = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise((v - F.col("lo")) / (F.col("hi") - F.col("lo")))
    counted = features.where(v.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.least(F.col("bins") - 1, F.floor(share * F.col("bins"))).cast("int").alias("bin")).agg(F.count("*").alias("count"))
    rows = ends.select("lo", "hi", "bins", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    edge = lambda k: F.col("lo") * (1 - k / F.col("bins")) + F.col("hi") * (k / F.col("bins"))
    return rows.join(counted, "bin", "left").select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


def frequencies(features: DataFrame, field: str) -> DataFrame:
    """(value, count) of the values that aren't missing, in text order."""
    v = F.col(field)
    return features.where(v.isNotNull() & (F.trim(v.cast("string")) != "")).groupBy(v.alias("value")).agg(F.count("*").alias("count")).orderBy(F.col("value").cast("string"))


def hotspots(features: DataFrame, field: str, share: float = 0.9) -> DataFrame:
    """Rows at or above the value of rank floor((n - 1) * share) from below."""
    v = F.col(field).cast("double")
    rows = features.where(v.isNotNull())
    n = rows.count()
    return rows.where(v >= values_of_ranks(rows, v, int((n - 1) * share) + 1)[0]) if n else rows


def average_duplicates(points: DataFrame, field: str) -> DataFrame:
    """One row for each position, with the mean of its values."""
    return points.where(F.col(field).isNotNull()).groupBy("lon", "lat").agg(F.avg(field).alias(field))


# Extents and grids


def extent(arcs: DataFrame, *by: str) -> DataFrame:
    """One row (by, west, south, east, north), or one for each group, of rows (by, a, b, lat): segments from
    longitude a to b the short way.
    The longitudes are the complement of the largest gap between arcs, so that a layer across the
    antimeridian stays narrow. Arcs are merged by millionths of a degree (about a tenth of a metre, below
    which gaps don't count), those within hundredths, and these with what reaches them from the west: what one
    task orders is 36 001 rows of a group at most."""
    d = F.col("b") - F.col("a")
    end = F.col("a") + F.when(F.abs(d) == 360, d).when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)
    length = F.abs(end - F.col("a"))
    start = wrap_longitude(F.least(F.col("a"), end)) + 180
    pieces = F.when(length >= 360, F.array(F.struct(F.lit(0.0).alias("s"), F.lit(360.0).alias("e"))))
    pieces = pieces.when(start + length <= 360, F.array(F.struct(start.alias("s"), (start + length).alias("e"))))
    pieces = pieces.otherwise(F.array(F.struct(start.alias("s"), F.lit(360.0).alias("e")), F.struct(F.lit(0.0).alias("s"), (start + length - 360).alias("e"))))
    spans = arcs.select(*by, F.explode(pieces).alias("p")).select(*by, "p.s", "p.e")
    fine = spans.groupBy(*by, F.floor(F.col("s") * 1e6).alias("f")).agg(F.min("s").alias("s"), F.max("e").alias("e")).withColumn("cell", F.floor(F.col("f") / 10_000))
    fine = stored(fine)
    coarse = fine.groupBy(*by, "cell").agg(F.max("e").alias("e")).withColumn("_one", F.lit(1))
    west = coarse.select(*by, "cell", F.max("e").over(Window.partitionBy("_one", *by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    within = Window.partitionBy(*by, "cell").orderBy("f").rowsBetween(Window.unboundedPreceding, -1)
    reached = fine.join(west if by else F.broadcast(west), [*by, "cell"]).select(*by, "s", F.greatest("before", F.max("e").over(within)).alias("e"))
    around = fine.groupBy(*by).agg(F.max("e").alias("e"), (F.min("s") + 360).alias("s")).where("s IS NOT NULL")
    gaps = reached.where("s > e").unionByName(around.select(*by, "s", "e")).select(*by, (F.col("s") - F.col("e")).alias("gap"), "e", F.col("s").alias("next"))
    best = gaps.groupBy(*by).agg(F.max(F.struct("gap", (-F.col("e")).alias("k"), "next", "e")).alias("g"))
    lats = arcs.groupBy(*by).agg(F.min("lat").alias("south"), F.max("lat").alias("north"))
    wide = F.col("g.gap") <= 1e-10
    met = best.join(lats, list(by)) if by else best.crossJoin(lats)
    return met.where("g IS NOT NULL").select(*by, F.when(wide, -180.0).otherwise(wrap_longitude(F.col("g.next") - 180)).alias("west"), "south", F.when(wide, 180.0).otherwise(wrap_longitude(F.col("g.e") - 180)).alias("east"), "north")


def plain_extent(points: DataFrame) -> DataFrame:
    return points.agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


def density_grid(points: DataFrame, bounds: DataFrame | None = None, most: int = 24) -> DataFrame:
    """(row, col, count, west, south, east, north): square cells over the extent, at most `most` a side;
    counts distinct features. The count is pre-aggregated by (cell, feature), so a hot cell is no group."""
    bounds = plain_extent(points) if bounds is None else bounds
    b = bounds.where("west IS NOT NULL")
    width = F.when(F.col("east") < F.col("west"), F.col("east") + 360 - F.col("west")).otherwise(F.col("east") - F.col("west"))
    b = b.withColumn("_w", width).withColumn("_step", F.greatest(F.col("_w"), F.col("north") - F.col("south"), F.lit(0.024)) / most)
    b = b.withColumn("_x", F.when(F.col("_w") != 0, F.col("west")).otherwise(F.col("west") - F.col("_step") / 2))
    b = b.withColumn("_y", F.least(90 - F.col("_step"), F.when(F.col("south") == F.col("north"), F.col("south") - F.col("_step") / 2).otherwise(F.col("south"))))
    side = lambda d: F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(d / F.col("_step") - 1e-9))).cast("int")
    b = b.select("_x", "_y", "_step", side(F.col("_w")).alias("_cols"), side(F.col("north") - F.col("_y")).alias("_rows"))
    p = points.crossJoin(F.broadcast(b))
    x = longitude_near("lon", F.col("_x") + F.col("_cols") * F.col("_step") / 2) - F.col("_x")
    cut = lambda v, n: F.least(F.col(n) - 1, F.greatest(F.lit(0), F.floor(v / F.col("_step")))).cast("int")
    cells = p.select("feature_id", cut(F.col("lat") - F.col("_y"), "_rows").alias("row"), cut(x, "_cols").alias("col"))
    counts = cells.groupBy("row", "col", "feature_id").agg(F.lit(1).alias("_1")).groupBy("row", "col").agg(F.count("*").alias("count"))
    g = counts.crossJoin(F.broadcast(b))
    return g.select("row", "col", "count", (F.col("_x") + F.col("col") * F.col("_step")).alias("west"), F.greatest(F.lit(-90.0), F.col("_y") + F.col("row") * F.col("_step")).alias("south"), (F.col("_x") + (F.col("col") + 1) * F.col("_step")).alias("east"), F.least(F.lit(90.0), F.col("_y") + (F.col("row") + 1) * F.col("_step")).alias("north"))


def weights(features: DataFrame, field: str, metres: bool = False) -> DataFrame:
    """features with weight (0..1 between the extremes, 0.5 for a constant), heat_weight and height."""
    v = F.col(field).cast("double")
    ends = F.broadcast(features.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi")))
    scale = F.coalesce(F.nullif(F.greatest(F.abs("_lo"), F.abs("_hi")), F.lit(0.0)), F.lit(1.0))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v / scale - F.col("_lo") / scale) / (F.col("_hi") / scale - F.col("_lo") / scale)))
    weight = F.when(F.col("_lo") == F.col("_hi"), 0.5).otherwise(share)
    heat = F.when(F.col("_lo") >= 0, F.when(F.col("_hi") > 0, v / F.col("_hi")).otherwise(0.0)).otherwise(weight)
    height = F.greatest(F.lit(0.0), v) if metres else weight * 1500
    return features.crossJoin(ends).withColumns({"weight": weight, "heat_weight": heat, "height": height}).drop("_lo", "_hi")


def category_codes(features: DataFrame, field: str, palette: int) -> DataFrame:
    """(value, code): distinct values of the whole layer, of any type, in the order of their JSON text,
    numbered modulo the palette. Values are dealt to tasks by ranges of that text, and numbered from the number
    of values in the ranges before."""
    values = features.where(F.col(field).isNotNull()).select(F.col(field).alias("value")).distinct()
    whole = F.to_json(F.struct(F.col("value").alias("v")))
    text = F.substr(whole, F.lit(6), F.char_length(whole) - 6)
    dealt = values.withColumn("_text", text).repartitionByRange("_text").sortWithinPartitions("_text")
    # The number of a row in its range, and the range, as they are written: they stay.
    ranked = stored(dealt.select("value", F.monotonically_increasing_id().alias("_k")))
    ranked = ranked.select("value", F.shiftright("_k", 33).alias("_range"), F.col("_k").bitwiseAND(F.lit((1 << 33) - 1)).alias("_k"))
    sizes = ranked.groupBy("_range").agg(F.count("*").alias("n")).withColumn("_one", F.lit(1))
    before = sizes.select("_range", (F.sum("n").over(Window.partitionBy("_one").orderBy("_range")) - F.col("n")).alias("_before"))
    return ranked.join(F.broadcast(before), "_range").select("value", F.pmod(F.col("_before") + F.col("_k"), F.lit(palette)).cast("int").alias("code"))


def inventory(features: DataFrame) -> DataFrame:
    """(dataset_id, feature_count, geometry_types, extent) of many layers at once; rows have dataset_id,
    geom_type, lon, lat."""
    return features.groupBy("dataset_id").agg(F.count("*").alias("feature_count"), F.array_join(F.array_sort(F.collect_set("geom_type")), ",").alias("geometry_types"), F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


def _shape(*kinds: str) -> Column:
    return F.col("geom_type").isin(*kinds, *(f"Multi{k}" for k in kinds))


def layer_mode(features: DataFrame, mode: str, field: str | None = None, metres: bool = False) -> tuple[DataFrame, DataFrame]:
    """(shown, legend) of a filtered layer (feature_id, geom_type, parts and, if there is a field, its numbers as
    value, null where missing) in one of MODES.

    points, heatmap, tactical: a point for each geometry's representative (of a MultiPoint all). choropleth and
    extrusion: polygons; where the layer has none, counts of its points in grid cells. flow: lines. density:
    counts of all representatives in grid cells. Features of other geometry are left out and counted, as are
    those without a value, never taken as 0; without a field the value is 1. Cells don't encode the field.

    shown has value, weight, heat_weight and height (extrusions of polygons by a field in metres have their own);
    legend is one row: mode, geometry_type, title, unit (`features`, `features/cell`, or null for the layer's
    own), input_count, incompatible, missing, shown, min, mid, max, and caveats, an array of: `grid counts`,
    `field not encoded`, `incompatible geometry`, `missing values`, `index height` or `metre height`, `scaled by
    maximum` or `relative weights`, `given lines only`, `nothing shown`, `constant`.
    Flow without a line, and polygon modes without a polygon or point, are errors, as in no mode are invented."""
    if mode not in MODES:
        raise ValueError(f"unsupported mode {mode}")
    points, polygons, lines = _shape("Point"), _shape("Polygon"), _shape("LineString")
    has = features.agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in (("point", points), ("polygon", polygons), ("line", lines)))).first()
    areal = mode in ("choropleth", "extrusion")
    if mode == "flow" and not has.line:
        raise ValueError("flow needs lines")
    if areal and not has.polygon and not has.point:
        raise ValueError(f"{mode} needs polygons, or points to count")
    grid = mode == "density" or areal and not has.polygon
    fits = (points if grid else polygons) if areal else lines if mode == "flow" else F.lit(True)
    valued = grid or field is None
    marked = features.withColumns({"_fits": F.coalesce(fits, F.lit(False)), "value": F.lit(1.0) if valued else F.col("value").cast("double")})
    counts = marked.agg(F.count("*").alias("input_count"), F.count_if(~F.col("_fits")).alias("incompatible"), F.count_if(F.col("_fits") & F.col("value").isNull()).alias("missing"))
    kept = marked.where("_fits AND value IS NOT NULL").drop("_fits")
    if areal and not grid or mode == "flow":
        shapes, kind = kept, "LineString" if mode == "flow" else "Polygon"
    else:
        places = F.when(F.col("geom_type") == "MultiPoint", vertices("parts")).otherwise(F.array(representative("geom_type", "parts")))
        at = kept.select("feature_id", "value", F.explode(places).alias("p")).where("p IS NOT NULL").select("feature_id", "value", "p.lon", "p.lat")
        shapes, kind = (density_grid(at).withColumn("value", F.col("count").cast("double")), "Polygon") if grid else (at, "Point")
    own = metres and mode == "extrusion" and not grid and field is not None
    shown = weights(stored(shapes), "value", own)
    ends = shown.agg(F.count("*").alias("shown"), F.min("value").alias("min"), F.max("value").alias("max"))
    low, high = F.col("min"), F.col("max")
    said = {
        "grid counts": F.lit(grid), "field not encoded": F.lit(grid and field is not None), "incompatible geometry": F.col("incompatible") > 0, "missing values": F.col("missing") > 0, "index height": F.lit(mode == "extrusion" and not own), "metre height": F.lit(own),
        "scaled by maximum": F.lit(mode == "heatmap") & (low >= 0), "relative weights": F.lit(mode == "heatmap") & (low < 0), "given lines only": F.lit(mode == "flow"), "nothing shown": F.col("shown") == 0, "constant": low == high,
    }
    caveats = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in said.items())), lambda x: x.isNotNull())
    title = "Feature count" if valued else field
    unit = "features/cell" if grid else "features" if field is None else None
    legend = counts.crossJoin(ends).select(F.lit(mode).alias("mode"), F.lit(kind).alias("geometry_type"), F.lit(title).alias("title"), F.lit(unit).cast("string").alias("unit"), "input_count", "incompatible", "missing", "shown", "min", ((low + high) / 2).alias("mid"), "max", caveats.alias("caveats"))
    return shown, legend


def layer_inventory(features: DataFrame, matching: Column | None = None) -> DataFrame:
    """(dataset_id, feature_count, matching_count, geometry_types, west, south, east, north, numeric_fields,
    categorical_fields) of many layers at once. features (a row each) have dataset_id, geom_type, parts and props,
    a map of texts; `matching` is the layers' filter. Types are sorted; bounds are narrow over the antimeridian
    and null without a position; fields are the first LISTED_FIELDS, by name, with names of 128 characters at
    most: numeric ones have nothing but numbers, categorical ones are neither those nor times."""
    path = F.flatten("parts")
    lines = F.when(F.col("geom_type").isin("Point", "MultiPoint"), F.array().cast("array<array<struct<a:double,b:double,lat:double>>>")).otherwise(F.transform(path, lambda r: F.transform(pairs(r), lambda s: F.struct(s["a"]["lon"].alias("a"), s["b"]["lon"].alias("b"), s["a"]["lat"].alias("lat")))))
    points = F.transform(F.flatten(path), lambda p: F.struct(p["lon"].alias("a"), p["lon"].alias("b"), p["lat"].alias("lat")))
    arcs = features.select("dataset_id", F.explode(F.concat(points, F.flatten(lines))).alias("s")).select("dataset_id", "s.a", "s.b", "s.lat")
    counts = features.groupBy("dataset_id").agg(F.count("*").alias("feature_count"), F.count_if(F.coalesce(matching, F.lit(False)) if matching is not None else F.lit(True)).alias("matching_count"), F.array_sort(F.collect_set("geom_type")).alias("geometry_types"))
    short = F.char_length("key") <= 128
    first = lambda ok: F.slice(F.array_sort(F.collect_list(F.when(short & ok, F.col("key")))), 1, LISTED_FIELDS)
    fields = _profiled(features, "props", False, "dataset_id").groupBy("dataset_id").agg(first(F.col("numeric")).alias("numeric_fields"), first(~F.col("numeric") & ~F.col("temporal")).alias("categorical_fields"))
    none = F.array().cast("array<string>")
    j = counts.join(extent(arcs, "dataset_id"), "dataset_id", "left").join(fields, "dataset_id", "left")
    return j.withColumns({c: F.coalesce(c, none) for c in ("numeric_fields", "categorical_fields")}).select("dataset_id", "feature_count", "matching_count", "geometry_types", "west", "south", "east", "north", "numeric_fields", "categorical_fields")


def gated(features: DataFrame, requests: DataFrame) -> DataFrame:
    """(dataset_id, passed, reason, features, in_scope, shown): whether each dataset can be shown as its request
    asks, and if not, why. features have dataset_id, geom_type, lon, lat and props, a map of texts; requests
    (one for each dataset) dataset_id, visualization, field, west, south, east, north, reference_time and
    population_year, all but the first two nullable. Reasons, of which the first that holds is given:

    `no observations`; `invalid scope` (some sides lack, or lie beyond the map or the wrong way round; west >
    east goes over the date line); `several times` (any field of times has more than one); `no numeric field`
    (the field isn't one, of all the dataset's values); `unknown visualization`; `no field for a heatmap`; `not
    points` (points and heatmaps need nothing but points); `no polygons` (a choropleth needs one); `other year`
    (the one asked for isn't that of the observations); `nothing in scope`; `no value in scope` (no number of
    the field). Scopes are never widened, and missing values aren't 0.

    All datasets at once: fields and features are added up by dataset before they are shuffled, so that a large
    dataset is no task's work."""
    point, polygon = F.col("geom_type") == "Point", F.col("geom_type").isin("Polygon", "MultiPolygon")
    sides = [F.col(c) for c in ("west", "south", "east", "north")]
    given = reduce(or_, (c.isNotNull() for c in sides))
    fine = F.coalesce(reduce(and_, (c.isNotNull() for c in sides)) & sides[0].between(-180, 180) & sides[2].between(-180, 180) & (sides[1] >= -90) & (sides[3] <= 90) & (sides[1] < sides[3]) & (sides[0] != sides[2]), F.lit(False))
    asked = requests.withColumns({"scoped": given, "scope_ok": ~given | fine})
    met = features.select("dataset_id", "geom_type", "lon", "lat", "props").join(F.broadcast(asked) if requests.limit(ASKED + 1).count() <= ASKED else asked, "dataset_id")
    along = F.when(sides[0] <= sides[2], F.col("lon").between(sides[0], sides[2])).otherwise((F.col("lon") >= sides[0]) | (F.col("lon") <= sides[2]))
    inside = ~F.col("scoped") | (F.col("scope_ok") & F.coalesce(along & F.col("lat").between(sides[1], sides[3]), F.lit(False)))
    has_value = F.col("field").isNull() | (F.col("field") == "") | strict_number(F.try_element_at("props", F.col("field"))).isNotNull()
    per = met.groupBy("dataset_id").agg(F.count("*").alias("features"), F.count_if(~F.coalesce(point, F.lit(False))).alias("others"), F.count_if(polygon).alias("polygons"), F.count_if(inside).alias("in_scope"), F.count_if(inside & has_value).alias("shown"))
    fields = _profiled(features, "props", False, "dataset_id")
    several = fields.groupBy("dataset_id").agg(F.bool_or(F.col("temporal") & (F.col("first_time") != F.col("last_time"))).alias("several"), F.collect_set(F.when(F.col("numeric"), F.col("key"))).alias("numeric_fields"))
    j = asked.join(per, "dataset_id", "left").join(several, "dataset_id", "left").fillna(0, ["features", "others", "polygons", "in_scope", "shown"])
    field = F.when(F.col("field") != "", F.col("field"))
    kind, year = F.coalesce("visualization", F.lit("")), F.col("population_year").cast("string")
    reason = F.when(F.col("features") == 0, "no observations").when(~F.col("scope_ok"), "invalid scope").when(F.coalesce("several", F.lit(False)), "several times")
    reason = reason.when(field.isNotNull() & ~F.coalesce(F.array_contains("numeric_fields", field), F.lit(False)), "no numeric field")
    reason = reason.when(~kind.isin("points", "heatmap", "choropleth"), "unknown visualization").when((kind == "heatmap") & field.isNull(), "no field for a heatmap")
    reason = reason.when(kind.isin("points", "heatmap") & (F.col("others") > 0), "not points").when((kind == "choropleth") & (F.col("polygons") == 0), "no polygons")
    reason = reason.when(year.isNotNull() & (F.coalesce(F.substring("reference_time", 1, 4), F.lit("")) != year), "other year")
    reason = reason.when(F.col("in_scope") == 0, "nothing in scope").when(F.col("shown") == 0, "no value in scope")
    return j.select("dataset_id", reason.isNull().alias("passed"), reason.alias("reason"), "features", "in_scope", "shown")


def compared(a: DataFrame, b: DataFrame, field: str, key: str = "feature_id") -> DataFrame:
    """(key, side, delta): which of two versions has a feature, and how its value differs."""
    x, y = a.select(key, F.col(field).alias("_a"), F.lit(True).alias("_in_a")), b.select(key, F.col(field).alias("_b"), F.lit(True).alias("_in_b"))
    side = F.when(F.col("_in_a").isNull(), "b").when(F.col("_in_b").isNull(), "a").otherwise("both")
    return x.join(y, key, "full_outer").select(key, side.alias("side"), (F.col("_b") - F.col("_a")).alias("delta"))
