"""Places: normal records, deduplication, search, ranking, lookup, table joins, boundaries."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import DEDUP_METRES_PER_DEGREE, LOCALITY_WORDS, dedup_distance, distance, name_stem, same_place_name, text_key
from ..functions.inputs import spread
from ..scratch import Scratch
from .crowds import split_keys
from .graphs import connected

# Fixed values that results depend on.
DEDUP_METRES = 35
SETTLEMENTS = ("city", "town", "village", "hamlet", "locality", "isolated_dwelling")
#: Query words, and the tags that they search for; the first row with a word in the query counts.
TAXONOMY = (
    (("coffee", "cafe", "cafes"), (("amenity", "cafe"),)),
    (("restaurant", "restaurants", "food", "dining"), (("amenity", "restaurant"), ("amenity", "fast_food"))),
    (("museum", "museums"), (("tourism", "museum"),)),
    (("park", "parks", "playground"), (("leisure", "park"), ("leisure", "playground"))),
    (("hotel", "hotels", "hostel", "lodging"), (("tourism", "hotel"), ("tourism", "hostel"), ("tourism", "guest_house"))),
    (("pharmacy", "pharmacies"), (("amenity", "pharmacy"),)),
    (("hospital", "hospitals", "clinic", "clinics", "doctor", "doctors"), (("amenity", "hospital"), ("amenity", "clinic"), ("amenity", "doctors"))),
    (("library", "libraries"), (("amenity", "library"),)),
    (("supermarket", "supermarkets", "grocery", "groceries"), (("shop", "supermarket"), ("shop", "convenience"))),
    (("gas", "fuel", "petrol"), (("amenity", "fuel"),)),
    (("bank", "banks", "atm"), (("amenity", "bank"), ("amenity", "atm"))),
    (("attraction", "attractions", "landmark", "landmarks"), (("tourism", "attraction"),)),
)

#: Places of a group that one task decides.
GROUP_PLACES = 200_000


def cell_width(row: Column, step: float) -> Column:
    """Degrees of longitude of the cells of a row of the lattice, at least `step` degrees of latitude wide also
    at the far edge of the row beside it."""
    edge = F.least(F.lit(90.0), (F.greatest(F.abs(row), F.abs(row + 1)) + 1) * step)
    return F.lit(step) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-9))


def near_pairs(left: DataFrame, right: DataFrame, metres: float, max_latitude: float | None = None, also: tuple[str, ...] = (), few: bool = False) -> DataFrame:
    """Pairs (l, r: structs of the rows) whose cells touch: cells have a side of `metres` at least, the right
    side, or the left if its rows are few, takes the nine cells around, and cells are joined by equality, as are the columns of `also`. Cells are as
    wide as their row needs, or all as wide as max_latitude needs where rows are known to lie below it. Crowded
    cells are dealt over tasks. A residual distance is up to the caller."""
    step = metres / 111_320 * 1.001
    wide = lambda row: cell_width(row, step) if max_latitude is None else F.lit(step / max(0.1, math.cos(math.radians(max_latitude))))
    cy = F.floor(F.col("lat") / step)
    cx = lambda row: F.floor(F.col("lon") / wide(row))
    keys = [f"_k{n}" for n in range(len(also))]
    named = [F.col(c).alias(k) for c, k in zip(also, keys, strict=True)]
    own = lambda df, name: df.select(F.struct("*").alias(name), cx(cy).alias("cx"), cy.alias("cy"), *named)
    around = F.explode(F.array(*(F.struct((cx(cy + dy) + dx).alias("cx"), (cy + dy).alias("cy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1))))
    all_nine = lambda df, name: df.select(F.struct("*").alias(name), around.alias("c"), *named).select(name, "c.cx", "c.cy", *keys)
    a, b = (all_nine(left, "l"), own(right, "r")) if few else (own(left, "l"), all_nine(right, "r"))
    a, b = split_keys(a, b, ["cx", "cy", *keys], by=F.xxhash64(F.to_json("l")))
    return a.join(b, ["cx", "cy", *keys, "_split"]).select("l", "r")


def same_places(places: DataFrame, max_latitude: float | None = None) -> DataFrame:
    """(place_id, other_id) of pairs within 35 m whose names say the same, other being earlier in
    (created_at, place_id). Rows need normalized_name."""
    p = places.select("place_id", "normalized_name", "lon", "lat", "created_at", name_stem("normalized_name").alias("stem"))
    pairs = near_pairs(p, p, DEDUP_METRES, max_latitude, ("stem",))
    earlier = F.struct("r.created_at", "r.place_id") < F.struct("l.created_at", "l.place_id")
    close = dedup_distance(F.col("l.lon"), F.col("l.lat"), F.col("r.lon"), F.col("r.lat")) <= DEDUP_METRES
    return pairs.where(earlier & close & same_place_name(F.col("l.normalized_name"), F.col("r.normalized_name"))).select(F.col("l.place_id").alias("place_id"), F.col("r.place_id").alias("other_id"))


class _Chosen:
    """The canonical places of a group so far, by cell and by what they may be called."""

    def __init__(self) -> None:
        self.step, self.cells, self.count = DEDUP_METRES / 111_320 * 1.001, {}, 0

    def _cell(self, lon: float, row: int) -> int:
        edge = min(90.0, (max(abs(row), abs(row + 1)) + 1) * self.step)
        return math.floor(lon / (self.step / max(math.cos(math.radians(edge)), 1e-9)))

    @staticmethod
    def _starts(name: str) -> list[str]:
        """The shorter names that this one goes on from."""
        words = name.split(" ")
        return [" ".join(words[:k]) for k in range(2, len(words)) if words[k] in LOCALITY_WORDS]

    def first(self, name: str, lon: float, lat: float) -> str | None:
        row, best = math.floor(lat / self.step), None
        called = [("is", name), ("from", name), *(("is", n) for n in self._starts(name))]
        for y in (row - 1, row, row + 1):
            x = self._cell(lon, y)
            for cell in ((x - 1, y), (x, y), (x + 1, y)):
                for how in called if cell in self.cells else ():
                    for at, other_lon, other_lat, ident in self.cells[cell].get(how, ()):
                        if best is not None and at > best[0]:
                            break
                        east = (lon - other_lon) * DEDUP_METRES_PER_DEGREE * math.cos(math.radians((lat + other_lat) / 2))
                        if math.hypot((lat - other_lat) * DEDUP_METRES_PER_DEGREE, east) <= DEDUP_METRES:
                            best = (at, ident)
                            break
        return best[1] if best else None

    def add(self, at: int, name: str, lon: float, lat: float, ident: str) -> None:
        row, self.count = math.floor(lat / self.step), self.count + 1
        names = self.cells.setdefault((self._cell(lon, row), row), {})
        for how in [("is", name), *(("from", n) for n in self._starts(name))]:
            names.setdefault(how, []).append((at, lon, lat, ident))


def _greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each group's places, which follow each other in order: the first canonical one that each matches, or
    itself. Batches have many groups, and a group may go on in the next one."""
    chosen, last = _Chosen(), None
    for batch in batches:
        out = []
        for group, ident, name, lon, lat in zip(batch["group"], batch["place_id"], batch["normalized_name"], batch["lon"], batch["lat"], strict=True):
            if group != last:
                chosen, last = _Chosen(), group
            to = chosen.first(name, lon, lat)
            if to is None:
                chosen.add(chosen.count, name, lon, lat, ident)
            out.append(ident if to is None else to)
        yield pd.DataFrame({"place_id": batch["place_id"], "canonical_id": out})


def _groups(places: DataFrame, scratch: Scratch) -> DataFrame:
    """places with group: no place matches one of another group. Cells of one stem of names are joined with
    the occupied cells around them, and connected; no pair of places is formed."""
    step = DEDUP_METRES / 111_320 * 1.001
    y = F.floor(F.col("lat") / step)
    x = lambda lon, row: F.floor(lon / cell_width(row, step))
    p = places.withColumns({"y": y, "x": x(F.col("lon"), y), "stem": name_stem("normalized_name")})
    node = lambda x, y: F.xxhash64("stem", x, y)
    cells = scratch.written(p.select("stem", "x", "y").distinct(), "cells")
    sides = [(F.col("x") + k) * cell_width(F.col("y"), step) for k in (0, 1)]
    beside = F.explode(F.array(F.struct(F.col("y").alias("y"), (F.col("x") + 1).alias("low"), (F.col("x") + 1).alias("high")), F.struct((F.col("y") + 1).alias("y"), (x(sides[0], F.col("y") + 1) - 1).alias("low"), (x(sides[1], F.col("y") + 1) + 1).alias("high"))))
    near = cells.select("stem", node("x", "y").alias("a"), beside.alias("n")).select("stem", "a", "n.y", F.explode(F.sequence("n.low", "n.high")).alias("x"))
    edges = near.join(cells, ["stem", "x", "y"], "left_semi").select("a", node("x", "y").alias("b"))
    roots = connected(edges, scratch)
    met = scratch.written(roots, "roots")
    left, right = split_keys(p.withColumn("node", node("x", "y")), met, ["node"], by=F.xxhash64("place_id"))
    return left.join(right, ["node", "_split"], "left").select(*places.columns, F.coalesce("root", "node").alias("group"))


def canonical_places(places: DataFrame, max_latitude: float | None = None) -> DataFrame:
    """(place_id, canonical_id): in (created_at, place_id) order a place is canonical unless it matches an
    earlier canonical one, of which the first is its canonical. Not components: of A~B~C with A and C apart,
    A and C are canonical.

    Places of one name and position take the decision of the earliest of them. The others are told apart into
    groups that can't match each other, each of which one task goes through in order; its canonical places lie
    in an index by cell and name, so that no pairs are formed. Groups of more than GROUP_PLACES are decided in
    rounds over pairs instead, by all tasks. Places without a name or a position are canonical."""
    scratch = Scratch(places.sparkSession)
    columns = ["place_id", "normalized_name", "lon", "lat", "created_at"]
    some = places.select(*columns).where("normalized_name IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL")
    first = some.groupBy("normalized_name", "lon", "lat").agg(F.min(F.struct("created_at", "place_id")).alias("r")).select("r.place_id", "normalized_name", "lon", "lat", "r.created_at")
    grouped = scratch.written(_groups(scratch.written(first, "first"), scratch), "grouped")
    large = scratch.written(grouped.groupBy("group").count().where(F.col("count") > GROUP_PLACES), "large").select("group")
    kinds = {f.name: f.dataType.simpleString() for f in places.select("place_id").schema}
    # Groups are a few places each as a rule: rows in order of their groups go by in batches, not a group each.
    ordered = spread(grouped.join(large, "group", "left_anti"), "group").sortWithinPartitions("group", "created_at", "place_id")
    decided = ordered.select("group", *columns[:4]).mapInPandas(_greedy, f"place_id {kinds['place_id']}, canonical_id {kinds['place_id']}")
    if not large.isEmpty():
        decided = decided.unionByName(in_rounds(grouped.join(large, "group", "left_semi").select(*columns), max_latitude))
    decided = scratch.written(decided, "decided")
    to = decided.join(first.select("place_id", "normalized_name", "lon", "lat"), "place_id").select("canonical_id", *(F.col(c).alias(f"_{c}") for c in ("normalized_name", "lon", "lat")))
    keys = ["_normalized_name", "_lon", "_lat"]
    named = some.select("place_id", *(F.col(c[1:]).alias(c) for c in keys))
    left, right = split_keys(named, to, keys, by=F.xxhash64("place_id"))
    known = left.join(right, [*keys, "_split"]).select("place_id", "canonical_id")
    none = places.where("normalized_name IS NULL OR lon IS NULL OR lat IS NULL").select("place_id", F.col("place_id").alias("canonical_id"))
    return known.unionByName(none)


def in_rounds(places: DataFrame, max_latitude: float | None = None) -> DataFrame:
    """The same by rounds over all pairs that match: a round decides all places whose earlier neighbours are
    decided, at least the earliest of those left, so that there are as many rounds as the longest chain of
    decisions has places; rounds keep only what is still open."""
    scratch = Scratch(places.sparkSession)
    order = places.select(F.col("place_id").alias("other_id"), F.struct("created_at", "place_id").alias("rank"))
    edges = scratch.written(same_places(places, max_latitude).join(order, "other_id"), "edges")
    # Places with no earlier neighbour are canonical; what a round decides is written as one more part.
    first = edges.select(F.col("other_id").alias("place_id")).distinct().join(edges.select("place_id"), "place_id", "left_anti").withColumn("canonical", F.lit(True))
    new, left, k = scratch.written(first, "rounds/part=0"), edges, 0
    while not left.isEmpty():
        # Of an open place, the decided neighbours that are canonical settle it; the others no longer count.
        seen = left.join(new.select(F.col("place_id").alias("other_id"), "canonical"), "other_id", "left")
        state = seen.groupBy("place_id").agg(F.bool_or(F.coalesce("canonical", F.lit(False))).alias("hit"), F.bool_or(F.col("canonical").isNull()).alias("waits"))
        k += 1
        new = scratch.written(state.where("hit OR NOT waits").select("place_id", (~F.col("hit")).alias("canonical")), f"rounds/part={k}")
        rest = seen.where("canonical IS NULL").select("place_id", "other_id").join(new.select("place_id"), "place_id", "left_anti")
        left = scratch.written(rest, f"left-{k}")
        if k > 1:
            scratch.remove(f"left-{k - 1}")
    decided = places.sparkSession.read.schema(new.schema).parquet(scratch.path("rounds"))
    alias = edges.join(decided.where("canonical").select(F.col("place_id").alias("other_id")), "other_id").groupBy("place_id").agg(F.min_by("other_id", "rank").alias("to"))
    alias = alias.join(decided.where("NOT canonical").select("place_id"), "place_id", "left_semi")
    return places.select("place_id").join(alias, "place_id", "left").select("place_id", F.coalesce("to", "place_id").alias("canonical_id"))


def resolve_aliases(rows: DataFrame, aliases: DataFrame, position: str = "input_pos") -> DataFrame:
    """rows with canonical_id by one hop through aliases (place_id, canonical_id), each canonical once."""
    joined = rows.join(aliases, "place_id", "left").withColumn("canonical_id", F.coalesce("canonical_id", "place_id"))
    first = joined.groupBy("canonical_id").agg(F.min(position).alias(position))
    return joined.join(first, ["canonical_id", position], "left_semi")


# Search


def in_bounds(places: DataFrame, west: float, south: float, east: float, north: float, limit: int) -> DataFrame:
    """Latest first, at most `limit` rows, with truncated; boxes with west > east wrap."""
    lon = F.col("lon").between(west, east) if west <= east else (F.col("lon") >= west) | (F.col("lon") <= east)
    found = places.where(F.col("lat").between(south, north) & lon).orderBy(F.desc("updated_at"), "place_id").limit(limit + 1)
    numbered = found.withColumn("_k", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("updated_at"), "place_id")))
    return numbered.withColumn("truncated", F.max("_k").over(Window.partitionBy(F.lit(1))) > limit).where(F.col("_k") <= limit).drop("_k")


def search_names(places: DataFrame, query: str, limit: int | None = None, provider: str = "", country: str = "") -> DataFrame:
    found = places.where(F.contains("normalized_name", F.lit(query)))
    if provider:
        found = found.where(F.col("provider") == provider)
    if country:
        found = found.where(F.col("country_code") == country.upper())
    found = found.orderBy(F.desc("updated_at"), "place_id")
    return found if limit is None else found.limit(limit)


def rank_by_context(places: DataFrame, country: str, lon: float, lat: float, most: int | None = 20, by: str | None = None) -> DataFrame:
    """Country first, then distance, then name; per query if there is a column of queries."""
    away = (F.col("country_code") != country.upper()).cast("int") if country else F.lit(0)
    ranked = places.withColumn("metres", distance(F.lit(lon), F.lit(lat), "lon", "lat"))
    if by is None:
        out = ranked.orderBy(away, "metres", "name", "place_id")
        return out if most is None else out.limit(most)
    order = Window.partitionBy(by).orderBy(away, "metres", "name", "place_id")
    ranked = ranked.withColumn("rank", F.row_number().over(order))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def saved_matches(places: DataFrame, query: str, country: str = "") -> DataFrame:
    """Names that contain the query's first part, all qualifiers being in name, address and country; exact
    names, the country, and the main provider first, the latest first among equals."""
    parts = [p for p in (" ".join(unicodedata.normalize("NFKC", x).strip().casefold().split()) for x in query.split(",")) if p]
    if not parts or len(parts[0]) < 2:
        return places.limit(0)
    only = country.upper() if len(parts) == 1 else ""
    label = text_key(F.concat_ws(" ", "name", "address", "country_code"))
    found = places.where(F.contains("normalized_name", F.lit(parts[0])))
    if only:
        found = found.where((F.col("country_code") == "") | (F.col("country_code") == only))
    for p in parts[1:]:
        found = found.where(F.contains(label, F.lit(p)))
    keys = [F.col("normalized_name") != parts[0], (F.col("country_code") != only) if only else F.lit(False), F.col("provider") != "openstreetmap", F.desc("updated_at"), F.col("place_id")]
    return found.orderBy(*keys)


def category_tags(query: str) -> tuple[tuple[str, str], ...]:
    """The tags of the first row one of whose words is part of the query."""
    q = " ".join(query.lower().split())
    return next((tags for words, tags in TAXONOMY if any(w in q for w in words)), ())


def category_search(places: DataFrame, query: str, lon: float, lat: float, metres: float = 5000) -> DataFrame:
    """Places (tag_key, tag_value, lon, lat) of the query's category within a radius of 500 to 25 000 m."""
    r = min(25_000.0, max(500.0, metres))
    d_lat = r / 110_540
    d_lon = d_lat / max(0.1, math.cos(math.radians(lat)))
    near = places.where(F.col("lat").between(lat - d_lat, lat + d_lat) & F.col("lon").between(lon - d_lon, lon + d_lon))
    tags = F.lit(False)
    for k, v in category_tags(query):
        tags |= (F.col("tag_key") == k) & (F.col("tag_value") == v)
    found = near.where(tags).withColumn("metres", distance(F.lit(lon), F.lit(lat), "lon", "lat"))
    return found.where(F.col("metres") <= r)


def lookup(queries: DataFrame, *stages: tuple[str, str, DataFrame]) -> DataFrame:
    """queries (query_id, ...) with the rows of the first stage that has any: stages are (name, reason,
    candidates with query_id). Every query keeps one stage; queries without rows are left out."""
    tagged = None
    for k, (name, reason, rows) in enumerate(stages):
        own = rows.withColumns({"stage": F.lit(name), "reason": F.lit(reason), "_stage": F.lit(k)})
        tagged = own if tagged is None else tagged.unionByName(own)
    tagged = tagged.join(queries.select("query_id"), "query_id", "left_semi")
    first = tagged.groupBy("query_id").agg(F.min("_stage").alias("_stage"))
    return tagged.join(first, ["query_id", "_stage"], "left_semi").drop("_stage")


def geocode(queries: DataFrame, places: DataFrame) -> DataFrame:
    """queries (query_id, query) with status and place_id: `name, qualifier, ...` names a place whose
    normalised name is equal and whose name, address and country contain every qualifier. One place:
    resolved; several: ambiguous; none: missing."""
    q = queries.withColumn("_parts", F.transform(F.split(text_key("query"), ","), lambda x: F.trim(x)))
    q = q.withColumn("normalized_name", F.element_at("_parts", 1)).withColumn("_rest", F.filter(F.slice("_parts", F.lit(2), F.size("_parts")), lambda x: x != ""))
    label = text_key(F.concat_ws(" ", "name", "address", "country_code"))
    hit = q.join(places.withColumn("_label", label).select("place_id", "normalized_name", "_label"), "normalized_name").where(F.forall("_rest", lambda x: F.contains(F.col("_label"), x)))
    found = hit.groupBy("query_id").agg(F.count("*").alias("n"), F.min("place_id").alias("place_id"))
    out = queries.select("query_id").join(found, "query_id", "left")
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return out.select("query_id", status.alias("status"), F.when(F.col("n") == 1, F.col("place_id")).alias("place_id"))


def verify_boundaries(cities: DataFrame, boundaries: DataFrame) -> DataFrame:
    """cities (city_id, name, country_code, lon, lat) with the one boundary (boundary_id, name, country_code,
    class, west, south, east, north) of that name and country that is an administrative or settlement area
    around the point: status resolved, ambiguous or missing."""
    b = boundaries.where(F.col("class").isin("administrative", "settlement")).select("boundary_id", text_key("name").alias("_key"), "country_code", "west", "south", "east", "north")
    c = cities.withColumn("_key", text_key("name"))
    hit = c.join(b, ["_key", "country_code"]).where(F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north")))
    found = hit.groupBy("city_id").agg(F.count_distinct("boundary_id").alias("n"), F.min("boundary_id").alias("boundary_id"))
    out = cities.select("city_id").join(found, "city_id", "left")
    return out.select("city_id", F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("missing").alias("status"), F.when(F.col("n") == 1, F.col("boundary_id")).alias("boundary_id"))


def _words(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)[^\w]+", " "))


def join_table(rows: DataFrame, places: DataFrame, time: str | None = None) -> DataFrame:
    """Source rows (row_index, name, value_text[, region][, time]) with the settlement of the same name:
    values are explicit numbers, a region must stand in the place's name and address as whole words, and
    every row and place is used once. `ambiguous` tells the others; rows without a place are left out."""
    from ..functions.columns import table_number

    r = rows if time is None else rows.where(F.col("time") == time)
    r = r.withColumns({"_key": _words(F.col("name")), "value": table_number("value_text")}).where("value IS NOT NULL AND _key <> ''")
    p = places.where(F.col("place_type").isin(*SETTLEMENTS)).select("place_id", _words(F.col("name")).alias("_key"), _words(F.concat_ws(" ", "name", "address")).alias("_around"), "lon", "lat")
    hit = r.join(p, "_key")
    if "region" in rows.columns:
        hit = hit.where(F.contains(F.concat(F.lit(" "), "_around", F.lit(" ")), F.concat(F.lit(" "), _words(F.col("region")), F.lit(" "))) & (_words(F.col("region")) != ""))
    by_row = hit.groupBy("row_index").agg(F.count("*").alias("_rn"))
    by_place = hit.groupBy("place_id").agg(F.count("*").alias("_pn"))
    both = hit.join(by_row, "row_index").join(by_place, "place_id")
    return both.select("row_index", "place_id", "lon", "lat", "value", ((F.col("_rn") > 1) | (F.col("_pn") > 1)).alias("ambiguous"))


def public_places(places: DataFrame) -> DataFrame:
    """Places without their payload (a variant), with the type that it names."""
    v = lambda path: F.try_variant_get("payload", path, "string")
    tagged, kind = v("$.tags.place"), v("$.type")
    other = F.when(F.array_contains(F.coalesce(F.try_variant_get("payload", "$.types", "array<string>"), F.array().cast("array<string>")), "locality"), "locality").when(kind.isin("City", "Town", "Village", "Locality"), F.lower(kind))
    osm = F.coalesce(F.nullif(v("$.addresstype"), F.lit("")), kind, F.lit(""))
    place_type = F.when(F.coalesce(tagged, F.lit("")) != "", tagged).when(F.col("provider") == "openstreetmap", osm).otherwise(other)
    return places.withColumn("place_type", F.substring(place_type, 1, 80)).drop("payload")
