"""Readers and writers of features: Parquet footprints, GeoJSON, delimited text, OSM elements, rows with
aliased columns, encoded geometries; and export."""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import level_range, parse_length, poi_category, table_number, valid_coordinate
from ..functions.geometry import PARTS, point_parts

# Names that columns go by, and columns that stay text.
LON_NAMES, LAT_NAMES = ("lon", "lng", "longitude", "x"), ("lat", "latitude", "y")
KEEP_TEXT = re.compile(r"(?:^|[_\s-])(?:id|name|date|time|year|code)(?:$|[_\s-])|(?:id|name|date|time|year|code)$", re.I)
ROW_ALIASES = {
    "source_id": ("fid", "id", "building_id", "osm_id"),
    "height": ("height", "height_m", "height_metres", "building:height"),
    "community": ("society", "project", "project_name", "complex", "complex_name", "community", "community_name", "development"),
    "building_type": ("building", "building_type", "type", "class", "subtype"),
    "levels": ("building:levels", "building_levels", "levels", "num_floors"),
    "min_height": ("min_height", "minheight", "building:min_height"),
    "name": ("name", "building_name", "label"),
}


def scan_buildings(spark: SparkSession, path: str, box: tuple[float, float, float, float], columns: tuple[str, ...] = ("id", "subtype", "class", "height", "num_floors", "min_height", "geometry")) -> DataFrame:
    """Footprints whose bbox struct meets a box and that aren't underground; both predicates and the columns
    are pushed into the Parquet scan."""
    w, s, e, n = box
    meets = (F.col("bbox.xmin") <= e) & (F.col("bbox.xmax") >= w) & (F.col("bbox.ymin") <= n) & (F.col("bbox.ymax") >= s)
    return spark.read.parquet(path).where(meets & ~F.col("is_underground").eqNullSafe(True)).select(*columns)


# GeoJSON

_COORDS = {"Point": "array<double>", "MultiPoint": "array<array<double>>", "LineString": "array<array<double>>", "MultiLineString": "array<array<array<double>>>", "Polygon": "array<array<array<double>>>", "MultiPolygon": "array<array<array<array<double>>>>"}


def _position(p: Column) -> Column:
    return F.struct(p[0].alias("lon"), p[1].alias("lat"))


def geometry_parts(kind: Column, coordinates: Column) -> Column:
    """The uniform parts of GeoJSON coordinates given as text; null for other types or texts that don't fit."""
    read = lambda k: F.from_json(coordinates, _COORDS[k])
    path = lambda ps: F.transform(ps, _position)
    out = F.when(kind == "Point", F.array(F.array(F.array(_position(read("Point"))))))
    out = out.when(kind == "MultiPoint", F.transform(read("MultiPoint"), lambda p: F.array(F.array(_position(p)))))
    out = out.when(kind == "LineString", F.array(F.array(path(read("LineString")))))
    out = out.when(kind == "MultiLineString", F.transform(read("MultiLineString"), lambda l: F.array(path(l))))
    out = out.when(kind == "Polygon", F.array(F.transform(read("Polygon"), path)))
    return out.when(kind == "MultiPolygon", F.transform(read("MultiPolygon"), lambda g: F.transform(g, path))).cast(PARTS)


def geojson_features(texts: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(features, rejects) of GeoJSON documents, one a row: collections, single features and bare geometries.
    Features have feature_id, geom_type, parts and props (a map of JSON texts as strings); a document with a
    crs member, or a geometry that can't be read, is rejected with a reason."""
    shape = "struct<type:string,id:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>,coordinates:string,crs:string,features:array<struct<id:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>>"
    d = texts.select(F.from_json(column, shape).alias("d")).withColumn("doc_pos", F.monotonically_increasing_id())
    single = F.struct(F.col("d.id").alias("id"), F.when(F.col("d.type") == "Feature", F.col("d.geometry")).otherwise(F.struct(F.col("d.type").alias("type"), F.col("d.coordinates").alias("coordinates"))).alias("geometry"), F.col("d.properties").alias("properties"))
    ok = d.where("d.type IS NOT NULL AND d.crs IS NULL")
    each = ok.select("doc_pos", F.posexplode(F.when(F.col("d.type") == "FeatureCollection", F.coalesce("d.features", F.array().cast("array<struct<id:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"))).otherwise(F.array(single))).alias("input_pos", "f"))
    read = each.select("doc_pos", "input_pos", F.col("f.id").alias("feature_id"), F.col("f.geometry.type").alias("geom_type"), geometry_parts(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("parts"), F.coalesce("f.properties", F.create_map().cast("map<string,string>")).alias("props"))
    whole = F.col("parts").isNotNull() & F.forall(F.flatten(F.flatten("parts")), lambda p: F.coalesce(p["lon"].between(-180, 180) & p["lat"].between(-90, 90), F.lit(False)))
    rejects = read.where(~F.coalesce(whole, F.lit(False))).select("doc_pos", "input_pos", F.lit("geometry").alias("reason")).unionByName(d.where("d.type IS NULL OR d.crs IS NOT NULL").select("doc_pos", F.lit(None).cast("int").alias("input_pos"), F.when(F.col("d.crs").isNotNull(), "crs").otherwise("json").alias("reason")))
    return read.where(whole), rejects


# Delimited text


def read_points(spark: SparkSession, path: str, separator: str = ",") -> tuple[DataFrame, DataFrame]:
    """(points, rejects) of delimited text with a header: one longitude and one latitude column by their
    usual names; other columns become numbers where every value is one (ids, names, dates, years and codes
    stay text); rows without valid coordinates are rejects; blank rows are dropped."""
    raw = spark.read.csv(path, header=True, sep=separator, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    named = lambda names: [c for c in raw.columns if c.strip().lower() in names]
    lon, lat = named(LON_NAMES), named(LAT_NAMES)
    if len(lon) != 1 or len(lat) != 1:
        raise ValueError("one longitude and one latitude column are needed")
    rest = [c for c in raw.columns if c not in (lon[0], lat[0])]
    filled = F.lit(False)
    for c in raw.columns:
        filled |= F.trim(F.col(f"`{c}`")) != ""
    rows = raw.where(F.coalesce(filled, F.lit(False)))
    x, y = table_number(F.col(f"`{lon[0]}`")), table_number(F.col(f"`{lat[0]}`"))
    blank = lambda c: F.col(f"`{c}`").isNull() | F.lower(F.trim(F.col(f"`{c}`"))).isin("", "null")
    candidates = [c for c in rest if not KEEP_TEXT.search(c)]
    all_numbers = rows.agg(*(F.bool_and(blank(c) | table_number(F.col(f"`{c}`")).isNotNull()).alias(c) for c in candidates)).first() if candidates else {}
    value = lambda c: F.when(~blank(c), table_number(F.col(f"`{c}`")) if c in candidates and all_numbers[c] else F.col(f"`{c}`")).alias(c)
    good = valid_coordinate(x, y)
    return rows.where(good).select(x.alias("lon"), y.alias("lat"), *map(value, rest)), rows.where(~good)


# OSM elements and rows


def osm_buildings(elements: DataFrame) -> DataFrame:
    """(source_id, kind, building_type, real_height, levels, min_height, name) of elements (type, id, tags)
    that are buildings or parts of them."""
    t = lambda k: F.element_at("tags", k)
    kind = F.coalesce(F.nullif(t("building"), F.lit("")), F.nullif(t("building:part"), F.lit("")))
    return elements.where(kind.isNotNull()).select(F.concat_ws("/", "type", "id").alias("source_id"), F.lit("building").alias("kind"), kind.alias("building_type"), F.lit("openstreetmap").alias("data_source"), parse_length(t("height")).alias("real_height"), F.coalesce(t("building:levels").try_cast("double"), F.lit(0.0)).alias("levels"), parse_length(t("min_height")).alias("min_height"), F.substring(F.coalesce(t("name"), F.lit("")), 1, 160).alias("name"))


def osm_pois(elements: DataFrame) -> DataFrame:
    """(source_id, category, name, parts) of elements (type, id, tags, lon, lat, center) of a known class."""
    t = lambda k: F.coalesce(F.element_at("tags", k), F.lit(""))
    category = poi_category({k: t(k) for k in ("amenity", "tourism", "shop")})
    lon, lat = F.coalesce("center.lon", "lon"), F.coalesce("center.lat", "lat")
    rows = elements.withColumns({"category": category, "_lon": lon, "_lat": lat}).where("category <> '' AND _lon IS NOT NULL AND _lat IS NOT NULL")
    return rows.select(F.concat_ws("/", "type", "id").alias("source_id"), "category", F.substring(F.coalesce(F.nullif(t("name"), F.lit("")), t("brand")), 1, 160).alias("name"), point_parts("_lon", "_lat").alias("parts"))


def osm_places(elements: DataFrame, country: str) -> DataFrame:
    """Place rows of elements with a name or brand and valid coordinates; the address joins what there is."""
    t = lambda k: F.trim(F.coalesce(F.element_at("tags", k), F.lit("")))
    lon, lat = F.coalesce("center.lon", "lon"), F.coalesce("center.lat", "lat")
    name = F.coalesce(F.nullif(t("name"), F.lit("")), t("brand"))
    street = F.trim(F.concat_ws(" ", t("addr:housenumber"), t("addr:street")))
    address = F.concat_ws(", ", *(F.nullif(x, F.lit("")) for x in (street, t("addr:city"), t("addr:postcode"))))
    rows = elements.where(valid_coordinate(lon, lat) & (name != ""))
    return rows.select(F.concat_ws(":", F.lit("openstreetmap"), "type", "id").alias("place_id"), F.lit("openstreetmap").alias("provider"), F.substring(name, 1, 160).alias("name"), F.substring(address, 1, 500).alias("address"), F.lit(country.upper()).alias("country_code"), lon.alias("lon"), lat.alias("lat"), F.struct(lon.alias("w"), lat.alias("s"), lon.alias("e"), lat.alias("n")).alias("bbox"))


def geocoder_places(rows: DataFrame) -> DataFrame:
    """Place rows of geocoder results (osm_type, osm_id, name, display_name, country_code, lon, lat, south,
    north, west, east): without an extent, 0.03 degrees around."""
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.trim(F.substring_index("display_name", ",", 1)))
    full = F.col("west").isNotNull() & F.col("east").isNotNull() & F.col("south").isNotNull() & F.col("north").isNotNull()
    side = lambda c, around: F.when(full, F.col(c)).otherwise(around)
    bbox = F.struct(side("west", F.col("lon") - 0.03).alias("w"), side("south", F.col("lat") - 0.03).alias("s"), side("east", F.col("lon") + 0.03).alias("e"), side("north", F.col("lat") + 0.03).alias("n"))
    ident = F.concat_ws(":", F.coalesce("osm_type", F.lit("place")), F.coalesce(F.col("osm_id").cast("string"), F.format_string("%.6f,%.6f", "lat", "lon")))
    return rows.where(name != "").select(F.concat(F.lit("openstreetmap:"), ident).alias("place_id"), F.lit("openstreetmap").alias("provider"), F.substring(name, 1, 160).alias("name"), F.substring(F.coalesce("display_name", F.lit("")), 1, 500).alias("address"), F.upper(F.coalesce("country_code", F.lit(""))).alias("country_code"), "lon", "lat", bbox.alias("bbox"))


def aliased_rows(rows: DataFrame, filename: str) -> DataFrame:
    """The record of building rows whose columns go by several names: of each, the first that isn't blank."""
    by_name = {c.lower(): c for c in rows.columns}

    def pick(field: str) -> Column:
        there = [F.nullif(F.col(f"`{by_name[a]}`").cast("string"), F.lit("")) for a in ROW_ALIASES[field] if a in by_name]
        return F.coalesce(*there, F.lit(None).cast("string"))

    lr = level_range(pick("height"))
    return rows.select(F.concat_ws(":", F.lit(filename), F.coalesce(pick("source_id"), F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(rows.columns)))), 256))).alias("source_id"), F.coalesce(pick("building_type"), F.lit("unknown")).alias("building_type"), parse_length(pick("height")).alias("real_height"), lr["lo"].alias("lo"), lr["hi"].alias("hi"), F.coalesce(pick("levels").try_cast("double"), F.lit(0.0)).alias("levels"), parse_length(pick("min_height")).alias("min_height"), F.substring(F.coalesce(pick("name"), F.lit("")), 1, 160).alias("name"), F.substring(F.coalesce(pick("community"), F.lit("")), 1, 160).alias("community"))


# Encoded geometries


def _closed(ring: list) -> list | None:
    if len(ring) < 3:
        return None
    ring = ring if ring[0] == ring[-1] else [*ring, ring[0]]
    return ring if len(ring) >= 4 else None


def parse_wkt(text: str) -> tuple[str, list] | None:
    """(type, polygons) of WKT polygons, an SRID prefix allowed."""
    text = re.sub(r"^\s*SRID=\d+;", "", text, flags=re.I).strip()
    m = re.fullmatch(r"(MULTI)?POLYGON\s*(?:Z|M|ZM)?\s*(\(.*\))", text, re.I | re.S)
    if not m:
        return None
    nested = re.sub(r"[^(),]+", lambda t: t[0] if not t[0].strip() else f'"{t[0].strip()}"', m[2]).replace("(", "[").replace(")", "]")
    try:
        import json

        groups = json.loads(nested)
        polygons = groups if m[1] else [groups]
        out = []
        for polygon in polygons:
            rings = [_closed([[float(v) for v in p.split()[:2]] for p in ring]) for ring in polygon]
            if rings and rings[0] and all(len(p) == 2 for r in rings if r for p in r):
                out.append([r for r in rings if r])
        return ("MultiPolygon" if m[1] else "Polygon", out) if out else None
    except (ValueError, TypeError, AttributeError, IndexError):
        return None


class _Bytes:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def take(self, form: str):
        out = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return out


def _wkb(source: _Bytes, only: int | None = None) -> tuple[str, list]:
    order = {0: ">", 1: "<"}[source.take("B")[0]]
    code = source.take(order + "I")[0]
    size = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    iso, kind = divmod(code & 0x0FFFFFFF, 1000)
    size += {0: 0, 1: 1, 2: 1, 3: 2}[iso]
    if kind not in (3, 6) or only and kind != only:
        raise ValueError("not a polygon")
    count = source.take(order + "I")[0]
    if count * 4 > len(source.data):
        raise ValueError("more parts than bytes")
    if kind == 6:
        return "MultiPolygon", [_wkb(source, 3)[1][0] for _ in range(count)]
    rings = []
    for _ in range(count):
        n = source.take(order + "I")[0]
        if n < 3 or n * size * 8 > len(source.data) - source.at:
            raise ValueError("not a ring")
        flat = source.take(f"{order}{n * size}d")
        ring = [[flat[k * size], flat[k * size + 1]] for k in range(n)]
        if not all(map(math.isfinite, (v for p in ring for v in p))):
            raise ValueError("not finite")
        rings.append(ring if ring[0] == ring[-1] else [*ring, ring[0]])
    if not rings:
        raise ValueError("no ring")
    return "Polygon", [rings]


def parse_hex(text: str) -> tuple[str, list] | None:
    """(type, polygons) of hexadecimal WKB, EWKB and GeoPackage geometries."""
    text = re.sub(r"^0x", "", text.strip(), flags=re.I)
    try:
        data, at = bytes.fromhex(text), 0
        if data[:2] == b"GP":
            if data[2] or data[3] & 0x10:
                return None
            at = 8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[data[3] >> 1 & 7]
        source = _Bytes(data, at)
        out = _wkb(source)
        return out if source.at == len(data) and out[1] else None
    except (ValueError, KeyError, IndexError, struct.error):
        return None


def decode_geometries(rows: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(decoded, rejects): key, geom_type and parts of encoded geometries; keys of those that can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, text in batch.itertuples(index=False):
                found = (parse_wkt(text) or parse_hex(text)) if isinstance(text, str) else None
                parts = [[[{"lon": p[0], "lat": p[1]} for p in ring] for ring in polygon] for polygon in found[1]] if found else None
                out.append((k, found[0] if found else None, parts))
            yield pd.DataFrame(out, columns=["key", "geom_type", "parts"])

    kind = rows.schema[key].dataType.simpleString()
    done = rows.select(key, column).mapInPandas(run, f"key {kind}, geom_type string, parts {PARTS}").withColumnRenamed("key", key)
    return done.where("parts IS NOT NULL"), done.where("parts IS NULL").select(key)


def assembled_rings(members: DataFrame) -> DataFrame:
    """(relation_id, parts) of relation members (relation_id, pos, role, path: array of vertices): lines are
    stitched at their ends into rings; inner rings go to the first outer one; relations without an outer ring
    are left out. A relation is one row, as large as its members; a batch has many."""

    def stitch(lines: list) -> list:
        left, rings = [list(x) for x in lines if len(x) >= 2], []
        while left:
            line, grew = left.pop(0), True
            while grew and line[0] != line[-1]:
                grew = False
                for k, other in enumerate(left):
                    joined = line + other[1:] if line[-1] == other[0] else line + other[-2::-1] if line[-1] == other[-1] else other[:-1] + line if line[0] == other[-1] else other[:0:-1] + line if line[0] == other[0] else None
                    if joined:
                        line, grew = joined, True
                        left.pop(k)
                        break
            if ring := _closed(line):
                rings.append(ring)
        return rings

    def polygons(members: list) -> list | None:
        lines = lambda inner: [[(p["lon"], p["lat"]) for p in m["path"]] for m in members if (m["role"] == "inner") == inner]
        outer = [[r] for r in stitch(lines(False))]
        if not outer:
            return None
        outer[0] += stitch(lines(True))
        return [[[{"lon": a, "lat": b} for a, b in ring] for ring in polygon] for polygon in outer]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = batch.assign(parts=[polygons(list(members)) for members in batch["_members"]])
            yield made.loc[made["parts"].notna(), ["relation_id", "parts"]]

    each = members.groupBy("relation_id").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "path"))).alias("_members"))
    return each.mapInPandas(run, f"relation_id long, parts {PARTS}")


# Export


def geojson_rows(features: DataFrame, properties: list[str], layer: str | None = None) -> DataFrame:
    """(value): a GeoJSON feature a row, ready for the text writer; with a layer, its id is a property."""
    xy = lambda path: F.transform(path, lambda p: F.array(p["lon"], p["lat"]))
    t, parts = F.col("geom_type"), F.col("parts")
    coordinates = F.when(t == "Point", F.to_json(xy(parts[0][0])[0]))
    coordinates = coordinates.when(t == "LineString", F.to_json(xy(parts[0][0]))).when(t == "Polygon", F.to_json(F.transform(parts[0], xy)))
    coordinates = coordinates.when(t == "MultiPoint", F.to_json(F.transform(parts, lambda p: xy(p[0])[0]))).when(t == "MultiLineString", F.to_json(F.transform(parts, lambda p: xy(p[0])))).otherwise(F.to_json(F.transform(parts, lambda g: F.transform(g, xy))))
    props = [F.col(c) for c in properties] + ([F.lit(layer).alias("layer")] if layer else [])
    whole = F.to_json(F.struct(F.col("feature_id").cast("string").alias("v")))
    ident = F.concat(F.lit('{"type":"Feature","id":'), F.regexp_replace(F.substr(whole, F.lit(6)), r"\}$", ""))
    return features.select(F.concat(ident, F.lit(',"geometry":{"type":"'), t, F.lit('","coordinates":'), coordinates, F.lit('},"properties":'), F.to_json(F.struct(*props)), F.lit("}")).alias("value"))
