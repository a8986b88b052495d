"""Column expressions on scalars: distances, tiles, names, lengths, numbers, times, longitudes.

All but `text_key` are built from Spark's own functions, so they stay in generated code.
"""

from __future__ import annotations

import math
import re
import unicodedata
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
EARTH_RADIUS = 6_371_008.8
DEDUP_METRES_PER_DEGREE = 111_320
LATTICE_X, LATTICE_Y, NEIGHBOUR_RADIUS = 111_320, 110_540, 150
LEVEL_HEIGHT, DRIVE_SPEED, TILE_ZOOM = 3.1, 13.89, 14
LOCALITY_WORDS = ("society", "residency", "residential", "apartment", "apartments", "housing", "enclave", "colony")
HEIGHT_PRIORS = (
    (("apartments", "apartment", "residential"), 14.0),
    (("office", "commercial"), 18.0),
    (("hotel",), 20.0),
    (("hospital",), 16.0),
    (("school", "college", "university"), 12.0),
    (("industrial", "warehouse", "shed", "garage"), 8.0),
    (("house", "detached", "bungalow", "hut"), 6.0),
    (("church", "mosque", "temple", "cathedral"), 14.0),
)
DEFAULT_HEIGHT = 9.0
POI_CLASSES = (
    ("amenity", ("hospital", "clinic", "doctors", "pharmacy"), "health"),
    ("amenity", ("fuel",), "fuel"),
    ("amenity", ("school", "college", "university", "kindergarten", "library"), "education"),
    ("amenity", ("police", "fire_station"), "safety"),
    ("amenity", ("bus_station",), "transit"),
    ("tourism", ("hotel", "motel", "hostel", "guest_house"), "lodging"),
    ("tourism", ("museum", "attraction"), "culture"),
    ("shop", ("supermarket", "convenience"), "shopping"),
)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


# Distances


def distance(lon1, lat1, lon2, lat2) -> Column:
    """Metres on an equirectangular plane at the mean latitude; longitudes are not wrapped."""
    lon1, lat1, lon2, lat2 = map(_c, (lon1, lat1, lon2, lat2))
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.lit(EARTH_RADIUS) * F.hypot(x, F.radians(lat2 - lat1))


def haversine(lon1, lat1, lon2, lat2) -> Column:
    lon1, lat1, lon2, lat2 = map(_c, (lon1, lat1, lon2, lat2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def dedup_distance(lon1, lat1, lon2, lat2) -> Column:
    """The plane that place deduplication measures on."""
    lon1, lat1, lon2, lat2 = map(_c, (lon1, lat1, lon2, lat2))
    north = (lat1 - lat2) * DEDUP_METRES_PER_DEGREE
    east = (lon1 - lon2) * DEDUP_METRES_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    return F.hypot(north, east)


# Longitudes


def wrap_longitude(lon) -> Column:
    return F.pmod(_c(lon) + 180, F.lit(360.0)) - 180


def longitude_near(lon, reference) -> Column:
    """The longitude, by whole turns, in the band centred on the reference."""
    lon = _c(lon)
    return lon + F.floor((_c(reference) - lon) / 360 + 0.5) * 360


def longitude_delta(a, b) -> Column:
    """The short way from a to b; an explicit whole turn stays one."""
    d = _c(b) - _c(a)
    return F.when(F.abs(d) == 360, d).when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)


# Tiles


def tile_x(lon, z: int) -> Column:
    n = 1 << z
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((_c(lon) + 180) / 360 * n))).cast("int")


def tile_y(lat, z: int) -> Column:
    n = 1 << z
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((1 - F.asinh(F.tan(F.radians(F.greatest(F.lit(-85.0511), F.least(F.lit(85.0511), _c(lat)))))) / math.pi) / 2 * n))).cast("int")


def tile_bbox(x, y, z: int) -> Column:
    """struct<west, south, east, north> of a tile."""
    n, x, y = float(1 << z), _c(x), _c(y)
    lat = lambda row: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * row / n))))
    return F.struct((x / n * 360 - 180).alias("west"), lat(y + 1).alias("south"), ((x + 1) / n * 360 - 180).alias("east"), lat(y).alias("north"))


def quadkey(x, y, z: int) -> Column:
    x, y = _c(x), _c(y)
    return F.concat(*((F.shiftright(x, k).bitwiseAND(1) + 2 * F.shiftright(y, k).bitwiseAND(1)).cast("string") for k in range(z - 1, -1, -1)))


# Names and texts


def text_key(text) -> Column:
    """NFKC, case-folded, single-spaced. ASCII texts, which most are, need no Python: only the others'
    values go to a vectorised function."""
    text = _c(text)
    ascii_form = F.trim(F.regexp_replace(F.lower(text), r"[\s\x1c-\x1f]+", " "))

    def fold(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).strip().casefold().split()))

    fold.__annotations__ = {"values": pd.Series, "return": pd.Series}
    other = F.pandas_udf(fold, "string")(F.when(~F.regexp_like(text, F.lit(r"^\p{ASCII}*$")), text))
    return F.coalesce(other, ascii_form)


def plain_terms(text: str) -> list[str]:
    """The distinct words of a text: unquoted, compatibility forms, in one case, without accents."""
    plain = unicodedata.normalize("NFKD", unquote(text)).casefold()
    plain = "".join(c for c in plain if not unicodedata.combining(c))
    return sorted(set(re.findall(r"[^\W_]+", plain)))


def terms(text) -> Column:
    """plain_terms of each text (array<string>). ASCII texts without a percent sign need no Python."""
    text = _c(text)

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else plain_terms(v))

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    other = F.pandas_udf(run, "array<string>")(F.when(~F.regexp_like(text, F.lit(r"^[\p{ASCII}&&[^%]]*$")), text))
    return F.coalesce(other, F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1))))


def ascii_key(text) -> Column:
    """text_key for columns that are known to be ASCII."""
    return F.trim(F.regexp_replace(F.lower(_c(text)), r"\s+", " "))


def same_place_name(a, b) -> Column:
    """Equal names, or a name of two words at least that the other one goes on from with a locality word."""
    a, b = _c(a), _c(b)
    short, long = F.when(F.char_length(a) <= F.char_length(b), a).otherwise(b), F.when(F.char_length(a) <= F.char_length(b), b).otherwise(a)
    rest = F.substr(long, F.char_length(short) + 2)
    goes_on = F.startswith(long, F.concat(short, F.lit(" "))) & (F.size(F.split(short, " ")) >= 2) & F.substring_index(rest, " ", 1).isin(*LOCALITY_WORDS)
    return (a == b) | goes_on


def name_stem(name) -> Column:
    """What all names that may say the same have in common: two words or more before the first locality word
    after them, or the whole name."""
    words = F.split(_c(name), " ")
    at = F.filter(F.sequence(F.lit(2), F.greatest(F.size(words) - 1, F.lit(2))), lambda k: F.get(words, k).isin(*LOCALITY_WORDS))
    return F.when(F.size(at) > 0, F.array_join(F.slice(words, 1, F.get(at, F.lit(0))), " ")).otherwise(_c(name))


def phrase_match(text, phrase: str) -> Column:
    """The phrase occurs as whole words, in either case, with any white space between them."""
    quoted = r"\s+".join("\\Q" + w.replace("\\E", "\\E\\\\E\\Q") + "\\E" for w in phrase.split())
    return F.regexp_like(_c(text), F.lit(rf"(?iu)(?<!\w){quoted}(?!\w)"))


def redact(text) -> Column:
    """Values that follow a credential's name go."""
    return F.regexp_replace(_c(text), r"(?i)((?:api[_-]?key|access[_-]?token|authorization|token)\s*[:=]\s*)[^\s&,;]+", "$1[redacted]")


def request_hash(**fields) -> Column:
    """SHA-256 of the compact JSON of the fields in name order; nulls are written."""
    parts = []
    for name in sorted(fields):
        parts += [F.lit("," if parts else "{"), F.lit(f'"{name}":'), _json(_c(fields[name]))]
    return F.sha2(F.concat(*parts, F.lit("}")), 256)


def _json(value: Column) -> Column:
    whole = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.regexp_extract(whole, r'(?s)^\{"v":(.*)\}$', 1)


def coordinates(text) -> Column:
    """struct<lon, lat> of `lat,lon`, of `28.6 N, 77.2 E` and of `geo:lat,lon`; null for other texts and
    for coordinates out of range."""
    t = F.trim(_c(text))
    number = r"([+-]?\d{1,3}(?:\.\d+)?)"
    plain = rf"(?i)^(?:geo:{number},{number}(?:\?z=\d+(?:\.\d+)?)?|{number}\s*[,;]\s*{number})$"
    lettered = r"(?i)^(\d{1,2}(?:\.\d+)?)\s*°?\s*([NS])\s*[,;\s]+(\d{1,3}(?:\.\d+)?)\s*°?\s*([EW])$"
    is_plain, is_lettered = F.regexp_like(t, F.lit(plain)), F.regexp_like(t, F.lit(lettered))
    got = lambda p, k: F.regexp_extract(t, p, k)
    lat = F.when(is_plain, F.coalesce(got(plain, 1).try_cast("double"), got(plain, 3).try_cast("double"))).when(is_lettered, got(lettered, 1).try_cast("double") * F.when(F.upper(got(lettered, 2)) == "S", -1).otherwise(1))
    lon = F.when(is_plain, F.coalesce(got(plain, 2).try_cast("double"), got(plain, 4).try_cast("double"))).when(is_lettered, got(lettered, 3).try_cast("double") * F.when(F.upper(got(lettered, 4)) == "W", -1).otherwise(1))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lon.alias("lon"), lat.alias("lat")))


def valid_coordinate(lon, lat) -> Column:
    lon, lat = _c(lon).try_cast("double"), _c(lat).try_cast("double")
    return F.coalesce(~F.isnan(lon) & ~F.isnan(lat) & lon.between(-180, 180) & lat.between(-90, 90), F.lit(False))


# Numbers, lengths, times


def strict_number(text) -> Column:
    """A number without thousands separators, or null; infinities are null."""
    t = F.trim(_c(text))
    n = F.when(F.regexp_like(t, F.lit(r"(?i)^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:e[+-]?\d+)?$")), t.try_cast("double"))
    return F.when(F.abs(n) < float("inf"), n)


def table_number(text) -> Column:
    """A number whose thousands may be grouped by commas, all of them rightly, or null."""
    t = F.trim(_c(text))
    grouped = F.regexp_like(t, F.lit(r"^[+-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?$"))
    return F.when(grouped, F.regexp_replace(t, ",", "").try_cast("double")).otherwise(strict_number(t))


def parse_length(text) -> Column:
    """Metres: a leading number in feet, centimetres, metres or without a unit; 0 where there is none."""
    t = F.lower(F.trim(_c(text).cast("string")))
    n = F.regexp_extract(t, r"^[-+]?\d+(?:\.\d+)?", 0).try_cast("double")
    feet = F.regexp_like(t, F.lit(r"\b(ft|feet|foot)\b|\d\s*'"))
    metres = F.regexp_like(t, F.lit(r"\b(m|meter|metre)s?\b|^[-+]?\d+(?:\.\d+)?$"))
    return F.coalesce(F.when(feet, n * 0.3048).when(F.regexp_like(t, F.lit(r"\bcm\b")), n / 100).when(metres, n), F.lit(0.0))


def level_range(text) -> Column:
    """struct<lo, hi> of `HBET:lo-hi` with 0 < lo <= hi <= 200, or null."""
    p = r"(?i)^\s*HBET\s*:\s*(\d{1,3})\s*-\s*(\d{1,3})\s*$"
    lo, hi = F.regexp_extract(_c(text), p, 1).try_cast("double"), F.regexp_extract(_c(text), p, 2).try_cast("double")
    return F.when((lo > 0) & (lo <= hi) & (hi <= 200), F.struct(lo.alias("lo"), hi.alias("hi")))


def normal_time(value, field: str) -> Column:
    """ISO time in UTC, or the year for fields named so; null for what isn't a valid date, a time without
    zone included."""
    v = F.trim(_c(value).cast("string"))
    lower = field.lower()
    is_year = lower.endswith("year") or any(p == "year" for p in lower.replace("-", " ").replace("_", " ").split())
    p = r"(?i)^\d{4}-\d{2}-\d{2}(?:T([01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d{1,3})?)?(?:Z|[+-](?:[01]\d|2[0-3]):[0-5]\d))?$"
    zoned = F.when(F.char_length(v) == 10, F.concat(v, F.lit("T00:00:00Z"))).otherwise(v)
    stamp = F.when(F.regexp_like(v, F.lit(p)), F.try_to_timestamp(F.regexp_replace(F.upper(zoned), r"(T\d{2}:\d{2})(?=[Z+-])", "$1:00")))
    utc = F.to_utc_timestamp(stamp, F.current_timezone())
    iso = F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    return F.when(F.regexp_like(v, F.lit(r"^[1-9]\d{3}$")), v).otherwise(iso) if is_year else iso


# Buildings and points of interest


def poi_category(tags: dict[str, Column]) -> Column:
    """The first class that a tag names; tags maps amenity, tourism and shop to columns."""
    out = F.when(F.lit(False), "")
    for key, values, name in POI_CLASSES:
        out = out.when(_c(tags[key]).isin(*values), name)
    return out.otherwise("")


def height_prior(building_type, area) -> Column:
    """Of the first group one of whose words is part of the type, adjusted by the footprint."""
    kind, base = F.lower(_c(building_type)), None
    for terms, value in HEIGHT_PRIORS:
        hit = F.regexp_like(kind, F.lit("|".join(terms)))
        base = F.when(hit, value) if base is None else base.when(hit, value)
    adjust = F.greatest(F.lit(-2.0), F.least(F.lit(14.0), F.log(F.greatest(_c(area), F.lit(1.0)) / 100) * 3.2))
    return F.least(F.lit(120.0), F.greatest(F.lit(3.0), base.otherwise(DEFAULT_HEIGHT) + adjust))


def known_height(real_height, levels) -> Column:
    """struct<height, source>: the given height if plausible, else levels times LEVEL_HEIGHT, else null."""
    h, n = _c(real_height), _c(levels)
    return F.when((h > 1) & (h < 1000), F.struct(h.alias("height"), F.lit("height").alias("source"))).when((n > 0) & (n < 200), F.struct((n * LEVEL_HEIGHT).alias("height"), F.lit("levels").alias("source")))


def above_base(height, min_height) -> tuple[Column, Column]:
    """(height, whether the base raised it)"""
    least = _c(min_height) + 0.5
    return F.greatest(_c(height), least), _c(height) < least
