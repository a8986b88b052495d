"""Rasters as tables of cells, and elevation samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEB_RADIUS = 6_378_137.0
# The ellipsoid and the grid of UTM (fixed values), and series in the third flattening.
_F = 1 / 298.257223563
_N = _F / (2 - _F)
_A = WEB_RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def utm_degrees(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """(lon, lat) of UTM metres of EPSG 32601..32660 (north) and 32701..32760 (south), to a millimetre."""
    xi = F.when(epsg >= 32700, y - 10_000_000.0).otherwise(y) / (0.9996 * _A)
    eta = (x - 500_000.0) / (0.9996 * _A)
    north, east = xi, eta
    for j, b in enumerate(_BETA, 1):
        xi = xi - b * F.sin(2 * j * north) * F.cosh(2 * j * east)
        eta = eta - b * F.cos(2 * j * north) * F.sinh(2 * j * east)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    zone = F.pmod(epsg, F.lit(100))
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(lat)


def crop(cells: DataFrame, meta: DataFrame, box: tuple[float, float, float, float], nonnegative: bool = False) -> DataFrame:
    """Cells (raster_id, row, col, value) with lon and lat whose centre lies in the box, edges included, of
    rasters (raster_id, a, c, e, f, epsg, nodata, width, height) in degrees, Web Mercator or UTM. NoData and
    non-finite values go, zeros stay. Cells are first cut to the window of rows and columns, which prunes
    the scan of a table sorted by them (of UTM rasters, whose grid is turned, all cells are looked at)."""
    west, south, east, north = map(float, box)
    mercator = F.col("epsg") == 3857
    utm = F.col("epsg").between(32601, 32660) | F.col("epsg").between(32701, 32760)
    mx = lambda lon: F.when(mercator, F.radians(F.lit(lon)) * WEB_RADIUS).otherwise(F.lit(lon))
    my = lambda lat: F.when(mercator, F.asinh(F.tan(F.radians(F.lit(lat)))) * WEB_RADIUS).otherwise(F.lit(lat))
    m = meta.where(F.col("epsg").isin(4326, 3857) | utm).select("raster_id", "a", "c", "e", "f", "epsg", "nodata", F.floor((mx(west) - F.col("c")) / F.col("a") - 1).alias("c0"), F.ceil((mx(east) - F.col("c")) / F.col("a") + 1).alias("c1"), F.floor((my(north) - F.col("f")) / F.col("e") - 1).alias("r0"), F.ceil((my(south) - F.col("f")) / F.col("e") + 1).alias("r1"))
    j = cells.join(m, "raster_id").where(utm | F.col("col").between(F.col("c0"), F.col("c1")) & F.col("row").between(F.col("r0"), F.col("r1")))
    x, y = F.col("c") + (F.col("col") + 0.5) * F.col("a"), F.col("f") + (F.col("row") + 0.5) * F.col("e")
    u_lon, u_lat = utm_degrees(x, y, F.col("epsg"))
    j = j.withColumns({"lon": F.when(utm, u_lon).when(mercator, F.degrees(x / WEB_RADIUS)).otherwise(x), "lat": F.when(utm, u_lat).when(mercator, F.degrees(F.atan(F.sinh(y / WEB_RADIUS)))).otherwise(y)})
    ok = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")) & ~F.coalesce(F.col("value") == F.col("nodata"), F.lit(False))
    if nonnegative:
        ok &= F.col("value") >= 0
    return j.where(F.col("lon").between(west, east) & F.col("lat").between(south, north) & ok).select("raster_id", "row", "col", "value", "lon", "lat")


def latest_year(meta: DataFrame, year: int | None = None) -> DataFrame:
    """The verified rasters of a year, or of their last one."""
    ok = meta.where("verified")
    if year is not None:
        return ok.where(F.col("year") == year)
    return ok.join(F.broadcast(ok.agg(F.max("year").alias("year"))), "year")


def tile_point(lon: Column, lat: Column, z: int) -> Column:
    """struct<x, y, u, v>: the Web Mercator tile of a position, and where in it."""
    n = float(1 << z)
    wrapped = F.pmod(lon + 180, F.lit(360.0)) - 180
    wx = F.greatest(F.lit(0.0), F.least(F.lit(n * (1 - 2.220446049250313e-16)), (wrapped + 180) / 360 * n))
    la = F.greatest(F.lit(-85.0511287798066), F.least(F.lit(85.0511287798066), lat))
    wy = F.greatest(F.lit(0.0), F.least(F.lit(n), (1 - F.asinh(F.tan(F.radians(la))) / F.pi()) / 2 * n))
    y = F.least(F.lit(n - 1), F.floor(wy))
    return F.struct(F.floor(wx).cast("int").alias("x"), y.cast("int").alias("y"), (wx - F.floor(wx)).alias("u"), F.least(F.lit(1.0), wy - y).alias("v"))


def elevations(points: DataFrame, dem: DataFrame, z: int) -> DataFrame:
    """points with elevation: the nearest pixel centre of the tile (z, x, y, width, height, data) that they
    are in; null where there is no tile or no value from -12 000 to 9 000. Zero is a value."""
    p = points.withColumn("_t", tile_point(F.col("lon"), F.col("lat"), z))
    d = dem.where(F.col("z") == z).select("x", "y", "width", "height", "data")
    j = p.join(d, (F.col("_t.x") == F.col("x")) & (F.col("_t.y") == F.col("y")), "left")
    at = lambda u, n: F.greatest(F.lit(0), F.least(F.col(n) - 1, F.floor(F.col(f"_t.{u}") * F.col(n) - 0.5 + 0.5))).cast("int")
    v = F.try_element_at("data", at("v", "height") * F.col("width") + at("u", "width") + 1).cast("double")
    value = F.when(~F.isnan(v) & v.between(-12000, 9000), v)
    return j.select(*points.columns, value.alias("elevation"))


def terrain_range(samples: DataFrame, by: str) -> DataFrame:
    return samples.groupBy(by).agg(F.min("elevation").alias("lowest"), F.max("elevation").alias("highest"), F.count("elevation").alias("known"))


