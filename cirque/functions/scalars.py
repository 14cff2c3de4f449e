"""Column expressions that operators share; all stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

SECTORS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
BANDS = ("btl", "tln", "alp")
#: Names, colours and danger names by class or level. Fixed values.
CLASS_NAMES = ("Non-avalanche", "Simple", "Challenging", "Complex", "Extreme")
CLASS_COLORS = ((255, 255, 255, 255), (0, 128, 0, 255), (0, 0, 255, 255), (0, 0, 0, 255), (255, 0, 0, 255))
DANGER = ("1 - Low", "2 - Moderate", "3 - Considerable", "4 - High", "5 - Extreme")
MAX_LAT = 85.05112878


def saturating(x: Column, low: int = -32768, high: int = 32767, kind: str = "smallint") -> Column:
    """Toward zero, clamped; NaN gives 0, null stays null."""
    x = x.cast("double")
    return F.when(F.isnan(x), F.lit(0)).otherwise(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))).cast(kind)


def is_nodata(x: Column, nodata: float | None) -> Column:
    return F.isnan(x) if nodata is None else F.isnan(x) | (x == nodata)


def aspect_sector(azimuth: Column) -> Column:
    i = (F.floor((azimuth.cast("double") + 22.5) / 45) % 8).cast("int")
    return F.when(azimuth.isNotNull(), F.get(F.array(*map(F.lit, SECTORS)), i))


def class_name(c: Column) -> Column:
    return F.when(c.isNotNull(), F.get(F.array(*map(F.lit, CLASS_NAMES)), c.cast("int")))


def class_rgba(c: Column) -> Column:
    """Packed red, green, blue, alpha; 0 (transparent) for null and other values."""
    out = F.lit(0).cast("long")
    for k, (r, g, b, a) in enumerate(CLASS_COLORS):
        out = F.when(c == k, F.lit(r << 24 | g << 16 | b << 8 | a).cast("long")).otherwise(out)
    return out


def cauchy(x: Column, a: float, b: float, c: float) -> Column:
    return 1 / (1 + F.pow((x.cast("double") - c) / a, F.lit(2.0 * b)))


def round5(x: Column) -> Column:
    return F.rint(x * 100000) / 100000


def half_even(x: Column) -> Column:
    return F.rint(x)


def bands_between(low: Column, high: Column, btl: Column, alp: Column) -> Column:
    """Elevation bands that a range touches: below btl, from btl to alp, above alp."""
    rank = lambda z: F.when(z < btl, 0).when(z > alp, 2).otherwise(1)
    every = F.array(*map(F.lit, BANDS))
    return F.filter(every, lambda b, i: (i >= rank(low)) & (i <= rank(high)))


def danger_level(s: Column) -> Column:
    """1 to 5, or null for no rating and for what isn't recognised."""
    k = F.lower(F.regexp_replace(F.coalesce(s, F.lit("")), r"[^0-9A-Za-z]", ""))
    out = F.lit(None).cast("int")
    for i, name in enumerate(("low", "moderate", "considerable", "high", "extreme"), 1):
        out = F.when((k == name) | (k == str(i)), i).otherwise(out)
    return out


def danger_known(s: Column) -> Column:
    k = F.lower(F.regexp_replace(F.coalesce(s, F.lit("")), r"[^0-9A-Za-z]", ""))
    return danger_level(s).isNotNull() | k.isin("", "norating", "noforecast", "none", "0")


def danger_name(level: Column) -> Column:
    return F.when(level.isNotNull(), F.get(F.array(*map(F.lit, DANGER)), level.cast("int") - 1))


def decode_location(s: Column) -> Column:
    """`aspect_band` or `band_aspect` code -> struct<aspect, band>; null if it isn't exactly that."""
    w = F.filter(F.split(F.lower(F.coalesce(s, F.lit(""))), r"[^0-9a-z]+"), lambda x: x != "")
    a, b = F.get(w, F.lit(0)), F.get(w, F.lit(1))
    sectors, bands = [x.lower() for x in SECTORS], list(BANDS)
    both = lambda x, y: F.struct(F.upper(x).alias("aspect"), y.alias("band"))
    return F.when(F.size(w) == 2, F.when(a.isin(sectors) & b.isin(bands), both(a, b)).when(b.isin(sectors) & a.isin(bands), both(b, a)))


def epoch(s: Column) -> Column:
    """Seconds of an ISO 8601 time; null without an explicit zone."""
    zoned = s.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$")
    return F.when(zoned, F.unix_seconds(F.try_to_timestamp(s)))


def utm_epsg(lon: Column, lat: Column) -> Column:
    ok = lon.between(-180, 180) & lat.between(-90, 90)
    return F.when(ok, F.when(lat >= 0, 32600).otherwise(32700) + F.least(F.lit(60), F.floor((lon + 180) / 6) + 1)).cast("int")


def tile_x(lon: Column, z: Column | int) -> Column:
    n = F.pow(F.lit(2.0), F.lit(z) if isinstance(z, int) else z)
    return F.greatest(F.lit(0.0), F.least(n - 1, F.floor((lon + 180) / 360 * n))).cast("int")


def tile_y(lat: Column, z: Column | int) -> Column:
    n = F.pow(F.lit(2.0), F.lit(z) if isinstance(z, int) else z)
    r = F.radians(F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), lat)))
    y = (1 - F.log(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * n
    return F.greatest(F.lit(0.0), F.least(n - 1, F.floor(y))).cast("int")


def tile_lon(x: Column, z: Column) -> Column:
    return x / F.pow(F.lit(2.0), z) * 360 - 180


def tile_lat(y: Column, z: Column) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / F.pow(F.lit(2.0), z)))))


def native_zoom(cell_m: Column, lat: Column, max_zoom: int = 26) -> Column:
    """The first zoom whose pixels are no larger than a cell."""
    base = F.lit(2 * math.pi * 6378137.0 / 256) * F.cos(F.radians(lat))
    return F.greatest(F.lit(0), F.least(F.lit(max_zoom), F.ceil(F.log2(base / cell_m)))).cast("int")


def tile_id(z: Column, x: Column, y: Column) -> Column:
    """Place on the Hilbert curves of all zooms in turn: those below z hold (4**z - 1) / 3 tiles."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(s: Column, k: Column) -> Column:
        side = F.pow(F.lit(2.0), k).cast("long")
        rx, ry = F.when(s["x"].bitwiseAND(side) > 0, 1).otherwise(0), F.when(s["y"].bitwiseAND(side) > 0, 1).otherwise(0)
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, side - 1 - s["x"]).otherwise(s["x"]), F.when(flip, side - 1 - s["y"]).otherwise(s["y"])
        return F.struct(
            F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), (s["d"] + side * side * (3 * rx).bitwiseXOR(ry)).alias("d")
        )

    levels = F.when(z > 0, F.sequence(z.cast("int") - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(levels, start, step)["d"] + ((F.pow(F.lit(4.0), z) - 1) / 3).cast("long")


def utm_forward(lon: Column, lat: Column, lon0: Column) -> tuple[Column, Column]:
    """Easting and northing (northern false origin) by the Krueger series to n**4 (Karney 2011)."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    e = math.sqrt(f * (2 - f))
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    d = F.radians(lon - lon0)
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + 0.9996 * a * x, 0.9996 * a * y


def utm_inverse(x: Column, y: Column, lon0: Column) -> tuple[Column, Column]:
    """Longitude and latitude from easting and northing (northern false origin)."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    )
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    xi, eta = y / (0.9996 * a), (x - 500000) / (0.9996 * a)
    xi1, eta1 = xi, eta
    for j, c in enumerate(beta, 1):
        xi1 = xi1 - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, c in enumerate(delta, 1):
        lat = lat + c * F.sin(2 * j * chi)
    return lon0 + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(lat)


def degree_tiles(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """Names (north edge, west edge) of the one-degree tiles under a box, north to south, west to east."""
    north = F.sequence(F.ceil(max_y).cast("int"), F.floor(min_y).cast("int") + 1, F.lit(-1))
    west = F.sequence(F.floor(min_x).cast("int"), F.ceil(max_x).cast("int") - 1)
    name = lambda n, w: F.concat(
        F.when(n >= 0, "n").otherwise("s"), F.lpad(F.abs(n).cast("string"), 2, "0"), F.when(w >= 0, "e").otherwise("w"), F.lpad(F.abs(w).cast("string"), 3, "0")
    )
    return F.flatten(F.transform(north, lambda n: F.transform(west, lambda w: name(n, w))))
