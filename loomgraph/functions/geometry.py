"""Reading points and polygons from text, as JVM expressions where possible."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import computed

_N = r"[-+]?[0-9]+(?:\.[0-9]*)?(?:[eE][-+]?[0-9]+)?"
_WKT = rf"(?i)^\s*(?:SRID=\d+;)?\s*POINT\s*(?:ZM|Z|M)?\s*\(\s*({_N})\s+({_N})(?:\s+{_N}){{0,2}}\s*\)\s*$"
_JSON = rf'^\s*\{{[^\[]*"coordinates"\s*:\s*\[\s*({_N})\s*,\s*({_N})[^\]]*\][^\[]*$'
_PAIR = rf"^\s*\(?\s*({_N})\s*,\s*({_N})\s*\)?\s*$"
_WKB = r"^(?:01010000[0-9A-Fa-f]{2}(?:[0-9A-Fa-f]{8})?|00[0-9A-Fa-f]{2}000001(?:[0-9A-Fa-f]{8})?)[0-9A-Fa-f]{32,64}$"


def _let(value: Column, body) -> Column:
    """`body` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hex_double(h: Column) -> Column:
    """The IEEE double of 16 big-endian hex digits; null for infinities and NaN."""
    return _let(h, _hex_double_of)


def _hex_double_of(h: Column) -> Column:
    top = F.conv(F.substring(h, 1, 3), 16, 10).cast("int")
    exponent, mantissa = top % 2048, F.conv(F.substring(h, 4, 13), 16, 10).cast("double")
    sign = F.when(top >= 2048, -1.0).otherwise(1.0)
    normal = (1.0 + mantissa / float(2**52)) * F.pow(F.lit(2.0), exponent - 1023)
    return F.when(exponent == 0, sign * mantissa * 2.0**-1074).when(exponent < 2047, sign * normal)


def _swapped(h: Column) -> Column:
    return F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)])


def _wkb(t: Column, which: int) -> Column:
    """Ordinate 0 or 1 of a hex WKB or EWKB point of either byte order."""
    little = F.substring(t, 1, 2) == "01"
    flag = F.when(little, F.substring(t, 9, 2)).otherwise(F.substring(t, 3, 2))
    start = F.when(F.conv(flag, 16, 10).cast("int").bitwiseAND(0x20) != 0, 19).otherwise(11) + 16 * which
    h = t.substr(start, F.lit(16))
    return _hex_double(F.when(little, _swapped(h)).otherwise(h))


def with_point(df: DataFrame, keep: list, text: Column) -> DataFrame:
    """`keep`, lon and lat of WGS84 points in WKT, EWKT, GeoJSON, hex WKB or as a bare pair (latitude first); unreadable and out-of-range ones are dropped."""
    json = F.when(text.rlike(r'"type"\s*:\s*"Point"'), F.regexp_replace(text, _JSON, "$1|$2"))
    wkb = text.rlike(_WKB)
    found = F.when(wkb, None).when(text.contains("{"), json).when(text.contains("("), F.regexp_replace(F.regexp_replace(text, _WKT, "$1|$2"), _PAIR, "$2|$1")).otherwise(F.regexp_replace(text, _PAIR, "$2|$1"))
    read = computed(df, keep, _two=F.split(found, r"\|"), _wkb=F.when(wkb, text))
    of = lambda i: F.when(F.col("_wkb").isNotNull(), _wkb(F.col("_wkb"), i)).when(F.size("_two") == 2, F.get("_two", F.lit(i)).try_cast("double"))
    kept = [c for c in read.columns if c not in ("_two", "_wkb")]
    return computed(read, kept, lon=of(0), lat=of(1)).filter("abs(lon) <= 180 AND abs(lat) <= 90")


def polygon_rings(wkt: str | None) -> list[list[tuple[float, float]]]:
    """All rings of a POLYGON or MULTIPOLYGON text; by the even-odd rule over all of them a point is inside or not. Empty if unreadable."""
    if not wkt or not re.match(r"\s*(SRID=\d+;)?\s*(MULTI)?POLYGON\b", wkt, re.I):
        return []
    rings = []
    for ring in re.findall(r"\(([^()]+)\)", wkt):
        try:
            points = [(float(x[0]), float(x[1])) for x in (p.split() for p in ring.split(","))]
        except (ValueError, IndexError):
            return []
        if len(points) >= 3:
            rings.append(points if points[0] == points[-1] else [*points, points[0]])
    return rings
