"""Great-circle distances."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def parse_km(distance: float | str) -> float:
    """Kilometres of a number, or of a string with km, m or no unit."""
    if isinstance(distance, (int, float)) and not isinstance(distance, bool):
        return float(distance)
    m = re.fullmatch(r"\s*([+-]?\d+(?:\.\d+)?)\s*(km|m)?\s*", str(distance).lower())
    if not m:
        raise ValueError(f"no distance: {distance!r}")
    return float(m[1]) / (1000 if m[2] == "m" else 1)


def parse_point(center) -> tuple[float, float]:
    """(lat, lon) of a pair or a mapping; a pair whose first number can't be a latitude is taken as (lon, lat)."""
    if isinstance(center, dict):
        return float(center["lat"]), float(center["lon"])
    a, b = map(float, center)
    return (a, b) if abs(a) <= 90 and abs(b) <= 180 else (b, a)


def near(lat: Column, lon: Column, center: tuple[float, float], km: float) -> Column:
    """Whether a point is within the distance. A bounding box goes first, which Parquet can use to skip row groups."""
    lat0, lon0 = center
    dlat = math.degrees(km / EARTH_KM) * 1.000001 + 1e-9
    box = lat.between(lat0 - dlat, lat0 + dlat)
    edge = max(abs(lat0 - dlat), abs(lat0 + dlat))
    if edge < 89.9:
        x = math.sin(min(km / EARTH_KM / 2, math.pi / 2)) / math.cos(math.radians(edge))
        dlon = math.degrees(2 * math.asin(min(1.0, x))) * 1.000001 + 1e-9
        if lon0 - dlon >= -180 and lon0 + dlon <= 180:
            box = box & lon.between(lon0 - dlon, lon0 + dlon)
    return box & (haversine_km(lat, lon, F.lit(lat0), F.lit(lon0)) <= km)
