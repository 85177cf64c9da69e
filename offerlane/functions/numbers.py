"""Distances, ramps, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.asin(F.sqrt(h))


def ramp(x: Column, bad: float, good: float) -> Column:
    """0 at bad, 1 at good, straight between, clamped; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - bad) / (good - bad))))


def drive_hours(km: Column) -> Column:
    return km * 1.25 / 100


def within_radius(km: Column, radius: float) -> Column:
    """An offer without a place stays."""
    return km.isNull() | (km <= radius)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def softmax(v: Column) -> Column:
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def log_softmax(v: Column) -> Column:
    top = F.array_max(v)
    total = F.ln(F.aggregate(v, F.lit(0.0), lambda s, y: s + F.exp(y - top)))
    return F.transform(v, lambda x: x - top - total)


def unit(v: Column) -> Column:
    """The vector at length one."""
    return F.transform(v, lambda x: x / F.sqrt(dot(v, v)))
