"""Column functions over coordinates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecheck import rule_values as rv

WGS84_KM = 6378.137
WGS84_FLATTENING = 1 / 298.257223563

# Cells per degree. Fine cells serve density maps and short radii, coarse ones long radii.
CELL_COARSE, CELL_FINE = 25, 200


def central_angle(
    b1: Column, l1: Column, b2: Column, l2: Column, cos1: Column | None = None, cos2: Column | None = None
) -> Column:
    """Angle between two points whose latitudes and longitudes are in radians; ``cos1`` and ``cos2`` are the cosines of the
    latitudes where they are known."""
    cos1 = F.cos(b1) if cos1 is None else cos1
    cos2 = F.cos(b2) if cos2 is None else cos2
    half_lat = F.sin((b2 - b1) / 2)
    half_lon = F.sin((l2 - l1) / 2)
    h = half_lat * half_lat + cos1 * cos2 * half_lon * half_lon
    return F.lit(2.0) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


@dataclass(frozen=True)
class Metric:
    """A distance in two steps, so that each point is prepared once however many pairs it joins.

    ``latitude`` turns degrees into the radians the angle is taken between; ``km`` turns
    both latitudes and the angle into kilometres.
    """

    latitude: Callable[[Column], Column]
    km: Callable[[Column, Column, Column], Column]


def _reduced(lat: Column) -> Column:
    return F.atan(F.lit(1 - WGS84_FLATTENING) * F.tan(F.radians(lat)))


def _lambert(b1: Column, b2: Column, sigma: Column) -> Column:
    f = WGS84_FLATTENING
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    sin_p, cos_p, sin_q, cos_q = F.sin(p), F.cos(p), F.sin(q), F.cos(q)
    sin_half, cos_half = F.sin(sigma / 2), F.cos(sigma / 2)
    x = (sigma - F.sin(sigma)) * sin_p * sin_p * cos_q * cos_q / (cos_half * cos_half)
    y = (sigma + F.sin(sigma)) * cos_p * cos_p * sin_q * sin_q / (sin_half * sin_half)
    distance = F.lit(WGS84_KM) * (sigma - F.lit(f / 2) * (x + y))
    return F.when(sigma == 0, F.lit(0.0)).otherwise(distance)


# On the sphere, and on WGS-84 by Lambert's closed formula.
SPHERE = Metric(F.radians, lambda b1, b2, sigma: F.lit(rv.EARTH_RADIUS_KM) * sigma)
ELLIPSOID = Metric(_reduced, _lambert)


def distance_km(metric: Metric, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    b1, b2 = metric.latitude(lat1), metric.latitude(lat2)
    return metric.km(b1, b2, central_angle(b1, F.radians(lon1), b2, F.radians(lon2)))


def within(df: DataFrame, km: str, limit: str) -> DataFrame:
    """Rows whose column ``km`` is at most the column ``limit``.

    Written over an outer explode of one value: a plain filter would be pushed into the join
    below, where the distance would be spelled out, and computed, once more.
    """
    measured = df.withColumn("_km", F.explode_outer(F.array(km)))
    return measured.where(F.col("_km") <= F.col(limit)).drop("_km")


def round_km(km: Column) -> Column:
    """``round(km, 6)``, without its decimal numbers where the digits after the sixth are not close to a half.

    A quotient of whole numbers is the double nearest to its decimal form, as that of ``round`` is.
    """
    scaled = km * 1e6
    plain = km.between(0, 1e6) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    return F.when(plain, F.floor(scaled + 0.5) / F.lit(1e6)).otherwise(F.round(km, 6))


def cell_index(degrees: Column, offset: int, per_degree: Column | int) -> Column:
    return F.floor((degrees + F.lit(float(offset))) * per_degree).cast("bigint")


def cell_id(lat: Column, lon: Column, per_degree: int) -> Column:
    """Grid cell of a point as text ``row_column``; null where a coordinate is missing."""
    row = cell_index(lat, 90, per_degree).cast("string")
    column = cell_index(lon, 180, per_degree).cast("string")
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat(row, F.lit("_"), column))


def wkt_point(lat: Column, lon: Column) -> Column:
    """``POINT(lon lat)``; null where a coordinate is missing."""
    text = F.concat(
        F.lit("POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")")
    )
    return F.when(lat.isNotNull() & lon.isNotNull(), text)


def in_box(lat: Column, lon: Column) -> Column:
    """Inside the box columns of the row, bounds included."""
    return lat.between(F.col("min_lat"), F.col("max_lat")) & lon.between(
        F.col("min_lon"), F.col("max_lon")
    )
