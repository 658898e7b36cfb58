"""Great-circle distance and the sun's position, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from featherline.functions.times import micros

EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_lon), 2
    )
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def sun_declination_and_time(ts: Column) -> tuple[Column, Column]:
    """Declination in degrees and equation of time in minutes (low-precision almanac series).

    Days are counted from 2000-01-01 12:00 UTC.
    """
    d = micros(ts) / F.lit(8.64e10) - F.lit(10957.5)
    mean_anomaly = F.radians(F.lit(357.529) + F.lit(0.98560028) * d)
    mean_longitude = F.pmod(F.lit(280.459) + F.lit(0.98564736) * d, F.lit(360.0))
    longitude = F.radians(
        mean_longitude + F.lit(1.915) * F.sin(mean_anomaly) + F.lit(0.020) * F.sin(2 * mean_anomaly)
    )
    tilt = F.radians(F.lit(23.439) - F.lit(0.00000036) * d)
    declination = F.degrees(F.asin(F.sin(tilt) * F.sin(longitude)))
    ascension = F.degrees(F.atan2(F.cos(tilt) * F.sin(longitude), F.cos(longitude)))
    lag = F.pmod(mean_longitude - ascension + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)
    return declination, lag * 4


def solar_zenith(ts: Column, lat: Column, lon: Column) -> Column:
    """Angle of the sun from straight overhead, in degrees, without refraction."""
    declination, equation = sun_declination_and_time(ts)
    minute = F.pmod(micros(ts) / F.lit(6e7), F.lit(1440.0))
    hour_angle = F.radians((minute + equation) / 4 + lon - F.lit(180.0))
    cosine = F.sin(F.radians(lat)) * F.sin(F.radians(declination)) + F.cos(F.radians(lat)) * F.cos(
        F.radians(declination)
    ) * F.cos(hour_angle)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
