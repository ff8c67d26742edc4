"""Column functions on places, dates and the sun."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km, radius 6371 (FN-11)."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 6371 * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def dms_to_decimal(dms: Column, ref: Column) -> Column:
    """Degrees, minutes, seconds to degrees; negative for S and W; null where parts are missing (FN-12)."""
    value = F.get(dms, 0) + F.get(dms, 1) / 60 + F.get(dms, 2) / 3600
    return F.when(F.size(dms) >= 3, F.when(ref.isin("S", "W"), -value).otherwise(value))


def exif_date(number: Column, text: Column) -> Column:
    """Day of an EXIF time: an epoch in seconds, or ``YYYY:MM:DD ...`` (FN-13)."""
    from_text = F.when(text.rlike(r"^\d{4}[:-]\d{2}[:-]\d{2}"), F.regexp_replace(F.substring(text, 1, 10), ":", "-"))
    return F.coalesce(F.date_format(F.timestamp_seconds(number), "yyyy-MM-dd"), from_text)


def exif_year(text: Column) -> Column:
    """The first four digits in a row (FN-13)."""
    year = F.regexp_extract(text, r"(\d{4})", 1)
    return F.when(year != "", year.cast("int"))


def julian_day(ts: Column) -> Column:
    """Julian day of a UTC time: the integer day of the proleptic calendar plus (hours - 12) / 24 (FN-14)."""
    day = F.unix_date(F.to_date(ts)) + 2440588
    hours = F.hour(ts) + F.minute(ts) / 60 + F.second(ts) / 3600
    return day + (hours - 12) / 24


def turn(c: Column) -> Column:
    """An angle within (-360, 360), its sign kept."""
    return c % 360


def sun_position(lat: Column, lon: Column, ts: Column) -> Column:
    """Struct (altitude, azimuth, declination) in degrees, low-precision almanac (FN-15)."""
    n = julian_day(ts) - 2451545.0
    mean_long = turn(280.460 + 0.9856474 * n)
    anomaly = F.radians(turn(357.528 + 0.9856003 * n))
    ecliptic = F.radians(mean_long + 1.915 * F.sin(anomaly) + 0.020 * F.sin(2 * anomaly))
    tilt = F.radians(23.439 - 0.0000004 * n)
    dec = F.asin(F.sin(tilt) * F.sin(ecliptic))
    ra = F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic))
    sidereal = F.radians(turn(280.460 + 360.9856474 * n) + lon)
    hour = sidereal - ra
    p = F.radians(lat)
    alt = F.asin(F.sin(p) * F.sin(dec) + F.cos(p) * F.cos(dec) * F.cos(hour))
    cos_az = (F.sin(dec) - F.sin(p) * F.sin(alt)) / (F.cos(p) * F.cos(alt))
    az = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_az))))
    return F.struct(F.degrees(alt).alias("altitude"), F.when(F.sin(hour) > 0, 360 - az).otherwise(az).alias("azimuth"), F.degrees(dec).alias("declination"))


def expected_shadow(altitude: Column, azimuth: Column) -> Column:
    """Struct (exists, ratio, direction) of a shadow (FN-16)."""
    up = altitude > 0
    return F.struct(up.alias("exists"), F.when(up, 1 / F.tan(F.radians(altitude))).alias("ratio"), F.when(up, turn(azimuth + 180)).alias("direction"))


def day_of_year(ts: Column) -> Column:
    """FN-17."""
    return F.dayofyear(ts)


def landmark_class(km: Column) -> Column:
    """JOIN-9: how near a landmark is; without a distance unknown."""
    return F.when(km < 1, "exact").when(km < 10, "close").when(km.isNotNull(), "distant").otherwise("unknown")
