"""Scalar functions: forgiving casts, times and days, distances, colours. All are Column expressions."""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_HAVERSINE = 6372797.560856
EARTH_RADIUS_COSINES = 6378100.0


def as_int(text: Column, kind: str = "int") -> Column:
    """The leading integer of a text, 0 if there is none or it does not fit."""
    return F.coalesce(F.regexp_extract(text.cast("string"), r"^\s*([+-]?[0-9]+)", 1).try_cast(kind), F.lit(0).cast(kind))


def as_double(text: Column) -> Column:
    """The leading decimal number of a text, 0 if there is none."""
    number = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
    return F.coalesce(F.regexp_extract(text.cast("string"), number, 1).try_cast("double"), F.lit(0.0))


def as_text(value: Column) -> Column:
    """A double with six decimals; null stays null."""
    return F.when(value.isNotNull(), F.format_string("%.6f", value.cast("double")))


def seconds_of_day(text: Column) -> Column:
    """``H:MM:SS`` as seconds; anything else is an error that names the value."""
    ok = text.rlike(r"^[0-9]{1,2}:[0-9]{2}:[0-9]{2}$")
    part = lambda k: F.split(text, ":")[k].cast("int")
    return F.when(text.isNull(), None).when(ok, part(0) * 3600 + part(1) * 60 + part(2)).otherwise(F.raise_error(F.concat(F.lit("not a time of day: "), text)).cast("int"))


def date_of(yyyymmdd: Column) -> Column:
    return F.try_to_date(yyyymmdd.cast("string"), "yyyyMMdd")


def weekday(yyyymmdd: Column, first: str = "sunday") -> Column:
    """0 to 6 from Sunday, or from Monday."""
    day = date_of(yyyymmdd)
    return (F.dayofweek(day) - 1) if first == "sunday" else F.weekday(day)


def minute_of_day(hhmm: Column) -> Column:
    """Minutes of a time given as HHMM; null outside 0 to 2400."""
    return F.when(hhmm.between(0, 2400), F.floor(hhmm / 100) * 60 + hhmm % 100).cast("int")


def half_hour(hhmm: Column) -> Column:
    """Half-hour slot 0 to 47; null outside the day."""
    slot = F.floor(minute_of_day(hhmm) / 30).cast("int")
    return F.when(slot < 48, slot)


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between points in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_HAVERSINE * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def law_of_cosines(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between points in degrees, by the spherical law of cosines."""
    c = F.sin(F.radians(lat1)) * F.sin(F.radians(lat2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return EARTH_RADIUS_COSINES * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def luma(red: Column, green: Column, blue: Column) -> Column:
    return 0.30 * red + 0.59 * green + 0.11 * blue


# Streets that are twice as wide, as addresses and as lines name them.
WIDE_STREETS = ("SPADINA AVE", "UNIVERSITY AVE", "ST CLAIR AVE")
WIDE_LINES = ("Spadina Ave", "University Ave", "St Clair Ave W")


def road_width(name: Column, width: float = 0.0002, wide: Sequence[object] = WIDE_STREETS) -> Column:
    """``width``, twice for the streets named ``wide``; a null name is no wide street."""
    return F.when(name.isin(*wide), 2 * width).otherwise(F.lit(width))


def unit_sphere(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """x, y, z on the unit sphere: y is the axis."""
    return F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.sin(F.radians(lat)), F.cos(F.radians(lat)) * F.sin(F.radians(lon))


def hex_colour(red: Column, green: Column, blue: Column, alpha: Column) -> Column:
    """aabbggrr of parts in [0, 1]."""
    byte = lambda c: F.lower(F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(c * 255))).cast("int")), 2, "0"))
    return F.concat(byte(alpha), byte(blue), byte(green), byte(red))


DEGREE = math.pi / 180
