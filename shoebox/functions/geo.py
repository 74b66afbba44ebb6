"""Coordinates and place labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def degrees(parts: Column) -> Column:
    """Degrees from an array of one decimal value or of degrees, minutes, seconds; else null."""
    at = lambda i: F.try_element_at(parts, F.lit(i))
    return F.when(F.size(parts) == 3, at(1) + at(2) / 60 + at(3) / 3600).when(F.size(parts) == 1, at(1))


def position(lat: Column, lat_ref: Column, lng: Column, lng_ref: Column) -> Column:
    """Struct (lat, lng) in decimal degrees; null if missing, out of range or (0, 0)."""
    turned = lambda value, ref, letter: F.when(F.upper(F.coalesce(ref, F.lit(""))).startswith(letter), -value).otherwise(value)
    y, x = turned(degrees(lat), lat_ref, "S"), turned(degrees(lng), lng_ref, "W")
    return F.when(y.between(-90, 90) & x.between(-180, 180) & ~((y == 0) & (x == 0)), F.struct(y.alias("lat"), x.alias("lng")))


def gps_field(gps: Column, tag: int, name: str) -> Column:
    """A GPS value from a string map keyed by tag number or by tag name."""
    return F.coalesce(F.try_element_at(gps, F.lit(str(tag))), F.try_element_at(gps, F.lit(name)))


def position_of_map(gps: Column) -> Column:
    """:func:`position` of a raw EXIF map whose values are JSON numbers or arrays."""
    def numbers(tag, name):
        text = gps_field(gps, tag, name)
        return F.when(text.startswith("["), F.from_json(text, "array<double>")).otherwise(F.array(text.try_cast("double")))

    return position(numbers(2, "GPSLatitude"), gps_field(gps, 1, "GPSLatitudeRef"), numbers(4, "GPSLongitude"), gps_field(gps, 3, "GPSLongitudeRef"))


def rounded(value: Column) -> Column:
    """Four decimals, half to even on the decimal form."""
    return F.bround(value, 4)


def coordinate_key(lat: Column, lng: Column) -> Column:
    return F.format_string("%.4f,%.4f", rounded(lat), rounded(lng))


def city_label(city: Column, country: Column) -> Column:
    """``city, cc``, or the one that is not blank, or ``Unknown``."""
    city, country = (F.nullif(F.trim(c), F.lit("")) for c in (city, country))
    return F.coalesce(F.nullif(F.concat_ws(", ", city, country), F.lit("")), F.lit("Unknown"))
