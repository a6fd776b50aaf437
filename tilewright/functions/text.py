"""Names of photos and frames, written and read, and small text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns that other tools read names with.
ALTITUDE_PATTERN = r"(?i)__[A-Za-z0-9]*__(\d+(?:\.\d+)?)m"
GPS_PATTERN = r"^(-?\d+\.\d+)_(-?\d+\.\d+)-"
#: As the first, but it also reads names whose distance has a dot.
ANY_ALTITUDE_PATTERN = r"(?i)__[A-Za-z0-9.]*__(\d+(?:\.\d+)?)m"


def fix_name(lat: Column, lon: Column, fix_lat: Column, fix_lon: Column, distance_m: Column, alt_m: Column | None = None, position: Column | None = None) -> Column:
    """A photo's name: true position, estimated one (NOFIX without), distance; then the altitude, with a position's name
    in the survey's form."""
    fixed = F.format_string("%.7f_%.7f-%.7f_%.7f__%.1fm", lat, lon, fix_lat, fix_lon, distance_m)
    name = F.when(fix_lat.isNotNull() & fix_lon.isNotNull(), fixed).otherwise(F.format_string("%.7f_%.7f-NOFIX_NOFIX__NAm", lat, lon))
    if position is not None:
        name = F.concat(name, F.format_string("_pos%s_alt%.0fm", position, alt_m))
    elif alt_m is not None:
        name = F.concat(name, F.format_string("__%.1fm", alt_m))
    return F.concat(name, F.lit(".png"))


def live_name(ts: Column, alt_m: Column) -> Column:
    return F.concat(time_tag(ts), F.format_string("__live__%.1fm.jpg", alt_m))


def time_tag(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def parse_altitude(name: Column, pattern: str = ALTITUDE_PATTERN) -> Column:
    """The altitude in a name, null without. By default names of fixes with an altitude give null too, as their distance
    has a dot; ANY_ALTITUDE_PATTERN reads those."""
    return F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).cast("double")


def parse_gps(name: Column) -> Column:
    lat, lon = (F.nullif(F.regexp_extract(name, GPS_PATTERN, i), F.lit("")).cast("double") for i in (1, 2))
    return F.when(lat.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def without_commas(argument: Column) -> Column:
    """An argument without commas at its ends."""
    return F.btrim(argument, F.lit(","))
