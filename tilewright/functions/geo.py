"""Geographic and slippy-tile functions as Column expressions. Angles are degrees and distances metres; nulls give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.config import EARTH_RADIUS_M, GPS_EPOCH_S, METRES_PER_DEGREE, WEEK_S, Odometry

PI = 3.141592653589793


def _tiles(zoom: Column) -> Column:
    return F.pow(F.lit(2.0), zoom)


def tile_x(lon: Column, zoom: Column) -> Column:
    return F.floor((lon + 180.0) / 360.0 * _tiles(zoom)).cast("int")


def tile_y(lat: Column, zoom: Column) -> Column:
    return F.floor((1.0 - F.asinh(F.tan(F.radians(lat))) / PI) / 2.0 * _tiles(zoom)).cast("int")


def lon_of(x: Column, zoom: Column) -> Column:
    """Longitude of a (fractional) tile column: of the tile's west edge for a whole one."""
    return x / _tiles(zoom) * 360.0 - 180.0


def lat_of(y: Column, zoom: Column) -> Column:
    """Latitude of a (fractional) tile row: of the tile's north edge for a whole one."""
    return F.degrees(F.atan(F.sinh(PI * (1.0 - 2.0 * y / _tiles(zoom)))))


def tile_bounds(x: Column, y: Column, zoom: Column) -> Column:
    return F.struct(lat_of(y, zoom).alias("lat_nw"), lon_of(x, zoom).alias("lon_nw"), lat_of(y + 1, zoom).alias("lat_se"), lon_of(x + 1, zoom).alias("lon_se"))


def tile_centre(x: Column, y: Column, zoom: Column) -> Column:
    """Mean of the edges (not the middle of the projection)."""
    return F.struct(((lat_of(y, zoom) + lat_of(y + 1, zoom)) / 2).alias("lat"), ((lon_of(x, zoom) + lon_of(x + 1, zoom)) / 2).alias("lon"))


def pixel_to_latlon(x: Column, y: Column, zoom: Column, px: Column, py: Column, size: int = 256, exact: bool = True) -> Column:
    """Position of a tile's pixel: by the projection, or (exact=False) linear between the tile's edges."""
    if exact:
        lat, lon = lat_of(y + py / float(size), zoom), lon_of(x + px / float(size), zoom)
    else:
        lat = lat_of(y, zoom) + (lat_of(y + 1, zoom) - lat_of(y, zoom)) * py / float(size)
        lon = lon_of(x, zoom) + (lon_of(x + 1, zoom) - lon_of(x, zoom)) * px / float(size)
    return F.struct(lat.alias("lat"), lon.alias("lon"))


def metres_per_pixel(lat: Column, zoom: Column) -> Column:
    return 156543.03 * F.cos(F.radians(lat)) / _tiles(zoom)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def offset_latlon(lat: Column, lon: Column, north_m: Column, east_m: Column) -> Column:
    """A flat-earth step; the east part is scaled at the latitude before it."""
    return F.struct((lat + north_m / METRES_PER_DEGREE).alias("lat"), (lon + east_m / (METRES_PER_DEGREE * F.cos(F.radians(lat)))).alias("lon"))


def bearing_error_deg(err_m: Column, dist_m: Column) -> Column:
    return F.degrees(F.atan2(err_m, dist_m))


def from_e7(value: Column) -> Column:
    return value / 1e7


def to_e7(degrees: Column) -> Column:
    """Whole 1e-7 degrees, towards zero."""
    return (degrees * 1e7).cast("bigint")


def gps_week_ms(ts: Column) -> Column:
    """GPS week and milliseconds of the week, without leap seconds."""
    ms = F.unix_millis(ts.cast("timestamp")) - GPS_EPOCH_S * 1000
    return F.struct(F.floor(ms / (WEEK_S * 1000)).cast("bigint").alias("week"), F.pmod(ms, F.lit(WEEK_S * 1000)).alias("ms"))


def maps_pin(lat: Column, lon: Column) -> Column:
    return F.format_string("https://www.google.com/maps?q=%.7f,%.7f", lat, lon)


def maps_satellite(lat: Column, lon: Column) -> Column:
    return F.format_string("https://www.google.com/maps/@%.7f,%.7f,100m/data=!3m1!1e3", lat, lon)


def focal_px(cfg: Odometry = Odometry()) -> tuple[float, float]:
    """Focal lengths in pixels from the footprint at the reference altitude."""
    return cfg.width / 2 * (cfg.reference_altitude_m / (cfg.footprint_w_m / 2)), cfg.height / 2 * (cfg.reference_altitude_m / (cfg.footprint_h_m / 2))


def ground_sampling(altitude_m: Column, cfg: Odometry = Odometry()) -> Column:
    """Metres of ground per pixel, for both axes."""
    fx, fy = focal_px(cfg)
    return F.struct((altitude_m / fx).alias("x"), (altitude_m / fy).alias("y"))


def altitude_used(first: Column, second: Column, cfg: Odometry = Odometry()) -> Column:
    """The mean of a pair's altitudes, or the one there is, or the reference; 0 counts as missing."""
    a, b = F.nullif(first, F.lit(0.0)), F.nullif(second, F.lit(0.0))
    return F.coalesce((a + b) / 2, a, b, F.lit(cfg.reference_altitude_m))
