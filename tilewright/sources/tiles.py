"""Map tiles: images in {folder}/{zoom}/{x}/{y}.png, planning of what to fetch, photo files and small JSON records."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions import geo

PLACE = r"/(\d+)/(\d+)/(\d+)\.png$"


def read_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """zoom, tile_x, tile_y and image of every readable tile; unreadable ones are dropped."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").option("pathGlobFilter", "*.png").load(folder)
    zoom, x, y = (F.regexp_extract("image.origin", PLACE, i).try_cast("int").alias(n) for i, n in ((1, "zoom"), (2, "tile_x"), (3, "tile_y")))
    return images.select(zoom, x, y, "image").where("zoom is not null")


def tile_files(spark: SparkSession, folder: str) -> DataFrame:
    """zoom, tile_x, tile_y of every tile file, without reading images."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(folder).select("path")
    return files.select(*[F.regexp_extract("path", PLACE, i).try_cast("int").alias(n) for i, n in ((1, "zoom"), (2, "tile_x"), (3, "tile_y"))]).where("zoom is not null")


def _place(lat: float, lon: float, zoom: int) -> tuple[int, int]:
    n = 2**zoom
    return int((lon + 180) / 360 * n), int((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n)


def box_tiles(spark: SparkSession, lat_min: float, lon_min: float, lat_max: float, lon_max: float, zoom: int) -> DataFrame:
    """All tiles of a box with both its edges."""
    x0, y0 = _place(lat_max, lon_min, zoom)
    x1, y1 = _place(lat_min, lon_max, zoom)
    rows = spark.range(x0, x1 + 1).select(F.lit(zoom).alias("zoom"), F.col("id").cast("int").alias("tile_x"))
    return rows.withColumn("tile_y", F.explode(F.sequence(F.lit(y0), F.lit(y1))))


def to_fetch(planned: DataFrame, present: DataFrame) -> DataFrame:
    """Planned tiles that are not there yet."""
    return planned.join(present, ["zoom", "tile_x", "tile_y"], "left_anti")


def read_photos(spark: SparkSession, folder: str) -> DataFrame:
    """Photo files (png, jpg, jpeg in any case), oldest first."""
    files = spark.read.format("binaryFile").load(folder)
    return files.where(F.lower("path").rlike(r"\.(png|jpe?g)$")).select("path", F.col("modificationTime").alias("modified"), "content").orderBy("modified", "path")


HOME = T.StructType().add("lat", "double").add("lon", "double").add("alt_msl", "double").add("rel_alt", "double").add("time", "string")
ATTITUDE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("roll_deg", "pitch_deg", "yaw_deg", "alt_m", "lat", "lon")])


def read_json(spark: SparkSession, path: str, schema: T.StructType = HOME) -> DataFrame:
    """Records of JSON files that span lines; malformed ones and those without a position are dropped."""
    return spark.read.schema(schema).json(path, multiLine=True).where("lat is not null and lon is not null")


def _places(x: Column, n: int) -> Column:
    """x to n places by scaling, so that ties of the scaled value go away from zero."""
    return F.round(x * F.lit(10.0**n)) / F.lit(10.0**n)


def attitude_json(roll: Column, pitch: Column, yaw: Column, alt: Column, lat: Column, lon: Column) -> Column:
    """The sidecar record of a photo: angles with 4 places, altitude with 1, position with 7."""
    places = {"roll_deg": (roll, 4), "pitch_deg": (pitch, 4), "yaw_deg": (yaw, 4), "alt_m": (alt, 1), "lat": (lat, 7), "lon": (lon, 7)}
    return F.to_json(F.struct(*[_places(x, n).alias(name) for name, (x, n) in places.items()]))


def gps_input(rows: DataFrame, hacc: Column, ignore: int = 191) -> DataFrame:
    """Message rows of position input; nothing is sent."""
    return rows.select("flight", "msg", (F.col("lat") * 1e7).cast("bigint").alias("lat_e7"), (F.col("lon") * 1e7).cast("bigint").alias("lon_e7"), hacc.alias("hacc_m"), F.lit(ignore).alias("ignore_flags"), F.lit(3).alias("fix_type"))


def position_messages(rows: DataFrame, vn: Column, ve: Column, hacc: Column) -> DataFrame:
    """Full message rows of a second receiver's position (flight, msg, ts, lat, lon, alt_m): with the time, velocity and
    accuracy that an estimator sends; vertical velocity, speed and vertical accuracy are marked as ignored. Nothing is sent."""
    now = geo.gps_week_ms(F.col("ts"))
    fixed = {"gps_id": 1, "ignore_flags": 16 + 32 + 128, "fix_type": 3, "satellites_visible": 10, "yaw": 0}
    reals = {"hdop": 1.0, "vdop": 1.5, "vd": 0.0, "speed_accuracy": 0.3, "vert_accuracy": 0.0}
    lat, lon = ((F.col(k) * 1e7).cast("bigint").alias(f"{k}_e7") for k in ("lat", "lon"))
    return rows.select("flight", "msg", F.unix_micros(F.col("ts").cast("timestamp")).alias("time_usec"), now["week"].alias("time_week"), now["ms"].alias("time_week_ms"), lat, lon, F.col("alt_m").alias("alt"), vn.alias("vn"), ve.alias("ve"), hacc.alias("horiz_accuracy"), *[F.lit(v).alias(k) for k, v in (fixed | reals).items()])


def download_counts(plan: DataFrame, present: DataFrame) -> DataFrame:
    """Of each zoom's planned tiles (zoom, tile_x, tile_y): how many are there (ok) and how many are not (failed)."""
    keys = ["zoom", "tile_x", "tile_y"]
    found = plan.select(*keys).distinct().join(present.select(*keys).distinct().withColumn("__there", F.lit(True)), keys, "left")
    return found.groupBy("zoom").agg(F.count("__there").alias("ok"), F.count_if(F.col("__there").isNull()).alias("failed"))


def merged_state(messages: DataFrame) -> DataFrame:
    """Decoded vehicle messages (flight, ts, msg, kind, values in wire units) -> a state row for each: the newest position,
    attitude and arming so far, in degrees and metres. Heartbeats of ground stations (vehicle_type 6) count for nothing."""
    from pyspark.sql import Window as W

    now = W.partitionBy("flight").orderBy("ts", "msg").rowsBetween(W.unboundedPreceding, W.currentRow)
    kind = F.col("kind")
    position = F.when(kind == "GLOBAL_POSITION_INT", F.struct((F.col("lat_e7") / 1e7).alias("lat"), (F.col("lon_e7") / 1e7).alias("lon"), (F.col("rel_alt_mm") / 1e3).alias("alt_m")))
    attitude = F.when(kind == "ATTITUDE", F.struct(*[F.degrees(f"{k}_rad").alias(f"{k}_deg") for k in ("roll", "pitch", "yaw")]))
    heartbeat = F.when((kind == "HEARTBEAT") & (F.coalesce("vehicle_type", F.lit(0)) != 6), F.struct((F.col("base_mode").bitwiseAND(F.lit(128)) != 0).alias("armed")))
    state = {k: F.last(c, ignorenulls=True).over(now) for k, c in (("p", position), ("a", attitude), ("h", heartbeat))}
    out = messages.select("flight", "ts", "msg", *[c.alias(k) for k, c in state.items()])
    return out.select("flight", "ts", "msg", "p.lat", "p.lon", "p.alt_m", "a.roll_deg", "a.pitch_deg", "a.yaw_deg", "h.armed", F.col("p").isNotNull().alias("gps_ok"))


def simulated_vehicle(spark: SparkSession, steps: int, lat0: float = 25.05, lon0: float = 121.47) -> DataFrame:
    """Steps of a synthetic flight: a climb, then a swaying altitude, with a position that drifts."""
    from pyspark.sql import Window as W

    k = F.col("id")
    alt = F.when(k < 20, k * 2.75).otherwise(55 + 1.2 * F.sin(0.3 * k))
    w = W.partitionBy("flight").orderBy("id").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = spark.range(steps).withColumn("flight", F.lit(0))
    return rows.select("flight", k.alias("step"), alt.alias("alt_m"), (lat0 + F.sum(1e-6 * F.sin(0.1 * k)).over(w)).alias("lat"), (lon0 + F.sum(1e-6 * F.cos(0.1 * k)).over(w)).alias("lon"))


def write_home(rows: DataFrame, path: str) -> None:
    """Home records (lat, lon, alt_msl, rel_alt, time) as JSON."""
    rows.select(*HOME.fieldNames()).write.mode("overwrite").json(path)
