"""Tracking: trajectories, dead reckoning with an accuracy recurrence, resending and interpolation."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.config import METRES_PER_DEGREE, Odometry
from tilewright.operators.telemetry import fold, until_now

ORDER = ("ts", "leg")


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def pairs(frames: DataFrame, flight: str = "flight", order: tuple[str, ...] = ("ts", "frame")) -> DataFrame:
    """Consecutive frames of a flight; dt_s is null unless time goes forward between them."""
    w = W.partitionBy(flight).orderBy(*order)
    dt = (_micros(F.lead("ts").over(w)) - _micros(F.col("ts"))) / 1e6
    out = frames.withColumns({"next_frame": F.lead("frame").over(w), "dt_s": F.when(dt > 0, dt)})
    return out.where("next_frame is not null").select(flight, "frame", "next_frame", "dt_s")


def trajectory(legs: DataFrame) -> DataFrame:
    """Relative path: legs that are ok and confident turn and move it, others repeat the last point."""
    w = until_now(W.partitionBy("flight").orderBy(*ORDER))
    used = F.col("ok") & F.col("confident")
    turned = legs.withColumn("heading", F.sum(F.when(used, F.col("yaw_deg")).otherwise(0.0)).over(w))
    a = F.radians("heading")
    x = F.when(used, F.col("dx_m") * F.cos(a) - F.col("dy_m") * F.sin(a)).otherwise(0.0)
    y = F.when(used, F.col("dx_m") * F.sin(a) + F.col("dy_m") * F.cos(a)).otherwise(0.0)
    return turned.select("flight", "leg", "heading", F.sum(x).over(w).alias("x_m"), F.sum(y).over(w).alias("y_m"))


def segments(legs: DataFrame) -> DataFrame:
    """legs with segment (the number of anchors so far) and legs_since_anchor; anchors are no legs."""
    w = until_now(W.partitionBy("flight").orderBy(*ORDER))
    counted = legs.withColumn("segment", F.sum(F.col("anchor").cast("int")).over(w))
    inside = until_now(W.partitionBy("flight", "segment").orderBy(*ORDER))
    return counted.withColumn("legs_since_anchor", F.sum((~F.col("anchor")).cast("int")).over(inside))


def dead_reckoning(legs: DataFrame, home: tuple[float, float, float], mount_deg: float = 0.0, altitude: bool = False) -> DataFrame:
    """Position after each leg since its anchor: every ok leg turns first and then moves; the east step is scaled at the
    new latitude. vn and ve are 0 where the time step is missing.

    An anchor is where its own fix says (anchor_lat, anchor_lon, anchor_heading, anchor_alt_m, those that legs have and
    that are not null), else at home (lat, lon, heading); mount_deg is the camera's turn against the airframe. With
    `altitude` the result has alt_m too: the anchor's, 0 if unknown, and the altitude changes (altitude_change_m) since.
    """
    w = W.partitionBy("flight", "segment").orderBy(*ORDER)

    def base(name: str, default: float) -> Column:
        own = F.first(F.when(F.col("anchor"), F.col(name))).over(until_now(w)) if name in legs.columns else F.lit(None)
        return F.coalesce(own, F.lit(default))

    lat0, lon0, heading0 = (base(f"anchor_{k}", x) for k, x in zip(("lat", "lon", "heading"), home, strict=True))
    moves = F.col("ok") & ~F.col("anchor")
    t = segments(legs).withColumn("heading", heading0 + mount_deg + F.sum(F.when(moves, F.col("yaw_deg")).otherwise(0.0)).over(until_now(w)))
    a = F.radians("heading")
    north = F.when(moves, -F.col("dy_m") * F.cos(a) - F.col("dx_m") * F.sin(a)).otherwise(0.0)
    east = F.when(moves, -F.col("dy_m") * F.sin(a) + F.col("dx_m") * F.cos(a)).otherwise(0.0)
    dt = (_micros(F.col("ts")) - _micros(F.lag("ts").over(w))) / 1e6
    t = t.withColumns({"north_m": north, "east_m": east, "dt_s": F.when(dt > 0, dt)})
    t = t.withColumn("lat", lat0 + F.sum(F.col("north_m") / METRES_PER_DEGREE).over(until_now(w)))
    t = t.withColumn("lon", lon0 + F.sum(F.col("east_m") / (METRES_PER_DEGREE * F.cos(F.radians("lat")))).over(until_now(w)))
    speed = {f"v{k[0]}": F.coalesce(F.col(k) / F.col("dt_s"), F.lit(0.0)) for k in ("north_m", "east_m")}
    climbed = F.sum(F.when(moves, F.coalesce("altitude_change_m", F.lit(0.0))).otherwise(0.0)).over(until_now(w)) if altitude else F.lit(0.0)
    t = t.withColumns(speed | ({"alt_m": base("anchor_alt_m", 0.0) + climbed} if altitude else {}))
    return t.select("flight", "leg", "segment", "legs_since_anchor", "heading", "lat", "lon", *(["alt_m"] if altitude else []), "vn", "ve")


def next_accuracy(h: float, ok: bool | None, confident: bool | None, anchor: bool | None, magnitude_m: float | None, anchor_m: float | None, cfg: Odometry) -> float:
    """The accuracy after a leg, or of an anchor."""
    if anchor:
        return cfg.hacc_anchor_m if anchor_m is None else anchor_m
    if not ok or magnitude_m is None:
        return min(cfg.hacc_cap_m, h + cfg.fail_extra_m)
    if confident:
        return min(cfg.hacc_cap_m, math.hypot(h, cfg.confident_rate * magnitude_m))
    return min(cfg.hacc_cap_m, math.hypot(h, cfg.low_rate * magnitude_m) + cfg.low_extra_m)


def accuracy(legs: DataFrame, cfg: Odometry = Odometry()) -> DataFrame:
    """flight, leg, hacc_m: the accuracy after each leg. Anchors set it, to their own if they have one (anchor_hacc_m);
    failed legs add to it; others combine it with a share of their length; it is capped, so it is a fold and no running sum."""
    columns = ["ok", "confident", "anchor", "magnitude_m", *(["anchor_hacc_m"] if "anchor_hacc_m" in legs.columns else [])]

    def step(h, part: pa.RecordBatch):
        h, out = cfg.hacc_anchor_m if h is None else h, []
        for ok, confident, anchor, m, *own in zip(*(part.column(c).to_pylist() for c in columns), strict=True):
            h = next_accuracy(h, ok, confident, anchor, m, own[0] if own else None, cfg)
            out.append(h)
        return h, pa.record_batch([part.column("flight"), part.column("leg"), pa.array(out, pa.float64())], names=["flight", "leg", "hacc_m"])

    narrow = legs.select("flight", "leg", "ts", *columns)
    return fold(narrow, step, T.StructType([narrow.schema["flight"], narrow.schema["leg"], T.StructField("hacc_m", T.DoubleType())]), "flight", ORDER)


def resend(states: DataFrame, every_s: int, flight: str = "flight", order: tuple[str, ...] = ("ts", "msg")) -> DataFrame:
    """Each state again and again until the next one of its flight; the last one once."""
    w = W.partitionBy(flight).orderBy(*order)
    until = F.coalesce(F.greatest(F.col("ts"), F.lead("ts").over(w) - F.expr("INTERVAL 1 MICROSECOND")), F.col("ts"))
    return states.withColumn("until", until).withColumn("sent", F.explode(F.sequence("ts", "until", F.expr(f"INTERVAL {every_s} SECONDS")))).drop("until")


def interpolate(moves: DataFrame, hz: float) -> DataFrame:
    """A move's samples: n of them at equal parts from its start with a constant velocity, then its end at rest.

    moves: move, lat0, lon0, lat1, lon1, seconds.
    """
    n = F.greatest(F.lit(1), F.floor(F.col("seconds") * hz)).cast("int")
    vn = F.try_divide((F.col("lat1") - F.col("lat0")) * METRES_PER_DEGREE, F.col("seconds"))
    ve = F.try_divide((F.col("lon1") - F.col("lon0")) * METRES_PER_DEGREE * F.cos(F.radians("lat0")), F.col("seconds"))
    t = moves.withColumns({"n": n, "vn": vn, "ve": ve}).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    part, ends = F.col("i") / F.col("n"), F.col("i") == F.col("n")
    return t.select(
        "move",
        "i",
        F.when(ends, F.col("lat1")).otherwise(F.col("lat0") + (F.col("lat1") - F.col("lat0")) * part).alias("lat"),
        F.when(ends, F.col("lon1")).otherwise(F.col("lon0") + (F.col("lon1") - F.col("lon0")) * part).alias("lon"),
        F.when(ends, 0.0).otherwise(F.col("vn")).alias("vn"),
        F.when(ends, 0.0).otherwise(F.col("ve")).alias("ve"),
    )


def out_and_back(lat: Column, lon: Column, steps: int = 10, step_m: float = 20.0) -> Column:
    """Waypoints north 1..steps and back to 0, as an array of (lat, lon)."""
    path = F.concat(F.sequence(F.lit(1), F.lit(steps)), F.sequence(F.lit(steps - 1), F.lit(0), F.lit(-1)))
    return F.transform(path, lambda k: F.struct((lat + k * step_m / METRES_PER_DEGREE).alias("lat"), lon.alias("lon")))
