"""Guards and grades of fixes and legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.config import BATCH, Localizer, Odometry
from tilewright.functions import geo


def hacc_m(inliers: Column) -> Column:
    """Horizontal accuracy that a number of inliers stands for."""
    return F.when(inliers > 80, 10.0).when(inliers >= 40, 30.0).when(inliers >= 20, 60.0).otherwise(100.0)


def match_grade(inliers: Column) -> Column:
    return F.when(inliers >= 200, "excellent").when(inliers >= 50, "reliable").when(inliers >= 10, "weak").otherwise("reject")


def has_fix(lat: Column, lon: Column) -> Column:
    """(0, 0) stands for no fix."""
    return F.coalesce(~((lat == 0) & (lon == 0)), F.lit(False))


def is_level(roll_deg: Column, pitch_deg: Column, cfg: Localizer = BATCH) -> Column:
    return (F.abs(roll_deg) <= cfg.tilt_limit_deg) & (F.abs(pitch_deg) <= cfg.tilt_limit_deg)


def is_sent(inliers: Column, cfg: Localizer = BATCH) -> Column:
    return inliers >= cfg.send_inliers


def passes_ratio(d1: Column, d2: Column, ratio: float = BATCH.ratio) -> Column:
    return d1 < ratio * d2


def leg_ok(keypoints1: Column, keypoints2: Column, matches: Column, inliers: Column, cfg: Odometry = Odometry()) -> Column:
    return (keypoints1 >= 4) & (keypoints2 >= 4) & (matches >= 4) & (inliers >= cfg.min_inliers)


def leg_confident(matches: Column, inliers: Column, cfg: Odometry = Odometry()) -> Column:
    return F.coalesce(F.try_divide(inliers, matches) >= cfg.confident_ratio, F.lit(False))


def is_trusted(hacc: Column, cfg: Odometry = Odometry()) -> Column:
    return hacc < cfg.hacc_cap_m / 2


def spacing(rows: DataFrame, window, least_m: float = 300.0) -> DataFrame:
    """rows (lat, lon) with metres from the one before in the window, null for the first, and whether that is far enough."""
    before = [F.lag(c).over(window) for c in ("lat", "lon")]
    measured = rows.withColumn("metres", geo.haversine_m(*before, F.col("lat"), F.col("lon")))
    return measured.withColumn("apart", F.coalesce(F.col("metres") >= least_m, F.lit(True)))


def has_arrived(horizontal_m: Column, vertical_m: Column) -> Column:
    return (horizontal_m <= 3.0) & (F.abs(vertical_m) <= 2.5)
