"""Whole runs: captures with their comparison to the true position, surveys, and odometry as a stream of positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.config import LIVE, Localizer, Odometry
from tilewright.functions import geo, geometry, quality, text
from tilewright.operators import survey, telemetry, track


def captures(rows: DataFrame, interval_s: float, cfg: Localizer = LIVE, guarded: bool = True) -> DataFrame:
    """Rows at which a shot is taken: in the air by the altitude's hysteresis, throttled, with a fix and, if guarded (passive
    runs are not), level."""
    up = telemetry.hysteresis(F.col("alt_m"), cfg.capture_on_m, cfg.capture_off_m, telemetry.ordered())
    flying = rows.withColumn("up", up).where("up = 1").withColumns({"fix": quality.has_fix(F.col("lat"), F.col("lon")), "level": quality.is_level(F.col("roll_deg"), F.col("pitch_deg"), cfg) if guarded else F.lit(True)})
    shots = telemetry.capture_slots(flying, interval_s).where("outcome = 'shot'").select("flight", "msg")
    return rows.join(shots, ["flight", "msg"])


def compared(shots: DataFrame, estimates: DataFrame, cfg: Localizer = LIVE) -> DataFrame:
    """Each shot with its estimate (flight, msg, lat_est, lon_est, inliers), if there is one: distance to the true
    position, accuracy, whether it would be sent, and the photo's name."""
    both = shots.drop("inliers").join(estimates, ["flight", "msg"], "left")
    d = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("lat_est"), F.col("lon_est"))
    name = text.fix_name(F.col("lat"), F.col("lon"), F.col("lat_est"), F.col("lon_est"), F.col("error_m"), F.col("alt_m"))
    found = both.withColumn("error_m", d).withColumn("name", name)
    sent = F.coalesce(quality.is_sent(F.col("inliers"), cfg), F.lit(False))
    return found.select("flight", "msg", "error_m", F.when(sent, quality.hacc_m(F.col("inliers"))).alias("hacc_m"), sent.alias("sent"), "name")


def survey_cells(rows: DataFrame, plan: DataFrame, errors: DataFrame, tolerance_m: float, timeout_s: int) -> DataFrame:
    """Cells of a survey plan (flight, started, pos_idx, pos_name, alt_idx, alt_m): measured if the altitude was reached
    in time and an estimate's error is known for that row (flight, ts, err_m), else NOFIX or NOT_TESTED."""
    reached = survey.first_near(rows, plan, tolerance_m, timeout_s).withColumnRenamed("reached", "ts").distinct()
    cells = plan.join(reached, ["flight", "started", "alt_m"], "left").join(errors, ["flight", "ts"], "left")
    status = F.when(F.col("ts").isNull(), "NOT_TESTED").when(F.col("err_m").isNull(), "NOFIX").otherwise("OK")
    return cells.select("flight", "started", "pos_idx", "pos_name", "alt_idx", "alt_m", status.alias("status"), "err_m")


def survey_report(cells: DataFrame, positions: list[str]) -> DataFrame:
    """The matrix of a survey with each altitude's mean and number of cells."""
    return survey.matrix(cells, positions).join(survey.means(cells).withColumnRenamed("n", "n_cells"), "alt_m", "full")


def legs_of(pairs: DataFrame, altitude_m: Column, cfg: Odometry = Odometry()) -> DataFrame:
    """Legs of odometry pairs (flight, frame, n_matches, n_inliers, m): movement, whether they are ok and confident."""
    ok = F.col("m").isNotNull() & (F.col("n_inliers") >= cfg.min_inliers)
    moved = pairs.withColumn("d", F.when(ok, geometry.displacement(F.col("m"), altitude_m, cfg)))
    return moved.select("flight", F.col("frame").alias("leg"), ok.alias("ok"), (ok & quality.leg_confident(F.col("n_matches"), F.col("n_inliers"), cfg)).alias("confident"), "d.dx_m", "d.dy_m", "d.magnitude_m", F.col("d.yaw_change_deg").alias("yaw_deg"), "d.altitude_change_m", "dt_s")


def tracked(legs: DataFrame, home: tuple[float, float, float], cfg: Odometry = Odometry(), mount_deg: float = 0.0, altitude: bool = False) -> DataFrame:
    """Position, accuracy and trust after each leg."""
    both = track.dead_reckoning(legs, home, mount_deg, altitude).join(track.accuracy(legs, cfg), ["flight", "leg"])
    return both.withColumn("trusted", quality.is_trusted(F.col("hacc_m"), cfg))


def leg_errors(pairs: DataFrame) -> DataFrame:
    """Estimated against true length of legs between named photos (name, next_name, magnitude_m), in per cent."""
    a, b = text.parse_gps(F.col("name")), text.parse_gps(F.col("next_name"))
    true = geo.haversine_m(a["lat"], a["lon"], b["lat"], b["lon"])
    measured = pairs.withColumn("true_m", true)
    share = F.try_divide(F.abs(F.col("magnitude_m") - F.col("true_m")), F.col("true_m")) * 100
    return measured.withColumn("error_pct", share)
