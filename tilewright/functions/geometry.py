"""Planar geometry of homographies (nine numbers by row), similarities (six) and projected quadrilaterals."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.config import BATCH, Localizer, Odometry
from tilewright.functions.geo import ground_sampling


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once, so long expressions do not repeat it."""
    return F.transform(F.array(value), body)[0]


def project(h: Column, x: Column, y: Column) -> Column:
    """A point through a homography; null where its weight is 0."""
    w = F.nullif(h[6] * x + h[7] * y + h[8], F.lit(0.0))
    return F.struct(((h[0] * x + h[1] * y + h[2]) / w).alias("x"), ((h[3] * x + h[4] * y + h[5]) / w).alias("y"))


def quad_of(h: Column, width: Column, height: Column) -> Column:
    """The projected corners of an image, clockwise from its origin."""
    zero = F.lit(0.0)
    return F.array(project(h, zero, zero), project(h, width, zero), project(h, width, height), project(h, zero, height))


def _cross(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - b["x"] * a["y"]


def quad_area(q: Column) -> Column:
    return F.abs(sum((_cross(q[i], q[(i + 1) % 4]) for i in range(4)), F.lit(0.0))) / 2


def is_convex(q: Column, whole_px: bool = True) -> Column:
    """All turns to one side; corners are cut to whole pixels first unless whole_px is False."""
    def at(i: int, k: str) -> Column:
        c = q[i % 4][k]
        return F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("double") if whole_px else c

    turns = [(at(i + 1, "x") - at(i, "x")) * (at(i + 2, "y") - at(i + 1, "y")) - (at(i + 1, "y") - at(i, "y")) * (at(i + 2, "x") - at(i + 1, "x")) for i in range(4)]
    left, right = F.lit(True), F.lit(True)
    for t in turns:
        left, right = left & (t > 0), right & (t < 0)
    return F.coalesce(left | right, F.lit(False))


def rejection(query_kps: Column, composite_kps: Column, good: Column, inliers: Column, h: Column, width: Column, height: Column, cfg: Localizer = BATCH) -> Column:
    """The first stage that rejects a candidate, null if it is accepted. Bounds of the centre are inclusive."""
    area, side = width * height, float((2 * cfg.radius + 1) * cfg.tile_size)

    def outline(q: Column) -> Column:
        fits = F.coalesce(quad_area(q).between(cfg.area_low * area, cfg.area_high * area), F.lit(False))
        return F.when(~fits, "area").when(~is_convex(q), "not convex")

    def place(c: Column) -> Column:
        low, high = -cfg.margin_px, side + cfg.margin_px
        return F.when(~F.coalesce(c["x"].between(low, high) & c["y"].between(low, high), F.lit(False)), "centre outside")

    out = F.when(query_kps < cfg.least_keypoints, "few query keypoints").when(composite_kps < cfg.min_inliers, "few composite keypoints").when(good < cfg.min_inliers, "few matches").when(h.isNull(), "no homography").when(inliers < cfg.min_inliers, "few inliers")
    late = bound(project(h, width / 2, height / 2), place)
    return out.otherwise(F.coalesce(bound(quad_of(h, width, height), outline), late) if cfg.quad_checks else late)


def tilt_homography(pitch: Column, roll: Column, yaw: Column, width: int, height: int, fov_deg: float = BATCH.fov_deg, least_deg: float = 0.5) -> Column:
    """The homography that undoes a camera's tilt (angles in degrees), null if no angle exceeds least_deg.

    Rotations about x by -pitch, y by -roll and z by -yaw, multiplied in this order, between the camera matrix and its
    inverse; written out entry by entry.
    """
    f, cx, cy = width / (2 * math.tan(math.radians(fov_deg) / 2)), width / 2, height / 2
    p, r, y = (F.radians(-a) for a in (pitch, roll, yaw))
    sp, cp, sr, cr, sy, cyaw = F.sin(p), F.cos(p), F.sin(r), F.cos(r), F.sin(y), F.cos(y)
    rot = [
        [cr * cyaw, -cr * sy, sr],
        [cp * sy + sp * sr * cyaw, cp * cyaw - sp * sr * sy, -sp * cr],
        [sp * sy - cp * sr * cyaw, sp * cyaw + cp * sr * sy, cp * cr],
    ]
    top = [[f * rot[0][j] + cx * rot[2][j] for j in range(3)], [f * rot[1][j] + cy * rot[2][j] for j in range(3)], rot[2]]
    entries = [e for row in top for e in (row[0] / f, row[1] / f, row[2] - row[0] * (cx / f) - row[1] * (cy / f))]
    tilted = (F.abs(pitch) > least_deg) | (F.abs(roll) > least_deg) | (F.abs(yaw) > least_deg)
    return F.when(tilted, F.array(*entries))


def displacement(m: Column, altitude_m: Column, cfg: Odometry = Odometry()) -> Column:
    """Movement over ground from the similarity (six numbers) of one frame to the next."""
    cx, cy = cfg.width / 2, cfg.height / 2
    gsd = ground_sampling(altitude_m, cfg)
    dx = -(m[0] * cx + m[1] * cy + m[2] - cx) * gsd["x"]
    dy = -(m[3] * cx + m[4] * cy + m[5] - cy) * gsd["y"]
    scale = F.hypot(m[0], m[3])
    return F.struct(
        dx.alias("dx_m"),
        dy.alias("dy_m"),
        F.hypot(dx, dy).alias("magnitude_m"),
        (-F.degrees(F.atan2(m[3], m[0]))).alias("yaw_change_deg"),
        scale.alias("scale"),
        F.when(scale > 0, altitude_m * (F.try_divide(F.lit(1.0), scale) - 1)).otherwise(F.lit(float("nan"))).alias("altitude_change_m"),
    )
