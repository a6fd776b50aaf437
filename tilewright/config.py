"""Parameters with their usual values; each profile of the localizer is one set of them."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Localizer:
    zoom: int = 19
    tile_size: int = 256
    min_inliers: int = 6
    top_candidates: int = 20
    ratio: float = 0.75
    query_keypoints: int = 2000
    index_keypoints: int = 300
    composite_keypoints: int = 3000
    least_keypoints: int = 5
    radius: int = 1
    ransac_px: float = 5.0
    quad_checks: bool = True
    area_low: float = 0.05
    area_high: float = 50.0
    margin_px: float = 256.0
    capture_on_m: float = 30.0
    capture_off_m: float = 10.0
    send_inliers: int = 10
    tilt_limit_deg: float = 15.0
    fov_deg: float = 80.0


#: The profiles that differ from the batch one.
BATCH = Localizer()
NATIVE_BATCH = replace(BATCH, zoom=18, min_inliers=15, top_candidates=5, quad_checks=False)
LIVE = replace(BATCH, zoom=18)
LIVE_SENDING = replace(BATCH, capture_on_m=50.0)
PASSIVE = replace(BATCH, query_keypoints=3000, capture_off_m=20.0)
REPLAY = BATCH


@dataclass(frozen=True)
class Odometry:
    width: int = 1280
    height: int = 720
    #: Ground footprint at the reference altitude, which fixes the focal lengths.
    footprint_w_m: float = 70.0
    footprint_h_m: float = 55.0
    reference_altitude_m: float = 60.0
    min_inliers: int = 12
    confident_ratio: float = 0.30
    ransac_px: float = 4.0
    crop: float = 0.8
    keypoints: int = 4000
    hacc_anchor_m: float = 0.5
    hacc_cap_m: float = 50.0
    confident_rate: float = 0.15
    low_rate: float = 0.6
    low_extra_m: float = 2.0
    fail_extra_m: float = 5.0
    resend_hz: float = 5.0


EARTH_RADIUS_M, METRES_PER_DEGREE = 6_371_000.0, 111_111.0
GPS_EPOCH_S, WEEK_S = 315_964_800, 604_800
