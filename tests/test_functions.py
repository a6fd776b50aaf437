"""Known answers of the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from tilewright.config import BATCH
from tilewright.functions import geo, geometry, quality, text
from tilewright.operators import survey, telemetry, track
from tilewright.sources import tiles


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(("zoom", "x", "y"), [(18, 219522, 112216), (19, 439044, 224433)])
def test_tile_of_position(spark, zoom, x, y):
    lat, lon, z = F.lit(25.05452), F.lit(121.46801), F.lit(zoom)
    assert one(spark, geo.tile_x(lon, z), geo.tile_y(lat, z)) == (x, y)


def test_tile_centre(spark):
    c = geo.tile_centre(F.lit(219522), F.lit(112216), F.lit(18))
    assert one(spark, F.round(c["lat"], 7), F.round(c["lon"], 7)) == (25.0551231, 121.4682770)


def test_metres_per_pixel_and_focal_lengths(spark):
    assert one(spark, F.round(geo.metres_per_pixel(F.lit(25.055), F.lit(19)), 5)) == (0.27049,)
    assert geo.focal_px() == pytest.approx((1097.142857, 785.454545))


@pytest.mark.parametrize(("err", "degrees"), [(500, 5.7), (200, 14.0), (100, 26.6), (50, 45.0), (20, 68.2)])
def test_bearing_error(spark, err, degrees):
    assert one(spark, F.round(geo.bearing_error_deg(F.lit(50.0), F.lit(float(err))), 1)) == (degrees,)


@pytest.mark.parametrize(("n", "metres"), [(9, 100), (10, 100), (19, 100), (20, 60), (39, 60), (40, 30), (80, 30), (81, 10)])
def test_accuracy_of_inliers(spark, n, metres):
    assert one(spark, quality.hacc_m(F.lit(n)), quality.is_sent(F.lit(n))) == (float(metres), n >= 10)


@pytest.mark.parametrize(("name", "altitude", "any_altitude"), [
    ("25.0500000_121.4700000-25.0500100_121.4700200__2.3m.png", None, None),
    ("25.0500000_121.4700000-NOFIX_NOFIX__NAm.png", None, None),
    ("25.0500000_121.4700000-25.0500100_121.4700200__8.2m__34.5m.png", None, 34.5),
    ("25.0500000_121.4700000-NOFIX_NOFIX__NAm__34.5m.png", 34.5, 34.5),
    ("20260101_000000__live__60.0m.jpg", 60.0, 60.0),
])
def test_altitude_in_names(spark, name, altitude, any_altitude):
    assert one(spark, text.parse_altitude(F.lit(name)), text.parse_altitude(F.lit(name), text.ANY_ALTITUDE_PATTERN)) == (altitude, any_altitude)


def test_altitude_pairs(spark):
    def used(a, b):
        return one(spark, geo.altitude_used(F.lit(a).cast("double"), F.lit(b).cast("double")))[0]

    assert [used(40.0, 60.0), used(None, 30.0), used(0.0, 30.0), used(None, None), used(0.0, 0.0)] == [50.0, 30.0, 30.0, 60.0, 60.0]


def test_quads(spark):
    def reason(h):
        return one(spark, geometry.rejection(F.lit(100), F.lit(100), F.lit(50), F.lit(50), F.array(*[F.lit(float(x)) for x in h]), F.lit(320.0), F.lit(240.0)))[0]

    assert reason([1, 0, 200, 0, 1, 200, 0, 0, 1]) is None
    assert reason([0.1, 0, 0, 0, 0.1, 0, 0, 0, 1]) == "area"
    assert reason([8, 0, 0, 0, 8, 0, 0, 0, 1]) == "area"
    assert reason([1, 0, 864, 0, 1, 0, 0, 0, 1]) is None  # the centre is just on the margin
    assert reason([1, 0, 865, 0, 1, 0, 0, 0, 1]) == "centre outside"
    assert reason([1, 0, 0, 0, 1, 0, -0.004, -0.004, 1]) in ("not convex", "area")


def test_tilt_of_a_level_camera_is_null(spark):
    z = F.lit(0.0)
    assert one(spark, geometry.tilt_homography(z, z, F.lit(0.5), 1280, 720)) == (None,)
    h = one(spark, geometry.tilt_homography(z, z, F.lit(90.0), 1280, 720))[0]
    assert [round(x, 6) for x in h[:2]] == [0.0, 1.0]


def test_box_counts(spark):
    from tilewright.sources.tiles import box_tiles

    near = box_tiles(spark, 25.02, 121.43, 25.02, 121.43, 18)
    assert near.count() == 1


def test_dead_reckoning_of_one_leg(spark):
    legs = spark.createDataFrame([(1, 1, "2026-01-01 00:00:00", True, True, False, 20.0, 0.0, -20.0, 0.0)], "flight bigint, leg bigint, ts string, ok boolean, confident boolean, anchor boolean, magnitude_m double, dx_m double, dy_m double, yaw_deg double").withColumn("ts", F.to_timestamp("ts"))
    row = track.dead_reckoning(legs, (25.0, 121.5, 0.0)).first()
    assert row.lat == pytest.approx(25 + 20 / 111111, abs=1e-9) and row.lon == pytest.approx(121.5, abs=1e-9)
    assert track.accuracy(legs).first().hacc_m == pytest.approx(math.hypot(0.5, 3.0))


def test_survey_sentinels_and_means(spark):
    cells = spark.createDataFrame([(0, "C", 0, 20.0, "OK", 41.0), (1, "N", 0, 20.0, "NOFIX", None), (2, "E", 1, 30.0, "OK", 41.0), (3, "S", 1, 30.0, "NOT_TESTED", None)], "pos_idx int, pos_name string, alt_idx int, alt_m double, status string, err_m double")
    assert tuple(survey.best(cells).first()) == (20.0, "C", 41.0)
    assert {r.alt_m: (r.mean_err_m, r.n) for r in survey.means(cells).collect()} == {20.0: (41.0, 1), 30.0: (41.0, 1)}
    assert sorted(r[0] for r in cells.select(survey.display(F.col("status"), F.col("err_m"))).collect()) == [-2.0, -1.0, 41.0, 41.0]
    assert survey.best(cells.where("false")).count() == 0


def test_anchor_for_handheld_runs(spark):
    asked = spark.createDataFrame([(1, None, None, None, None, None)], "flight bigint, lat double, lon double, alt_msl double, heading double, agl double")
    live, cache = asked.where("false"), asked.select("flight", "lat", "lon", "alt_msl").where("false")
    assert tuple(telemetry.resolve_anchor(asked, live, cache).first()) == (1, None, None, None, None, 60.0, False)
    assert tuple(telemetry.resolve_anchor(asked, live, cache, handheld=True).first()) == (1, 0.0, 0.0, 0.0, 0.0, 60.0, True)


def test_json_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n"lat": 25.0, "lon": 121.0,\n"alt_msl": 3.5, "rel_alt": 1.0, "time": "t"}')
    (tmp_path / "b.json").write_text("{broken")
    assert [tuple(r) for r in tiles.read_json(spark, str(tmp_path)).collect()] == [(25.0, 121.0, 3.5, 1.0, "t")]


def test_profiles_differ_where_they_should():
    from tilewright import config

    assert (config.NATIVE_BATCH.min_inliers, config.NATIVE_BATCH.top_candidates, config.NATIVE_BATCH.quad_checks) == (15, 5, False)
    assert (config.LIVE.zoom, config.PASSIVE.query_keypoints, config.PASSIVE.capture_off_m, BATCH.ratio) == (18, 3000, 20.0, 0.75)


def test_sidecar_places(spark):
    """Ties of the scaled value go away from zero; nulls leave their field out."""
    rows = spark.createDataFrame([(0.00005, -0.00005, 12.25), (1.23454, 1.23456, -0.25), (None, 359.99996, 7.0)], "roll double, pitch double, alt double")
    j = tiles.attitude_json(F.col("roll"), F.col("pitch"), F.lit(90.0), F.col("alt"), F.lit(25.12345678), F.lit(121.5))
    found = [r.a.asDict() for r in rows.select(F.from_json(j, tiles.ATTITUDE).alias("a")).collect()]
    assert [(a["roll_deg"], a["pitch_deg"], a["alt_m"]) for a in found] == [(0.0001, -0.0001, 12.3), (1.2345, 1.2346, -0.3), (None, 360.0, 7.0)]
    assert {(a["yaw_deg"], a["lat"], a["lon"]) for a in found} == {(90.0, 25.1234568, 121.5)}
