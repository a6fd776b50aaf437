"""Ordered folds and waits: odd keys, batches that cut a key, nulls."""

import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilewright.operators import survey, telemetry, track

T0 = dt.datetime(2026, 1, 1)
BIG = 9007199254740992  # the next number has no double


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def rows_of(spark, keys, n=20):
    rows = [(k, i, T0 + dt.timedelta(hours=i), i % 5 != 4, i % 3 != 2) for k in keys for i in range(n)]
    return spark.createDataFrame(rows, "flight bigint, msg bigint, ts timestamp, fix boolean, level boolean")


def test_whole_keys_from_any_batches():
    rows = pa.table({"flight": pa.array([None, None, 0, 0, 0, 0, 0, BIG, BIG + 1, BIG + 1], pa.int64()), "msg": list(range(10))})
    for size in (1, 3, 20):
        found = [x for part in telemetry.whole(iter(rows.to_batches(max_chunksize=size)), "flight") for x in part]
        assert [(k, r["msg"].to_pylist()) for k, r in found] == [(None, [0, 1]), (0, [2, 3, 4, 5, 6]), (BIG, [7]), (BIG + 1, [8, 9])]
    assert not list(telemetry.whole(iter(rows.slice(0, 0).to_batches()), "flight"))


def test_keys_stay_apart_in_any_batch(spark, small_batches):
    rows = rows_of(spark, [None, BIG, BIG + 1, 0]).repartition(1)
    found = telemetry.throttle(rows, 4 * 3600).collect()
    for k in (None, BIG, BIG + 1, 0):
        assert sorted(r.msg for r in found if r.flight == k and r.fire) == [0, 4, 8, 12, 16]
    assert len(found) == 80
    slots = telemetry.capture_slots(rows, 4 * 3600).collect()
    one = sorted((r.msg, r.outcome) for r in slots if r.flight == 0)
    assert all(sorted((r.msg, r.outcome) for r in slots if r.flight == k) == one for k in (None, BIG, BIG + 1))


def test_rows_without_a_time(spark):
    rows = rows_of(spark, [1], 3).union(spark.createDataFrame([(1, 99, None, True, True)], rows_of(spark, [1]).schema))
    assert {r.msg: r.fire for r in telemetry.throttle(rows, 3600).collect()} == {99: False, 0: True, 1: True, 2: True}
    assert {r.msg: r.outcome for r in telemetry.capture_slots(rows, 3600).collect()}[99] == "wait"


def test_a_failing_camera_uses_its_slot_up(spark):
    rows = rows_of(spark, [1], 6).withColumns({"fix": F.lit(True), "level": F.lit(True), "camera": F.col("msg") != 0})
    found = [r.outcome for r in telemetry.capture_slots(rows, 3 * 3600).orderBy("msg").collect()]
    assert found == ["no photo", "wait", "wait", "shot", "wait", "wait"]


def test_accuracy_of_null_flights(spark, small_batches):
    rows = [(k, i, T0 + dt.timedelta(seconds=i), i != 3, True, i == 7, 10.0) for k in (None, BIG, BIG + 1) for i in range(12)]
    legs = spark.createDataFrame(rows, "flight bigint, leg bigint, ts timestamp, ok boolean, confident boolean, anchor boolean, magnitude_m double").repartition(1)
    found = track.accuracy(legs).collect()
    by = {k: [r.hacc_m for r in sorted((r for r in found if r.flight == k), key=lambda r: r.leg)] for k in (None, BIG, BIG + 1)}
    assert len(by[None]) == 12 and by[None] == by[BIG] == by[BIG + 1] and by[None][7] == 0.5


def test_waits_equal_brute_force(spark):
    rows = [(f, T0 + dt.timedelta(minutes=37 * i % 901), float(i * 7 % 50)) for f in (1, 2) for i in range(60)]
    starts = [(f, T0 + dt.timedelta(minutes=m)) for f in (1, 2, 3) for m in range(0, 900, 50)]
    frame, begun = spark.createDataFrame(rows, "flight bigint, ts timestamp, alt_m double"), spark.createDataFrame(starts, "flight bigint, started timestamp")
    limit = dt.timedelta(hours=1)
    got = {(r.flight, r.started): r.reached for r in survey.wait_until(frame, begun, F.abs(F.col("alt_m") - 20) <= 5, 3600).collect()}
    for f, s in starts:
        met = [t for k, t, a in rows if k == f and abs(a - 20) <= 5 and s <= t < s + limit]
        assert got[f, s] == min(met, default=None)
    plan = begun.withColumn("alt_m", F.when(F.minute("started") % 20 == 0, 20.0).otherwise(24.0))
    for r in survey.first_near(frame, plan, 5.0, 3600).collect():
        met = [t for k, t, a in rows if k == r.flight and abs(a - r.alt_m) <= 5 and r.started <= t < r.started + limit]
        assert r.reached == min(met, default=None)
