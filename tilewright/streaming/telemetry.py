"""Streaming forms of the stateful telemetry rules; over the same rows they give what the batch forms give.

Rows of a flight count in order of arrival, and by (ts, msg) within a micro-batch; a row that comes late is taken as it
comes, as the live register does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tilewright.config import METRES_PER_DEGREE, Odometry
from tilewright.operators.telemetry import slot_rules
from tilewright.operators.track import next_accuracy


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["ts", "msg"])


def hysteresis(rows: DataFrame, high: float, low: float) -> DataFrame:
    """flight, msg, on of a stream with flight, msg, ts, alt_m."""
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        on, part, out = state.get[0] if state.exists else 0, _ordered(frames), []
        for alt in part["alt_m"]:
            on = 1 if alt >= high else 0 if alt < low else on
            out.append(on)
        state.update((on,))
        yield part[["flight", "msg"]].assign(on=out)

    return rows.select("flight", "msg", "ts", "alt_m").groupBy("flight").applyInPandasWithState(step, "flight bigint, msg bigint, on int", "on int", "append", GroupStateTimeout.NoTimeout)


def throttle(rows: DataFrame, interval_s: float) -> DataFrame:
    """flight, msg, fire of a stream with flight, msg, ts: greedy shots at least interval_s apart."""
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, part, out = state.get[0] if state.exists else None, _ordered(frames), []
        for us in part["ts"].to_numpy("datetime64[us]").astype("int64").tolist():
            fire = last is None or us - last >= interval_s * 1e6
            last = us if fire else last
            out.append(fire)
        state.update((last,))
        yield part[["flight", "msg"]].assign(fire=out)

    return rows.select("flight", "msg", "ts").groupBy("flight").applyInPandasWithState(step, "flight bigint, msg bigint, fire boolean", "last bigint", "append", GroupStateTimeout.NoTimeout)


def capture_slots(rows: DataFrame, interval_s: float, give_back: float = 0.8) -> DataFrame:
    """flight, msg, outcome of a stream with flight, msg, ts, fix, level."""
    rules = slot_rules(interval_s, give_back)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, part, out = state.get[0] if state.exists else None, _ordered(frames), []
        for us, fix, level in zip(part["ts"].to_numpy("datetime64[us]").astype("int64").tolist(), part["fix"], part["level"], strict=True):
            last, outcome = rules(last, us, fix, level)
            out.append(outcome)
        state.update((last,))
        yield part[["flight", "msg"]].assign(outcome=out)

    return rows.select("flight", "msg", "ts", "fix", "level").groupBy("flight").applyInPandasWithState(step, "flight bigint, msg bigint, outcome string", "last bigint", "append", GroupStateTimeout.NoTimeout)


def tracked(legs: DataFrame, home: tuple[float, float, float], cfg: Odometry = Odometry()) -> DataFrame:
    """flight, leg, heading, lat, lon, hacc_m of a stream of legs (flight, leg, ts, ok, confident, anchor, magnitude_m, dx_m,
    dy_m, yaw_deg), anchored at home: one leg after another, as a vehicle would track itself."""
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lat, lon, heading, h = state.get if state.exists else (*home, cfg.hacc_anchor_m)
        part, out = pd.concat(list(frames)).sort_values(["ts", "leg"]), []
        for r in part.itertuples():
            h = next_accuracy(h, r.ok, r.confident, r.anchor, r.magnitude_m, None, cfg)
            if r.anchor:
                lat, lon, heading = home
            elif r.ok:
                heading += r.yaw_deg
                a = math.radians(heading)
                lat += (-r.dy_m * math.cos(a) - r.dx_m * math.sin(a)) / METRES_PER_DEGREE
                lon += (-r.dy_m * math.sin(a) + r.dx_m * math.cos(a)) / (METRES_PER_DEGREE * math.cos(math.radians(lat)))
            out.append((heading, lat, lon, h))
        state.update((lat, lon, heading, h))
        yield pd.concat([part[["flight", "leg"]].reset_index(drop=True), pd.DataFrame(out, columns=["heading", "lat", "lon", "hacc_m"])], axis=1)

    narrow = legs.select("flight", "leg", "ts", "ok", "confident", "anchor", "magnitude_m", "dx_m", "dy_m", "yaw_deg")
    return narrow.groupBy("flight").applyInPandasWithState(step, "flight bigint, leg bigint, heading double, lat double, lon double, hacc_m double", "lat double, lon double, heading double, hacc_m double", "append", GroupStateTimeout.NoTimeout)


def latest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The newest row's columns of each flight so far (update or complete mode)."""
    return rows.groupBy("flight").agg(F.max_by(F.struct(*columns), F.struct("ts", "msg")).alias("now")).select("flight", "now.*")


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Run an append stream over all that is there into Parquet below folder, and read that."""
    out = f"{folder}/out"
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(out).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
