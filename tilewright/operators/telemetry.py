"""Stateful telemetry rules over ordered rows of a flight, as windows where they can be and as streamed folds otherwise."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions.quality import has_fix


def ordered(flight: str = "flight", ts: str = "ts", msg: str = "msg"):
    return W.partitionBy(flight).orderBy(ts, msg)


def until_now(window):
    return window.rowsBetween(W.unboundedPreceding, W.currentRow)


def as_of(left: DataFrame, right: DataFrame, values: list[str], flight: str = "flight", ts: str = "ts") -> DataFrame:
    """left rows with the values of the latest right row of their flight at or before them, null without one.

    One window over the union: a right row comes before left rows of the same time, and of right rows at one time the
    last in `values` order counts.
    """
    lefts = left.select(*left.columns, F.lit(1).alias("__side"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__right"))
    rights = right.select(*[F.col(c) if c in (flight, ts) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.lit(0).alias("__side"), F.struct(*values).alias("__right"))
    window = until_now(W.partitionBy(flight).orderBy(ts, "__side", "__right"))
    both = lefts.unionByName(rights).withColumn("__right", F.last("__right", ignorenulls=True).over(window))
    return both.where("__side = 1").select(*left.columns, *[F.col("__right")[v].alias(v) for v in values])


def latest(rows: DataFrame, columns: list[str], flight: str = "flight", ts: str = "ts", msg: str = "msg") -> DataFrame:
    """The newest known value of each column for each flight."""
    return rows.groupBy(flight).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(ts, msg))).alias(c) for c in columns])


def first_fix(rows: DataFrame, flight: str = "flight", ts: str = "ts", msg: str = "msg") -> DataFrame:
    """Each flight's first row with a fix."""
    fixes = rows.where(has_fix(F.col("lat"), F.col("lon")))
    return fixes.groupBy(flight).agg(F.min_by(F.struct(ts, msg, "lat", "lon"), F.struct(ts, msg)).alias("f")).select(flight, "f.*")


def hysteresis(value: Column, high: float, low: float, window) -> Column:
    """1 from a value of at least `high` until one below `low`; 0 at first."""
    mark = F.when(value >= high, 1).when(value < low, 0)
    return F.coalesce(F.last(mark, ignorenulls=True).over(until_now(window)), F.lit(0))


def _runs(keys: pa.Array) -> Iterator[tuple[object, int, int]]:
    """(key, first row, row behind the last) of equal neighbours; nulls are equal, and so are NaNs."""
    codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(codes)], strict=True):
        yield keys[a].as_py(), a, b


def fold(rows: DataFrame, step: Callable[[object, pa.RecordBatch], tuple[object, pa.RecordBatch]], schema: T.StructType, key: str = "flight", order: tuple[str, ...] = ("ts", "msg")) -> DataFrame:
    """An ordered fold for each key: step(state, rows) -> (state, output), called with pieces of the key's rows in order.

    Keys are sorted together and streamed, so no key's rows are held at once; state is None at a key's start. A null key is
    a key like any other. Rows with nulls in `order` come first.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now = None, object()
        for batch in batches:
            for k, a, b in _runs(batch.column(key)):
                if not (k == now or k != k and now != now):
                    state, now = None, k
                state, out = step(state, batch.slice(a, b - a))
                yield out

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[tuple[object, pa.Table]]]:
    """(key, its rows) of batches sorted by key, a list of them for each batch in which keys end."""
    now, held = None, []
    for batch in batches:
        done = []
        for k, a, b in _runs(batch.column(key)):
            if held and k != now:
                done.append((now, pa.Table.from_batches(held)))
                held = []
            now = k
            held.append(batch.slice(a, b - a))
        if done:
            yield done
    if held:
        yield [(now, pa.Table.from_batches(held))]


def _with(part: pa.RecordBatch, columns: list[str], name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.record_batch([*[part.column(c) for c in columns], values], names=[*columns, name])


def _micros(ts: pa.Array) -> list[int | None]:
    return ts.cast(pa.timestamp("us", ts.type.tz)).cast(pa.int64()).to_pylist()


def throttle(rows: DataFrame, interval_s: float, flight: str = "flight") -> DataFrame:
    """flight, msg, ts, fire: greedy shots at least interval_s apart; each one starts the interval anew. Rows without a
    time never fire."""
    gap = int(interval_s * 1e6)

    def step(last, part: pa.RecordBatch):
        unknown = part.column("ts").null_count  # they come first
        ts = np.array(_micros(part.column("ts"))[unknown:], np.int64)
        fire, i = np.zeros(len(ts), bool), 0
        while True:
            if last is not None:
                i = max(i, int(np.searchsorted(ts, last + gap)))
            if i >= len(ts):
                return last, _with(part, [flight, "msg", "ts"], "fire", pa.array(np.concatenate([np.zeros(unknown, bool), fire])))
            fire[i], last = True, int(ts[i])
            i += 1

    narrow = rows.select(flight, "msg", "ts")
    return fold(narrow, step, T.StructType([*narrow.schema, T.StructField("fire", T.BooleanType())]), flight)


def capture_slots(rows: DataFrame, interval_s: float, give_back: float = 0.8, flight: str = "flight") -> DataFrame:
    """flight, msg, outcome: what the throttled capture does at each row.

    Within the interval it waits. A shot, a missing fix and a camera that fails use the slot up; a tilted vehicle gets a
    part of it back. rows: flight, msg, ts, fix, level and, if the camera can fail, camera (booleans). A null fix or level
    counts as false, a null camera as true, and a row without a time waits.
    """
    rules = slot_rules(interval_s, give_back)
    columns = ["fix", "level", *(["camera"] if "camera" in rows.columns else [])]

    def step(last, part: pa.RecordBatch):
        out = []
        for ts, *flags in zip(_micros(part.column("ts")), *(part.column(c).to_pylist() for c in columns), strict=True):
            last, outcome = rules(last, ts, *flags)
            out.append(outcome)
        return last, _with(part, [flight, "msg"], "outcome", pa.array(out, pa.string()))

    narrow = rows.select(flight, "msg", "ts", *columns)
    return fold(narrow, step, T.StructType([narrow.schema[flight], narrow.schema["msg"], T.StructField("outcome", T.StringType())]), flight)


def slot_rules(interval_s: float, give_back: float = 0.8) -> Callable[..., tuple[int | None, str]]:
    """(start of the last slot, time, fix, level, camera) -> (start of the slot now, outcome); times in microseconds."""
    gap, back = int(interval_s * 1e6), int(interval_s * give_back * 1e6)

    def rules(last: int | None, ts: int | None, fix: bool | None, level: bool | None, camera: bool | None = True) -> tuple[int | None, str]:
        if ts is None or last is not None and ts - last < gap:
            return last, "wait"
        if not fix:
            return ts, "no fix"
        if not level:
            return ts - back, "tilted"
        return ts, "no photo" if camera is False else "shot"

    return rules


def complete_mission(items: DataFrame, mission: str = "mission", expected: str = "expected") -> DataFrame:
    """Waypoints of missions of which every item came; others have none. Kept: navigation items (16) after the first
    with a position."""
    whole = items.withColumn("__n", F.count("*").over(W.partitionBy(mission)))
    kept = whole.where((F.col("__n") == F.col(expected)) & (F.col("seq") > 0) & (F.col("command") == 16) & (F.col("x") != 0) & (F.col("y") != 0))
    return kept.select(mission, "seq", (F.col("x") / 1e7).alias("lat"), (F.col("y") / 1e7).alias("lon"))


def parse_waypoints(text: Column) -> Column:
    """An array of (lat, lon) from 'lat,lon lat,lon ...'; an item with another number of commas, or no number, is null."""
    def item(s: Column) -> Column:
        parts = F.split(s, ",")
        lat, lon = (F.try_element_at(parts, F.lit(i)).try_cast("double") for i in (1, 2))
        return F.when((F.size(parts) == 2) & lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))

    return F.transform(F.filter(F.split(text, " "), lambda s: s != ""), item)


def resolve_anchor(requests: DataFrame, live: DataFrame, cache: DataFrame, handheld: bool = False, agl_m: float = 60.0) -> DataFrame:
    """Each request's anchor, field by field: as asked, from live telemetry, from the cache (no heading there), and
    0 for handheld runs only; resolved is false where a field is missing. Tables have one row for each flight."""
    joined = requests.alias("r").join(live.alias("l"), "flight", "left").join(cache.alias("c"), "flight", "left")
    dummy = [F.lit(0.0)] if handheld else []
    fields = {k: F.coalesce(F.col(f"r.{k}"), F.col(f"l.{k}"), *([F.col(f"c.{k}")] if k != "heading" else []), *dummy) for k in ("lat", "lon", "alt_msl", "heading")}
    resolved = F.lit(True)
    for c in fields.values():
        resolved = resolved & c.isNotNull()
    return joined.select("flight", *[c.alias(k) for k, c in fields.items()], F.coalesce("r.agl", "l.agl", F.lit(agl_m)).alias("agl"), resolved.alias("resolved"))
