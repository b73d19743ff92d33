"""Stateful rules as Structured Streaming operators; each has a batch twin in ``sightline.operators``.

Time is event time. State lives in Spark's state store, keyed by camera or event key, so a restarted query goes on from
its checkpoint. Rows later than the watermark are not in the rules' source, which keys on the wall clock; here they are
dropped, which is an addition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sightline.operators.tracking import TRACK_FIELDS, Tracker


def _per_key(df: DataFrame, keys: Sequence[str], columns: Sequence[str], state: str, step: Callable, until: Callable | None = None, ts: str | None = None) -> DataFrame:
    """Run ``step(rows sorted by time, state tuple or None) -> (kept positions, new state tuple)`` for each key.

    With ``until`` (state to seconds) and ``ts``, a column that has a watermark, a key's state goes when the watermark passes
    that second; else it stays for ever.
    """
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*keys, *columns])

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(parts)).sort_values(list(columns), kind="stable").reset_index(drop=True)
        kept, new = step(rows, held.get if held.exists else None)
        held.update(new)
        if until:
            held.setTimeoutTimestamp(max(int(until(new) * 1000), held.getCurrentWatermarkMs() + 1))
        yield rows.iloc[kept][[*keys, *columns]]

    timed = [ts] if until else []
    grouped = df.select(*keys, *columns, *timed).groupBy(*keys)
    return grouped.applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.EventTimeTimeout if until else GroupStateTimeout.NoTimeout)


def rate_limit(df: DataFrame, keys: Sequence[str], time: str, row_id: str, seconds: float, ts: str | None = None) -> DataFrame:
    """Events that fire: the first of a key, then each at least ``seconds`` after the last that fired.

    With ``ts``, the same time as a timestamp that has a watermark, a key is forgotten when it can hold up no event any more.
    """

    def step(rows: pd.DataFrame, held: tuple | None) -> tuple[list[int], tuple]:
        last, kept = held[0] if held else None, []
        for i, t in enumerate(rows[time]):
            if last is None or t - last >= seconds:
                last = int(t)
                kept.append(i)
        return kept, (last,)

    return _per_key(df, keys, [time, row_id], "last long", step, (lambda state: state[0] + seconds) if ts else None, ts)


def recognition_events(faces: DataFrame, camera: str, time: str, row_id: str, seconds: float, delay: str = "1 minute") -> DataFrame:
    """camera, event, who, time, row_id: *face_recognized* of a known face, *unknown_person* of an unknown one.

    Each comes at most once in ``seconds`` for a camera and person; all strangers of a camera count as one. ``faces``:
    status (known, unknown or anything else, which is no event) and identity. People who have left are forgotten.
    """
    who = F.when(F.col("status") == "known", F.col("identity").cast("string")).when(F.col("status") == "unknown", "Unknown")
    event = F.when(F.col("status") == "known", "face_recognized").otherwise("unknown_person")
    named = faces.withColumns({"who": who, "event": event, "__ts": F.timestamp_seconds(time)}).where("who is not null").withWatermark("__ts", delay)
    return rate_limit(named, [camera, "event", "who"], time, row_id, seconds, "__ts")


def carry_forward(df: DataFrame, camera: str, time: str, row_id: str, seconds: float) -> DataFrame:
    """camera, time, row_id, result_of: the frame whose result stands for each frame, itself if it is run.

    A frame is run if the last that was is at least ``seconds`` older; the others have its result.
    """
    schema = f"`{camera}` {df.schema[camera].dataType.simpleString()}, `{time}` {df.schema[time].dataType.simpleString()}, `{row_id}` long, result_of long"

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values([time, row_id], kind="stable")
        last, of, out = *(held.get if held.exists else (None, None)), []
        for t, i in zip(rows[time], rows[row_id], strict=True):
            if last is None or t - last >= seconds:
                last, of = int(t), int(i)
            out.append(of)
        held.update((last, of))
        yield rows.assign(result_of=out)[[camera, time, row_id, "result_of"]]

    return df.select(camera, time, row_id).groupBy(camera).applyInPandasWithState(run, schema, "last long, of long", "append", GroupStateTimeout.NoTimeout)


def attendance(df: DataFrame, employee: str, time: str, row_id: str, timeout: int) -> DataFrame:
    """Recorded sightings: at most one per timeout, and one per day (UTC) if the timeout is 12 h or more; 0: all."""
    if not timeout:
        return df.select(employee, time, row_id)

    def step(rows: pd.DataFrame, held: tuple | None) -> tuple[list[int], tuple]:
        last, day = held if held else (None, None)
        kept = []
        for i, t in enumerate(rows[time]):
            t = int(t)
            if last is not None and t - last < timeout:
                continue
            last = t
            if timeout < 43_200 or day != t // 86_400:
                day = t // 86_400
                kept.append(i)
        return kept, (last, day)

    return _per_key(df, [employee], [time, row_id], "last long, day long", step)


def throttle_frames(df: DataFrame, camera: str, time: str, row_id: str, seconds: float) -> DataFrame:
    """Boxes of frames that are kept: a frame of a camera is kept if the last kept one is ``seconds`` older; all its boxes."""

    def step(rows: pd.DataFrame, held: tuple | None) -> tuple[list[int], tuple]:
        last, kept = held[0] if held else None, []
        for i, t in enumerate(rows[time]):
            if last is None or t == last or t - last >= seconds:
                last = int(t)
                kept.append(i)
        return kept, (last,)

    return _per_key(df, [camera], [time, row_id], "last long", step)


def state_changes(df: DataFrame, camera: str, time: str, row_id: str, state: str) -> DataFrame:
    """Rows where a camera's state differs from the one before, over micro-batches."""

    def step(rows: pd.DataFrame, held: tuple | None) -> tuple[list[int], tuple]:
        last, kept = held[0] if held else None, []
        for i, s in enumerate(rows[state]):
            if last is not None and s != last:
                kept.append(i)
            last = s
        return kept, (last,)

    return _per_key(df, [camera], [time, row_id, state], "last string", step)


def track(df: DataFrame, keys: Sequence[str] = ("camera_id", "label"), **options) -> DataFrame:
    """Confirmed tracks of each frame; ids never cross keys. Input: keys, frame_no, det_id, score, x1..y2."""
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), TRACK_FIELDS])
    columns = ["frame_no", "det_id", "score", "x1", "y1", "x2", "y2"]

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["frame_no", "det_id"])
        tracker = Tracker.from_state(held.get[0], **options) if held.exists else Tracker(**options)
        out = tracker.run(rows)
        held.update((tracker.state(),))
        yield out.assign(**dict(zip(keys, key, strict=True)))[[*keys, *out.columns]]

    return df.select(*keys, *columns).groupBy(*keys).applyInPandasWithState(run, schema, "tracks string", "append", GroupStateTimeout.NoTimeout)


def windowed_rates(df: DataFrame, camera: str, ts: str, latency: str, length: str = "10 seconds", delay: str = "30 seconds") -> DataFrame:
    """camera, start, n, mean and greatest latency in tumbling windows."""
    w = df.withWatermark(ts, delay).groupBy(F.window(ts, length).alias("w"), camera)
    return w.agg(F.count("*").alias("n"), F.avg(latency).alias("mean_latency"), F.max(latency).alias("max_latency")).select(camera, F.col("w.start").alias("start"), "n", "mean_latency", "max_latency")


def crowd(df: DataFrame, camera: str, ts: str, length: str = "10 seconds", delay: str = "30 seconds") -> DataFrame:
    """camera, start, most people in a frame of the window. Input: one row for each camera frame, with ``people``."""
    return df.withWatermark(ts, delay).groupBy(F.window(ts, length).alias("w"), camera).agg(F.max("people").alias("people")).select(camera, F.col("w.start").alias("start"), "people")


def latest(df: DataFrame, key: str, ts: str, *values: str) -> DataFrame:
    """Newest values of each key; for update mode."""
    return df.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(ts, *values)).alias("__m"), F.max(ts).alias(ts)).select(key, ts, "__m.*")


def alert_label(task: Column, label: Column) -> Column:
    """Type of alert of a detection; null for none. Missing protective gear is a violation, fire and smoke are fire alerts."""
    lower = F.lower(label)
    return (
        F.when((task == "ppe") & (lower.startswith("no_") | lower.startswith("no-")), "ppe_violation")
        .when((task == "fire") & lower.isin("fire", "smoke", "explosion"), F.concat(lower, F.lit("_detected")))
        .when(task.isin("weapon", "violence", "fall"), F.concat(task, F.lit("_detected")))
    )


def alerts(df: DataFrame, time: str, row_id: str, seconds: float = 10) -> DataFrame:
    """Alerts of a detection stream (camera_id, task, label), each type once per camera and interval."""
    named = df.withColumn("alert", alert_label(F.col("task"), F.col("label"))).where("alert is not null")
    return rate_limit(named, ["camera_id", "alert"], time, row_id, seconds)
