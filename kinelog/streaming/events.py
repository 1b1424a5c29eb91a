"""Event-time windows over a stream of states or events; the same functions serve a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def source(spark, path: str) -> DataFrame:
    """The events of a folder as a stream; ts becomes a timestamp, which watermarks ask for."""
    return spark.readStream.schema(EVENTS).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def counted(events: DataFrame, length: str, slide: str | None = None, late: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows and sum of value for each window, tumbling or sliding. ``late``: how long a stream waits."""
    rows = events.withWatermark("ts", late) if late else events
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return rows.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", *by, "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None, by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Runs of events of a key with no gap as long as ``gap``."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), *by).agg(F.count("*").alias("n")).select("w.start", "w.end", *by, "n")


def motion(events: DataFrame, forget: str | None = None) -> DataFrame:
    """Velocities along each key of a stream (agent_id, scene_ts, x, y), from the last state kept for it.

    The rows of a key in one trigger are taken together, in order; one that isn't later than the last state, or repeats a
    timestep, is late and dropped, and n_late of the next row counts such rows. ``forget``: how long (in the time of
    processing) the state of a silent key is kept, such as "1 hour".
    """
    wait = int(pd.Timedelta(forget).total_seconds() * 1000) if forget else None

    def update(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        rows = pd.concat(list(parts)).sort_values("scene_ts", kind="stable")
        n_late = last[3] if last else 0
        fresh = rows.drop_duplicates("scene_ts")
        if last is not None:
            fresh = fresh[fresh.scene_ts > last[0]]
        n_late += len(rows) - len(fresh)
        if len(fresh):
            ts, x, y = (np.append(first, fresh[c]) for c, first in zip(("scene_ts", "x", "y"), last or ([], [], [])))
            dt = np.diff(ts)
            vx, vy = np.diff(x) / dt, np.diff(y) / dt
            if last is None:
                vx, vy = np.append(0.0, vx), np.append(0.0, vy)
            late = np.zeros(len(fresh), np.int64)
            late[0] = n_late
            yield pd.DataFrame({"agent_id": key[0], "scene_ts": fresh.scene_ts.to_numpy(), "x": fresh.x.to_numpy(), "y": fresh.y.to_numpy(), "vx": vx, "vy": vy, "n_late": late})
            last, n_late = (int(fresh.scene_ts.iloc[-1]), float(fresh.x.iloc[-1]), float(fresh.y.iloc[-1])), 0
        if last is not None:
            state.update((*last[:3], n_late))
        if wait:
            state.setTimeoutDuration(wait)

    return events.groupBy("agent_id").applyInPandasWithState(
        update, "agent_id long, scene_ts long, x double, y double, vx double, vy double, n_late long", "scene_ts long, x double, y double, n_late long", "append",
        "ProcessingTimeTimeout" if forget else "NoTimeout",
    )


def episodes(events: DataFrame, closing: str, gap: str, late: str) -> DataFrame:
    """Runs of a user's events that end with an event of the type ``closing`` or, by a timer on event time, once more than ``gap`` has passed without one.

    Gives user_id, start_us, end_us (microseconds), n, total (of value; nulls count as none) and outcome: closed or expired. An event more than ``gap`` after the last begins a new episode.
    Rows that come out of order wait in the state until the watermark (``late`` behind the newest event) has passed them and are then taken in order of ts and event_id,
    so that the result doesn't depend on how they arrive; later ones are dropped by the watermark. What a user's state holds is the open episode's sums and the rows of the last ``late``, and of one trigger (a stream of old files should take a few at a time).
    Rows without a ts or user are left out. Episodes open at the end of the stream are not given.
    """
    pause = int(pd.Timedelta(gap).total_seconds() * 1_000_000)

    def update(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        start, end, n, total, *held = state.get if state.exists else (None, None, 0, 0.0, [], [], [], [])
        for part in parts:
            held = [[*a, *b] for a, b in zip(held, (part.us.tolist(), part.event_id.tolist(), part.closes.tolist(), part.value.tolist()))]
        now = state.getCurrentWatermarkMs() * 1000
        rows, out = sorted(zip(*held), key=lambda row: row[:2]), []
        passed = sum(us <= now for us, *_ in rows)
        for us, _, closes, value in rows[:passed]:
            if n and us - end > pause:
                out.append((key[0], start, end, n, total, "expired"))
                n = 0
            if not n:
                start, total = us, 0.0
            end, n, total = us, n + 1, total + value
            if closes:
                out.append((key[0], start, end, n, total, "closed"))
                n = 0
        if n and now - end > pause:
            out.append((key[0], start, end, n, total, "expired"))
            n = 0
        if out:
            yield pd.DataFrame(out, columns=["user_id", "start_us", "end_us", "n", "total", "outcome"])
        waiting = rows[passed:]
        if not n and not waiting:
            state.remove()
            return
        state.update((start if n else None, end if n else None, n, total, *([row[k] for row in waiting] for k in range(4))))
        # A timer goes off once the watermark is later than it.
        due = ([waiting[0][0] - 1] if waiting else []) + ([end + pause] if n else [])
        state.setTimeoutTimestamp(max(min(due) // 1000, now // 1000, 1))

    rows = events.filter("ts IS NOT NULL AND user_id IS NOT NULL").withWatermark("ts", late)
    rows = rows.select("user_id", "ts", F.unix_micros("ts").alias("us"), F.coalesce("event_id", F.lit(-1)).alias("event_id"), F.coalesce(F.col("event_type") == closing, F.lit(False)).alias("closes"), F.coalesce("value", F.lit(0.0)).alias("value"))
    return rows.groupBy("user_id").applyInPandasWithState(
        update, "user_id long, start_us long, end_us long, n long, total double, outcome string",
        "start long, end long, n long, total double, us array<long>, event_id array<long>, closes array<boolean>, value array<double>", "append", "EventTimeTimeout",
    )


def run(stream: DataFrame, path: str) -> DataFrame:
    """All that a stream gives for what is there now, written under ``path`` and read again; its progress is kept beside it."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
