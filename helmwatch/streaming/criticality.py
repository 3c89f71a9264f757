"""The criticality walk and zero runs over unbounded streams, in the order of event time, with state per case."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "case_key string, ts timestamp, criticality long, zero_run long"
STATE = "last_us long, criticality long, zero_run long, held binary"
#: Rows that wait for the watermark, packed.
ROW = np.dtype([("us", "<i8"), ("zero", "?"), ("alarm", "?"), ("actionable", "?")])


def _packed(frame: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(frame), ROW)
    out["us"] = frame["ts"].astype("datetime64[us]").astype("int64")
    out["zero"] = frame["value"].to_numpy(float) == 0
    for c in ("alarm", "actionable"):
        out[c] = frame[c].fillna(False).astype(bool)
    return out


def walk_rows(rows: np.ndarray, last: int | None, criticality: int, zeros: int, step_us: int) -> tuple[np.ndarray, np.ndarray]:
    """Criticality and zero run of rows in the order of time, going on from a case's last row. Both begin afresh where
    a step is not exactly step_us. The walk reflected at 0 is the free walk less its least value so far, if negative."""
    us = rows["us"]
    steps = np.where(rows["actionable"], np.where(rows["alarm"], 1, -1), 0)
    level, run = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    begins = np.diff(us, prepend=us[0] if last is None else last) != step_us
    begins[0] |= last is None
    for at in np.split(np.arange(len(rows)), np.flatnonzero(begins)):
        if not len(at):
            continue
        if begins[at[0]]:
            criticality, zeros = 0, 0
        free = criticality + np.cumsum(steps[at])
        level[at] = free - np.minimum(np.minimum.accumulate(free), 0)
        place = np.arange(len(at))
        other = np.maximum.accumulate(np.where(rows["zero"][at], -1, place))
        run[at] = np.where(other < 0, place + 1 + zeros, place - other)
        criticality, zeros = int(level[at[-1]]), int(run[at[-1]])
    return level, run


def _walker(step_seconds: int):
    def walk(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, criticality, zeros, held = state.get if state.exists else (None, 0, 0, b"")
        fresh = [] if state.hasTimedOut else [_packed(f) for f in frames]
        rows = np.concatenate([np.frombuffer(bytes(held), ROW), *fresh])
        # Of rows with one time the first that came stays.
        rows = rows[np.unique(rows["us"], return_index=True)[1]]
        if last is not None:
            rows = rows[rows["us"] > last]
        watermark = state.getCurrentWatermarkMs()
        due = int(np.searchsorted(rows["us"], watermark * 1000, side="right"))
        ready, rest = rows[:due], rows[due:]
        if due:
            level, run = walk_rows(ready, last, criticality, zeros, step_seconds * 1_000_000)
            last, criticality, zeros = int(ready["us"][-1]), int(level[-1]), int(run[-1])
            yield pd.DataFrame({"case_key": key[0], "ts": pd.to_datetime(ready["us"], unit="us"), "criticality": level, "zero_run": run})
        state.update((last, criticality, zeros, rest.tobytes()))
        if len(rest):
            state.setTimeoutTimestamp(max(int(rest["us"][0]) // 1000, watermark + 1))

    return walk


def criticality_stream(events: DataFrame, step_seconds: int = 600, delay: str = "10 minutes") -> DataFrame:
    """events (case_key, ts timestamp, value double, alarm boolean, actionable boolean) as a stream: each row with its
    criticality and zero run. Both start afresh where the step is not exactly step_seconds.

    Rows wait in the state until the watermark, delay behind the newest time, has passed them; then they are walked in
    the order of their times, woken by a timer if no later row of the case comes. So rows that come late or in any
    order within delay give the result of a batch. Later ones are dropped, and of several rows of a case with one time
    all but one. A missing value ends a zero run; a missing flag is false."""
    return events.withWatermark("ts", delay).groupBy("case_key").applyInPandasWithState(_walker(step_seconds), OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
