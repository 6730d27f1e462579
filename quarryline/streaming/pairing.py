"""Pairing of calls with their ends over an event stream; the batch twin is operators.events.pair_calls."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PAIRED = "call_id string, at timestamp, tool string, done_at timestamp, success boolean, seconds double"


def _ms(at: pd.Timestamp) -> int:
    return at.value // 1_000_000


def fold(pending: list[list], open_call: list | None, upto: int, give_up_ms: int) -> tuple[list[list], list | None, list[tuple]]:
    """Of pending events [ms, kind, tool, success] (kind 0: a call) those at or before ``upto`` in time, after the call that
    is open: what stays pending, the call that is then open, and rows (call, its end or None) that are settled. A call
    that another one follows, or that has been open for give_up_ms, is settled without an end."""
    settled = []
    due = sorted((e for e in pending if e[0] <= upto), key=lambda e: (e[0], e[1]))
    for e in due:
        if e[1] == 0:
            if open_call is not None:
                settled.append((open_call, None))
            open_call = e
        elif open_call is not None:
            settled.append((open_call, e) if e[0] - open_call[0] <= give_up_ms else (open_call, None))
            open_call = None
    if open_call is not None and open_call[0] + give_up_ms < upto:
        settled.append((open_call, None))
        open_call = None
    return [e for e in pending if e[0] > upto], open_call, settled


def paired_calls(events: DataFrame, late: str = "10 minutes", give_up: str = "1 hour") -> DataFrame:
    """events (call_id, at, kind: 'call' or 'end', tool, success) to calls with their ends, as PAIRED, in append mode.

    An id's events wait in its state until the watermark (``late`` behind the latest event) has passed them, and are then
    folded in order of time; so the order of arrival within ``late`` doesn't matter, and nothing that was emitted is ever
    revised. A call without an end is emitted with null done_at once another call of its id follows it or it has been open
    for ``give_up``; then its state is dropped. State holds the events of the last ``late`` and one open call an id.
    """
    wait = int(pd.Timedelta(give_up).total_seconds() * 1000)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, open_call = json.loads(state.get[0]) if state.exists else ([], None)
        if not state.hasTimedOut:
            for e in pd.concat(list(parts)).itertuples(index=False):
                pending.append([_ms(e.at), int(e.kind == "end"), e.tool, None if e.success is None else bool(e.success)])
        mark = state.getCurrentWatermarkMs()
        pending, open_call, settled = fold(pending, open_call, mark, wait)
        if pending or open_call is not None:
            state.update((json.dumps([pending, open_call]),))
            wake = min([e[0] for e in pending] + ([open_call[0] + wait] if open_call is not None else []))
            state.setTimeoutTimestamp(max(wake, mark) + 1)
        else:
            state.remove()
        time = lambda ms: None if ms is None else pd.Timestamp(ms, unit="ms")
        rows = [(key[0], time(c[0]), c[2], time(d and d[0]), d and d[3], d and (d[0] - c[0] + 5) // 10 / 100) for c, d in settled]
        out = pd.DataFrame(rows, columns=["call_id", "at", "tool", "done_at", "success", "seconds"])
        yield out.astype({"at": "datetime64[ns]", "done_at": "datetime64[ns]", "seconds": "float64", "success": "object"})

    own = events.select(F.col("call_id").cast("string").alias("call_id"), "at", "kind", "tool", "success").withWatermark("at", late)
    return own.groupBy("call_id").applyInPandasWithState(run, PAIRED, "state string", "append", GroupStateTimeout.EventTimeTimeout)
