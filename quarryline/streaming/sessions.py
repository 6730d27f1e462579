"""State of sessions and of open records over event streams; batch twins are in operators.sessions and operators.events."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import sessions as S

RECORD = "stream string, event string, data string"


def track_phases(events: DataFrame) -> DataFrame:
    """As operators.sessions.track_phases: the phases of each session that a micro-batch has events of. State is the
    session's plan and statuses; events of a micro-batch count in order of seq."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = json.loads(state.get[0]) if state.exists else S.phase_state()
        for e in pd.concat(list(parts)).sort_values("seq", kind="stable").itertuples(index=False):
            S.advance(own, e.type, e.name, e.index, e.status)
        state.update((json.dumps(own),))
        yield S.phase_rows(key[0], own)

    return S.phase_events(events).groupBy("session").applyInPandasWithState(fold, S.TRACKED, "state string", "update", GroupStateTimeout.NoTimeout)


def sse_records(lines: DataFrame) -> DataFrame:
    """lines (stream, seq, line) to the records that a blank line ends; the open record of a stream waits in the state.

    A record needs an event and data; several data lines are joined by line breaks.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        event, data = json.loads(state.get[0]) if state.exists else (None, [])
        out = []
        for line in pd.concat(list(parts)).sort_values("seq", kind="stable")["line"]:
            line = (line or "").strip()
            if not line:
                if event and data:
                    out.append((key[0], event, "\n".join(data)))
                event, data = None, []
            elif line.startswith("event:"):
                event = line.removeprefix("event:").strip()
            elif line.startswith("data:"):
                data.append(line.removeprefix("data:").strip())
        state.update((json.dumps([event, data]),))
        yield pd.DataFrame(out, columns=["stream", "event", "data"])

    own = lines.selectExpr("cast(stream as string) as stream", "seq", "line")
    return own.groupBy("stream").applyInPandasWithState(fold, RECORD, "state string", "append", GroupStateTimeout.NoTimeout)


def until_terminal(records: DataFrame, terminal: Sequence[str]) -> DataFrame:
    """records (job, position, type, and others) up to the first terminal one of their job, that one included, as
    operators.events.until_terminal; what comes after it, in whichever micro-batch, is dropped.

    A job's records of one micro-batch are one group; they must come in order of position from batch to batch. State is
    the position of the end, or nothing. A null type isn't terminal.
    """
    schema = records.schema

    def cut(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            return
        own = list(parts)
        ends = [p["position"][p["type"].isin(terminal)].min() for p in own]
        end = min((int(e) for e in ends if pd.notna(e)), default=None)
        if end is not None:
            state.update((end,))
        for p in own:
            yield p if end is None else p[p["position"] <= end]

    return records.groupBy("job").applyInPandasWithState(cut, schema, "end long", "append", GroupStateTimeout.NoTimeout)
