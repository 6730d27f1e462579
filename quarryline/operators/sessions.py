"""State of sessions from their ordered events: phases, milestones, tool use, approvals, patches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def since_last(events: DataFrame, session: str, order: list[str], start: Column) -> DataFrame:
    """Events after the last start of their session; sessions without one keep all."""
    last = events.groupBy(F.col(session).alias("_session")).agg(F.max(F.when(start, F.struct(*order))).alias("_last"))  # partial sums, no sort of a hot session
    own = events.join(last, F.col(session).eqNullSafe(F.col("_session")))
    return own.where(F.col("_last").isNull() | (F.struct(*order) > F.col("_last"))).drop("_last", "_session")


def milestone_states(events: DataFrame, session: str, order: list[str], milestone: str, status: str) -> DataFrame:
    """(session, completed, in_progress) of ordered updates: completed ones in order of their first completion; the one
    in progress is the last started, unless that one was completed or any failed since."""
    done = events.where(F.col(status) == "completed").groupBy(session, milestone).agg(F.min(F.struct(*order)).alias("at"))
    done = done.groupBy(session).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(milestone).alias("m")))), lambda x: x["m"]).alias("completed"))
    begun = events.where(F.col(status) == "in_progress").groupBy(session).agg(F.max(F.struct(*order, F.col(milestone).alias("m"))).alias("b"))
    over = events.join(begun, session).where((F.struct(*order) > F.struct(*[F.col(f"b.{o}") for o in order])) & ((F.col(status) == "failed") | ((F.col(status) == "completed") & (F.col(milestone) == F.col("b.m")))))
    open_ = begun.join(over.select(session).distinct(), session, "left_anti").select(session, F.col("b.m").alias("in_progress"))
    return events.select(session).distinct().join(done, session, "left").join(open_, session, "left")


def percent(phase: Column, total: Column) -> Column:
    """Progress when a phase starts: whole per cent of the phases before it."""
    return F.when(total > 0, F.floor((phase - 1) * 100 / total)).otherwise(0).cast("int")


def tool_use(calls: DataFrame, session: str) -> DataFrame:
    """calls (session, tool, path, lines, chunks, success) to totals by session."""
    read, wrote = F.col("tool").isin("read_file", "read_files"), F.col("tool").isin("write_file", "edit_file") & F.col("success")
    own = F.when(F.col("path") != "", F.col("path"))
    return calls.groupBy(session).agg(
        F.countDistinct(F.when(read, own)).alias("files_read"), F.coalesce(F.sum(F.when(read, F.col("lines"))), F.lit(0)).alias("lines_read"),
        F.count_if(F.col("tool") == "search_code").alias("searches"), F.coalesce(F.sum(F.when(F.col("tool") == "search_code", F.col("chunks"))), F.lit(0)).alias("chunks"),
        F.countDistinct(F.when(wrote, own)).alias("files_written"),
    )


def approvals(asked: DataFrame, session: str, order: list[str], tool: str, answer: str) -> DataFrame:
    """asked with decision: 'auto' once all calls ('a') or this tool ('t') were approved before, else 'rejected' for 'n'
    and 'approved' for any other answer. Answers to calls that need none don't count: after 'a' or 't' none is asked."""
    before = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(session, tool).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # An 'a' given for a tool already approved was never asked for.
    own = asked.withColumn("_tool", F.coalesce(F.max(F.col(answer) == "t").over(same), F.lit(False)))
    own = own.withColumn("_all", F.coalesce(F.max((F.col(answer) == "a") & ~F.col("_tool")).over(before), F.lit(False)))
    decision = F.when(F.col("_all") | F.col("_tool"), "auto").when(F.col(answer) == "n", "rejected").otherwise("approved")
    return own.withColumn("decision", decision).drop("_all", "_tool")


def patched(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Each key with the last value of every column that isn't null."""
    return rows.groupBy(*keys).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*order))).alias(v) for v in values])


def recent(turns: DataFrame, session: str, order: list[str], role: str, text: str, cut: int = 45) -> DataFrame:
    """(session, instruction, turns): the first text of the user, cut, and how many turns there are."""
    first = F.min_by(F.when(F.col(role) == "user", F.col(text)), F.when(F.col(role) == "user", F.struct(*order)))
    s = turns.groupBy(session).agg(F.coalesce(first, F.lit("")).alias("t"), F.count(F.lit(1)).alias("turns"))
    return s.select(session, F.when(F.length("t") > cut, F.concat(F.substring("t", 1, cut), F.lit("..."))).otherwise(F.col("t")).alias("instruction"), "turns")


def project_sessions(sessions: DataFrame, project: str, limit: int = 10, order: str = "created_at") -> DataFrame:
    """The newest sessions (session, project, and others) of a project, ties by session."""
    return sessions.where(F.col("project") == project).orderBy(F.desc(order), "session").limit(limit)


# What a status is shown as.
STATUS = {"done": "✓ done", "completed": "✓ done", "failed": "✗ failed", "cancelled": "⊘ cancel", "thinking": "◌ active", "running": "◌ active"}


def cut(text: Column, n: int) -> Column:
    """The first n characters, with dots if there are more; null as an empty text."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def newest(sessions: DataFrame, limit: int) -> DataFrame:
    """sessions (session, project, created_at as text, and others), of each project the newest and their place from 1; those
    without a time come last, ties go by session. Spark cuts at the limit before it shuffles, so a large project is no hot one."""
    w = Window.partitionBy("project").orderBy(F.col("created_at").desc_nulls_last(), "session")
    return sessions.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def listed_sessions(sessions: DataFrame, limit: int = 10) -> DataFrame:
    """(project, place, session, date, instruction, status) of the newest sessions of every project, as shown in a list.

    created_at is a time in ISO form, shown in its own zone; of other text the first ten characters are shown, and for none
    'Unknown'. A status without a label is shown as it is, null as 'unknown'.
    """
    at = F.col("created_at")
    # a time keeps its zone's hours: what names the zone is cut off
    own = F.when(at.rlike(r"^\d{4}-\d\d-\d\d"), F.regexp_replace(at, r"(Z|[+-]\d\d:?\d\d)$", "")).try_cast("timestamp_ntz")
    date = F.when(F.coalesce(at, F.lit("")) == "", "Unknown").otherwise(F.coalesce(F.date_format(own, "MMM dd HH:mm"), F.substring(at, 1, 10)))
    status = F.coalesce("status", F.lit("unknown"))
    label = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return newest(sessions, limit).select("project", "place", "session", date.alias("date"), cut(F.col("instruction"), 45).alias("instruction"), F.coalesce(F.try_element_at(label, status), status).alias("status"))


def session_hints(sessions: DataFrame, limit: int = 3) -> DataFrame:
    """(project, found, last): how many sessions a project has, limit at most, and the newest one's instruction."""
    last = F.min_by(cut(F.col("instruction"), 40), "place")
    return newest(sessions, limit).groupBy("project").agg(F.count(F.lit(1)).alias("found"), last.alias("last"))


def run_summary(events: DataFrame, session: str, order: list[str]) -> DataFrame:
    """events (session, order, type, value) to (session, files_changed, phases_completed, milestones_completed, error).

    type phase_start: value is the phase's number, and the milestones completed so far no longer count; milestone: one is
    completed; change: a file's path (an empty one is none); error: its message. Files and milestones count once, the last
    phase (0 if none) and the last error decide; null values don't count. The files themselves: operators.events.changed_files.
    """
    own = events.where(F.col("type").isin("phase_start", "milestone", "change", "error") & F.col("value").isNotNull())
    of = lambda kind: F.when(F.col("type") == kind, F.struct(*order))
    path = F.when((F.col("type") == "change") & (F.col("value") != ""), F.col("value"))
    total = own.groupBy(session).agg(
        F.countDistinct(path).alias("files_changed"), F.coalesce(F.max_by("value", of("phase_start")).try_cast("int"), F.lit(0)).alias("phases_completed"), F.max_by("value", of("error")).alias("error"),
    )
    left = since_last(own.where("type in ('phase_start', 'milestone')"), session, order, F.col("type") == "phase_start").where("type = 'milestone'")
    done = left.groupBy(F.col(session).alias("_session")).agg(F.countDistinct("value").alias("_n"))
    out = total.join(done, F.col(session).eqNullSafe(F.col("_session")), "left")
    return out.select(session, "files_changed", "phases_completed", F.coalesce("_n", F.lit(0).cast("long")).alias("milestones_completed"), "error")


def session_events(events: DataFrame, session: str, value, order: list[str], limit: int = 100) -> DataFrame:
    """The first events of a session, in order."""
    return events.where(F.col(session) == F.lit(value)).orderBy(*order).limit(limit)


def token_usage(usage: DataFrame, session: str, values: list[str]) -> DataFrame:
    """Totals by session; null counts as none."""
    return usage.groupBy(session).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values], F.count(F.lit(1)).alias("calls"))


def progress(phases: DataFrame, session: str = "session", status: str = "status") -> DataFrame:
    """(session, completed, running, total, shown) of tracked phases: which phase runs, or how many are done."""
    n = phases.groupBy(session).agg(F.count_if(F.col(status) == "completed").alias("completed"), F.count_if(F.col(status) == "running").alias("running"), F.count(F.lit(1)).alias("total"))
    text = lambda x: F.col(x).cast("string") if isinstance(x, str) else x.cast("string")
    now = F.concat(F.lit("Phase "), text(F.col("completed") + 1), F.lit("/"), text("total"), F.lit(" ("), text("completed"), F.lit(" completed)"))
    return n.withColumn("shown", F.when(F.col("running") > 0, now).otherwise(F.concat(F.lit("Progress: "), text("completed"), F.lit("/"), text("total"), F.lit(" phases"))))


TRACKED = "session string, phase int, name string, status string, current boolean, tools long"


def phase_state() -> dict:
    return {"names": [], "states": [], "at": 0, "tools": 0}


def advance(state: dict, kind: str, name: str | None, index: float | None, status: str | None) -> None:
    """One event's effect on the phases of its session; see :func:`track_phases`."""
    names, states, at = state["names"], state["states"], state["at"]
    if kind == "plan" and not names:
        state["names"] = [n for n in (name or "").split("\n") if n]
        state["states"] = ["pending"] * len(state["names"])
    elif kind == "phase":
        i = int(index) if pd.notna(index) else -1
        if not 0 <= i < len(names):
            i = next((i for i, n in enumerate(names) if n == name or i == at), -1)
        if i >= 0:
            states[i], state["at"] = status, i
    elif kind in ("worker_start", "worker_done"):
        state["tools"] = 0
        if at < len(names):
            states[at] = "running" if kind == "worker_start" else "completed"
            state["at"] = at + (kind == "worker_done")
    elif kind == "tool":
        state["tools"] += 1


def phase_rows(session: str, state: dict) -> pd.DataFrame:
    out = [(session, i, n, s, i == state["at"], state["tools"]) for i, (n, s) in enumerate(zip(state["names"], state["states"], strict=True))]
    return pd.DataFrame(out, columns=[c.split()[0] for c in TRACKED.split(", ")])


def phase_events(events: DataFrame) -> DataFrame:
    return events.select(F.col("session").cast("string"), "seq", "type", "name", F.col("index").cast("double"), "status")


def track_phases(events: DataFrame) -> DataFrame:
    """events (session, seq, type, name, index, status) to the phases of each session and their states.

    plan: name holds the phases, separated by line breaks; a later plan is ignored. phase: a phase gets a
    status; without an index in range the first phase that has the name or is current changes. worker_start
    and worker_done run and end the current phase; both set the count of tools to 0; tool adds 1. An empty session, or one
    without a plan, gives no rows. Tool events, the bulk of a session, meet as counts between two other events; the rest of
    one session's events meets in one task.
    """
    own = phase_events(events).where(F.col("type").isin("plan", "phase", "worker_start", "worker_done", "tool"))
    marks = own.where("type <> 'tool'")
    reset = marks.where("type <> 'plan' and type <> 'phase'").groupBy(F.col("session").alias("_s")).agg(F.max("seq").alias("_reset"))
    since = own.where("type = 'tool'").join(reset, F.col("session").eqNullSafe(F.col("_s")), "left").where("_reset is null or seq > _reset")
    tools = since.groupBy(F.col("session").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))

    def fold(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        state = phase_state()
        for e in g.sort_values("seq", kind="stable").itertuples(index=False):
            advance(state, e.type, e.name, e.index, e.status)
        return phase_rows(key[0], state)

    folded = marks.groupBy("session").applyInPandas(fold, TRACKED)
    out = folded.join(tools, F.col("session").eqNullSafe(F.col("_s")), "left")
    return out.select("session", "phase", "name", "status", "current", F.coalesce("_n", F.lit(0).cast("long")).alias("tools"))
