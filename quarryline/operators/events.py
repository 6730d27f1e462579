"""Reducers over ordered event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import epoch_ms


def until_terminal(events: DataFrame, session: str, order: list[str], terminal: Column) -> DataFrame:
    """Events up to the first terminal one of their session, that one included."""
    w = Window.partitionBy(session).orderBy(*order)
    before = F.sum(terminal.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("_n", F.coalesce(before, F.lit(0))).where("_n = 0").drop("_n")


def running_since(events: DataFrame, session: str, order: list[str], reset: Column) -> DataFrame:
    """segment (resets so far) and place (rows since the last one)."""
    w = Window.partitionBy(session).orderBy(*order)
    seg = events.withColumn("segment", F.sum(reset.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return seg.withColumn("place", F.row_number().over(Window.partitionBy(session, "segment").orderBy(*order)))


def latest(events: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The value of the last event of each key; a partial aggregate, no sort."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def pair_calls(calls: DataFrame, ends: DataFrame, keys: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """calls (keys, at, order, and others) with their ends (keys, at, order, success): done_at, seconds (rounded to 2 digits;
    null while the call is open) and success, a row for each call.

    An end closes the latest call with its id before it that is still open. So a call's end is what follows it among the
    calls and ends of its id; one that another call follows stays open, and an end without an open call counts for none.
    At the same time, and with equal order columns, a call comes first. No call is ever joined to other calls' ends: the
    two are read in a row, in time, and only the one row ahead is looked at.
    """
    others = [c for c in calls.columns if c not in (*keys, "at", *order)]
    place = [*[F.col(c) for c in keys], F.col("at"), *[F.col(c) for c in order]]
    own = calls.select(*place, F.lit(0).alias("_kind"), F.struct(F.lit(0).alias("_"), *others).alias("_own"), F.lit(None).cast("boolean").alias("_success"))
    done = ends.select(*place, F.lit(1).alias("_kind"), F.lit(None).cast(own.schema["_own"].dataType).alias("_own"), F.col("success").alias("_success"))
    w = Window.partitionBy(*keys).orderBy("at", *order, "_kind")
    closed = F.lead("_kind").over(w) == 1
    both = own.unionByName(done).withColumns({"done_at": F.when(closed, F.lead("at").over(w)), "success": F.when(closed, F.lead("_success").over(w))})
    took = F.floor((epoch_ms(F.col("done_at")) - epoch_ms(F.col("at")) + 5) / 10) / 100
    return both.where("_kind = 0").select(*place, *[f"_own.{c}" for c in others], "done_at", "success").withColumn("seconds", took)


def open_calls(paired: DataFrame) -> DataFrame:
    return paired.where("done_at is null").drop("done_at", "seconds", "success")


def changed_files(paired: DataFrame, session: str, tool: str = "tool", path: str = "path", writers: tuple[str, ...] = ("write_file", "edit_file")) -> DataFrame:
    """(session, path): files that a successful call wrote, each once."""
    return paired.where(F.col(tool).isin(*writers) & F.col("success") & (F.col(path) != "")).select(session, path).distinct()


def first_seen(events: DataFrame, session: str, value: str, order: list[str]) -> DataFrame:
    """Distinct values of a session, joined in the order in which they first occur."""
    first = events.groupBy(session, value).agg(F.min(F.struct(*order)).alias("at"))
    return first.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x[value]), ",").alias("seen"))


def framed(lines: DataFrame, stream: str, seq: str, line: str) -> DataFrame:
    """SSE records of numbered lines: (stream, event, data). A blank line ends a record; an open one counts at the end."""
    w = Window.partitionBy(stream).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    r = lines.withColumn("rec", F.coalesce(F.sum((F.trim(line) == "").cast("int")).over(w), F.lit(0)))
    data = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(line).startswith("data:"), F.struct(F.col(seq).alias("s"), F.trim(F.substring(line, 6, 1 << 30)).alias("d"))))), lambda x: x["d"]), "\n")
    event = F.max_by(F.when(F.col(line).startswith("event:"), F.trim(F.substring(line, 7, 1 << 30))), F.when(F.col(line).startswith("event:"), F.col(seq)))
    return r.groupBy(stream, "rec").agg(event.alias("event"), data.alias("data")).where("event is not null and data <> ''").select(stream, "event", "data")
