"""The state machines as Structured Streaming queries and as batch replays.

Samples are rows (session, frame, ts, right, left, gap, turn), and may have a
``control`` ("reset" or "stop") in place of a sample. They may arrive in any
order within the delay; the stream holds them back until the watermark has
passed (``buffered``). The replay applies the same machine to whole sessions in
order, batch by batch, and is what the stream is tested against.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.ordered import in_order
from .buffered import IDLE_S, RESET, STOP, rows_of, session_events
from .counter import CounterRules
from .machines import REPS, VERDICTS, Counting, Judging, Machine
from .session import SessionRules

__all__ = ["REPS", "VERDICTS", "changes", "count_reps", "increasing_ms", "judge_sessions", "replay", "replay_reps", "replay_sessions", "session_report", "spoken"]


def replay(samples: DataFrame, machine: Machine) -> DataFrame:
    """The machine's rows of whole sessions, each read in order of (ts, frame); a session holds its state and no more."""
    types = to_arrow_schema(samples.sparkSession.createDataFrame([], machine.schema).schema)
    control = F.col("control") if "control" in samples.columns else F.lit(None).cast("string")
    known = [c for c in samples.columns if c not in ("session", "frame", "ts", "control")]
    rows = samples.select("session", F.unix_micros("ts").alias("us"), "frame", control.alias("control"), *known)

    def step(state: tuple | None, part: pa.RecordBatch) -> tuple[tuple, pa.RecordBatch | None]:
        state, over = state or (machine.load(None), False)
        made = []
        for r in part.to_pylist():
            over = over or r["control"] == STOP or machine.over(state)
            if over:
                break
            if r["control"] == RESET:
                state = machine.load(None)
            else:
                made += [{"session": r["session"], **m} for m in machine.feed(state, r["frame"], r["us"] / 1e6, r)]
        return (state, over), pa.RecordBatch.from_pylist(made, schema=types) if made else None

    return in_order(rows, ("session",), ("us", "frame"), step, machine.schema)


def count_reps(samples: DataFrame, rules: CounterRules = CounterRules(), delay_s: float = 10.0, idle_s: float = IDLE_S) -> DataFrame:
    """Repetitions as they are confirmed, from a stream of samples; a session idle for ``idle_s`` is forgotten."""
    machine = Counting(rules)
    return rows_of(session_events(samples, machine, delay_s, idle_s), machine)


def replay_reps(samples: DataFrame, rules: CounterRules = CounterRules()) -> DataFrame:
    return replay(samples, Counting(rules))


def judge_sessions(samples: DataFrame, rules: SessionRules = SessionRules(), delay_s: float = 10.0, idle_s: float = IDLE_S) -> DataFrame:
    """Repetitions with the errors found in them, from a stream of samples; a session idle for ``idle_s`` is forgotten."""
    machine = Judging(rules)
    return rows_of(session_events(samples, machine, delay_s, idle_s), machine)


def replay_sessions(samples: DataFrame, rules: SessionRules = SessionRules()) -> DataFrame:
    return replay(samples, Judging(rules))


def session_report(verdicts: DataFrame) -> DataFrame:
    """Per session: judged repetitions, how many had no error, their share, and the errors, the most frequent first."""
    judged = verdicts.filter("phase = 'ACTIVE'")
    totals = judged.groupBy("session").agg(F.count("*").alias("total_reps"), F.count_if(F.size("errors") == 0).alias("correct_reps")).withColumn("accuracy", F.col("correct_reps") / F.col("total_reps"))
    counts = judged.select("session", F.explode("errors").alias("error")).groupBy("session", "error").agg(F.count("*").alias("n"))
    named = counts.groupBy("session").agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "error", "n"))), lambda e: F.struct(e["error"], e["n"]))).alias("error_counts"))
    return totals.join(named, "session", "left")


def spoken(messages: DataFrame, cooldown_s: float = 4.0) -> DataFrame:
    """Of (session, key, t) the messages that are said: none within ``cooldown_s`` of the last one said with that key.

    Whether one is said depends on the last that was, so the times of a key are
    read in order; all that is carried is that one.
    """
    rows = messages.select("session", "key", F.col("t").cast("double").alias("t")).filter("t IS NOT NULL")

    def step(last: float | None, part: pa.RecordBatch) -> tuple[float | None, pa.RecordBatch]:
        said = []
        for k, t in enumerate(part.column("t").to_pylist()):
            if last is None or t - last >= cooldown_s:
                said.append(k)
                last = t
        return last, part.take(pa.array(said, pa.int64()))

    return in_order(rows, ("session", "key"), ("t",), step, rows.schema)


def changes(states: DataFrame) -> DataFrame:
    """Of (session, t, phase, count) the rows at which the phase or the count changes; ``streak`` numbers rows since the phase did."""
    from pyspark.sql import Window

    order = Window.partitionBy("session").orderBy("t")
    before = F.struct(F.lag("phase").over(order).alias("phase"), F.lag("count").over(order).alias("count"))
    marked = states.withColumns({"_b": before, "_new": F.coalesce(F.col("phase") != F.lag("phase").over(order), F.lit(True)).cast("int")})
    runs = marked.withColumn("_run", F.sum("_new").over(order)).withColumn("streak", F.row_number().over(Window.partitionBy("session", "_run").orderBy("t")))
    return runs.filter((F.col("_new") == 1) | ~F.col("count").eqNullSafe(F.col("_b.count"))).drop("_b", "_new", "_run")


def increasing_ms(times: DataFrame) -> DataFrame:
    """Strictly increasing milliseconds from seconds ``t``: at least one more than the last.

    max(last + 1, now) over a sequence is the running maximum of now less its
    position, plus the position.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("session").orderBy("t", "frame")
    n = F.row_number().over(order)
    numbered = times.withColumn("_n", n).withColumn("_x", F.floor(F.col("t") * 1000) - F.col("_n"))
    return numbered.withColumn("ms", (F.max("_x").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_n")).cast("long")).drop("_n", "_x")
