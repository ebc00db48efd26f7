"""Streams of samples put into order of event time before a session takes them.

Samples wait in the state until the watermark has passed them, so a session sees
them in order whatever order they arrive in, as long as none is more than the
delay behind the latest. Those that are come out as rows of their own. Timers
release what waits, end sessions that went idle, and forget them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .machines import REPORTS, Machine

#: What a stream of sessions gives: rows of the machine, samples that came too late, and a report of each session that ended.
EVENTS = "kind string, session string, us long, frame long, payload string"
ROW, LATE, REPORT = "row", "late", "report"
#: What a sample's ``control`` may say: forget all that was seen, or take no more samples.
RESET, STOP = "reset", "stop"
#: Why a session ended.
STOPPED, IDLE, FULL = "stop", "idle", "max_reps"
#: Seconds of event time after a session's last sample at which it ends and its state goes.
IDLE_S = 24 * 3600.0
#: Seconds beyond the delay within which a late sample still comes out as a row; those later yet are only counted by Spark.
GRACE_S = 7 * 24 * 3600.0
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_WAITING = "us long, frame long, control string, sample string"
_KEPT = "machine string, first long, last long, timer long, ended boolean"


class Ordered(StatefulProcessor):
    """Holds samples until the watermark has passed them, then feeds them to ``machine`` in order of (us, frame)."""

    def __init__(self, machine: Machine, grace_s: float, idle_s: float):
        self.machine, self.grace_ms, self.idle_us = machine, int(grace_s * 1000), int(idle_s * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.kept = handle.getValueState("kept", _KEPT)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if key[0] is None:  # these rows have moved the watermark, which is all they are for
            return
        passed = self._passed(timerValues)
        out, fresh = [], []
        for frame in rows:
            for us, number, control, sample in zip(frame["us"].tolist(), frame["frame"].tolist(), frame["control"].tolist(), frame["sample"].tolist(), strict=True):
                if us < passed:
                    out.append((LATE, key[0], us, number, None))
                else:
                    fresh.append((us, number, control, sample))
        yield from self._go_on(key[0], passed, fresh, out)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._go_on(key[0], self._passed(timerValues), [], [])

    def close(self) -> None:
        pass

    def _passed(self, timers: Any) -> int:
        """No sample before that time, in microseconds, is in order any more. Spark's watermark lies ``grace_ms`` behind."""
        mark = timers.getCurrentWatermarkInMs()
        return (mark + self.grace_ms) * 1000 if mark > 0 else -(2**63)

    def _go_on(self, session: str, passed: int, fresh: list[tuple], out: list[tuple]) -> Iterator[pd.DataFrame]:
        text, first, last, timer, ended = self.kept.get() or (None, None, None, None, False)
        if not fresh and last is None:  # nothing but late samples of a session that is forgotten
            if out:
                yield _events(out)
            return
        stored = first is not None  # samples wait from batches before
        if fresh:
            times = [f[0] for f in fresh]
            first, last = min(times) if first is None else min(first, *times), max(times) if last is None else max(last, *times)
        if first is not None and first < passed:
            held = [*self.waiting.get(), *fresh] if stored else fresh
            due = sorted((h for h in held if h[0] < passed), key=lambda h: h[:2])
            rest = [h for h in held if h[0] >= passed]
            if rest:
                self.waiting.put(rest)
            elif stored:
                self.waiting.clear()
            first = min((h[0] for h in rest), default=None)
            text, ended = self._feed(session, text, ended, due, out)
        elif fresh:
            self.waiting.appendList(fresh)
        if first is None and last + self.idle_us < passed:
            if not ended:
                out.append(self._report(session, self.machine.load(text), IDLE, last))
            self.kept.clear()
            if timer is not None:
                self.handle.deleteTimer(timer)
        else:
            # one timer: for the first sample that waits, or else for the end
            due_at = max((last + self.idle_us if first is None else first) // 1000 + 1 - self.grace_ms, 1)
            if due_at != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(due_at)
            self.kept.update((text, first, last, due_at, ended))
        if out:
            yield _events(out)

    def _feed(self, session: str, text: str | None, ended: bool, due: list[tuple], out: list[tuple]) -> tuple[str | None, bool]:
        state = self.machine.load(text)
        for us, frame, control, sample in due:
            if ended:  # what comes after the end is of no account
                break
            if control == RESET:
                state = self.machine.load(None)
            elif control == STOP:
                ended = True
                out.append(self._report(session, state, STOPPED, us))
            else:
                made = self.machine.feed(state, frame, us / 1e6, json.loads(sample))
                out += [(ROW, session, us, frame, json.dumps(m)) for m in made]
                if self.machine.over(state):
                    ended = True
                    out.append(self._report(session, state, FULL, us))
        return self.machine.dump(state), ended

    def _report(self, session: str, state: Any, reason: str, us: int) -> tuple:
        return REPORT, session, us, None, json.dumps(self.machine.report(state, reason))


def _events(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["kind", "session", "us", "frame", "payload"])
    return frame.astype({"us": "Int64", "frame": "Int64"})


def session_events(samples: DataFrame, machine: Machine, delay_s: float = 10.0, idle_s: float = IDLE_S, grace_s: float = GRACE_S) -> DataFrame:
    """``EVENTS`` of a stream of samples (session, frame, ts, perhaps control, and what the machine takes).

    A sample is in order if it is at most ``delay_s`` older than the latest that
    came with earlier batches. Late ones come out as rows of kind ``late``, up
    to ``grace_s`` beyond the delay. Rows without a session move the watermark
    and do nothing else, so a source can tell by them how far it has come. The
    state store has to be ``PROVIDER``.
    """
    known = [c for c in samples.columns if c not in ("session", "frame", "ts", "control")]
    # a stream keeps the provider that it was started with in its checkpoint
    samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    control = F.col("control") if "control" in samples.columns else F.lit(None).cast("string")
    # rows without a session are left for the operator to pass over: a filter would be moved below the watermark
    rows = samples.withWatermark("ts", f"{round((delay_s + grace_s) * 1000)} milliseconds").filter(F.col("ts").isNotNull())
    waiting = rows.select("session", F.unix_micros("ts").alias("us"), F.coalesce(F.col("frame"), F.lit(0)).cast("long").alias("frame"), control.alias("control"), F.to_json(F.struct(*known)).alias("sample"), "ts")
    return waiting.groupBy("session").transformWithStateInPandas(statefulProcessor=Ordered(machine, grace_s, idle_s), outputStructType=EVENTS, outputMode="Append", timeMode="EventTime")


def rows_of(events: DataFrame, machine: Machine) -> DataFrame:
    """The machine's rows among ``EVENTS``."""
    body = machine.schema.split(", ", 1)[1]
    return events.filter(F.col("kind") == ROW).select("session", F.from_json("payload", body).alias("p")).select("session", "p.*")


def late_of(events: DataFrame) -> DataFrame:
    """(session, ts, frame) of samples that came too late."""
    return events.filter(F.col("kind") == LATE).select("session", F.timestamp_micros("us").alias("ts"), "frame")


def reports_of(events: DataFrame) -> DataFrame:
    """``REPORTS`` of sessions that ended, with the event time of their end."""
    body = REPORTS.split(", ", 1)[1]
    return events.filter(F.col("kind") == REPORT).select("session", F.timestamp_micros("us").alias("ended"), F.from_json("payload", body).alias("p")).select("session", "ended", "p.*")


def upsert_to(folder: str):
    """For ``foreachBatch``: write each batch to a place of its own, so that a batch that is done again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def upserted(written: DataFrame, *key: str) -> DataFrame:
    """Of rows written by ``upsert_to`` the ones of the latest batch that has their key."""
    latest = written.groupBy(*(F.col(c).alias(f"_{c}") for c in key)).agg(F.max("batch").alias("_batch"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    return written.join(latest, [*same, F.col("batch") == F.col("_batch")], "left_semi")
