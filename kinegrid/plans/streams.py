"""Streams of events as samples of sessions; hours take the place of seconds. Streams of embeddings as frames."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import pose
from ..functions.stats import rounded
from ..session import checkpoint_dir
from ..streaming import buffered
from ..streaming import queries as q
from ..streaming.counter import CounterRules
from ..streaming.engine import Engine, EngineRules
from ..streaming.machines import Counting, Judging, Machine
from ..streaming.session import SessionRules
from ..streaming.speech import Coaching, SpeechRules
from .poses import MASKS_SQL, L, mask_place, masks
from .tables import NUDGE, POSES_SQL, load, poses

HOUR = 3600.0
DAY = 24 * HOUR
#: Events of a user can be months apart.
IDLE = 400 * DAY
#: How late a sample may come, and in how many files they all do.
LATE, FILES = 3 * DAY, 4
COUNTING = CounterRules(range_window=120 * HOUR, trough_window=60 * HOUR, refractory=HOUR, slowest_rise=90 * HOUR)
JUDGING = SessionRules(setup_s=24 * HOUR, setup_samples=4, memory_s=240 * HOUR, counter=COUNTING)


def samples(events: DataFrame) -> DataFrame:
    value, right = F.col("value") / 100, F.col("event_type").isin("click", "purchase", "view")
    return events.select(
        F.col("user_id").cast("string").alias("session"),
        F.col("event_id").alias("frame"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(right, value).alias("right"),
        F.when(~right, value).alias("left"),
        (value / 100).alias("gap"),
        (F.col("value") / 1000).alias("turn"),
    )


def arrivals(rows: DataFrame, folder: str, late_s: float, files: int, end_s: float) -> None:
    """Write samples as files in the order in which they arrive: each up to ``late_s`` after its time, so that no file is in order.

    A last file tells that time has gone on by ``end_s``.
    """
    at = F.unix_micros("ts") + F.pmod(F.xxhash64("session", "frame"), F.lit(int(late_s * 1e6)))
    low, high = rows.agg(F.min(at), F.max(at)).first()
    part = F.least(F.floor((at - F.lit(low)) / F.lit(max((high or 0) - (low or 0), 1) / files)), F.lit(files - 1))
    rows.withColumn("part", part.cast("int")).write.partitionBy("part").parquet(f"{folder}/dealt")
    dealt = rows.sparkSession.read.schema(StructType([*rows.schema, StructField("part", IntegerType())])).parquet(f"{folder}/dealt")
    for k in range(files):  # one after the other, as a file's age is its place in the stream
        dealt.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != "ts" else F.timestamp_micros(F.lit((high or 0) + int(end_s * 1e6))).alias("ts") for f in rows.schema]
    rows.sparkSession.range(1).coalesce(1).select(*empty).write.mode("append").parquet(f"{folder}/in")


def streamed(rows: DataFrame, machine: Machine, late_s: float, files: int, idle_s: float) -> tuple[DataFrame, str]:
    """The events of a stream over the samples, which arrive out of order, several files one after the other."""
    spark = rows.sparkSession
    root = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    arrivals(rows, root, late_s, files, 2 * (idle_s + late_s) + buffered.GRACE_S)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    found = buffered.session_events(stream, machine, late_s, idle_s)
    sink = found.writeStream.foreachBatch(buffered.upsert_to(f"{root}/events")).option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    sink.start().awaitTermination()
    return spark.read.schema(f"{buffered.EVENTS}, batch long").parquet(f"{root}/events"), root


def _events(spark: SparkSession, sf_dir: str, machine: Machine) -> DataFrame:
    return streamed(samples(load(spark, sf_dir, "events")), machine, LATE, FILES, IDLE)[0]


def stream_rep_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetitions from samples that arrive up to three days late, in several files."""
    machine = Counting(COUNTING)
    return buffered.rows_of(_events(spark, sf_dir, machine), machine)


def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    machine = Judging(JUDGING)
    return buffered.rows_of(_events(spark, sf_dir, machine), machine).withColumn("errors", F.array_join("errors", ";"))


def stream_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that sessions give when they end, each of the last batch that told it."""
    told = buffered.upserted(_events(spark, sf_dir, Judging(JUDGING)).filter(F.col("kind") == buffered.REPORT), "session")
    reports = buffered.reports_of(told).filter("total_reps > 0")
    return reports.select("session", "total_reps", "correct_reps", F.bround("accuracy", 6).alias("accuracy"), F.nullif(F.to_json("error_counts"), F.lit("{}")).alias("error_counts"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An embedding as a frame of its label: silhouette, the window of its gap, and the proxy of rotation; one frame a second, some without a silhouette."""
    shown = masks(spark, sf_dir).withColumn("w", mask_place()).select("vec_id", "bottom", "w")
    both = poses(spark, sf_dir).join(shown, "vec_id")
    return both.select(
        F.col("entity").cast("string").alias("session"),
        "frame",
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("frame") * 1_000_000).alias("ts"),
        F.when(F.col("vec_id") % 10 != 0, F.col("bottom")).alias("bottom"),
        F.col("w.x0").alias("x0"),
        F.col("w.x1").alias("x1"),
        F.lit(80.0).alias("torso"),
        pose.hip_ratio(F.col("lm"), L, 1e-9).alias("proxy"),
    )


def stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap and rotation of every frame, measured against what its session calibrated on its first frames."""
    machine = Engine(EngineRules())
    found, _ = streamed(frames(spark, sf_dir), machine, 20.0, FILES, DAY)
    rows = buffered.rows_of(found, machine)
    return rows.select("session", "frame", rounded(F.col("gap") + NUDGE).alias("gap"), rounded(F.col("turn") + NUDGE).alias("turn"), "floor_ready")


def replay_rep_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.replay_reps(samples(load(spark, sf_dir, "events")), COUNTING)


def session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = q.session_report(q.replay_sessions(samples(load(spark, sf_dir, "events")), JUDGING))
    return report.select("session", "total_reps", "correct_reps", F.bround("accuracy", 6).alias("accuracy"), F.to_json("error_counts").alias("error_counts"))


def stream_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("t")).distinct()
    return q.spoken(e, 48 * HOUR)


SPEECH = SpeechRules(cooldown_s=48 * HOUR, waiting=2, service_s=30 * HOUR)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, frame, ts, phase, reps_done, reps_correct, errors): an event of a user as a repetition, one of type error with that error; weeks are phases."""
    e = load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("frame"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"), "event_type")
    far = Window.partitionBy("session").orderBy("ts", "frame")
    fine = F.col("event_type") != "error"
    return e.select(
        "session",
        "frame",
        "ts",
        F.weekofyear("ts").cast("string").alias("phase"),
        F.row_number().over(far).alias("reps_done"),
        F.count_if(fine).over(far).alias("reps_correct"),
        F.when(fine, F.array().cast("array<string>")).otherwise(F.array(F.lit("error"))).alias("errors"),
    )


def coach_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of the states of every session, through a queue of two."""
    said = q.replay(states(spark, sf_dir), Coaching(SPEECH))
    return said.select("session", "frame", "key", "text", (F.col("start_s") - F.lit(1_700_000_000)).cast("long").alias("start_s"))


def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("t"), F.col("event_type").alias("phase"), F.floor(F.col("value") / 200).alias("count"))
    return q.changes(e).select("session", "t", "phase", "count", F.col("streak").cast("long").alias("streak"))


def stream_increasing_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("frame"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).cast("double").alias("t"))
    return q.increasing_ms(e).select("session", "frame", "ms")


QUERIES = {f.__name__: f for f in (stream_rep_counter, stream_session, stream_report, stream_frames, replay_rep_counter, session_report, coach_messages, stream_cooldown, stream_changes, stream_increasing_ms)}
#: The counter as a recursion over the samples of each side, and the sessions that are judged from its repetitions.
_SAMPLES = """WITH RECURSIVE taken AS (
  SELECT user_id::VARCHAR AS session, event_id AS frame, epoch_us(ts) / 1e6 AS t, value / 100 AS v, value / 100 / 100 AS gap, value / 1000 AS turn,
    CASE WHEN event_type IN ('click', 'purchase', 'view') THEN 'R' ELSE 'L' END AS side
  FROM events),
"""
_SETUP = """rested AS (
  SELECT *, t - min(t) OVER (PARTITION BY session) >= 86400 AND count(gap) OVER (PARTITION BY session ORDER BY t, frame ROWS UNBOUNDED PRECEDING) >= 4 AS rested FROM taken),
counted AS (SELECT * FROM rested QUALIFY count(*) FILTER (rested) OVER (PARTITION BY session ORDER BY t, frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0),
"""
_COUNTER = """ranged AS (
  SELECT session, side, frame, t, v, row_number() OVER (PARTITION BY session, side ORDER BY t, frame) AS n,
    list_sort(list(v) OVER (PARTITION BY session, side ORDER BY t RANGE BETWEEN 432000 PRECEDING AND CURRENT ROW)) AS near
  FROM {source} WHERE v IS NOT NULL),
placed AS (
  SELECT * EXCLUDE near, {{'v': v, 'f': frame, 't': t}} AS now,
    CASE WHEN len(near) < 8 THEN 0.0 ELSE near[floor(0.95 * (len(near) - 1))::INT + 1] - near[floor(0.05 * (len(near) - 1))::INT + 1] END AS spread
  FROM ranged),
walk AS (
  SELECT session, side, 0::BIGINT AS n, []::STRUCT(v DOUBLE, f BIGINT, t DOUBLE)[] AS recent, NULL::STRUCT(v DOUBLE, f BIGINT, t DOUBLE) AS low,
    NULL::STRUCT(v DOUBLE, f BIGINT, t DOUBLE) AS high, NULL::DOUBLE AS last_rep,
    NULL::STRUCT(low STRUCT(v DOUBLE, f BIGINT, t DOUBLE), high STRUCT(v DOUBLE, f BIGINT, t DOUBLE), done STRUCT(v DOUBLE, f BIGINT, t DOUBLE)) AS rep
  FROM placed WHERE n = 1
  UNION ALL
  SELECT session, side, n, CASE WHEN event = 'fall' THEN [now] ELSE recent END, CASE WHEN event = 'fall' THEN now ELSE low END,
    CASE WHEN event IN ('rise', 'higher') THEN now WHEN event = 'fall' THEN NULL ELSE high END,
    CASE WHEN confirmed THEN t ELSE last_rep END, CASE WHEN confirmed THEN {{'low': low, 'high': high, 'done': now}} END
  FROM (
    SELECT *, event = 'fall' AND coalesce(t - last_rep >= 3600, TRUE) AND high.t - low.t <= 324000 AS confirmed
    FROM (
      SELECT *, CASE WHEN high IS NULL THEN CASE WHEN v - low.v >= greatest(0.05, 0.25 * spread) THEN 'rise' ELSE 'rest' END
                     WHEN v > high.v THEN 'higher'
                     WHEN high.v - low.v > 0 AND high.v - v >= 0.4 * (high.v - low.v) THEN 'fall' ELSE 'hold' END AS event
      FROM (
        SELECT * EXCLUDE (recent, was), kept AS recent, CASE WHEN high IS NULL THEN list_sort(kept)[1] ELSE was END AS low
        FROM (
          SELECT w.session, w.side, p.n, p.v, p.t, p.now, p.spread, w.recent, w.low AS was, w.high, w.last_rep,
            CASE WHEN w.high IS NULL THEN list_append(list_filter(w.recent, lambda x: p.t - x.t <= 216000), p.now)
                 ELSE list_filter(w.recent, lambda x: p.t - x.t <= 216000) END AS kept
          FROM walk w JOIN placed p ON p.session = w.session AND p.side = w.side AND p.n = w.n + 1))))),
reps AS (
  SELECT session, side, row_number() OVER o AS rep_index, coalesce(side = lag(side) OVER o, FALSE) AS alternation_broken,
    rep.low.f AS start, rep.high.f AS peak, rep.done.f AS end, rep.low.t AS start_s, rep.high.t AS peak_s, rep.done.t AS end_s, rep.high.v - rep.low.v AS amplitude
  FROM walk WHERE rep IS NOT NULL WINDOW o AS (PARTITION BY session ORDER BY rep.done.t, rep.done.f, side DESC))
"""
_JUDGED = """, measured AS (
  SELECT r.*, max(f.gap) AS gap_peak, max(abs(f.turn)) AS turn_peak, r.peak_s - r.start_s AS t_extend_s
  FROM reps r LEFT JOIN taken f ON f.session = r.session AND f.frame BETWEEN r.start AND r.end AND f.t <= r.end_s AND r.end_s - f.t <= 864000
  WHERE r.rep_index <= 103 GROUP BY ALL),
base AS (
  SELECT session, avg(gap_peak) AS gm, stddev_pop(gap_peak) AS gs, avg(turn_peak) AS tm, stddev_pop(turn_peak) AS ts, median(t_extend_s) AS usual
  FROM measured WHERE rep_index <= 3 GROUP BY session),
judged AS (
  SELECT m.*, CASE WHEN rep_index <= 3 THEN 'BASELINE' ELSE 'ACTIVE' END AS phase,
    CASE WHEN rep_index <= 3 THEN [] ELSE list_filter([
      CASE WHEN gap_peak > greatest(gm + 2.5 * gs, gm + 0.004) THEN 'lumbar_arch' END,
      CASE WHEN turn_peak > greatest(tm + 2.5 * b.ts, tm + 0.04) THEN 'rotation' END,
      CASE WHEN t_extend_s < 0.6 * usual THEN 'too_fast' END], lambda e: e IS NOT NULL) END AS errors
  FROM measured m JOIN base b ON b.session = m.session)
"""
_COUNTED = _SAMPLES + _COUNTER.format(source="taken") + "SELECT * FROM reps"
_SESSIONS = _SAMPLES + _SETUP + _COUNTER.format(source="counted") + _JUDGED
_REPORTED = (
    _SESSIONS
    + """, wrong AS (
  SELECT session, '{' || string_agg('"' || e || '":' || n, ',' ORDER BY n DESC, e) || '}' AS error_counts
  FROM (SELECT session, e, count(*) AS n FROM (SELECT session, unnest(errors) AS e FROM judged) GROUP BY ALL) GROUP BY session)
SELECT j.session, count(*) AS total_reps, count(*) FILTER (len(errors) = 0) AS correct_reps,
  round_even(count(*) FILTER (len(errors) = 0) / count(*)::DOUBLE, 6) AS accuracy, any_value(error_counts) AS error_counts
FROM judged j LEFT JOIN wrong w ON w.session = j.session WHERE phase = 'ACTIVE' GROUP BY j.session"""
)
ORACLES = {
    "replay_rep_counter": _COUNTED,
    "stream_rep_counter": _COUNTED,
    "stream_session": _SESSIONS + "SELECT * EXCLUDE errors, array_to_string(errors, ';') AS errors FROM judged",
    "session_report": _REPORTED,
    "stream_report": _REPORTED,
    "coach_messages": """WITH RECURSIVE e AS (
  SELECT user_id::VARCHAR AS session, event_id AS frame, floor(epoch(ts))::BIGINT - 1700000000 AS t, event_type <> 'error' AS fine, weekofyear(ts)::VARCHAR AS phase FROM events),
told AS (
  SELECT *, coalesce(phase <> lag(phase) OVER w, TRUE) AS fresh, count(*) FILTER (fine) OVER w AS correct, count(*) FILTER (NOT fine) OVER w AS broken
  FROM e WINDOW w AS (PARTITION BY session ORDER BY t, frame)),
runs AS (SELECT *, count(*) FILTER (fine) OVER (PARTITION BY session, broken ORDER BY t, frame) AS streak FROM told),
wanted AS (
  SELECT session, frame, t, 0 AS k, 'phase:' || phase AS key, 'phase:' || phase AS text, TRUE AS forced FROM runs WHERE fresh
  UNION ALL SELECT session, frame, t, 1, CASE WHEN fine THEN 'count' ELSE 'error' END, CASE WHEN fine THEN correct::VARCHAR ELSE 'error' END, fine FROM runs
  UNION ALL SELECT session, frame, t, 2, 'praise', 'praise', FALSE FROM runs WHERE fine AND streak IN (5, 10, 15, 20)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t, frame, k) AS n FROM wanted),
walk AS (
  SELECT session, 0::BIGINT AS n, NULL::BIGINT AS frame, NULL::VARCHAR AS key, NULL::VARCHAR AS text, NULL::BIGINT AS start, []::STRUCT(k VARCHAR, t BIGINT)[] AS heard, []::BIGINT[] AS starts, -1000000000000 AS free_at
  FROM numbered WHERE n = 1
  UNION ALL
  SELECT session, n, frame, key, text, CASE WHEN taken THEN greatest(t, free_at) END,
    CASE WHEN taken THEN list_append(list_filter(heard, lambda x: x.k <> key), {'k': key, 't': t}) ELSE heard END,
    CASE WHEN taken AND free_at > t THEN list_append(left_over, free_at) ELSE left_over END,
    CASE WHEN taken THEN greatest(t, free_at) + 108000 ELSE free_at END
  FROM (
    SELECT w.session, m.n, m.frame, m.key, m.text, m.t, heard, free_at, list_filter(starts, lambda s: s > m.t) AS left_over,
      (m.forced OR len(list_filter(heard, lambda x: x.k = m.key AND m.t - x.t < 172800)) = 0) AND len(list_filter(starts, lambda s: s > m.t)) < 2 AS taken
    FROM walk w JOIN numbered m ON m.session = w.session AND m.n = w.n + 1))
SELECT session, frame, key, text, start::BIGINT AS start_s FROM walk WHERE start IS NOT NULL""",
    "stream_frames": f"""WITH {POSES_SQL},
{MASKS_SQL},
told AS (
  SELECT p.entity, p.frame, p.vec_id % 10 <> 0 AS masked, sqrt((x[12] - x[13]) ** 2 + (y[12] - y[13]) ** 2) AS hips,
    sqrt(((x[6] + x[7]) / 2 - (x[12] + x[13]) / 2) ** 2 + ((y[6] + y[7]) / 2 - (y[12] + y[13]) / 2) ** 2) AS torso, bottom, x0, x1
  FROM poses p JOIN placed m ON m.vec_id = p.vec_id),
proxied AS (SELECT *, CASE WHEN masked AND torso > 1e-9 THEN hips / torso END AS proxy FROM told),
numbered AS (
  SELECT *, count(*) FILTER (masked) OVER w AS n_masks, count(proxy) OVER w AS n_proxies FROM proxied
  WINDOW w AS (PARTITION BY entity ORDER BY frame ROWS UNBOUNDED PRECEDING)),
points AS (SELECT entity, unnest(bottom) AS y FROM numbered WHERE masked AND n_masks <= 15),
cuts AS (SELECT entity, quantile_cont(y, 0.8) AS cut FROM points WHERE y IS NOT NULL GROUP BY entity),
floors AS (SELECT p.entity, quantile_cont(y, 0.95) AS b FROM points p JOIN cuts c ON c.entity = p.entity AND y >= cut GROUP BY p.entity),
rests AS (SELECT entity, median(proxy) AS rest FROM numbered WHERE proxy IS NOT NULL AND n_proxies <= 15 GROUP BY entity HAVING count(*) = 15)
SELECT n.entity::VARCHAR AS session, n.frame,
  CASE WHEN masked AND n_masks >= 15 THEN round_even(coalesce(list_sum([coalesce(greatest(0, b - bottom[k + 1]), 0) FOR k IN range(x0, x1)]), 0) / 6400 + 1e-9, 6) END AS gap,
  CASE WHEN proxy IS NOT NULL AND n_proxies > 15 THEN round_even(proxy - rest + 1e-9, 6) END AS turn, n_masks >= 15 AS floor_ready
FROM numbered n LEFT JOIN floors f ON f.entity = n.entity LEFT JOIN rests r ON r.entity = n.entity""",
    "stream_cooldown": """WITH RECURSIVE e AS (SELECT DISTINCT user_id AS session, event_type AS key, floor(epoch(ts))::DOUBLE AS t FROM events),
said AS (
  SELECT session, key, min(t) AS t FROM e GROUP BY ALL
  UNION ALL
  SELECT session, key, t FROM (
    SELECT s.session, s.key, (SELECT min(e.t) FROM e WHERE e.session = s.session AND e.key = s.key AND e.t - s.t >= 172800) AS t FROM said s) WHERE t IS NOT NULL)
SELECT session, key, t FROM said""",
    "stream_changes": """WITH e AS (SELECT user_id AS session, event_id AS t, event_type AS phase, floor(value / 200)::BIGINT AS count FROM events),
b AS (SELECT *, coalesce(phase <> lag(phase) OVER w, TRUE) AS fresh, lag(count) OVER w AS before FROM e WINDOW w AS (PARTITION BY session ORDER BY t)),
r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY session ORDER BY t) AS run FROM b)
SELECT session, t, phase, count, streak FROM (SELECT *, row_number() OVER (PARTITION BY session, run ORDER BY t) AS streak FROM r) WHERE fresh OR count IS DISTINCT FROM before""",
    "stream_increasing_ms": """WITH e AS (SELECT user_id AS session, event_id AS frame, floor(floor(epoch(ts)) / 86400) * 1000 AS x, row_number() OVER (PARTITION BY user_id ORDER BY floor(floor(epoch(ts)) / 86400), event_id) AS n FROM events)
SELECT session, frame, (max(x - n) OVER (PARTITION BY session ORDER BY n) + n)::BIGINT AS ms FROM e""",
}
