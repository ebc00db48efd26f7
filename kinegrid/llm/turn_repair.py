"""Repairing the structure of conversations at the least cost of edits.

Rows of a conversation are kept, given another role, deleted or joined by empty
turns, so that the roles read as an optional system turn and then user and
assistant in turn. Which edits are cheapest is a dynamic programme over the rows
and the four places in that order of roles. A conversation streams through a
task twice: from its end, where every row is given a byte that says what to do
in each of the four places, and from its start, where the bytes are followed.
A task holds four numbers of a conversation, however long it is; the bytes leave
with their rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import small_batches, table

SPACE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
#: Costs of the edits; a truncated row that stays costs one more.
DELETE, INSERT, REROLE, STAYS = 3, 2, 2, 1
#: Letters of the edits by number; of equally cheap edits the letter that comes first is taken.
EDITS = "DIKR"
D, I, K, R = range(4)
#: Places in the order of roles: the start, after system, after user, after assistant. The role that may follow, by its place.
FOLLOWS = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
#: Where the initial of a kept row leads from each place.
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
FAR = 1 << 30


def _relaxed(costs: list[int]) -> list[int]:
    """Costs from each place to the end, if turns may be inserted first."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[FOLLOWS[q]]) for q, c in enumerate(costs)]
    return costs


#: Costs from each place after the last row: the start and an assistant's turn may be the end.
AT_END = tuple(_relaxed([0, FAR, FAR, 0]))


@functools.lru_cache(maxsize=65_536)
def _step(after: tuple[int, ...], initial: str, fault: str | None) -> tuple[tuple[int, ...], int]:
    """Costs from each place before a row, less the least of them, and a byte with two bits for the edit in each place.

    ``after`` are the costs behind the row, less the least. Few such differences
    exist, as an insertion leads from place to place, so steps are remembered.
    """
    stays = STAYS if fault == TRUNCATED else 0
    ways = []
    for q in range(4):
        way = {D: DELETE + after[q]}
        if fault not in (BLANK, DUPLICATE):
            to = KEPT.get(initial, (None,) * 4)[q]
            if to is not None:
                way[K] = stays + after[to]
            way[R] = REROLE + stays + after[FOLLOWS[q]]
        ways.append(way)
    costs = _relaxed([min(w.values()) for w in ways])
    chosen = 0
    for q, way in enumerate(ways):
        way[I] = INSERT + costs[FOLLOWS[q]]
        chosen |= min(e for e, c in way.items() if c == costs[q]) << (2 * q)
    least = min(costs)
    return tuple(c - least for c in costs), chosen


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with _copy, which numbers equal roles and texts of a conversation, and fault.

    A row's first fault counts: blank (only white space), duplicate (role and
    text came earlier), truncated (the last character that isn't white space is
    none of ``.!?``). Null roles and texts are one space. The rows are dealt out
    by conversation once; the window needs no other layout.
    """
    filled = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).repartition("conv_id")
    stripped = F.rtrim(F.col("text"), F.lit(SPACE))
    from pyspark.sql import Window

    seen = Window.partitionBy("conv_id", "role", F.sha2("text", 256)).orderBy(F.col("turn").asc_nulls_first())
    fault = F.when(stripped == "", BLANK).when(F.col("_copy") > 1, DUPLICATE).when(~F.substring(stripped, -1, 1).isin(*".!?"), TRUNCATED)
    return filled.withColumn("_copy", F.row_number().over(seen)).withColumn("fault", fault)


def _order(descending: bool) -> list[Column]:
    if descending:
        return [F.col("turn").desc_nulls_last(), *(F.col(c).desc() for c in ("role", "text", "_copy"))]
    return [F.col("turn").asc_nulls_first(), *(F.col(c).asc() for c in ("role", "text", "_copy"))]


def _with_choices(rows: DataFrame) -> DataFrame:
    """``rows`` with _choice, the byte that ``_step`` gives each; read from the end of each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, costs, started = None, AT_END, False
        for b in batches:
            choices = np.empty(b.num_rows, np.int16)
            for k, (conv, role, fault) in enumerate(zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("fault").to_pylist(), strict=True)):
                if not started or conv != current:
                    current, costs, started = conv, AT_END, True
                costs, choices[k] = _step(costs, role[:1], fault)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(choices)], [*b.schema.names, "_choice"])

    ordered = rows.sortWithinPartitions("conv_id", *_order(descending=True))
    return ordered.mapInArrow(run, StructType([*rows.schema, *rows.sparkSession.createDataFrame([], "_choice short").schema]))


def _edited(rows: DataFrame) -> DataFrame:
    """The edits of rows with _choice; those of a conversation come together and in order."""
    kind = rows.schema["conv_id"].dataType
    names = ["conv_id", "place", "edit", "turn", "was", "role", "text", "fault"]
    schema = StructType([StructField("conv_id", kind), StructField("place", LongType()), StructField("edit", StringType()), StructField("turn", rows.schema["turn"].dataType), *(StructField(c, StringType()) for c in names[4:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, q, place, started, types = None, 0, 0, False, None
        for b in batches:
            types = [b.column("conv_id").type, pa.int64(), pa.string(), b.column("turn").type, *[pa.string()] * 4]
            out: list[tuple] = []

            def insert(out=out) -> None:
                nonlocal q, place
                q, place = FOLLOWS[q], place + 1
                out.append((current, place, "I", None, None, ROLE[q], "", None))

            for conv, turn, role, text, fault, choice in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "_choice")), strict=True):
                if not started or conv != current:
                    while started and q in (1, 2):
                        insert()
                    current, q, place, started = conv, 0, 0, True
                while (edit := choice >> (2 * q) & 3) == I:
                    insert()
                place += 1
                if edit == D:
                    out.append((conv, place, "D", turn, role, None, None, fault))
                    continue
                q = KEPT[role[:1]][q] if edit == K else FOLLOWS[q]
                out.append((conv, place, EDITS[edit], turn, role, role if edit == K else ROLE[q], text, fault))
            yield _batch(out, names, types)
        out = []
        while started and q in (1, 2):
            q, place = FOLLOWS[q], place + 1
            out.append((current, place, "I", None, None, ROLE[q], "", None))
        if out:
            yield _batch(out, names, types)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *_order(descending=False)).mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """The cheapest edits of every conversation in ``rows`` (conv_id, turn, role, text): a row for each edit.

    | column       | of the edit                                              |
    |--------------|----------------------------------------------------------|
    | place        | its number in the conversation, from 1                   |
    | edit         | K keep, R another role, D delete, I insert               |
    | turn, was    | turn and role of the row it concerns; null if inserted   |
    | role, text   | of the repaired row; null if deleted                     |
    | fault        | blank, duplicate or truncated, else null                 |

    The rows that aren't deleted are the repaired conversation. Rows are in
    order of turn (null first), then role and text; rows without a conv_id form
    one conversation; other columns are left behind. A conversation of blank
    rows alone ends up empty.
    """
    small_batches(rows.sparkSession)
    return _edited(_with_choices(with_faults(rows)))


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NEXT_TO = ("su", "ua", "au")


class _Summary:
    """Counts over the edits of one conversation; texts are hashed as they pass."""

    def __init__(self) -> None:
        self.faults = dict.fromkeys((BLANK, DUPLICATE, TRUNCATED), 0)
        self.low = self.high = self.before = None
        self.turns = self.illegal = self.cost = 0
        self.audit: list[str] = []
        self.hash, self.first = hashlib.sha256(), True

    def add(self, edit: str, turn: int | None, was: str | None, role: str | None, text: str | None, fault: str | None) -> None:
        self.audit.append(edit)
        self.cost += {"D": DELETE, "I": INSERT, "R": REROLE, "K": 0}[edit] + (STAYS if fault == TRUNCATED and edit != "D" else 0)
        if edit != "I":
            if fault:
                self.faults[fault] += 1
            if turn is not None:
                self.turns += turn != self.high  # ascending
                self.low, self.high = turn if self.low is None else self.low, turn
            self.illegal += self.before is not None and self.before + was[:1] not in NEXT_TO
            self.before = was[:1]
        if edit != "D":
            self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
            self.first = False

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def _summed_up(edits: DataFrame) -> DataFrame:
    """A row (conv_id, ``SUMMARY``) per conversation, from edits as ``_edited`` hands them on; no shuffle."""
    names = ["conv_id", *(c.split()[0] for c in SUMMARY.split(", "))]
    schema = StructType([edits.schema["conv_id"], *edits.sparkSession.createDataFrame([], SUMMARY).schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, types = None, None, None
        for b in batches:
            types = [b.column(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
            done = []
            for conv, edit, *rest in zip(*(b.column(c).to_pylist() for c in ("conv_id", "edit", "turn", "was", "role", "text", "fault")), strict=True):
                if state is None or conv != current:
                    if state is not None:
                        done.append((current, *state.row()))
                    current, state = conv, _Summary()
                state.add(edit, *rest)
            yield _batch(done, names, types)
        if state is not None:
            yield _batch([(current, *state.row())], names, types)

    return edits.mapInArrow(run, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows harmed by a hash of ``conv_id:turn``: one in 20 each is dropped, emptied, stripped of ``.!?``, repeated, or said by the user."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn")).cast("binary")) % 20
    hit = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), times))).drop("col")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each damaged conversation, and its cheapest repair; a row for each, in no order.

    Rows are in order of turn (null first), then role and text. Nulls are one
    space, in the key of the damage too. Rows without a conv_id form one
    conversation. A conversation that lost all its rows has zeros, an empty
    audit and the digest of nothing.
    """
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = _summed_up(repair_conversations(damaged(rows))).withColumnRenamed("conv_id", "_found")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_found")), "left")
    absent = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return every.select("conv_id", *(F.coalesce(c, absent.get(c, F.lit(0).cast("long"))).alias(c) for c in found.columns if c != "_found"))


OP13_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i::UBIGINT AS i, 0 AS k, i::UBIGINT AS c FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::UBIGINT) AS bytes
  FROM conversations),
hashed AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 20 AS kind
  FROM keyed, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE kind <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS stripped
  FROM damaged),
faulty AS (
  SELECT *, left(role, 1) AS initial,
    CASE WHEN stripped = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(stripped, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM numbered),
paired AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair FROM faulty),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n
  FROM paired GROUP BY conv_id),
walk AS (
  -- v: from each place (start, after system, user, assistant) the cheapest way to the end: cost, audit, repaired lines
  SELECT conv_id, n AS i, [{'c': 0, 'a': '', 't': ''}, {'c': 4, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)},
    {'c': 2, 'a': 'I', 't': 'assistant:' || chr(10)}, {'c': 0, 'a': '', 't': ''}] AS v
  FROM counted
  UNION ALL
  SELECT conv_id, i - 1, list_transform([1, 2, 3, 4], lambda q: list_sort([f[q],
      {'c': f[[3, 3, 4, 3][q]].c + 2, 'a': 'I' || f[[3, 3, 4, 3][q]].a, 't': ['user', 'user', 'assistant', 'user'][q] || ':' || chr(10) || f[[3, 3, 4, 3][q]].t},
      {'c': f[[4, 4, 3, 4][q]].c + 4, 'a': 'II' || f[[4, 4, 3, 4][q]].a,
       't': ['user', 'user', 'assistant', 'user'][q] || ':' || chr(10) || ['assistant', 'assistant', 'user', 'assistant'][q] || ':' || chr(10) || f[[4, 4, 3, 4][q]].t}])[1])
  FROM (
    SELECT w.conv_id, w.i, list_transform([1, 2, 3, 4], lambda q: list_sort([
        {'c': v[q].c + 3, 'a': 'D' || v[q].a, 't': v[q].t},
        {'c': CASE WHEN r.fault IN ('blank', 'duplicate') THEN 1000000000 ELSE v[[3, 3, 4, 3][q]].c + 2 + (r.fault = 'truncated')::INT END,
         'a': 'R' || v[[3, 3, 4, 3][q]].a, 't': ['user', 'user', 'assistant', 'user'][q] || ':' || r.text || chr(10) || v[[3, 3, 4, 3][q]].t},
        {'c': CASE WHEN r.fault IN ('blank', 'duplicate') OR NOT (r.initial = 's' AND q = 1 OR r.initial = 'u' AND q <> 3 OR r.initial = 'a' AND q = 3) THEN 1000000000
                   ELSE v[CASE r.initial WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].c + (r.fault = 'truncated')::INT END,
         'a': 'K' || v[CASE r.initial WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].a,
         't': r.role || ':' || r.text || chr(10) || v[CASE r.initial WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].t}])[1]) AS f
    FROM walk w JOIN faulty r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = w.i)),
best AS (SELECT conv_id, v[1] AS b FROM walk WHERE i = 0),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(left(b.t, length(b.t) - 1), '')) AS repaired_sha256
FROM ids LEFT JOIN counted ON ids.conv_id IS NOT DISTINCT FROM counted.conv_id LEFT JOIN best ON ids.conv_id IS NOT DISTINCT FROM best.conv_id
"""
