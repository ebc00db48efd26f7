"""Rules and gates: customers as clips, orders as repetitions, order statistics as measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import rounded
from ..operators import qc, validate
from .tables import load

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")
GATES = (
    qc.Gate("mean_total", least=100_000.0),
    qc.Gate("max_total", most=400_000.0),
    qc.Gate("spread", most=0.6),
    qc.Gate("urgent_share", least=0.05, rejects=True),
    qc.Gate("rep_count", least=4, rejects=True),
)


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("row"),
        F.when(k % 101 == 7, "").when(k % 50 == 3, F.lit("twice")).otherwise(F.col("c_name")).alias("clip_id"),
        F.when(k % 37 == 5, F.lit(None)).otherwise((k % 20).cast("string")).alias("person_id"),
        F.col("c_mktsegment").alias("condition"),
        F.when(k % 3 == 0, "side").when(k % 3 == 1, "oblique45").otherwise("other").alias("view"),
        F.when(k % 29 == 4, "maybe").otherwise("ok").alias("qc_status"),
        F.lit("intent").alias("label_source"),
        F.when(k % 4 == 0, F.format_string("G%02d", k % 9)).otherwise("").alias("dedup_group"),
    )


def validate_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.clip_violations(_clips(spark, sf_dir), "row", conditions=SEGMENTS)


def validate_dedup_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validate.shared_groups(_clips(spark, sf_dir))
    return found.select("dedup_group", F.array_join("persons", ",").alias("persons"))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers; one in 13 has another number than its orders say."""
    key = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(F.when(key % 13 == 0, -key).otherwise(key).alias("c_custkey"))


def validate_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return validate.orphans(orders, _known(spark, sf_dir), "c_custkey").select("o_orderkey")


def _reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.when(k % 997 == 1, F.lit("again")).otherwise(k.cast("string")).alias("rep_id"),
        F.concat(F.lit("Customer#"), F.format_string("%09d", F.col("o_custkey"))).alias("clip_id"),
        ((F.col("o_custkey") + F.when(k % 211 == 2, 1).otherwise(0)) % 20).cast("string").alias("person_id"),
        F.lit("any").alias("condition"),
        F.lit("side").alias("view"),
        F.when(k % 2 == 0, "R").when(k % 307 == 3, "X").otherwise("L").alias("side"),
        k.cast("double").alias("start_s"),
        (k + F.when(k % 401 == 9, 0).otherwise(3)).cast("double").alias("end_s"),
    )


def validate_reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _known(spark, sf_dir)
    parents = c.select(F.concat(F.lit("Customer#"), F.format_string("%09d", F.col("c_custkey"))).alias("clip_id"), (F.col("c_custkey") % 20).cast("string").alias("person_id"), F.lit("any").alias("condition"), F.lit("side").alias("view"))
    return validate.rep_violations(_reps(spark, sf_dir), parents)


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.col("o_totalprice")
    m = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.avg(total).alias("mean_total"), F.max(total).alias("max_total"), (F.stddev_samp(total) / F.avg(total)).alias("spread"), F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("urgent_share"), F.count("*").cast("double").alias("rep_count")
    )
    names = ("mean_total", "max_total", "spread", "urgent_share", "rep_count")
    entries = F.array(*(F.struct(F.lit(n).alias("k"), F.when((F.lit(n) == "max_total") & (F.col("o_custkey") % 17 == 3), F.lit(float("nan"))).otherwise(F.col(n)).alias("v")) for n in names))
    # some keys are absent, which is not the same as a missing value
    wired = F.filter(entries, lambda e: (F.col("o_custkey") % 19 != 5) | (e["k"] != "urgent_share"))
    return m.select("o_custkey", F.map_from_entries(wired).alias("measures"))


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.evaluate(_measured(spark, sf_dir), GATES)


def qc_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lambda c: F.array_join(F.transform(c, lambda x: F.regexp_extract(x, r"^([a-z_]+(:missing)?)", 1)), ";").alias(c)
    return _evaluated(spark, sf_dir).select("o_custkey", names("flags"), names("rejects"), "status")


def qc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.summarise(_evaluated(spark, sf_dir))


def qc_unwired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.unwired_gates(_measured(spark, sf_dir), GATES).select("o_custkey", F.array_join("unwired", ";").alias("unwired"))


def qc_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = qc.as_rows(_evaluated(spark, sf_dir), "o_custkey", ("spread", "rep_count"))
    return rows.select("o_custkey", "status", rounded("spread", 4).alias("spread"), "rep_count")


def protocol_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    problem = qc.protocol_problem(F.col("l_linenumber"), F.lit(2), F.col("l_quantity") - 1)
    return lines.select("l_orderkey", "l_linenumber", (problem == "").alias("fits"))


_CLIPS = """WITH clips AS (
  SELECT c_custkey AS row, CASE WHEN c_custkey % 101 = 7 THEN '' WHEN c_custkey % 50 = 3 THEN 'twice' ELSE c_name END AS clip_id,
    CASE WHEN c_custkey % 37 = 5 THEN NULL ELSE (c_custkey % 20)::VARCHAR END AS person_id, c_mktsegment AS condition,
    CASE WHEN c_custkey % 29 = 4 THEN 'maybe' ELSE 'ok' END AS qc_status,
    CASE WHEN c_custkey % 4 = 0 THEN 'G' || lpad((c_custkey % 9)::VARCHAR, 2, '0') ELSE '' END AS dedup_group FROM customer)
"""
_QC = """WITH m AS (
  SELECT o_custkey, avg(o_totalprice) AS mean_total, CASE WHEN o_custkey % 17 = 3 THEN NULL ELSE max(o_totalprice) END AS max_total,
    stddev_samp(o_totalprice) / avg(o_totalprice) AS spread, avg((o_orderpriority = '1-URGENT')::INT) AS urgent, count(*) AS n FROM orders GROUP BY 1),
g AS (
  SELECT *, array_to_string(list_filter([
      CASE WHEN mean_total < 100000 THEN 'mean_total' END,
      CASE WHEN max_total IS NULL OR max_total > 400000 THEN 'max_total' END,
      CASE WHEN spread IS NULL THEN 'spread:missing' WHEN spread > 0.6 THEN 'spread' END], lambda x: x IS NOT NULL), ';') AS flags,
    array_to_string(list_filter([
      CASE WHEN o_custkey % 19 = 5 THEN 'urgent_share:missing' WHEN urgent < 0.05 THEN 'urgent_share' END,
      CASE WHEN n < 4 THEN 'rep_count' END], lambda x: x IS NOT NULL), ';') AS rejects FROM m),
s AS (SELECT *, CASE WHEN rejects <> '' THEN 'reject' WHEN flags <> '' THEN 'flag' ELSE 'ok' END AS status FROM g)
"""

QUERIES = {f.__name__: f for f in (validate_manifest, validate_dedup_person, validate_orphans, validate_reps, qc_gates, qc_summary, qc_unwired, qc_report, protocol_fits)}
ORACLES = {
    "validate_manifest": _CLIPS
    + """SELECT row, clip_id, rule FROM (
  SELECT row, clip_id, CASE WHEN clip_id = '' THEN 'empty clip_id'
    WHEN row_number() OVER (PARTITION BY clip_id ORDER BY row) > 1 THEN 'duplicate clip_id'
    WHEN person_id IS NULL THEN 'empty person_id'
    WHEN condition NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD') THEN 'unknown condition'
    WHEN qc_status = 'maybe' THEN 'unknown qc_status' END AS rule FROM clips) WHERE rule IS NOT NULL""",
    "validate_dedup_person": _CLIPS
    + "SELECT dedup_group, string_agg(DISTINCT person_id, ',' ORDER BY person_id) AS persons FROM clips WHERE dedup_group <> '' GROUP BY 1 HAVING count(DISTINCT person_id) > 1",
    "validate_orphans": "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT CASE WHEN c_custkey % 13 = 0 THEN -c_custkey ELSE c_custkey END FROM customer)",
    "validate_reps": """WITH reps AS (
  SELECT CASE WHEN o_orderkey % 997 = 1 THEN 'again' ELSE o_orderkey::VARCHAR END AS rep_id, o_custkey, o_orderkey AS k,
    'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS clip_id FROM orders),
c AS (SELECT CASE WHEN c_custkey % 13 = 0 THEN -c_custkey ELSE c_custkey END AS c_custkey FROM customer)
SELECT rep_id, rule FROM (
  SELECT rep_id, CASE WHEN row_number() OVER (PARTITION BY rep_id ORDER BY clip_id, k) > 1 THEN 'duplicate rep_id'
    WHEN c.c_custkey IS NULL THEN 'unknown clip_id'
    WHEN k % 211 = 2 THEN 'person_id differs from the clip''s'
    WHEN k % 2 <> 0 AND k % 307 = 3 THEN 'unknown side'
    WHEN k % 401 = 9 THEN 'end_s is not after start_s' END AS rule
  FROM reps LEFT JOIN c ON c.c_custkey = reps.o_custkey) WHERE rule IS NOT NULL""",
    "qc_gates": _QC + "SELECT o_custkey, flags, rejects, status FROM s",
    "qc_summary": _QC + "SELECT status, count(*) AS n FROM s GROUP BY 1",
    "qc_unwired": "SELECT DISTINCT o_custkey, CASE WHEN o_custkey % 19 = 5 THEN 'urgent_share' ELSE '' END AS unwired FROM orders",
    "qc_report": _QC + "SELECT o_custkey, status, round_even(spread, 4) AS spread, n::DOUBLE AS rep_count FROM s",
    "protocol_fits": "SELECT l_orderkey, l_linenumber, l_quantity - 1 <= 0 OR l_quantity - 1 >= 3 + l_linenumber * 2 * 3 AS fits FROM lineitem",
}
