"""Normative bands over the lines of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bands
from .tables import REPS_SQL, reps, shown

FIT = (("N", "R"), ("O", "F"))
FLOOR = 3.0


def _fitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.eligible(reps(spark, sf_dir), *FIT)


def _shown(band: DataFrame) -> DataFrame:
    return band.select("held_out", "bin", *(shown(c) for c in ("low", "high", "mean", "std", "p05", "p95")), "count")


def band_fit_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(bands.fit_pooled(_fitting(spark, sf_dir)))


def band_loso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(bands.fit_loso(_fitting(spark, sf_dir)))


def band_loso_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(bands.fit_loso(_fitting(spark, sf_dir), bins=7, min_excursion=FLOOR))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reps(spark, sf_dir)
    return bands.score(rows, bands.fit_loso(bands.eligible(rows, *FIT)), F.col("person"))


def band_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("rep_id", "bin", shown("z"), shown("limit").alias("limit_value"), "exceeds", "support", "extrapolated", "reason")


def band_loso_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A band without each single customer: as many folds as there are customers."""
    band = bands.fit_loso(bands.eligible(reps(spark, sf_dir, None), *FIT))
    return band.select("held_out", "bin", *(shown(c, 4) for c in ("low", "high", "mean", "std", "p05", "p95")), "count")


def _rates(scored: DataFrame) -> DataFrame:
    rates = bands.exceed_rate(scored, "condition")
    return rates.select("condition", "exceed", "scored", "rows", *(shown(c) for c in ("rate", "ci_low", "ci_high")))


def band_exceed_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(_scored(spark, sf_dir))


def band_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = bands.separated(bands.exceed_rate(_scored(spark, sf_dir), "condition"), bad="A", good="N")
    return verdict.select(shown("bad_low"), shown("good_high"), "passed")


def band_supported_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = bands.with_upper(bands.supported(bands.fit_loso(_fitting(spark, sf_dir), min_excursion=FLOOR), 4))
    return band.select("held_out", "bin", "count", "supported", shown("upper"))


def band_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    sparse = bands.fit_loso(_fitting(spark, sf_dir), bins=60)
    return bands.display_band(sparse, 60).select("held_out", "bin", "count", shown("mean_display"), shown("std_display"))


def _sql(tail: str, bins: int = 20, floor: float = 0.2, pooled: bool = False) -> str:
    folds = (
        "folds AS (SELECT '__pooled__' AS held_out, min(excursion) AS low, max(excursion) AS high FROM usable)"
        if pooled
        else """persons AS (SELECT DISTINCT person FROM usable),
folds AS (
  SELECT p.person AS held_out, min(u.excursion) AS low, max(u.excursion) AS high
  FROM persons p JOIN usable u ON u.person <> p.person GROUP BY 1 HAVING count(*) >= 2)"""
    )
    on = "TRUE" if pooled else "u.person <> f.held_out"
    return f"""WITH {REPS_SQL},
usable AS (
  SELECT person, excursion, signal FROM reps
  WHERE condition IN ('N', 'R') AND view IN ('O', 'F') AND excursion >= {floor}),
{folds},
edges AS (
  SELECT held_out, low, high, [CASE WHEN i = {bins} THEN high ELSE low + i * ((high - low) / {bins}) END FOR i IN range({bins} + 1)] AS edges FROM folds),
band AS (
  SELECT held_out, low, high,
    least({bins} - 1, greatest(0, len(list_filter(edges, lambda x: x <= excursion)) - 1))::INT AS bin,
    avg(signal) AS mean, stddev_samp(signal) AS std, quantile_cont(signal, 0.05) AS p05, quantile_cont(signal, 0.95) AS p95, count(*) AS count
  FROM usable u JOIN edges f ON {on} GROUP BY ALL)
{tail}"""


_CUSTOMERS = "SELECT held_out, bin, round_even(low + 1e-9, 4) AS low, round_even(high + 1e-9, 4) AS high, round_even(mean + 1e-9, 4) AS mean, round_even(std + 1e-9, 4) AS std, round_even(p05 + 1e-9, 4) AS p05, round_even(p95 + 1e-9, 4) AS p95, count FROM band"
_BAND = "SELECT held_out, bin, round_even(low + 1e-9, 6) AS low, round_even(high + 1e-9, 6) AS high, round_even(mean + 1e-9, 6) AS mean, round_even(std + 1e-9, 6) AS std, round_even(p05 + 1e-9, 6) AS p05, round_even(p95 + 1e-9, 6) AS p95, count FROM band"
_SCORED = """, placed AS (
  SELECT r.*, e.low, e.high, least(19, greatest(0, len(list_filter(edges, lambda x: x <= r.excursion)) - 1))::INT AS bin
  FROM reps r JOIN edges e ON e.held_out = r.person),
scored AS (
  SELECT p.*, coalesce(b.count, 0) AS support,
    CASE WHEN coalesce(b.count, 0) >= 2 AND b.std > 0 THEN b.mean + 2 * b.std END AS limit_value,
    CASE WHEN coalesce(b.count, 0) >= 2 AND b.std > 0 THEN (p.signal - b.mean) / b.std END AS z,
    CASE WHEN coalesce(b.count, 0) >= 2 AND b.std > 0 THEN p.signal > b.mean + 2 * b.std END AS exceeds,
    p.excursion < p.low OR p.excursion > p.high AS extrapolated,
    CASE WHEN coalesce(b.count, 0) < 2 THEN 'bin has ' || coalesce(b.count, 0) || ' observation(s), needs 2'
         WHEN b.std IS NULL OR b.std <= 0 THEN 'bin has no spread' ELSE '' END AS reason
  FROM placed p LEFT JOIN band b ON b.held_out = p.person AND b.bin = p.bin)"""
_RATES = """, counted AS (
  SELECT condition, count(*) FILTER (exceeds) AS exceed, count(exceeds) AS scored, count(*) AS rows FROM scored GROUP BY 1),
parts AS (SELECT *, exceed::DOUBLE / scored AS p, 1.959963984540054::DOUBLE AS z FROM counted),
rates AS (
  SELECT condition, exceed, scored, rows, p AS rate,
    greatest(0, (p + z * z / (2 * scored)) / (1 + z * z / scored) - z * sqrt(p * (1 - p) / scored + z * z / (4.0 * scored * scored)) / (1 + z * z / scored)) AS ci_low,
    least(1, (p + z * z / (2 * scored)) / (1 + z * z / scored) + z * sqrt(p * (1 - p) / scored + z * z / (4.0 * scored * scored)) / (1 + z * z / scored)) AS ci_high
  FROM parts)"""

QUERIES = {
    "band_fit_pooled": band_fit_pooled,
    "band_loso": band_loso,
    "band_loso_customers": band_loso_customers,
    "band_loso_floor": band_loso_floor,
    "band_score": band_score,
    "band_exceed_wilson": band_exceed_wilson,
    "band_gate": band_gate,
    "band_supported_bins": band_supported_bins,
    "band_display": band_display,
}
ORACLES = {
    "band_fit_pooled": _sql(_BAND, pooled=True),
    "band_loso": _sql(_BAND),
    "band_loso_customers": _sql(_CUSTOMERS).replace("o_custkey % 10", "o_custkey"),
    "band_loso_floor": _sql(_BAND, bins=7, floor=FLOOR),
    "band_score": _sql(_SCORED + "SELECT rep_id, bin, round_even(z + 1e-9, 6) AS z, round_even(limit_value + 1e-9, 6) AS limit_value, exceeds, support, extrapolated, reason FROM scored"),
    "band_exceed_wilson": _sql(_SCORED + _RATES + "SELECT condition, exceed, scored, rows, round_even(rate + 1e-9, 6) AS rate, round_even(ci_low + 1e-9, 6) AS ci_low, round_even(ci_high + 1e-9, 6) AS ci_high FROM rates"),
    "band_gate": _sql(
        _SCORED
        + _RATES
        + """SELECT round_even(max(ci_low) FILTER (condition = 'A') + 1e-9, 6) AS bad_low, round_even(max(ci_high) FILTER (condition = 'N') + 1e-9, 6) AS good_high,
  coalesce(max(ci_low) FILTER (condition = 'A') > max(ci_high) FILTER (condition = 'N'), FALSE) AS passed FROM rates"""
    ),
    "band_supported_bins": _sql("SELECT held_out, bin, count, count >= 4 AS supported, round_even(mean + 2 * std + 1e-9, 6) AS upper FROM band", floor=FLOOR),
    "band_display": _sql(
        """, every AS (SELECT held_out, unnest(range(60))::INT AS bin FROM folds),
seen AS (
  SELECT e.held_out, e.bin, coalesce(b.count, 0) AS count, b.mean, b.std
  FROM every e LEFT JOIN band b ON b.held_out = e.held_out AND b.bin = e.bin),
near AS (
  SELECT *, max(CASE WHEN mean IS NOT NULL THEN bin END) OVER back AS m0, min(CASE WHEN mean IS NOT NULL THEN bin END) OVER ahead AS m1,
    max(CASE WHEN std IS NOT NULL THEN bin END) OVER back AS s0, min(CASE WHEN std IS NOT NULL THEN bin END) OVER ahead AS s1
  FROM seen WINDOW back AS (PARTITION BY held_out ORDER BY bin ROWS UNBOUNDED PRECEDING),
    ahead AS (PARTITION BY held_out ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT n.held_out, n.bin, n.count,
  round_even(coalesce(CASE WHEN m0 = m1 THEN a.mean ELSE a.mean + (b.mean - a.mean) * ((n.bin - m0)::DOUBLE / (m1 - m0)) END, a.mean, b.mean) + 1e-9, 6) AS mean_display,
  round_even(coalesce(CASE WHEN s0 = s1 THEN c.std ELSE c.std + (d.std - c.std) * ((n.bin - s0)::DOUBLE / (s1 - s0)) END, c.std, d.std) + 1e-9, 6) AS std_display
FROM near n LEFT JOIN seen a ON a.held_out = n.held_out AND a.bin = n.m0 LEFT JOIN seen b ON b.held_out = n.held_out AND b.bin = n.m1
  LEFT JOIN seen c ON c.held_out = n.held_out AND c.bin = n.s0 LEFT JOIN seen d ON d.held_out = n.held_out AND d.bin = n.s1""",
        bins=60,
    ),
}
