"""Rules on manifests and tables, as DataFrames of violations.

Every check returns what breaks it; ``first_violation`` raises the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONDITIONS = ("correct", "arched", "fast", "rotated")
VIEWS = ("side", "oblique45", "other")
LABEL_SOURCES = ("intent",)
QC_STATUS = ("ok", "flag", "reject")
SIDES = ("R", "L")


class SchemaError(ValueError):
    """A table breaks one of its rules."""


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "")


def outside(c: str, allowed: tuple[str, ...]) -> Column:
    """Not one of the allowed values; NULL is not allowed either."""
    return ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))


def clip_violations(clips: DataFrame, order: str, conditions: tuple[str, ...] = CONDITIONS, views: tuple[str, ...] = VIEWS) -> DataFrame:
    """(order, clip_id, rule) of every row that breaks a rule, with the first rule it breaks.

    An id is a duplicate from its second row on, in the order given.
    """
    again = F.row_number().over(Window.partitionBy("clip_id").orderBy(order)) > 1
    rule = (
        F.when(blank("clip_id"), "empty clip_id")
        .when(F.col("_again"), "duplicate clip_id")
        .when(blank("person_id"), "empty person_id")
        .when(outside("condition", conditions), "unknown condition")
        .when(outside("view", views), "unknown view")
        .when(outside("qc_status", QC_STATUS), "unknown qc_status")
        .when(outside("label_source", LABEL_SOURCES), "unknown label_source")
    )
    return clips.withColumn("_again", again).withColumn("rule", rule).filter(F.col("rule").isNotNull()).select(order, "clip_id", "rule")


def shared_groups(rows: DataFrame, group: str = "dedup_group", person: str = "person_id") -> DataFrame:
    """(group, persons) of the non-blank groups that hold more than one person; copies of a clip have one."""
    known = rows.filter(~blank(group)).select(group, person).distinct()
    return known.groupBy(group).agg(F.sort_array(F.collect_set(person)).alias("persons")).filter(F.size("persons") > 1)


def rep_violations(reps: DataFrame, clips: DataFrame) -> DataFrame:
    """(rep_id, rule) for reps with a repeated id, no clip, fields unlike their clip's, an unknown side, or no length."""
    named = clips.select("clip_id", *(F.col(c).alias(f"_{c}") for c in ("person_id", "condition", "view")), F.lit(True).alias("_known"))
    again = F.row_number().over(Window.partitionBy("rep_id").orderBy("clip_id", "start_s")) > 1
    joined = reps.withColumn("_again", again).join(named, "clip_id", "left")
    unlike = [F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(f"{c} differs from the clip's")) for c in ("person_id", "condition", "view")]
    rule = F.coalesce(
        F.when(F.col("_again"), F.lit("duplicate rep_id")),
        F.when(F.col("_known").isNull(), F.lit("unknown clip_id")),
        *unlike,
        F.when(outside("side", SIDES), F.lit("unknown side")),
        F.when(~F.coalesce(F.col("end_s") > F.col("start_s"), F.lit(False)) | F.isnan("end_s"), F.lit("end_s is not after start_s")),
    )
    return joined.withColumn("rule", rule).filter(F.col("rule").isNotNull()).select("rep_id", "rule")


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose key no parent has."""
    return rows.join(parents.select(key).distinct(), key, "left_anti")


def first_violation(violations: DataFrame, *order: str) -> None:
    found = violations.orderBy(*order).limit(1).collect()
    if found:
        raise SchemaError(str(found[0].asDict()))


def column_problems(columns: list[str], required: list[str], known: list[str]) -> tuple[list[str], list[str]]:
    """(unknown, missing) columns, sorted."""
    return sorted(set(columns) - set(known)), sorted(set(required) - set(columns))


def assert_not_circular(features: list[str], label: str, signal: str = "lumbar_gap") -> None:
    """A label must not be a feature, nor be made from the signal that the bands judge."""
    if label in features:
        raise SchemaError(f"{label} is a feature too")
    if label.startswith(signal):
        raise SchemaError(f"{label} is made from {signal}")


def as_double(c: str) -> Column:
    """A number from text; blank, NaN and anything else unreadable are NULL."""
    value = F.col(c).try_cast("double")
    return F.when(~F.isnan(value), value)
