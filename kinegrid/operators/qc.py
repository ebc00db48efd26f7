"""Quality gates with three kinds of missing.

A measure that was never taken (key absent from the map), one that is not a
number, and one that fails its bound give different outcomes. Measures are a
map<string, double>: an absent key or a NULL is missing, NaN or an infinity is
non-finite.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gate:
    """A bound on a measure: ``least`` or ``most``; failing a strict gate rejects, another flags."""

    measure: str
    least: float | None = None
    most: float | None = None
    rejects: bool = False


#: The gates of the pose pipeline.
POSE_GATES = (
    Gate("detection_rate", least=0.95),
    Gate("mean_visibility_core", least=0.70),
    Gate("torso_len_cv", most=0.10),
    Gate("floor_inlier_ratio", least=0.80, rejects=True),
    Gate("rep_count", least=4, rejects=True),
)


def _shown(value: Column) -> Column:
    """Four places, half to even, without trailing zeros; None if not finite."""
    text = F.bround(value, 4).cast("string")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit("None")).otherwise(text)


def gate_outcome(value: Column, gate: Gate) -> Column:
    """``name:missing``, ``name=value<bound`` or ``name=value>bound``, or NULL if the gate is passed."""
    if gate.least is not None:
        fails, sign, bound = F.isnan(value) | (F.abs(value) == float("inf")) | (value < gate.least), "<", gate.least
    else:
        fails, sign, bound = F.isnan(value) | (F.abs(value) == float("inf")) | (value > gate.most), ">", gate.most
    return F.when(value.isNull(), F.lit(f"{gate.measure}:missing")).when(fails, F.concat(F.lit(f"{gate.measure}="), _shown(value), F.lit(f"{sign}{bound:g}")))


def evaluate(clips: DataFrame, gates: tuple[Gate, ...], measures: str = "measures") -> DataFrame:
    """Adds flags and rejects (arrays) and status: reject before flag before ok."""
    of = lambda g: gate_outcome(F.try_element_at(F.col(measures), F.lit(g.measure)).cast("double"), g)
    collect = lambda rejects: F.array_compact(F.array(*(of(g) for g in gates if g.rejects == rejects), F.lit(None).cast("string")))
    out = clips.withColumns({"flags": collect(False), "rejects": collect(True)})
    return out.withColumn("status", F.when(F.size("rejects") > 0, "reject").when(F.size("flags") > 0, "flag").otherwise("ok"))


def unwired_gates(clips: DataFrame, gates: tuple[Gate, ...], measures: str = "measures") -> DataFrame:
    """Per clip the gates whose measure has no key at all."""
    names = F.array(*(F.lit(g.measure) for g in gates))
    return clips.withColumn("unwired", F.array_except(names, F.coalesce(F.map_keys(measures), F.array().cast("array<string>"))))


def summarise(evaluated: DataFrame) -> DataFrame:
    """Clips per status."""
    return evaluated.groupBy("status").agg(F.count("*").alias("n"))


def rejected(evaluated: DataFrame, key: str) -> DataFrame:
    """Each rejected clip with its reasons, joined by ``;``."""
    return evaluated.filter("status = 'reject'").select(key, F.array_join("rejects", ";").alias("reasons"))


def as_rows(evaluated: DataFrame, key: str, names: tuple[str, ...], measures: str = "measures") -> DataFrame:
    """The flat report: key, status, flags, rejects, then the measures sorted; one named like a fixed column gets a prefix."""
    fixed = {key, "status", "flags", "rejects"}
    cells = [F.bround(F.try_element_at(F.col(measures), F.lit(n)).cast("double"), 4).alias(f"measure_{n}" if n in fixed else n) for n in sorted(names)]
    return evaluated.select(key, "status", F.array_join("flags", ";").alias("flags"), F.array_join("rejects", ";").alias("rejects"), *cells)


def protocol_problem(reps: Column, sets: Column, duration_s: Column, seconds_per_rep: float = 3.0, setup_s: float = 3.0) -> Column:
    """'' if a clip is long enough for its protocol, else why not; a duration of 0 or less is unknown and passes."""
    needed = setup_s + reps * sets * seconds_per_rep
    return F.when(duration_s <= 0, F.lit("")).when(duration_s < needed, F.format_string("needs %.1f s, has %.1f s", needed, duration_s)).otherwise(F.lit(""))


def probe_problem(frames: Column, fps: Column, longest_s: float = 600.0) -> Column:
    """'' for a readable clip of at most ``longest_s``; a rate of 0 counts as 30."""
    rate = F.when(fps > 0, fps).otherwise(30.0)
    return F.when(frames.isNull() | (frames <= 0), "no frames").when(frames / rate > longest_s, "too long").otherwise("")
