"""Column functions on silhouettes.

A silhouette is the array of its lowest occupied row per image column, NULL
where the column is empty. The floor is a line a * x + b.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Windows along the torso, in torso lengths from the hip.
LUMBAR, RIB = (0.00, 0.35), (0.45, 0.75)


def floor_y(a: Column, b: Column, x: Column) -> Column:
    return a * x + b


def window(hip_x: Column, unit_x: Column, torso: Column, fractions: tuple[float, float], width: Column) -> Column:
    """Struct (x0, x1): columns from one fraction of the torso to another, rounded half to even, sorted, clipped, half open."""
    ends = [F.rint(hip_x + f * torso * unit_x) for f in fractions]
    clip = lambda v: F.greatest(F.lit(0), F.least(width, v.cast("int")))
    return F.struct(clip(F.least(*ends)).alias("x0"), clip(F.greatest(*ends)).alias("x1"))


def gap_profile(bottom: Column, a: Column, b: Column, x0: Column, x1: Column) -> Column:
    """Height of the silhouette over the floor in columns x0 to x1 - 1; 0 in empty columns and below the floor."""
    inside = F.when(x1 > x0, F.slice(bottom, x0 + 1, F.greatest(x1 - x0, F.lit(0)))).otherwise(F.array().cast("array<double>"))
    return F.transform(inside, lambda y, k: F.coalesce(F.greatest(F.lit(0.0), floor_y(a, b, (x0 + k).cast("double")) - y), F.lit(0.0)))


def band_signal(bottom: Column, a: Column, b: Column, place: Column, torso: Column) -> Column:
    """Struct (area, peak, width): summed gap over the torso squared, largest gap over the torso, columns.

    NULL for a torso of no length, 0 over an empty window.
    """
    gaps = gap_profile(bottom, a, b, place["x0"], place["x1"])
    area = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g)
    fine = torso > 1e-6
    return F.struct(
        F.when(fine, area / (torso * torso)).alias("area"),
        F.when(fine, F.coalesce(F.array_max(gaps), F.lit(0.0)) / torso).alias("peak"),
        F.when(fine, F.size(gaps)).alias("width"),
    )


def lifted(bottom: Column, place: Column, delta: Column) -> Column:
    """The silhouette with its lower boundary raised by round(delta) inside the window."""
    return F.transform(bottom, lambda y, k: F.when((k >= place["x0"]) & (k < place["x1"]), y - F.rint(delta)).otherwise(y))


def expected_slope(width: Column, torso: Column) -> Column:
    """How much the area signal grows with each row that the window is lifted."""
    return width / (torso * torso)
