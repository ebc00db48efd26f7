"""Column functions on arrays of landmarks.

A landmark is a struct with x and y, and z and v (visibility) where the source
has them. A missing landmark has NULL coordinates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the two landmark layouts.
#: Landmarks of the 33-point layout that make the 17-point one, in order.
COCO17 = (0, 2, 5, 7, 8, 11, 12, 13, 14, 15, 16, 23, 24, 25, 26, 27, 28)
#: Parent of each of the 17 points; bone k ends at point k + 1.
PARENTS17 = (0, 0, 0, 1, 2, 0, 0, 5, 6, 7, 8, 5, 6, 11, 12, 13, 14)
#: (a, vertex, c) of the eight joint angles.
ANGLES17 = ((6, 8, 10), (5, 7, 9), (12, 6, 8), (11, 5, 7), (6, 12, 14), (5, 11, 13), (12, 14, 16), (11, 13, 15))
#: Left and right counterparts.
PAIRS17 = tuple((k, k + 1) for k in range(1, 17, 2))
PAIRS33 = ((1, 4), (2, 5), (3, 6), *((k, k + 1) for k in range(7, 33, 2)))


@dataclass(frozen=True)
class Layout:
    """Indices of (left, right) landmarks."""

    points: int
    pairs: tuple[tuple[int, int], ...]
    shoulders: tuple[int, int]
    wrists: tuple[int, int]
    hips: tuple[int, int]
    knees: tuple[int, int]
    ankles: tuple[int, int]

    def mirror(self, joint: int) -> int:
        """The counterpart on the other side; a landmark on the axis is its own."""
        for a, b in self.pairs:
            if joint in (a, b):
                return b if joint == a else a
        if not 0 <= joint < self.points:
            raise IndexError(joint)
        return joint

    @property
    def permutation(self) -> list[int]:
        return [self.mirror(k) for k in range(self.points)]


L33 = Layout(33, PAIRS33, (11, 12), (15, 16), (23, 24), (25, 26), (27, 28))
L17 = Layout(17, PAIRS17, (5, 6), (9, 10), (11, 12), (13, 14), (15, 16))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def checked(lm: Column, layout: Layout) -> Column:
    """``lm``, or an error if it has another number of landmarks."""
    return F.when(F.size(lm) == layout.points, lm).otherwise(F.raise_error(F.lit(f"expected {layout.points} landmarks")))


def at(lm: Column, k: int) -> Column:
    return F.get(lm, F.lit(k))


def midpoint(lm: Column, pair: tuple[int, int]) -> Column:
    a, b = at(lm, pair[0]), at(lm, pair[1])
    return point((a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2)


def hip_center(lm: Column, layout: Layout = L33) -> Column:
    return midpoint(lm, layout.hips)


def shoulder_center(lm: Column, layout: Layout = L33) -> Column:
    return midpoint(lm, layout.shoulders)


def torso_vector(lm: Column, layout: Layout = L33) -> Column:
    """From the hip centre to the shoulder centre."""
    hip, shoulder = hip_center(lm, layout), shoulder_center(lm, layout)
    return point(shoulder["x"] - hip["x"], shoulder["y"] - hip["y"])


def torso_len(lm: Column, layout: Layout = L33) -> Column:
    t = torso_vector(lm, layout)
    return F.hypot(t["x"], t["y"])


def distance(lm: Column, a: int, b: int) -> Column:
    return F.hypot(at(lm, a)["x"] - at(lm, b)["x"], at(lm, a)["y"] - at(lm, b)["y"])


def hip_ratio(lm: Column, layout: Layout = L33, least: float = 1e-6) -> Column:
    """Hip separation over torso length; NULL for a torso of at most ``least``. With 1e-6 the view score, with 1e-9 the rotation proxy."""
    length = torso_len(lm, layout)
    return F.when(length > least, distance(lm, *layout.hips) / length)


def classify_view(score: Column, side: float = 0.12, oblique: float = 0.21) -> Column:
    return F.when(score < side, "side").when(score < oblique, "oblique45").otherwise("other")


def depth_proxy(lm: Column, layout: Layout = L33) -> Column:
    """Difference in depth of the hips; NULL without z."""
    return F.abs(at(lm, layout.hips[0])["z"] - at(lm, layout.hips[1])["z"])


def contralateral(lm: Column, layout: Layout = L33, per_torso: bool = False, least: float = 1e-6) -> Column:
    """Struct (R, L): right wrist to left ankle, and left wrist to right ankle.

    ``per_torso`` divides by the frame's own torso, NULL below ``least``.
    """
    right, left = distance(lm, layout.wrists[1], layout.ankles[0]), distance(lm, layout.wrists[0], layout.ankles[1])
    if per_torso:
        length = torso_len(lm, layout)
        right, left = (F.when(length > least, d / length) for d in (right, left))
    return F.struct(right.alias("R"), left.alias("L"))


def to_coco17(lm: Column) -> Column:
    return F.transform(F.array(*map(F.lit, COCO17)), lambda k: F.get(lm, k))


def scaled(lm: Column, width: Column, height: Column) -> Column:
    """Landmarks in [0, 1] as pixels; other fields stay."""
    return F.transform(lm, lambda p: p.withField("x", p["x"] * width).withField("y", p["y"] * height))


def normalized(lm: Column, torso: Column, layout: Layout = L33, rotate: bool = True) -> Column:
    """Hip centre to the origin, scaled by ``torso``, the clip's reference, and turned so that the frame's torso points along +x."""
    hip, t = hip_center(lm, layout), torso_vector(lm, layout)
    angle = torso_angle(lm, layout)
    c, s = (F.cos(angle), F.sin(angle)) if rotate else (F.lit(1.0), F.lit(0.0))

    def move(p: Column) -> Column:
        x, y = (p["x"] - hip["x"]) / torso, (p["y"] - hip["y"]) / torso
        return p.withField("x", c * x + s * y).withField("y", c * y - s * x)

    return F.when(t["x"].isNotNull() & t["y"].isNotNull(), F.transform(lm, move)).otherwise(F.transform(lm, lambda p: p.withField("x", F.lit(None).cast("double")).withField("y", F.lit(None).cast("double"))))


def torso_angle(lm: Column, layout: Layout = L33) -> Column:
    t = torso_vector(lm, layout)
    return F.atan2(t["y"], t["x"])


def flip_horizontal(lm: Column, width: Column | float, layout: Layout = L33) -> Column:
    """The mirror image in pixels: x becomes width - 1 - x, and left and right change places."""
    width = F.lit(float(width)) if not isinstance(width, Column) else width
    return F.transform(F.array(*map(F.lit, layout.permutation)), lambda k: F.get(lm, k).withField("x", width - 1 - F.get(lm, k)["x"]))


def bone_vectors(lm: Column) -> Column:
    """Child less parent of the 16 bones of the 17-point layout."""
    pairs = F.array(*(F.struct(F.lit(k).alias("c"), F.lit(PARENTS17[k]).alias("p")) for k in range(1, 17)))
    return F.transform(pairs, lambda b: point(F.get(lm, b["c"])["x"] - F.get(lm, b["p"])["x"], F.get(lm, b["c"])["y"] - F.get(lm, b["p"])["y"]))


def joint_angles(lm: Column) -> Column:
    """The eight unsigned angles at the vertices of ``ANGLES17``, in radians."""

    def angle(a: int, v: int, c: int) -> Column:
        ux, uy = at(lm, a)["x"] - at(lm, v)["x"], at(lm, a)["y"] - at(lm, v)["y"]
        wx, wy = at(lm, c)["x"] - at(lm, v)["x"], at(lm, c)["y"] - at(lm, v)["y"]
        return F.abs(F.atan2(ux * wy - uy * wx, ux * wx + uy * wy))

    return F.array(*(angle(*t) for t in ANGLES17))


def geometric_signal(lm: Column, layout: Layout = L33) -> Column:
    """Signed distance of the hip centre from the line between shoulder and knee centres, in torso lengths."""
    s, h, k = (midpoint(lm, p) for p in (layout.shoulders, layout.hips, layout.knees))
    kx, ky, hx, hy = k["x"] - s["x"], k["y"] - s["y"], h["x"] - s["x"], h["y"] - s["y"]
    line, torso = F.hypot(kx, ky), F.hypot(hx, hy)
    return F.when((line > 1e-9) & (torso > 1e-9), (kx * hy - ky * hx) / line / torso)


def visible(lm: Column, joints: tuple[int, ...]) -> Column:
    """Mean visibility of some landmarks, over those that have one."""
    values = F.filter(F.array(*(at(lm, k)["v"] for k in joints)), lambda v: v.isNotNull())
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values))


def detected(lm: Column) -> Column:
    """Whether any landmark has a coordinate."""
    return F.coalesce(F.exists(lm, lambda p: p["x"].isNotNull() | p["y"].isNotNull()), F.lit(False))


#: Layout of the 109 channels: 34 joint coordinates, 32 bone, 34 velocity, 8 angles, 1 gap.
CHANNELS = (("joint", 34), ("bone", 32), ("velocity", 34), ("angle", 8), ("lumbar", 1))


def channel_names() -> list[str]:
    out = []
    for name, n in CHANNELS:
        out += [f"{name}_{k // 2}_{'xy'[k % 2]}" if n in (34, 32) else f"{name}_{k}" if n > 1 else name for k in range(n)]
    return out


def flat_xy(points: Column) -> Column:
    return F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"])))


def stacked(lm: Column, before: Column, first: Column, fps: float, lumbar: Column | None = None) -> Column:
    """The 109 channels of a normalised 17-point frame; velocities are 0 on the first frame of a clip."""
    velocity = F.zip_with(flat_xy(lm), flat_xy(before), lambda a, b: (a - b) * F.lit(float(fps)))
    still = F.array_repeat(F.lit(0.0), 34)
    gap = F.coalesce(lumbar, F.lit(0.0)) if lumbar is not None else F.lit(0.0)
    return F.concat(flat_xy(lm), flat_xy(bone_vectors(lm)), F.when(first, still).otherwise(velocity), joint_angles(lm), F.array(gap))


def flip_tables() -> tuple[list[int], list[float]]:
    """(order, sign) of the channels of the mirror image, after normalisation: y changes sign, sides change places."""
    joints = L17.permutation
    bones = [joints[k + 1] - 1 for k in range(16)]
    angles = [k ^ 1 for k in range(8)]
    order, sign = [], []
    for base, permutation in ((0, joints), (34, bones), (66, joints)):
        order += [base + 2 * k + c for k in permutation for c in (0, 1)]
        sign += [1.0, -1.0] * len(permutation)
    return order + [100 + k for k in angles] + [108], sign + [1.0] * 9


def flip_features(features: Column) -> Column:
    order, sign = flip_tables()
    return F.transform(F.arrays_zip(F.array(*map(F.lit, order)).alias("o"), F.array(*map(F.lit, sign)).alias("s")), lambda c: F.get(features, c["o"]) * c["s"])


def checked_features(features: Column) -> Column:
    """``features``, or an error if they aren't as many as ``CHANNELS`` say."""
    n = sum(size for _, size in CHANNELS)
    return F.when(F.size(features) == n, features).otherwise(F.raise_error(F.format_string(f"expected {n} channels, not %d", F.size(features))))
