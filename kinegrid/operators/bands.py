"""Normative bands: how large a signal normally is at a given excursion.

Bands are fitted leaving one person out, and abstain where evidence is thin.
Input is one row per repetition with person, excursion and signal. Long form
throughout: one row per (held_out, bin).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import finite, ratio, wilson
from ..session import checkpointed

BINS, SIGMA, MIN_EXCURSION, MIN_SUPPORT = 20, 2.0, 0.20, 2
#: Held-out value of the band over everybody.
POOLED = "__pooled__"
#: Places in the order of a bin's values that are looked up together.
STRETCH = 1024
#: Share of a cell's sum of squares below which a fold is summed up directly.
LOST = 1e-4


def edge(i: Column, low: Column, high: Column, bins: int) -> Column:
    """Edge i of equally wide bins from low to high; the last edge is high itself."""
    return F.when(i == bins, high).otherwise(low + i * ((high - low) / bins))


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """The number of edges at or below value, less one, kept within 0 and bins - 1.

    The quotient can miss by one next to an edge, so the edges decide.
    """
    step = (high - low) / bins
    guess = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(value - low, step), F.lit(0.0))).cast("int")))
    up = (guess < bins - 1) & (value >= edge(guess + 1, low, high, bins))
    down = (guess > 0) & (value < edge(guess, low, high, bins))
    # bins of no width: every edge is at or below the value unless it lies below them all
    return F.when(high == low, F.when(value >= low, F.lit(bins - 1)).otherwise(F.lit(0))).otherwise(F.when(up, guess + 1).when(down, guess - 1).otherwise(guess))


def usable_reps(reps: DataFrame, min_excursion: float = MIN_EXCURSION) -> DataFrame:
    """(person, excursion, signal) with both finite and enough excursion."""
    return reps.select("person", finite("excursion").alias("excursion"), finite("signal").alias("signal")).filter(
        F.col("excursion").isNotNull() & F.col("signal").isNotNull() & (F.col("excursion") >= min_excursion)
    )


def eligible(reps: DataFrame, conditions: tuple[str, ...], views: tuple[str, ...]) -> DataFrame:
    """The repetitions a band may be fitted on; both predicates reach the scan."""
    return reps.filter(F.col("condition").isin(*conditions) & F.col("view").isin(*views))


def _tallied(rows: DataFrame, ranges: DataFrame, bins: int) -> DataFrame:
    """(range, low, high, bin, person, signal, n): usable rows counted by value in the bins of each range; ``ranges`` has few rows."""
    placed = rows.join(F.broadcast(ranges)).withColumn("bin", bin_of(F.col("excursion"), F.col("low"), F.col("high"), bins))
    return placed.groupBy("range", "low", "high", "bin", "person", "signal").agg(F.count("*").alias("n"))


def _placed(tally: DataFrame) -> DataFrame:
    """``tally`` with below and own_below: how many rows of the cell, and of the person in it, come before in order of signal and person.

    The rows are dealt out in that order once. Counts within a part and of whole
    parts before it add up, so that no task holds a large cell or person.
    """
    cell, own = ["range", "bin"], ["range", "bin", "person"]
    dealt = checkpointed(tally.repartitionByRange(*cell, "signal").withColumn("_part", F.spark_partition_id()))
    offsets = dealt.groupBy(*own, "_part").agg(F.sum("n").alias("_n"))
    parts = offsets.groupBy(*cell, "_part").agg(F.sum("_n").alias("_n"))
    before = lambda by, order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, by, *order: F.coalesce(F.sum(c).over(before(by, order)), F.lit(0))
    parts = parts.select(*cell, "_part", so_far("_n", cell, "_part").alias("_all"))
    offsets = offsets.select(*(F.col(c).alias(f"_of_{c}") for c in (*own, "_part")), so_far("_n", own, "_part").alias("_own"))
    within = dealt.withColumns({"_below": so_far("n", [*cell, "_part"], "signal", "person"), "_own_below": so_far("n", [*own, "_part"], "signal")})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*own, "_part")]
    placed = within.join(offsets, same).join(parts, [*cell, "_part"])
    return checkpointed(placed.select(*own, "signal", "n", (F.col("_all") + F.col("_below")).alias("below"), (F.col("_own") + F.col("_own_below")).alias("own_below")))


def _bands(tally: DataFrame, folds: DataFrame) -> DataFrame:
    """(held_out, low, high, bin, mean, std, p05, p95, count): the band of each of ``folds`` (range, held_out, low, high) without that person's rows.

    Nothing fans out: a fold's sums are those of all less the person's own, and
    its k-th smallest value is the (k + j)-th of all, where j of the person's
    own values come before it. These are the ones with at most k others below.

    Sums are taken about each cell's mean. Where little is left of them without
    the person, the subtraction has lost digits; that cell's fold is summed up
    directly. At most two persons of a cell can be so far off.
    """
    cell = ["range", "bin"]
    rows = _placed(tally)
    n = F.col("n")
    centres = rows.groupBy(*cell).agg((F.sum(n * F.col("signal")) / F.sum(n)).alias("centre"))
    x = F.col("signal") - F.col("centre")
    sums = lambda by: [F.sum(n).alias(f"{by}_n"), F.sum(n * x).alias(f"{by}_x"), F.sum(n * x * x).alias(f"{by}_xx")]
    # at most three ranges times the bins
    own = rows.join(F.broadcast(centres), cell).groupBy(*cell, "person").agg(F.first("centre").alias("centre"), *sums("own"))
    own = checkpointed(own)
    whole = own.groupBy(*cell).agg(F.first("centre").alias("centre"), *(F.sum(f"own_{c}").alias(f"all_{c}") for c in ("n", "x", "xx")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    cells = folds.join(whole, "range").join(own.drop("centre").withColumnRenamed("person", "held_out"), [*cell, "held_out"], "left")
    left = {c: F.col(f"all_{c}") - zero(F.col(f"own_{c}")) for c in ("n", "x", "xx")}
    at = lambda p: F.lit(p) * (F.col("count") - 1)
    ranks = {"first": F.lit(0), "last": F.col("count") - 1} | {f"{p}_{e}": f(at(v)) for p, v in (("p05", 0.05), ("p95", 0.95)) for e, f in (("low", F.floor), ("high", F.ceil))}
    cells = cells.withColumn("count", left["n"]).filter("count > 0")
    squares = left["xx"] - left["x"] * left["x"] / F.col("count")
    lost = zero(F.col("own_n")) > 0, squares <= F.lit(LOST) * F.col("all_xx")
    cells = checkpointed(
        cells.select(
            *cell, "held_out", "low", "high", "count", (F.col("centre") + left["x"] / F.col("count")).alias("mean"), squares.alias("squares"), (lost[0] & lost[1]).alias("lost"), *(r.cast("long").alias(k) for k, r in ranks.items())
        )
    )
    again = cells.filter("lost").select(*cell, "held_out")
    others = rows.join(F.broadcast(again), cell).filter(~F.col("person").eqNullSafe(F.col("held_out")))  # two a cell
    by_fold = [*cell, "held_out"]
    means = others.groupBy(*by_fold).agg((F.sum(n * F.col("signal")) / F.sum(n)).alias("_mean"))
    far = F.col("signal") - F.col("_mean")
    exact = others.join(F.broadcast(means), by_fold).groupBy(*by_fold).agg(F.first("_mean").alias("_mean"), F.sum(n * far * far).alias("_squares"))

    # a person's own values, with how many others come before each, and the ranks that are asked of the fold
    steps = rows.filter("person IS NOT NULL").select(*cell, F.col("person").alias("held_out"), (F.col("below") - F.col("own_below")).alias("others"), "n")
    asked = cells.select(*by_fold, *ranks)
    moved = asked.join(steps, by_fold, "left").groupBy(*by_fold).agg(*((F.first(k) + zero(F.sum(F.when(F.col("others") <= F.col(k), n)))).alias(k) for k in ranks))
    # values hold runs of places; runs and places meet in stretches of places
    stretch = lambda c: F.floor(c / STRETCH)
    runs = rows.select(*cell, "signal", "below", "n", F.explode(F.sequence(stretch(F.col("below")), stretch(F.col("below") + n - 1))).alias("stretch"))
    places = moved.select(*by_fold, F.inline(F.array(*(F.struct(F.lit(k).alias("rank"), F.col(k).alias("place")) for k in ranks)))).withColumn("stretch", stretch(F.col("place")))
    found = places.join(runs, [*cell, "stretch"]).filter(F.col("place").between(F.col("below"), F.col("below") + n - 1))
    values = found.groupBy(*by_fold).agg(*(F.max(F.when(F.col("rank") == k, F.col("signal"))).alias(f"_{k}") for k in ranks))
    between = lambda p, share: F.when(F.col(f"{p}_low") == F.col(f"{p}_high"), F.col(f"_{p}_low")).otherwise(F.col(f"_{p}_low") + (F.col(f"_{p}_high") - F.col(f"_{p}_low")) * (at(share) - F.col(f"{p}_low")))
    flat = F.col("_first") == F.col("_last")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.coalesce("_squares", "squares") / (F.col("count") - 1)))
    return (
        cells.join(values, by_fold)
        .join(F.broadcast(exact), by_fold, "left")
        .select(
            "held_out",
            "low",
            "high",
            "bin",
            F.when(flat, F.col("_first")).otherwise(F.coalesce("_mean", "mean")).alias("mean"),
            F.when(F.col("count") > 1, F.when(flat, F.lit(0.0)).otherwise(spread)).alias("std"),
            between("p05", 0.05).alias("p05"),
            between("p95", 0.95).alias("p95"),
            "count",
        )
    )


def fit_pooled(reps: DataFrame, bins: int = BINS, min_excursion: float = MIN_EXCURSION) -> DataFrame:
    """One band over all persons. Fewer than two usable rows give no band."""
    rows = usable_reps(reps, min_excursion)
    low, high, n = rows.agg(F.min("excursion"), F.max("excursion"), F.count("*")).first()
    everyone = rows.select(F.lit(None).cast("string").alias("person"), "excursion", "signal")
    ranges = rows.sparkSession.createDataFrame([(0, low, high)] if n >= 2 else [], "range int, low double, high double")
    return _bands(_tallied(everyone, ranges, bins), ranges.select("range", F.lit(POOLED).alias("held_out"), "low", "high"))


def fit_loso(reps: DataFrame, bins: int = BINS, min_excursion: float = MIN_EXCURSION) -> DataFrame:
    """A band per person from the rows of all others, for any number of persons.

    There are three ranges at most: that of all rows, and those without the
    person who holds the smallest or the largest excursion. Rows are counted
    once in the bins of each. A person without whom fewer than two rows are left
    has no band. Rows without a person belong to none.
    """
    # three numbers a row, read for the ranges and for the counts
    rows = checkpointed(usable_reps(reps, min_excursion).filter(F.col("person").isNotNull()))
    per = checkpointed(rows.groupBy("person").agg(F.min("excursion").alias("low"), F.max("excursion").alias("high"), F.count("*").alias("n")))
    lows, highs = (per.orderBy(o, "person").limit(2).collect() for o in (F.col("low"), F.col("high").desc()))
    total = per.agg(F.sum("n")).first()[0]
    spans = {None: (lows[0].low, highs[0].high)} if lows else {}
    if len(lows) == 2:
        for person in dict.fromkeys((lows[0].person, highs[0].person)):
            spans[person] = (lows[person == lows[0].person].low, highs[person == highs[0].person].high)
    # a person without whom the range stays the same belongs to the range of all
    spans = {p: span for p, span in spans.items() if p is None or span != spans[None]}
    kind = per.schema["person"].dataType
    schema = f"range int, special {kind.simpleString()}, low double, high double"
    ranges = rows.sparkSession.createDataFrame([(k, p, *span) for k, (p, span) in enumerate(spans.items())], schema)
    special = [p for p in spans if p is not None]
    fold = F.coalesce(*(F.when(F.col("person") == F.lit(p), F.lit(k)) for k, p in enumerate(spans) if p is not None), F.lit(0)) if special else F.lit(0)
    folds = per.filter(F.lit(total) - F.col("n") >= 2).select(F.col("person").alias("held_out"), fold.alias("range")).join(F.broadcast(ranges), "range")
    return _bands(_tallied(rows, ranges.drop("special"), bins), folds.select("range", "held_out", "low", "high"))


def supported(band: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """The band with a column that says which bins have enough observations."""
    return band.withColumn("supported", F.col("count") >= min_support)


def with_upper(band: DataFrame, sigma: float = SIGMA) -> DataFrame:
    return band.withColumn("upper", F.col("mean") + sigma * F.col("std"))


def display_band(band: DataFrame, bins: int = BINS) -> DataFrame:
    """All bins of every band; *_display fills empty ones linearly between known neighbours and flatly beyond them."""
    folds = band.select("held_out", "low", "high").distinct()
    every = folds.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = every.join(band.drop("low", "high"), ["held_out", "bin"], "left")
    order = Window.partitionBy("held_out").orderBy("bin")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    out = full
    for name in ("mean", "std"):
        at = F.when(F.col(name).isNotNull(), F.col("bin"))
        b0, v0 = F.last(at, True).over(back), F.last(name, True).over(back)
        b1, v1 = F.first(at, True).over(ahead), F.first(name, True).over(ahead)
        lerp = F.when(b0 == b1, v0).otherwise(v0 + (v1 - v0) * ((F.col("bin") - b0) / (b1 - b0)))
        out = out.withColumn(f"{name}_display", F.coalesce(lerp, v0, v1))
    return out.withColumn("count", F.coalesce("count", F.lit(0)))


def score(reps: DataFrame, band: DataFrame, held_out: Column, bins: int = BINS, sigma: float = SIGMA, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Each repetition against a band: bin, z, limit, exceeds, support, extrapolated, reason.

    ``held_out`` names the band of a row. The verdict is NULL, with a reason,
    where the bin has fewer than ``min_support`` observations or no spread. A
    band is a row per bin; Catalyst broadcasts it if it is small.
    """
    headers = band.select("held_out", "low", "high").distinct()
    e = finite("excursion")
    placed = reps.withColumn("held_out", held_out).join(headers, "held_out").withColumn("bin", bin_of(e, F.col("low"), F.col("high"), bins))
    scored = placed.join(band.drop("low", "high"), ["held_out", "bin"], "left").withColumn("support", F.coalesce("count", F.lit(0)))
    signal, few = finite("signal"), F.col("support") < min_support
    flat = F.col("std").isNull() | (F.col("std") <= 0)
    limit = F.col("mean") + sigma * F.col("std")
    reason = (
        F.when(e.isNull(), "no bin")
        .when(few, F.format_string(f"bin has %d observation(s), needs {min_support}", F.col("support")))
        .when(flat, "bin has no spread")
        .otherwise("")
    )
    fine = e.isNotNull() & ~few & ~flat
    return scored.withColumns(
        {
            "extrapolated": (e < F.col("low")) | (e > F.col("high")),
            "limit": F.when(fine, limit),
            "z": F.when(fine, (signal - F.col("mean")) / F.col("std")),
            "exceeds": F.when(fine, signal > limit),
            "reason": reason,
        }
    ).drop("mean", "std", "p05", "p95", "count", "low", "high")


def exceed_rate(scored: DataFrame, *by: str, alpha: float = 0.05) -> DataFrame:
    """Per group: rows that exceed, rows with a verdict, their share and its Wilson interval."""
    counted = scored.groupBy(*by).agg(F.count_if("exceeds").alias("exceed"), F.count("exceeds").alias("scored"), F.count("*").alias("rows"))
    low, high = wilson("exceed", "scored", alpha)
    return counted.withColumns({"rate": ratio("exceed", "scored"), "ci_low": low, "ci_high": high})


def separated(rates: DataFrame, bad: str, good: str, by: str = "condition") -> DataFrame:
    """Whether the interval of ``bad`` lies above that of ``good``: one row."""
    of = lambda name, c: F.max(F.when(F.col(by) == name, F.col(c)))
    return rates.agg(of(bad, "ci_low").alias("bad_low"), of(good, "ci_high").alias("good_high")).withColumn("passed", F.coalesce(F.col("bad_low") > F.col("good_high"), F.lit(False)))
