"""What is measured of recordings, and the rules of their verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwave.operators import clock, order, thresholds, windows
from tarnwave.sources.stage import staged

#: Most frames that a recorder writes into one recording: what ends there may have gone on.
LIMIT = 80
#: Frames of a segment of the spectrum.
SEGMENT = 32


def measured(rows: DataFrame, truth: DataFrame, key: str, limit: int = LIMIT, segment: int = SEGMENT) -> DataFrame:
    """One row of figures for each recording. rows: key, frame (dense from 0), us (time), region, v; truth: key, once each.

    frames, black (v below 1), peak, moved (v changes by more than 1), capped (has reached limit). told: the frames that its
    duration holds at its usual step, the median one. jitter: spread over mean of its steps, from 6 frames and 4 steps on. ratio:
    the largest variance of a region over the median one. strength: peak over median of its amplitudes, powers summed over
    full segments. separation: that of the two groups its values split into. has_truth: whether truth has its key.

    Figures that can't be told (too few frames, no variance) are null. Rows of a recording are never held together: steps
    and segments work in chunks of frames, everything else is summed before it is shuffled.
    """
    rows = staged(rows.select(key, "frame", "us", "region", F.col("v").cast("double").alias("v")))
    v = F.col("v")
    whole = rows.groupBy(key).agg(
        F.count("*").alias("frames"),
        F.count_if(v < 1).alias("black"),
        F.max(v).alias("peak"),
        (F.max(v) - F.min(v) > 1).alias("moved"),
        (F.count("*") >= limit).alias("capped"),
        (F.max("us") - F.min("us")).alias("__lasts"),
    )
    steps = windows.lagged(rows, [key], v="us").withColumn("dt", (F.col("us") - F.col("before")).cast("double")).filter("dt > 0")
    spread = {"__jitter": F.when(F.count("*") > 3, F.stddev_pop("dt") / F.avg("dt"))}
    steps = thresholds.quantiles(steps, [key], "dt", also=spread, __step=0.5)
    regions = rows.groupBy(key, "region").agg(F.var_pop(v).alias("s")).groupBy(key).agg(F.try_divide(F.max("s"), F.median("s")).alias("ratio"))
    cut = rows.withColumns({"seg": F.floor(F.col("frame") / segment), "i": F.col("frame") % segment})
    full = order.with_stats(cut, [key, "seg"], __m=F.avg(v), __c=F.count("*")).filter(F.col("__c") == segment)
    bins = clock.spectrum(full.withColumn("x", v - F.col("__m")), segment, [key, "seg"]).filter("bin > 0")
    bins = bins.groupBy(key, "bin").agg(F.sqrt(F.sum("power")).alias("a"))
    rhythm = bins.groupBy(key).agg((F.max("a") / (F.median("a") + 1e-12)).alias("strength"))
    split = thresholds.two_groups(order.with_stats(rows, [key], lo=F.min(v), hi=F.max(v), n=F.count("*")), key).select(key, "separation")
    known = truth.select(key, F.lit(True).alias("__known"))
    for part in (steps, regions, rhythm, split, known):
        whole = whole.join(part, key, "left")
    told = (F.round(F.col("__lasts") / F.col("__step")) + 1).cast("long")
    jitter = F.when(F.col("frames") > 5, F.col("__jitter"))
    has_truth = F.coalesce("__known", F.lit(False))
    return whole.withColumns({"told": told, "jitter": jitter, "has_truth": has_truth}).drop("__lasts", "__step", "__jitter", "__known")


def rules(few: int = 60, off: int = 2, uneven: float = 0.02, clipped: float = 250.0, busy: float = 3.0, clear: float = 3.0, apart: float = 1.0) -> list[tuple[str, Column, Column]]:
    """Rules (level, holds, reason) over the figures of measured, in the order in which reasons are told."""

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    c = F.col
    return [
        ("red", c("frames") < few, text("few frames: ", c("frames"))),
        ("amber", c("black") > 0, text("dark frames: ", c("black"))),
        ("note", c("capped"), text("ends at the limit of ", c("frames"))),
        ("amber", ~c("capped") & (F.abs(c("told") - c("frames")) > off), text("announced ", c("told"), ", found ", c("frames"))),
        ("amber", c("jitter") > uneven, text("uneven frame times")),
        ("amber", c("peak") >= clipped, text("top levels are clipped")),
        ("red", ~c("moved"), text("no region changes")),
        ("red", c("ratio") < busy, text("the busiest region is hardly busier than others")),
        ("unless red", c("strength") < clear, text("no clear rhythm")),
        ("amber", c("separation") < apart, text("levels do not split in two")),
        ("amber", ~c("has_truth"), text("no truth to compare with")),
    ]
