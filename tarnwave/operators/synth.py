"""Signals made from known bits: what a camera would record. Streams: keys, k, bit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwave.operators.order import small


def hash_bit(seed: Column, k: Column) -> Column:
    """A reproducible random bit: the lowest bit of the first hex digit of md5("seed:k")."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), k.cast("string"))), 1, 1), 16, 10).cast("long") % 2).cast("long")


def hash_unit(seed: Column, k: Column) -> Column:
    """A reproducible number from 0 to 1: the first 8 hex digits of md5("seed:k")."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), k.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def synthesise(bits: DataFrame, period: float, phase: float = 0.0, exposure: float = 0.3, hi: float = 245.0, lo: float = 1.0, sub: int = 16, noise: float = 0.0, keys: Sequence[str] = ("stream",)) -> DataFrame:
    """keys, frame, v: each frame averages the light at sub points of its exposure. noise: amplitude of uniform hash noise.

    Frames before the first or after the last symbol see that symbol.
    """
    n = bits.groupBy(*keys).agg(F.count("*").alias("__n"))
    count = F.floor(F.col("__n") * F.lit(period) + phase)
    # each symbol says how many of a frame's points see it, for the frames near it: no stream is unrolled from one row
    rows, k = bits.join(small(n), list(keys)), F.col("k")
    first = F.when(k == 0, F.lit(0).cast("long")).otherwise(F.floor(phase + k * F.lit(period) - exposure) - 1)
    last = F.when(k == F.col("__n") - 1, count - 1).otherwise(F.ceil(phase + (k + 1) * F.lit(period)) + 1)
    first, last = F.greatest(first, F.lit(0).cast("long")), F.least(last, count - 1)
    near = rows.filter(first <= last).withColumn("frame", F.explode(F.sequence(first, last)))

    def seen(j: int) -> Column:
        at = F.floor((F.col("frame") + F.lit((j + 0.5) / float(sub) * exposure) - phase) / F.lit(period))
        return (F.least(F.greatest(at, F.lit(0)), F.col("__n") - 1) == k).cast("int")

    near = near.withColumn("__w", sum((seen(j) for j in range(1, sub)), seen(0))).filter("__w > 0")
    lit = near.groupBy(*keys, "frame").agg((F.sum(F.col("__w") * F.when(F.col("bit") == 1, hi).otherwise(lo)) / sub).alias("v"))
    if noise:
        lit = lit.withColumn("v", F.col("v") + noise * (hash_unit(F.lit(17), F.col("frame")) - 0.5))
    return lit


def exposed(bits: DataFrame, period: float | Column, duty: float | Column, keys: Sequence[str] = ("stream",)) -> DataFrame:
    """keys, frame, v: the exact share of light in [frame, frame + duty]. period, duty: figures, or columns among keys."""
    period, duty = (x if isinstance(x, Column) else F.lit(x) for x in (period, duty))
    first, last = F.floor(F.col("k") * period - duty), F.ceil((F.col("k") + 1) * period)
    rows = bits.withColumn("frame", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    part = F.greatest(F.lit(0.0), F.least(F.col("frame") + duty, (F.col("k") + 1) * period) - F.greatest(F.col("frame").cast("double"), F.col("k") * period))
    n = bits.groupBy(*keys).agg(F.count("*").alias("__n"))
    sums = rows.withColumn("__part", F.col("bit") * part / duty).groupBy(*keys, "frame").agg(F.sum("__part").alias("v"))
    return sums.join(n, list(keys)).filter(F.col("frame") < F.floor(F.col("__n") * period) - 1).drop("__n")


def drifting(bits: DataFrame, fps: float = 30.0, rate: float = 10.0, phase: float = 0.35, drift: float = 0.0, lo: float = 0.25, hi: float = 0.85, exposure: float = 0.8, sub: int = 32, keys: Sequence[str] = ("stream",)) -> DataFrame:
    """keys, frame, v in 0 to 1: the other model, with a slow wander of the ambient light; phase is in symbols."""
    n = bits.groupBy(*keys).agg(F.count("*").alias("__nb")).withColumn("__n", F.floor(F.col("__nb") * F.lit(fps / rate)) - 1)
    rows = n.filter("__n > 0").withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    point = lambda j: F.least(F.greatest(F.floor((F.col("frame") + (j + 0.5) / F.lit(float(sub)) * F.lit(exposure)) / F.lit(fps) * F.lit(rate) - F.lit(phase)), F.lit(0)), F.col("__nb") - 1)
    seen = rows.withColumn("k", F.explode(F.transform(F.sequence(F.lit(0), F.lit(sub - 1)), point))).groupBy(*keys, "frame", "__n", "k").agg(F.count("*").alias("__w"))
    lit = seen.join(bits, [*keys, "k"]).groupBy(*keys, "frame", "__n").agg((F.sum(F.col("__w") * F.when(F.col("bit") == 1, hi).otherwise(lo)) / sub).alias("v"))
    wander = F.lit(drift) * F.sin(F.lit(2.5) * F.col("frame") / (F.col("__n") - 1))
    return lit.select(*keys, "frame", F.least(F.greatest(F.col("v") + wander, F.lit(0.0)), F.lit(1.0)).alias("v"))
