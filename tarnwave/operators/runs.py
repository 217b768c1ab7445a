"""Edges and runs of binary streams (keys, frame, bit)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwave.operators.order import chunked, running_sum

KEYS = ("lamp",)


def edges(df: DataFrame, keys: Sequence[str] = KEYS, bit: str = "bit", frame: str = "frame") -> DataFrame:
    """Rows whose bit differs from the one before."""
    near = chunked(df, keys, frame, 1, 0, lambda w: {"__was": F.lag(bit).over(w)})
    return near.filter(F.col("__was") != F.col(bit)).drop("__was")


def islands(df: DataFrame, keys: Sequence[str] = KEYS, bit: str = "bit", frame: str = "frame") -> DataFrame:
    """df with island: the number of changes up to each row."""
    near = chunked(df, keys, frame, 1, 0, lambda w: {"__was": F.lag(bit).over(w)})
    change = F.coalesce((F.col("__was") != F.col(bit)).cast("long"), F.lit(0))
    return running_sum(near, keys, frame, change, "island").drop("__was")


def runs(df: DataFrame, keys: Sequence[str] = KEYS, partial: bool = True, bit: str = "bit", frame: str = "frame") -> DataFrame:
    """One row for each run: keys, island, bit, start, length. Without partial, the first and last run are left out."""
    out = islands(df, keys, bit, frame).groupBy(*keys, "island").agg(F.max(bit).alias(bit), F.min(frame).alias("start"), F.count("*").alias("length"))
    if partial:
        return out
    ends = out.groupBy(*keys).agg(F.max("island").alias("__last"))
    return out.join(ends, list(keys)).filter((F.col("island") > 0) & (F.col("island") < F.col("__last"))).drop("__last")


def stream_stats(df: DataFrame, keys: Sequence[str] = KEYS, bit: str = "bit", frame: str = "frame") -> DataFrame:
    """n_bits, ones_pct, flip_rate_pct, longest_run, mean_run_bits of each key."""
    per_run = runs(df, keys, True, bit, frame)
    ones = F.sum(F.col(bit) * F.col("length"))
    n = F.sum("length")
    flips = F.count("*") - 1
    return per_run.groupBy(*keys).agg(n.alias("n_bits"), F.round(100.0 * ones / n, 6).alias("ones_pct"), F.round(100.0 * flips / F.nullif(n - 1, F.lit(0)), 6).alias("flip_rate_pct"), F.max("length").alias("longest_run"), F.round(F.avg("length"), 6).alias("mean_run_bits"))
