"""Fingerprints, manifests and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(signal: DataFrame, keys: Sequence[str] = ("lamp",), part: int = 1000) -> DataFrame:
    """keys, sha256 of a signal's values (in thousandths): of the list of its parts' fingerprints, in order."""
    value = F.round(F.col("v") * 1000).cast("long").cast("string")
    parts = signal.groupBy(*keys, F.floor(F.col("frame") / part).alias("part")).agg(F.array_sort(F.collect_list(F.struct("frame", value.alias("t")))).alias("x"))
    parts = parts.select(*keys, "part", F.sha2(F.array_join(F.transform("x", lambda x: x["t"]), ","), 256).alias("h"))
    whole = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", "h"))).alias("x"))
    return whole.select(*keys, F.sha2(F.array_join(F.transform("x", lambda x: x["h"]), ","), 256).alias("sha256"))


def compare_manifests(old: DataFrame, new: DataFrame, key: str, sha: str) -> DataFrame:
    """key, state: what is missing, new or changed between two manifests."""
    both = old.select(key, F.col(sha).alias("__a")).join(new.select(key, F.col(sha).alias("__b")), key, "full")
    state = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "new").otherwise("changed")
    return both.filter(~F.col("__a").eqNullSafe(F.col("__b"))).select(key, state.alias("state"))


def verdict(rules: Sequence[tuple[str, Column, Column]], readable: Column | None = None) -> tuple[Column, Column]:
    """Of rules (level, holds, reason): the worst level that holds (red, amber, else green), and the reasons in order.

    note: told, but no matter. unless red: amber, told only where nothing is red. What isn't readable is red at once.
    """
    holds = lambda *levels: F.greatest(F.lit(False), F.lit(False), *[F.coalesce(c, F.lit(False)) for level, c, _ in rules if level in levels])
    red = holds("red")
    level = F.when(red, "red").when(holds("amber", "unless red"), "amber").otherwise("green")
    reasons = F.array_compact(F.array(*[F.when(c & ~red if level_ == "unless red" else c, text) for level_, c, text in rules]))
    reasons = F.when(F.size(reasons) == 0, F.array(F.lit("nothing to object to"))).otherwise(reasons)
    if readable is None:
        return level, reasons
    return F.when(readable, level).otherwise("red"), F.when(readable, reasons).otherwise(F.array(F.lit("cannot be read")))
