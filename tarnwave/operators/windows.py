"""Sliding windows whose ends see the edge value repeated, trims and peaks, over signals (keys, frame, v)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwave.operators.order import chunked, small, with_stats
from tarnwave.sources.stage import staged

KEYS = ("lamp",)


def moving_averages(df: DataFrame, widths: dict[str, tuple[str, int]], keys: Sequence[str] = KEYS) -> DataFrame:
    """df with, for each name, the mean of a column (its value: column, width) as moving_average gives it; rows are dealt once.

    The keys' ends are one small table, told by a pass over df, so df should be cheap to read twice: step on step, stage.
    """
    columns = {v: i for i, v in enumerate(dict.fromkeys(v for v, _ in widths.values()))}
    reach = {name: (width // 2, width - 1 - width // 2) for name, (_, width) in widths.items()}
    ends = df.groupBy(*keys).agg(F.count("*").alias("__n"), *[end for v, i in columns.items() for end in (F.min_by(v, "frame").alias(f"__first{i}"), F.max_by(v, "frame").alias(f"__last{i}"))])
    rows = df.join(small(ends), list(keys))
    left, right = (max(r[i] for r in reach.values()) for i in (0, 1))
    summed = chunked(rows, keys, "frame", left, right, lambda w: {f"__sum_{name}": F.sum(v).over(w.rowsBetween(-reach[name][0], reach[name][1])) for name, (v, _) in widths.items()})
    out = {}
    for name, (v, width) in widths.items():
        missing_left = F.greatest(F.lit(reach[name][0]) - F.col("frame"), F.lit(0)) * F.col(f"__first{columns[v]}")
        missing_right = F.greatest(F.col("frame") + reach[name][1] - (F.col("__n") - 1), F.lit(0)) * F.col(f"__last{columns[v]}")
        out[name] = (F.col(f"__sum_{name}") + missing_left + missing_right) / width
    made = [f"__sum_{name}" for name in widths] + [f"__{end}{i}" for i in columns.values() for end in ("first", "last")]
    return summed.withColumns(out).drop("__n", *made)


def moving_average(df: DataFrame, width: int, keys: Sequence[str] = KEYS, v: str = "v", name: str = "ma") -> DataFrame:
    """df with the mean over [-width // 2, width - 1 - width // 2] frames; the first and last value stand in beyond the ends."""
    return moving_averages(df, {name: (v, width)}, keys)


def detrend(df: DataFrame, width: int, centre: bool = True, keys: Sequence[str] = KEYS) -> DataFrame:
    """df with flat: v less its moving average, put back to the average's mean if centre."""
    moved = moving_average(df, width, keys)
    if centre:
        moved = with_stats(moved, keys, __mean=F.avg("ma"))
        return moved.withColumn("flat", F.col("v") - F.col("ma") + F.col("__mean")).drop("__mean", "ma")
    return moved.withColumn("flat", F.col("v") - F.col("ma")).drop("ma")


def rolling_z(df: DataFrame, width: int, keys: Sequence[str] = KEYS, odd: bool = False) -> DataFrame:
    """df with z: (v - mean) / sd, both moving; sd from the squared distances to the moving mean, plus 1e-6.

    An even window reaches one frame further to the left than to the right; odd makes it one frame wider and centred.
    """
    return rolling_zs(df, {"z": width | int(odd)}, keys)


def rolling_zs(df: DataFrame, widths: dict[str, int], keys: Sequence[str] = KEYS) -> DataFrame:
    """df with rolling_z for each name and width: all of them in two passes, cut by a written table."""
    moved = moving_averages(df, {f"__mu_{z}": ("v", w) for z, w in widths.items()}, keys)
    moved = staged(moved.withColumns({f"__sq_{z}": F.pow(F.col("v") - F.col(f"__mu_{z}"), F.lit(2.0)) for z in widths}))
    moved = moving_averages(moved, {f"__var_{z}": (f"__sq_{z}", w) for z, w in widths.items()}, keys)
    scored = {z: (F.col("v") - F.col(f"__mu_{z}")) / (F.sqrt(f"__var_{z}") + 1e-6) for z in widths}
    return moved.withColumns(scored).drop(*[f"__{part}_{z}" for z in widths for part in ("mu", "sq", "var")])


def lit_windows(df: DataFrame, width: int, need: int, keys: Sequence[str] = KEYS, lit: str = "lit") -> DataFrame:
    """df with lit_count over the width frames from each row on, full windows only, and whether it reaches need."""
    forward = chunked(df, keys, "frame", 0, width - 1, lambda w: {"lit_count": F.sum(lit).over(w.rowsBetween(0, width - 1)), "__size": F.count("*").over(w.rowsBetween(0, width - 1))})
    return forward.filter(F.col("__size") == width).drop("__size").withColumn("enough", F.col("lit_count") >= need)


def sustained_trim(df: DataFrame, width: int, need: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """For each key the first lit frame of the first window that is lit enough, and the last of the last one.

    window_start is the earlier form: that window's own first frame. Without such a window: the whole signal.
    """
    good = lit_windows(df, width, need, keys).filter("enough").groupBy(*keys).agg(F.min("frame").alias("window_start"), F.max("frame").alias("__late"))
    rows = df.join(good, list(keys), "left")
    lit = F.col("lit") == 1
    first = F.min(F.when(lit & (F.col("frame") >= F.col("window_start")), F.col("frame")))
    last = F.max(F.when(lit & (F.col("frame") <= F.col("__late") + width - 1), F.col("frame")))
    out = rows.groupBy(*keys).agg(first.alias("a"), last.alias("b"), F.max("frame").alias("__end"), F.max("window_start").alias("window_start"))
    return out.select(*keys, F.coalesce("a", F.lit(0)).cast("long").alias("a"), F.coalesce("b", "__end").cast("long").alias("b"), F.coalesce("window_start", F.lit(0)).cast("long").alias("window_start"))


def lagged(df: DataFrame, keys: Sequence[str] = KEYS, by: int = 1, v: str = "v", name: str = "before", frame: str = "frame") -> DataFrame:
    """df with the value `by` rows before."""
    return chunked(df, keys, frame, by, 0, lambda w: {name: F.lag(v, by).over(w)})


def local_peaks(df: DataFrame, keys: Sequence[str] = KEYS, v: str = "v", frame: str = "frame") -> DataFrame:
    """Rows above their left and not below their right neighbour; the ends are none."""
    near = chunked(df, keys, frame, 1, 1, lambda w: {"__l": F.lag(v).over(w), "__r": F.lead(v).over(w)})
    return near.filter((F.col(v) > F.col("__l")) & (F.col(v) >= F.col("__r"))).drop("__l", "__r")
