"""Thresholds and decision state over signals (keys, frame, v)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tarnwave.operators.order import CHUNK, carried, fetched, numbered, small, with_stats
from tarnwave.sources.stage import staged

KEYS = ("lamp",)


def quantiles(df: DataFrame, keys: Sequence[str], v: str, accuracy: int = 100_000, gathered: int = 4_000_000, also: dict[str, Column] | None = None, **shares: float) -> DataFrame:
    """Exact quantiles (linear between ranks) of each key, one column for each share; keys without values have none.

    also: further aggregates of the key's rows, by name, which come out of the same pass.

    A sketch brackets each rank by values some 8 / accuracy of the key's rows apart; the rows below a bracket are
    counted, and only those strictly inside are gathered and sorted (so ties, however many, are not). Where a bracket would hold more than `gathered` rows, ranks
    come from a distributed sort instead.
    """
    at = {name: F.lit(float(p)) for name, p in shares.items()}
    width = 4 / accuracy
    asked = [x for p in shares.values() for x in (max(0.0, p - width), min(1.0, p + width))]
    also = also or {}
    rows = df.withColumn("__v", F.col(v))
    sketch = rows.groupBy(*keys).agg(F.percentile_approx("__v", asked, accuracy).alias("__b"), F.count("__v").alias("__n")).filter("__n > 0")
    table = fetched(sketch)
    sketch = staged(sketch, "sketch") if table is None else F.broadcast(df.sparkSession.createDataFrame(table, sketch.schema))
    most = (sketch.agg(F.max("__n")).first()[0] if table is None else pc.max(table["__n"]).as_py()) or 0
    if most * 2 * width > gathered:
        exact = sorted_quantiles(df, keys, v, **shares)
        return exact.join(df.groupBy(*keys).agg(*[c.alias(name) for name, c in also.items()]), list(keys)) if also else exact
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    both = rows.alias("r").join(sketch.alias("s"), same)
    parts, x = [F.first("__n").alias("__n")], F.col("__v")
    for i, name in enumerate(shares):
        lo, hi = F.col("__b")[2 * i], F.col("__b")[2 * i + 1]
        # ties with a bracket's ends are counted; with the neighbours outside, as a rank may lie between a bracket and the next value
        here = {"lo": F.first(lo), "hi": F.first(hi), "below": F.count_if(x < lo), "at_lo": F.count_if(x == lo), "at_hi": F.count_if((x == hi) & (hi > lo)), "inside": F.sort_array(F.collect_list(F.when((x > lo) & (x < hi), x))), "under": F.max(F.when(x < lo, x)), "over": F.min(F.when(x > hi, x))}
        parts.append(F.struct(*[c.alias(n) for n, c in here.items()]).alias(f"__of_{name}"))
    got = both.groupBy(*[F.col(f"r.{k}").alias(k) for k in keys]).agg(*parts, *[c.alias(name) for name, c in also.items()])

    def value(name: str) -> Column:
        place, b = at[name] * (F.col("__n") - 1), F.col(f"__of_{name}")
        m = F.size(b["inside"])

        def ranked(rank: Column) -> Column:
            i = (rank - b["below"] - b["at_lo"]).cast("int")
            found = F.when(rank == b["below"] - 1, b["under"]).when((rank >= b["below"]) & (i < 0), b["lo"]).when((i >= 0) & (i < m), F.get(b["inside"], i))
            found = found.when((i >= m) & (i < m + b["at_hi"]), b["hi"]).when(i == m + b["at_hi"], b["over"])
            return F.coalesce(found, F.raise_error(F.lit("a rank lies outside its bracket")).cast("double"))

        low, high = ranked(F.floor(place)), ranked(F.ceil(place))
        return (low + (high - low) * (place - F.floor(place))).alias(name)

    return got.select(*keys, *[value(name) for name in shares], *also)


def sorted_quantiles(df: DataFrame, keys: Sequence[str], v: str, **shares: float) -> DataFrame:
    """The same from a distributed sort, so one large key is no single task's work; ties make no difference."""
    n, at = "__n", "__rank"
    ranked = numbered(df.select(*keys, v).filter(F.col(v).isNotNull()), keys, [v], at)
    sized = ranked.join(df.groupBy(*keys).agg(F.count(v).alias(n)), list(keys))
    out = []
    for name, p in shares.items():
        place = F.lit(float(p)) * (F.col(n) - 1)
        low = F.max(F.when(F.col(at) == F.floor(place), F.col(v)))
        high = F.max(F.when(F.col(at) == F.ceil(place), F.col(v)))
        part = F.first(place - F.floor(place))
        out.append((low + (high - low) * part).alias(name))
    return sized.groupBy(*keys).agg(*out)


def fixed(df: DataFrame, low: float = 0.1, high: float = 0.9, keys: Sequence[str] = KEYS) -> DataFrame:
    """df with thr (the middle between two quantiles of its key), n (its frames) and span (max less min).

    One small table of the keys' figures meets the rows; it is sent to all executors where its size allows.
    """
    return with_levels(df, small(levels(df, low, high, keys)), keys)


def levels(df: DataFrame, low: float = 0.1, high: float = 0.9, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, thr, n, span: the figures of fixed, one row for each key."""
    q = quantiles(df, keys, "v", also={"n": F.count("*"), "span": F.max("v") - F.min("v")}, __lo=low, __hi=high)
    return q.select(*keys, ((F.col("__lo") + F.col("__hi")) / 2).alias("thr"), "n", "span")


def with_levels(df: DataFrame, figures: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """df with the figures of its keys."""
    return df.drop("n", "span").join(figures, list(keys))


def middle(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """df with thr_mid, (min + max) / 2, and thr_mean."""
    return with_stats(df, keys, thr_mid=(F.min("v") + F.max("v")) / 2, thr_mean=F.avg("v"))


def moving_quantiles(df: DataFrame, window: int, shares: dict[str, float], quarter: bool = True, odd: bool = False, keys: Sequence[str] = KEYS, chunk: int = CHUNK) -> DataFrame:
    """df with one column for each share: quantiles over a moving window at knots, linear between them.

    The window is min(window, max(51, n // 4)) frames if quarter, else window; odd makes it odd. Knots stand every
    max(1, w // 8) frames; windows see the edge value repeated; beyond the last knot its value holds.

    A chunk of frames comes together with what its windows see beyond its ends (some `window` frames a side), so there
    is one exchange, of hardly more than the table. Inside, blocks of frames are sorted once, and a window merges its
    sorted blocks with the few frames at its ends.
    """
    size = small(df.groupBy(*keys).agg(F.count("*").alias("__n")))
    own, far = [f"__own_{k}" for k in keys], window + window // 8 + 2
    same = [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)]
    rows = df.join(size.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], "__n"), same).drop(*own)
    near = F.sequence(F.greatest(F.lit(0), F.floor((F.col("frame") - far) / chunk)), F.least(F.floor((F.col("__n") - 1) / chunk), F.floor((F.col("frame") + far) / chunk)))
    rows = rows.withColumn("__c", F.explode(near))
    names, kept = list(shares), list(df.columns)

    def run(table: pa.Table) -> pa.Table:
        n, c = table["__n"][0].as_py(), table["__c"][0].as_py()
        w = min(window, max(51, n // 4)) if quarter else window
        w |= int(odd)
        step, half = max(1, w // 8), w // 2
        table = table.take(np.argsort(table["frame"].to_numpy(), kind="stable"))
        frame, v = table["frame"].to_numpy(), table["v"].to_numpy().astype(float)
        first = frame[0]
        inside = np.flatnonzero((frame >= c * chunk) & (frame < (c + 1) * chunk))
        knots = np.arange(frame[inside[0]] // step, min(frame[inside[-1]] // step + 1, (n - 1) // step) + 1)
        blocks = {}

        def sorted_block(i: int) -> np.ndarray:
            if i not in blocks:
                blocks[i] = np.sort(v[i * step : (i + 1) * step])
            return blocks[i]

        at = np.empty((len(knots), len(names)))
        ranks = np.array([shares[x] for x in names]) * (w - 1)
        low = np.floor(ranks).astype(np.int64)
        for i, knot in enumerate(knots.tolist()):
            begin, end = knot * step - half, knot * step - half + w  # end not included
            a, b = max(begin, 0) - first, min(end, n) - first
            lo, hi = -(-a // step), b // step
            parts = [np.repeat(v[:1], max(0, -begin)), np.repeat(v[-1:], max(0, end - n))]
            parts += [v[a : lo * step], *map(sorted_block, range(lo, hi)), v[hi * step : b]] if lo < hi else [v[a:b]]
            seen = np.sort(np.concatenate(parts), kind="stable")  # merges the runs it finds
            at[i] = seen[low] + (seen[np.minimum(low + 1, w - 1)] - seen[low]) * (ranks - low)
            blocks.pop(lo - 1, None)
        k = frame[inside] // step - knots[0]
        after = np.minimum(k + 1, len(knots) - 1)
        part = ((frame[inside] % step) / step)[:, None]
        values = at[k] + (at[after] - at[k]) * part
        out = table.take(inside).select(kept)
        for j, x in enumerate(names):
            out = out.append_column(x, pa.array(values[:, j]))
        return out

    kinds = StructType([*df.schema.fields, *(StructField(x, DoubleType()) for x in names)])
    return rows.groupBy(*keys, "__c").applyInArrow(run, kinds)


def adaptive(df: DataFrame, window: int = 2600, low: float = 0.1, high: float = 0.9, odd: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """df with thr: the middle of two moving quantiles."""
    moved = moving_quantiles(df, window, {"__lo": low, "__hi": high}, odd=odd, keys=keys)
    return moved.withColumn("thr", (F.col("__lo") + F.col("__hi")) / 2).drop("__lo", "__hi")


def local_normal(df: DataFrame, window: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """df with scaled: v between its moving 5 % and 95 % quantiles, as 0 to 255."""
    moved = moving_quantiles(df, window, {"__lo": 0.05, "__hi": 0.95}, quarter=False, odd=True, keys=keys)
    return moved.withColumn("scaled", (F.col("v") - F.col("__lo")) / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-6)) * 255.0).drop("__lo", "__hi")


def schmitt(df: DataFrame, thr: Column, band: Column, keys: Sequence[str] = KEYS, name: str = "state", v: str = "v", frame: str = "frame", start: Column | None = None) -> DataFrame:
    """df with a hysteresis state: 1 above thr + band, 0 below thr - band, else as before; at first, v > thr."""
    decided = F.when(F.col(v) > thr + band, 1).when(F.col(v) < thr - band, 0)
    firsts = start if start is not None else F.when(F.col(frame) == 0, F.when(F.col(v) > thr, 1).otherwise(0))
    return carried(df, keys, frame, F.coalesce(decided, firsts), name).withColumn(name, F.col(name).cast("long"))


def two_groups(rows: DataFrame, key: str = "lamp") -> DataFrame:
    """key, threshold_bin, threshold, separation. rows: key, v, and the key's lo, hi, n. A split that leaves a group fewer
    than two values gives way to the midpoint; the spread is 0.5 at least. The largest value is in bin 255.
    """
    h = rows.groupBy(key, "lo", "hi", "n", (F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * 255).cast("long").alias("bin")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(key).orderBy("bin")  # 256 bins at most
    h = h.withColumns({"w0": F.sum("c").over(w), "m0": F.sum(F.col("c") * F.col("bin")).over(w), "mt": F.sum(F.col("c") * F.col("bin")).over(Window.partitionBy(key))})
    rest = F.col("n") - F.col("w0")
    between = F.when(rest > 0, F.col("w0") * rest * F.pow(F.col("m0") / F.col("w0") - F.try_divide(F.col("mt") - F.col("m0"), rest), 2) / (F.col("n").cast("double") * F.col("n"))).otherwise(0.0)
    best = h.withColumn("b", F.round(between, 6)).groupBy(key, "lo", "hi").agg(F.max_by("bin", F.struct("b", -F.col("bin"))).alias("threshold_bin"))
    best = small(best.select(key, "threshold_bin", (F.col("lo") + F.col("threshold_bin") / F.lit(255.0) * (F.col("hi") - F.col("lo"))).alias("t1"), ((F.col("lo") + F.col("hi")) / 2).alias("t2")))
    split = rows.select(key, "v").join(best, key)
    sums = []
    for i in (1, 2):
        low, high = F.when(F.col("v") <= F.col(f"t{i}"), F.col("v")), F.when(F.col("v") > F.col(f"t{i}"), F.col("v"))
        far = F.abs(F.avg(high) - F.avg(low)) / F.greatest(F.sqrt((F.var_pop(low) + F.var_pop(high)) / 2), F.lit(0.5))
        sums.append(F.when((F.count(low) >= 2) & (F.count(high) >= 2), far).alias(f"s{i}"))
    got = split.groupBy(key, "threshold_bin", "t1", "t2").agg(*sums)
    return got.select(key, "threshold_bin", F.when(F.col("s1").isNotNull(), F.col("t1")).otherwise(F.col("t2")).alias("threshold"), F.coalesce("s1", "s2", F.lit(0.0)).alias("separation"))
