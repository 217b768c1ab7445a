"""Correlation, spectra and clock estimation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwave.operators.folds import folded, sampled
from tarnwave.operators.fourier import CELLS, lag_sums
from tarnwave.operators.order import with_stats
from tarnwave.sources.stage import staged

KEYS = ("lamp",)


def pair_correlation(signal: DataFrame, key: str = "lamp") -> DataFrame:
    """a, b, corr, n of all pairs of channels over the frames that both have.

    Sums of products come from one row for each frame (the channels of a rig at that frame), not from a join.
    """
    per = signal.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), "v"))).alias("x"))
    pairs = F.flatten(F.transform("x", lambda p: F.transform(F.filter("x", lambda q: q["key"] > p["key"]), lambda q: F.struct(p["key"].alias("a"), q["key"].alias("b"), p["v"].alias("va"), q["v"].alias("vb")))))
    return per.select(F.explode(pairs).alias("p")).select("p.*").groupBy("a", "b").agg(F.corr("va", "vb").alias("corr"), F.count("*").alias("n"))


def block_correlation(signal: DataFrame, key: str = "lamp", channels: int = 64, frames: int = 1024) -> DataFrame:
    """a, b, corr, n of all pairs of channels over the frames that both have, for many channels.

    Channels are dealt to blocks of about `channels` and frames to chunks; a task meets two blocks in one chunk, as two
    small tables whose products give its sums of all their pairs. Only sums of pairs are shuffled.
    """
    blocks = -(-signal.select(key).distinct().count() // channels) or 1
    rows = signal.select(F.col(key).alias("key"), "frame", F.col("v").cast("double").alias("v"))
    cells = rows.groupBy(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), F.floor(F.col("frame") / frames).alias("chunk")).agg(F.collect_list(F.struct("key", "frame", "v")).alias("rows"))
    cells = staged(cells, "cells")
    x, y = cells.select("chunk", F.col("block").alias("p"), F.col("rows").alias("x")), cells.select("chunk", F.col("block").alias("q"), F.col("rows").alias("y"))
    kind = signal.schema[key].dataType.simpleString()

    def table(rows: pa.Array, size: int) -> tuple[list, np.ndarray, np.ndarray]:
        cols = {c: rows.field(c) for c in ("key", "frame", "v")}
        names = cols["key"].dictionary_encode()
        at, frame = names.indices.to_numpy(zero_copy_only=False), cols["frame"].to_numpy() % size
        there, value = np.zeros((len(names.dictionary), size)), np.zeros((len(names.dictionary), size))
        there[at, frame], value[at, frame] = 1, cols["v"].to_numpy()
        return names.dictionary, there, value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (a, ta, va), (b, tb, vb) = (table(batch.column(c).slice(i, 1).flatten(), frames) for c in ("x", "y"))
                sums = {"n": ta @ tb.T, "sa": va @ tb.T, "sb": ta @ vb.T, "saa": (va * va) @ tb.T, "sbb": ta @ (vb * vb).T, "sab": va @ vb.T}
                j, k = np.nonzero(sums["n"])
                yield pa.RecordBatch.from_pydict({"a": a.take(pa.array(j)), "b": b.take(pa.array(k))} | {c: pa.array(s[j, k]) for c, s in sums.items()})

    got = x.join(y, "chunk").filter("p <= q").select("x", "y").mapInArrow(run, f"a {kind}, b {kind}, n double, sa double, sb double, saa double, sbb double, sab double")
    # within a block, and between blocks the other way round, each pair once
    two = got.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n", *[F.when(F.col("a") < F.col("b"), F.col(c)).otherwise(F.col(d)).alias(c) for c, d in (("sa", "sb"), ("sb", "sa"), ("saa", "sbb"), ("sbb", "saa"))], "sab", (F.col("a") < F.col("b")).alias("way"))
    s = two.groupBy("a", "b", "way").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    s = s.groupBy("a", "b").agg(*[F.first(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    n = F.col("n")
    spread = lambda q, t: F.col(q) - F.col(t) * F.col(t) / n
    corr = F.try_divide(F.col("sab") - F.col("sa") * F.col("sb") / n, F.sqrt(spread("saa", "sa") * spread("sbb", "sb")))
    return s.select("a", "b", corr.alias("corr"), n.cast("long").alias("n"))


def all_lags(bits: DataFrame, keys: Sequence[str] = KEYS, cells: int = CELLS) -> DataFrame:
    """keys, lag, s, n: the sum of products of bits (as -1 and 1) at every lag from 0 on, and the stream's length."""
    return lag_sums(bits, 2 * F.col("bit") - 1, keys, cells=cells, whole=True)


def all_lags_of(rows: DataFrame, value: str, keys: Sequence[str] = KEYS, cells: int = CELLS) -> DataFrame:
    """keys, lag, ac: autocorrelation of a value less its mean at every lag, over that at lag 0."""
    centred = with_stats(rows.select(*keys, "k", F.col(value).cast("double").alias("__v")), keys, __m=F.avg("__v"))
    sums = lag_sums(centred, F.col("__v") - F.col("__m"), keys, cells=cells)
    zero = centred.groupBy(*keys).agg(F.sum((F.col("__v") - F.col("__m")) * (F.col("__v") - F.col("__m"))).alias("__z"))
    return sums.join(zero, list(keys)).select(*keys, "lag", F.try_divide("s", "__z").alias("ac"))


def autocorrelation(bits: DataFrame, lags: Sequence[int], keys: Sequence[str] = KEYS, centre: bool = False, value: Column | None = None) -> DataFrame:
    """keys, lag, ac: sum of products at each lag over the sum at lag 0; bits as -1 and 1, or value less its mean."""
    x = (2 * F.col("bit") - 1).cast("double") if value is None else value
    rows = bits.select(*keys, "k", x.alias("x"))
    if centre:
        rows = rows.join(rows.groupBy(*keys).agg(F.avg("x").alias("__m")), list(keys)).select(*keys, "k", (F.col("x") - F.col("__m")).alias("x"))
    moved = rows.select(*keys, F.col("x").alias("y"), F.explode(F.array(*[F.struct(F.lit(v).cast("long").alias("lag"), (F.col("k") + v).alias("k")) for v in lags])).alias("__s")).select(*keys, "y", "__s.lag", "__s.k")
    zero = rows.groupBy(*keys).agg(F.sum(F.col("x") * F.col("x")).alias("__z"))
    sums = moved.join(rows, [*keys, "k"]).groupBy(*keys, "lag").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    return sums.join(zero, list(keys)).select(*keys, "lag", (F.col("s") / F.col("__z")).alias("ac"))


def grid_distance(at: Column, period: Column, phase: Column) -> Column:
    """How far a time lies from the nearest point of a grid."""
    r = (at - phase) / period
    return F.abs(r - F.rint(r)) * period


def period_grid(low: float, n: int, step: float) -> list[float]:
    """n periods from low on."""
    return [low + i * step for i in range(n)]


def of_period(sums: DataFrame, periods: Sequence[float]) -> DataFrame:
    """sums with the column period in place of its number i."""
    return sums.withColumn("period", F.element_at(F.array(*map(F.lit, periods)), F.col("i") + 1)).drop("i")


def grid_score(edges: DataFrame, periods: Sequence[float], phases: int, keys: Sequence[str] = KEYS, frame: str = "frame") -> DataFrame:
    """keys, period, score, better_pct: mean distance of edges to the best of so many grids of each period.

    Edges fold into `phases` bins of each period. Inside a bin the distance to any of the grids is linear, so a bin's
    count and sum of places are enough for all grids.
    """
    if phases % 2:
        raise ValueError("phases must be even, so that distances bend at borders of bins alone")
    p = np.array(periods)

    def fold(at: np.ndarray) -> np.ndarray:
        r = at[None, :].astype(float) / p[:, None]
        u = r - np.floor(r)
        cell = np.minimum((u * phases).astype(np.int64), phases - 1) + np.arange(len(p))[:, None] * phases
        return np.stack([np.bincount(cell.ravel(), w, len(p) * phases) for w in (None, u.ravel())], 1)

    bins = folded(edges, keys, [frame], ("c", "s"), len(p) * phases, fold)
    bins = bins.withColumns({"b": F.col("i") % phases, "i": F.floor(F.col("i") / phases).cast("int")})
    far = []
    for j in range(phases):
        sign = [1.0 if (b - j) % phases < phases // 2 else -1.0 for b in range(phases)]
        rest = [x * ((b < j) - j / phases) + (x < 0) for b, x in enumerate(sign)]
        of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("b") + 1)
        far.append(F.sum(F.col("c") * of(rest) + F.col("s") * of(sign)))
    means = of_period(bins.groupBy(*keys, "i").agg((F.least(*far) / F.sum("c")).alias("least")), periods)
    score = F.col("least") * F.col("period")
    return means.select(*keys, "period", score.alias("score"), ((F.col("period") / 4.0 - score) / (F.col("period") / 4.0) * 100).alias("better_pct"))


def concentration(edges: DataFrame, periods: Sequence[float], keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, period, r: length of the mean unit vector of the edges' phases."""
    p = np.array(periods)[:, None]

    def fold(at: np.ndarray) -> np.ndarray:
        a = 2 * np.pi * (np.mod(at[None, :].astype(float), p) / p)
        return np.stack([np.cos(a).sum(1), np.sin(a).sum(1), np.full(len(p), float(len(at)))], 1)

    sums = of_period(folded(edges, keys, ["frame"], ("x", "y", "n"), len(p), fold), periods)
    return sums.select(*keys, "period", (F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) / F.col("n")).alias("r"))


def gap_cost(gaps: DataFrame, periods: Sequence[float], keys: Sequence[str], gap: str = "gap") -> DataFrame:
    """keys, period, c: how far gaps lie from whole numbers of periods on average, in periods."""
    p = np.array(periods)[:, None]

    def fold(x: np.ndarray) -> np.ndarray:
        q = x[None, :].astype(float) / p
        return np.stack([np.abs(q - np.rint(q)).sum(1), np.full(len(p), float(len(x)))], 1)

    sums = of_period(folded(gaps, keys, [gap], ("s", "n"), len(p), fold), periods)
    return sums.select(*keys, "period", (F.col("s") / F.col("n")).alias("c"))


def sampled_mean(rows: DataFrame, settings: Sequence[tuple[float, float]], value: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, i (of the setting), mean: of value over the frames nearest to first + k * period, for settings (first, period).

    rows: keys, frame, n (frames of the key).
    """
    first, period = (np.array(x) for x in zip(*settings, strict=True))

    def fold(frame: np.ndarray, n: np.ndarray, x: np.ndarray) -> np.ndarray:
        there = sampled(frame, n, first, period)
        return np.stack([there @ x, there.sum(1).astype(float)], 1)

    sums = folded(rows.withColumn("__x", value.cast("double")), keys, ["frame", "n", "__x"], ("s", "c"), len(settings), fold)
    return sums.select(*keys, "i", F.try_divide("s", "c").alias("mean"))


def spectrum(signal: DataFrame, size: int, keys: Sequence[str]) -> DataFrame:
    """keys, bin, power: squared Hann-windowed Fourier sums of segments of `size` frames (column i within a segment).

    Short segments: bins and frames are crossed inside each row and summed before they are shuffled.
    """
    hann = 0.5 - 0.5 * F.cos(F.lit(6.283185307179586) * F.col("i") / (size - 1))
    rows = signal.select(*keys, "i", (F.col("x") * hann).alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size // 2).cast("long"))).alias("bin"))
    a = F.lit(6.283185307179586) * F.pmod(F.col("i") * F.col("bin"), F.lit(size)) / size
    return rows.groupBy(*keys, "bin").agg((F.pow(F.sum(F.col("x") * F.cos(a)), F.lit(2.0)) + F.pow(F.sum(F.col("x") * F.sin(a)), F.lit(2.0))).alias("power"))
