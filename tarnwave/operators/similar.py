"""Signals that go up and down alike, and frames whose hashes are near, found through lossless indexes.

Two signals are compared over the frames of the shorter one. Which pairs of lengths meet is known, so each signal enters
the few levels of length in which a partner may stop. There, the first L frames are told by their leading coefficients of
an orthonormal cosine transform (the constant left out), scaled to length 1. If two signals correlate by t over m frames,
what one misses of the other's best line over the first L of them is no more than over all m, so

    1 - corr(L)^2 <= (1 - t^2) * S(m) / S(L)        S: squared deviations from the mean, growing with the frames

for either signal, and the distance of their coefficients is at most sqrt(2 - 2 sqrt(that)). Each signal so has a
radius of its own. It lies in one cell of a grid over the first two coefficients and asks in all cells that its radius
touches; those who meet there and lie within both radii are candidates, and only these are compared frame by frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwave.operators.order import numbered, small
from tarnwave.sources.stage import staged

#: Sums lose some digits; distances are allowed that much more.
SLIP = 1e-6
#: Hashes of a block at most.
BLOCK = 1 << 14
#: Share of all hashes that an index may bring before each one; where it is more, comparing all pairs in blocks costs less.
WORTH = 0.01
#: Values of a cell of signals at most, bytes of cells that a task holds of either side, and correlations that it holds at once.
ROOM, PART, SLICE = 1 << 19, 1 << 24, 1 << 18


def level_of(n: Column, least: int, share: float) -> Column:
    """The level of a length: levels begin at least * (1 + share) ^ level, rounded up."""
    guess = F.floor(F.log(n / float(least)) / F.log(F.lit(1.0 + share)))
    # the logarithm may be off by one at a level's edge
    up = F.when(level_start(guess + 1, least, share) <= n, guess + 1).otherwise(guess)
    return F.when(level_start(up, least, share) > n, up - 1).otherwise(up).cast("long")


def level_start(level: Column, least: int, share: float) -> Column:
    return F.ceil(F.lit(float(least)) * F.pow(F.lit(1.0 + share), level)).cast("long")


def sketches(signal: DataFrame, key: str, corr: float, least: int, share: float, few: int, coefficients: int) -> DataFrame:
    """key, level, r2 (squared radius), f1, f2, ... of each signal in each level that it takes part in."""
    n = small(signal.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).filter(F.col("n") >= least))
    shortest = F.greatest(F.lit(least), F.least(F.col("n") - few, F.ceil(F.col("n") / (1.0 + share)) - 1))
    # levels of less than one frame hold no length
    levels = n.select("key", "n", F.explode(F.sequence(level_of(shortest, least, share), level_of(F.col("n"), least, share))).alias("level"))
    first, after = level_start(F.col("level"), least, share), level_start(F.col("level") + 1, least, share)
    levels = levels.select("key", "level", first.alias("l"), F.least("n", after - 1).alias("m")).filter("m >= l")
    near = levels.groupBy("key").agg(F.collect_list(F.struct("level", "l", "m")).alias("levels"))
    rows = signal.select(F.col(key).alias("key"), "frame", F.col("v").cast("double").alias("v")).join(small(near), "key")
    rows = rows.select("key", "frame", "v", F.explode("levels").alias("at")).filter(F.col("frame") < F.col("at.m"))
    inside = F.col("frame") < F.col("at.l")
    angle = F.lit(3.141592653589793) * (F.col("frame") + 0.5) / F.col("at.l")
    sums = {"s1": F.sum("v"), "s2": F.sum(F.col("v") * F.col("v")), "n": F.count("*"), "p1": F.sum(F.when(inside, F.col("v"))), "p2": F.sum(F.when(inside, F.col("v") * F.col("v")))}
    sums |= {f"c{i}": F.sum(F.when(inside, F.col("v") * F.cos(angle * i))) for i in range(1, coefficients + 1)}
    got = rows.groupBy("key", F.col("at.level").alias("level"), F.col("at.l").alias("l")).agg(*[c.alias(k) for k, c in sums.items()])
    whole, start = F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.col("p2") - F.col("p1") * F.col("p1") / F.col("l")
    # a flat start says nothing about the rest
    told = start > 1e-9 * F.greatest(whole, F.lit(1e-300)) + 1e-12 * F.col("p2")
    missed = F.when(told, (1 - corr * corr) * whole / start)
    r2 = F.when(missed < 1, 2 - 2 * F.sqrt(1 - missed) + SLIP).otherwise(4.0)
    scale = F.when(told, F.sqrt(2 / F.col("l")) / F.sqrt(start)).otherwise(0.0)
    return got.select("key", "level", r2.alias("r2"), *[(F.col(f"c{i}") * scale).alias(f"f{i}") for i in range(1, coefficients + 1)])


def candidates(signal: DataFrame, key: str = "lamp", corr: float = 0.98, least: int = 20, share: float = 0.05, few: int = 3, coefficients: int = 16) -> DataFrame:
    """Pairs a < b that may correlate by more than corr over the shorter one's frames; no such pair is missing."""
    points = staged(sketches(signal, key, corr, least, share, few, coefficients), "sketches")
    width = 0.25
    home = points.select("level", *[F.floor(F.col(f"f{i}") / width).alias(f"x{i}") for i in (1, 2)], F.col("key").alias("b"), F.col("r2").alias("r2b"), *[F.col(f"f{i}").alias(f"g{i}") for i in range(1, coefficients + 1)])
    reach = F.sqrt("r2")
    cells = [F.explode(F.sequence(F.floor((F.col(f"f{i}") - reach) / width), F.floor((F.col(f"f{i}") + reach) / width))).alias(f"x{i}") for i in (1, 2)]
    asked = points.withColumn("x1", cells[0]).withColumn("x2", cells[1]).withColumnRenamed("key", "a")
    far = reduce(Column.__add__, [(F.col(f"f{i}") - F.col(f"g{i}")) * (F.col(f"f{i}") - F.col(f"g{i}")) for i in range(1, coefficients + 1)])
    # one cell may hold many signals: Spark splits it, and pairs that don't lie within both radii never leave the join
    met = asked.join(home, ["level", "x1", "x2"]).filter((F.col("a") < F.col("b")) & (far <= F.least("r2", "r2b")))
    return met.select("a", "b").distinct()


def near_signals(signal: DataFrame, key: str = "lamp", corr: float = 0.98, least: int = 20, share: float = 0.05, few: int = 3, coefficients: int = 16) -> DataFrame:
    """a, b, corr, n: pairs of signals (a < b) that correlate by more than corr over the n frames of the shorter one.

    Signals have frames from 0 on without gaps. Pairs need `least` frames, lengths that differ by `few` frames or by
    `share` of the shorter one at most, and values that vary. Null keys are left out.
    """
    rows = staged(signal.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col("frame").cast("long").alias("frame"), F.col("v").cast("double").alias("v")), "signals")
    pairs = staged(candidates(rows, "key", corr, least, share, few, coefficients), "pairs")
    n = rows.groupBy("key").agg(F.count("*").alias("n"))
    known = lambda side: n.select(F.col("key").alias(side), F.col("n").alias(f"n{side}"))
    fit = pairs.join(known("a"), "a").join(known("b"), "b").filter(F.abs(F.col("na") - F.col("nb")) <= F.greatest(F.lit(float(few)), share * F.least("na", "nb")))
    x = fit.select("a", "b").join(rows.select(F.col("key").alias("a"), "frame", F.col("v").alias("va")), "a")
    both = x.join(rows.select(F.col("key").alias("b"), "frame", F.col("v").alias("vb")), ["b", "frame"])
    out = both.groupBy("a", "b").agg(F.covar_pop("va", "vb").alias("sab"), F.count("*").alias("n"), F.stddev_pop("va").alias("sa"), F.stddev_pop("vb").alias("sb"))
    out = out.withColumn("corr", F.try_divide("sab", F.col("sa") * F.col("sb")))
    return out.filter((F.col("corr") > corr) & (F.col("sa") >= 1e-9) & (F.col("sb") >= 1e-9)).select("a", "b", "corr", "n")


def correlated_signals(signal: DataFrame, key: str = "lamp", corr: float = 0.3, least: int = 20, share: float = 0.05, few: int = 3, channels: int = 1024, frames: int = 1 << 14) -> DataFrame:
    """The pairs of near_signals for a corr that is too low for its index to tell pairs apart: all pairs whose lengths
    fit are compared, in blocks of signals of like length. A null value counts as a frame, but not for mean and deviation
    of its signal; the covariance is over the frames where both have a value.

    Signals are sorted by length and dealt to blocks of up to `channels` signals and ROOM values, which are packed once, in
    cells of `frames` frames. Cells are dealt to parts, and each pair of parts is read by one task: nothing is shuffled for
    each pair of blocks or signals but the sums of signals that are both longer than a cell.
    """
    kind = signal.schema[key].dataType.simpleString()
    rows = signal.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col("frame").cast("long").alias("frame"), F.col("v").cast("double").alias("v"))
    values = F.sort_array(F.collect_list(F.struct("frame", "v")))["v"]
    held = staged(rows.groupBy("key", F.floor(F.col("frame") / frames).alias("chunk")).agg(values.alias("values"), F.sum("v").alias("s"), F.count("v").alias("told")), "signals")
    sizes = held.groupBy("key").agg(F.sum(F.size("values")).alias("n"), F.try_divide(F.sum("s"), F.sum("told")).alias("mean")).filter(F.col("n") >= least)
    # signals of a level have as many binary digits in their length, so they differ by less than twice
    placed = numbered(sizes.withColumn("level", F.length(F.bin(F.least("n", F.lit(frames))))), ["level"], ["n", "key"], "place")
    room = F.greatest(F.lit(1), F.least(F.lit(channels), F.floor(ROOM / F.pow(F.lit(2.0), "level"))))
    placed = staged(placed.select("key", "n", "mean", (F.col("level").cast("long") * (1 << 40) + F.floor(F.col("place") / room)).alias("block")), "places")
    dealt = held.join(small(placed), "key").select("block", "chunk", "key", "n", "mean", "values")
    cells = dealt.groupBy("block", "chunk").applyInArrow(cell, f"block long, chunk long, low long, high long, keys array<{kind}>, n array<long>, means array<double>, samples binary, nulls binary")
    cells = staged(cells, "cells")
    fit = F.col("low_q") - F.col("high_p") <= F.greatest(F.lit(float(few)), share * F.col("high_p"))

    def met(cells: DataFrame) -> DataFrame:
        """p, q, chunk, x, y: all pairs of cells of a chunk whose lengths may fit, p's signals not longer than q's."""
        n, size = cells.agg(F.count("*"), F.sum(F.length("samples"))).first()
        parts = max(1, min(n, 2 * isqrt(cells.sparkSession.sparkContext.defaultParallelism)), -(-(size or 0) // PART))
        side = lambda s, name: cells.repartition(parts).select(F.col("block").alias(s), F.col("chunk").alias(f"chunk_{s}"), F.col("low").alias(f"low_{s}"), F.col("high").alias(f"high_{s}"), F.struct("keys", "n", "means", "samples", "nulls").alias(name))
        return side("p", "x").hint("shuffle_replicate_nl").join(side("q", "y"), (F.col("p") <= F.col("q")) & (F.col("chunk_p") == F.col("chunk_q")) & fit)

    def run(batches: Iterator[pa.RecordBatch], compared: Callable) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                p, q, chunk, x, y = (batch.column(c)[i] for c in ("p", "q", "chunk_p", "x", "y"))
                with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                    a, b = opened(x, chunk.as_py(), frames), opened(y, chunk.as_py(), frames)
                    for j, k, figures in compared(a, b, p == q):
                        yield pa.RecordBatch.from_pydict({"a": x["keys"].values.take(pa.array(j)), "b": y["keys"].values.take(pa.array(k))} | {c: pa.array(s) for c, s in figures.items()})

    short = lambda batches: run(batches, lambda a, b, same: correlations(a, b, same, corr, share, few, frames))
    long = lambda batches: run(batches, lambda a, b, same: sums(a, b, same, share, few, frames))
    out = met(cells.filter("chunk = 0")).filter(F.col("low_p") <= frames).mapInArrow(short, f"a {kind}, b {kind}, corr double, n long")
    longer = cells.filter(F.col("high") > frames)
    if not longer.isEmpty():
        names = ("both", "sa", "sb", "sab", "na", "ta", "taa", "nb", "tb", "tbb")
        s = met(longer).mapInArrow(long, f"a {kind}, b {kind}, n long, {', '.join(f'{c} double' for c in names)}").groupBy("a", "b", "n").agg(*[F.sum(c).alias(c) for c in names])
        spread = lambda n, t, tt: F.sqrt(F.greatest(F.try_divide(F.col(tt) - F.try_divide(F.col(t) * F.col(t), n), n), F.lit(0.0)))
        s = s.withColumns({"da": spread(F.col("na"), "ta", "taa"), "db": spread(F.col("nb"), "tb", "tbb")}).filter("da >= 1e-9 AND db >= 1e-9")
        s = s.withColumn("corr", F.try_divide(F.try_divide(F.col("sab") - F.try_divide(F.col("sa") * F.col("sb"), "both"), F.col("both")), F.col("da") * F.col("db")))
        out = out.unionByName(s.filter((F.col("corr") > corr) & ~F.isnan("corr")).select("a", "b", "corr", "n"))
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "corr", "n")


def cell(group: pa.Table) -> pa.Table:
    """A block's signals in one chunk, by length and key, as one row: their values as bytes, and a bit for each null if there is one."""
    group = group.sort_by([("n", "ascending"), ("key", "ascending")])
    key, n, mean, values = (pa.concat_arrays(group[c].chunks) for c in ("key", "n", "mean", "values"))
    values, listed = values.flatten(), lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    null = values.is_null().to_numpy(zero_copy_only=False)
    row = {"block": group["block"][:1], "chunk": group["chunk"][:1], "low": n[:1], "high": n[-1:], "keys": listed(key), "n": listed(n), "means": listed(mean)}
    bits = np.packbits(null).tobytes() if null.any() else None
    return pa.table(row | {"samples": pa.array([values.fill_null(0.0).to_numpy().tobytes()], pa.binary()), "nulls": pa.array([bits], pa.binary())})


@dataclass
class Opened:
    """A cell's signals as rows: lengths, means, values (0 where there is none), where a frame is, where it has a value."""

    n: np.ndarray
    mean: np.ndarray
    value: np.ndarray
    there: np.ndarray
    told: np.ndarray
    gaps: bool


def opened(row: pa.StructScalar, chunk: int, frames: int) -> Opened:
    n, mean = row["n"].values.to_numpy(), row["means"].values.to_numpy(zero_copy_only=False)
    held = np.clip(n - chunk * frames, 0, frames)
    there = np.arange(held.max()) < held[:, None]
    value, told, gaps = np.zeros(there.shape), there, row["nulls"].is_valid
    value[there] = np.frombuffer(row["samples"].as_buffer())
    if gaps:
        told = there.copy()
        told[there] = np.unpackbits(np.frombuffer(row["nulls"].as_buffer(), np.uint8), count=held.sum()) == 0
    return Opened(n, mean, value, there, told, gaps)


def scaled(value: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Rows less their mean, by their standard deviation; NaN where that is too small."""
    n = told.sum(1, keepdims=True)
    off = np.where(told, value - value.sum(1, keepdims=True) / n, 0.0)
    deviation = np.sqrt((off * off).sum(1, keepdims=True) / n)
    return off / np.where(deviation >= 1e-9, deviation, np.nan)


def correlations(a: Opened, b: Opened, same: bool, corr: float, share: float, few: int, frames: int) -> Iterator[tuple[np.ndarray, np.ndarray, dict]]:
    """Pairs of a's signals of up to `frames` frames with b's, which aren't shorter, above corr; same: a is b, each pair once."""
    for m in np.unique(a.n[a.n <= frames]):
        first, last = np.searchsorted(a.n, (m, m + 1))
        # b is sorted by length, and in the same block those before are done
        begin, end = first if same else 0, np.searchsorted(b.n - m, max(float(few), share * m), "right")
        if begin >= end:
            continue
        there = b.told[begin:end, :m]
        y = scaled(b.value[begin:end, :m], there)
        step = max(1, SLICE // len(y))
        for i in range(first, last, step):
            here = a.told[i : min(i + step, last), :m]
            x = scaled(a.value[i : i + len(here), :m], here)
            if a.gaps or b.gaps:
                u, v = here.astype(float), there.astype(float)
                both = u @ v.T
                c = (x @ y.T - (x @ v.T) * (u @ y.T) / both) / both
            else:
                c = (x / m) @ y.T
            j, k = np.divmod(np.flatnonzero(c > corr), len(y))
            if same:
                once = begin + k > i + j
                j, k = j[once], k[once]
            if len(j):
                yield i + j, begin + k, {"corr": c[j, k], "n": np.full(len(j), m)}


def sums(a: Opened, b: Opened, same: bool, share: float, few: int, frames: int) -> Iterator[tuple[np.ndarray, np.ndarray, dict]]:
    """One chunk's sums for pairs of signals that are both longer than `frames`; same: a is b, each pair once."""
    m = np.minimum(a.n[:, None], b.n)
    ok = (m > frames) & (np.abs(a.n[:, None] - b.n) <= np.maximum(float(few), share * m))
    if same:
        ok &= np.triu(np.ones(ok.shape, bool), 1)
    j, k = np.nonzero(ok)
    if not len(j):
        return
    width = min(a.there.shape[1], b.there.shape[1])
    # values less their signal's mean: sums of squares keep their digits
    (u, ha, va), (w, hb, vb) = ((s.told[:, :width].astype(float), s.there[:, :width].astype(float), np.where(s.told, s.value - np.nan_to_num(s.mean, nan=0.0, posinf=0.0, neginf=0.0)[:, None], 0.0)[:, :width]) for s in (a, b))
    got = {"both": u @ w.T, "sa": va @ w.T, "sb": u @ vb.T, "sab": va @ vb.T}
    got |= {"na": u @ hb.T, "ta": va @ hb.T, "taa": (va * va) @ hb.T, "nb": ha @ w.T, "tb": ha @ vb.T, "tbb": ha @ (vb * vb).T}
    yield j, k, {"n": m[j, k]} | {c: s[j, k] for c, s in got.items()}


def near_hashes(frames: DataFrame, radius: int, bands: int = 4, hash_: str = "hash", key: str = "frame") -> tuple[DataFrame, DataFrame]:
    """Hashes of 64 bits (longs) that differ in `radius` bits at most, anywhere in the table.

    By the pigeonhole principle, two such hashes differ in radius // bands bits at most in at least one of so many bands.
    So each hash is filed under the value of each band, and asks under all values that near its own. Where it would meet
    more than WORTH of all hashes that way (a large radius), blocks of hashes are compared as a whole instead. No pair is
    lost either way. Equal hashes are one class from the start, however many frames share one.

    Returns pairs (a, b, distance: hashes, a < b) and members (hash, frames, first: their number and smallest key). Null
    hashes are left out.
    """
    if bands < 1 or 64 % bands or radius // bands > 2:
        raise ValueError("64 bits must divide into the bands, and a band may differ in 2 bits at most")
    members = staged(frames.filter(F.col(hash_).isNotNull()).groupBy(F.col(hash_).alias("hash")).agg(F.count("*").alias("frames"), F.min(key).alias("first")), "hashes")
    width, slips = 64 // bands, radius // bands
    if bands * sum(comb(width, n) for n in range(slips + 1)) > WORTH * 2**width:
        return pairs_by_blocks(members, radius), members
    return pairs_by_bands(members, radius, bands), members


def pairs_by_bands(members: DataFrame, radius: int, bands: int) -> DataFrame:
    """The pairs of near_hashes by an index of bands."""
    width, slips = 64 // bands, radius // bands
    full = (1 << width) - 1
    flips = [sum(1 << i for i in at) for n in range(slips + 1) for at in combinations(range(width), n)]
    value = [F.shiftrightunsigned("hash", i * width).bitwiseAND(F.lit(full)) for i in range(bands)]
    filed = members.select(F.col("hash").alias("b"), F.posexplode(F.array(*value)).alias("band", "value"))
    asks = F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), lambda x: x.bitwiseXOR(F.col("own")))
    asked = members.select(F.col("hash").alias("a"), F.posexplode(F.array(*value)).alias("band", "own")).select("a", "band", F.explode(asks).alias("value"))
    met = asked.join(filed, ["band", "value"]).filter("a < b").withColumn("distance", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))))
    # a pair may meet in several bands: the first band that is near enough keeps it
    near = [F.bit_count(F.shiftrightunsigned(F.col("a").bitwiseXOR(F.col("b")), i * width).bitwiseAND(F.lit(full))) <= slips for i in range(bands)]
    first = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(near)])
    return met.filter((F.col("distance") <= radius) & (F.col("band") == first)).select("a", "b", F.col("distance").cast("long").alias("distance"))


def pairs_by_blocks(members: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """The pairs of near_hashes by all comparisons: hashes are dealt to blocks, and a task holds two of them at a time."""
    spark, n = members.sparkSession, members.count()
    blocks = max(1, -(-n // block), min(16, n // 1024))
    # two blocks are a row of up to 16 * BLOCK bytes
    parts = max(4 * spark.sparkContext.defaultParallelism, blocks * (blocks + 1) // 128)
    at = F.pmod(F.xxhash64("hash"), F.lit(blocks)).cast("int")
    cells = staged(members.groupBy(at.alias("own")).agg(F.collect_list("hash").alias("hashes")), "blocks")
    x = cells.select(F.col("own").alias("p"), F.explode(F.sequence(F.col("own"), F.lit(blocks - 1))).alias("q"), F.col("hashes").alias("x"))
    y = cells.select(F.explode(F.sequence(F.lit(0), F.col("own"))).alias("p"), F.col("own").alias("q"), F.col("hashes").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                same = batch.column(0)[i] == batch.column(1)[i]
                a, b = (np.sort(batch.column(c).slice(i, 1).flatten().to_numpy()) for c in (2, 3))
                rows = max(1, (1 << 15) // len(b))  # comparisons that stay near the processor
                held, size = [], 0
                for j in range(0, len(a), rows):
                    far = np.bitwise_count(a[j : j + rows, None].view(np.uint64) ^ b.view(np.uint64))
                    near = np.flatnonzero(far <= radius)
                    k, m = j + near // len(b), near % len(b)
                    u, v, d = a[k], b[m], far.ravel()[near].astype(np.int64)
                    if same:
                        once = u < v
                        u, v, d = u[once], v[once], d[once]
                    held.append(np.stack([np.minimum(u, v), np.maximum(u, v), d]))
                    size += len(d)
                    if j + rows >= len(a) or size > 1 << 15:
                        found = np.concatenate(held, axis=1)
                        held, size = [], 0
                        yield pa.RecordBatch.from_pydict({c: pa.array(s) for c, s in zip(("a", "b", "distance"), found, strict=True)})

    two = x.repartition(parts, "p", "q").hint("merge").join(y.repartition(parts, "p", "q"), ["p", "q"])
    return two.select("p", "q", "x", "y").mapInArrow(run, "a long, b long, distance long")
