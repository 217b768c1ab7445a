"""Symbol windows, decoding rules and phase ensembles.

A frame lies in at most two windows of a phase, so each row says itself which symbols it serves: there is no join of
frames with windows. Rows are dealt by chunks of frames once and see the next few; the first row of a symbol's window
then says the symbol, whatever the number of phases or other variants, and nothing is shuffled for each of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwave.operators import packed
from tarnwave.operators.order import chunked, with_stats

KEYS = ("lamp",)
#: Frames of a symbol: 260 frames and 92 symbols a second.
PERIOD = 260.0 / 92.0
#: Frames that are dealt together: few, so that the symbols of all variants are spread over many tasks.
DEALT = 1 << 13


def phases(n: int, period: float = PERIOD) -> list[float]:
    step = period / n
    return [i * step for i in range(n)]


def window(phase: Column, k: Column, period: float | Column, margin: float | Column = 0.0) -> tuple[Column, Column]:
    """First and last frame of symbol k."""
    period = period if isinstance(period, Column) else F.lit(period)
    margin = margin if isinstance(margin, Column) else F.lit(float(margin))
    start = phase + k * period
    low = F.ceil(start)
    return low, F.greatest(F.floor(start + period - margin), low)


def bit_windows(sizes: DataFrame, period: float = PERIOD, phase: float = 0.0, margin: float = 0.0, n: str = "n", keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, k, lo, hi of all whole symbols of signals of n frames."""
    count = F.floor((F.col(n) - phase - 1) / period)
    rows = sizes.filter(count > 0).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("k"))
    low, high = window(F.lit(float(phase)), F.col("k"), period, margin)
    return rows.select(*keys, "k", low.alias("lo"), high.alias("hi"))


def settings(at: Sequence[float], period: float, shifts: Sequence[float] | None = None, periods: Sequence[float] | None = None) -> Column:
    """The variants of a decode as one array: phase_id (their place), phase, shift (of the threshold), period."""
    shifts, periods = shifts or [0.0] * len(at), periods or [period] * len(at)
    named = lambda x, name: F.lit(float(x)).alias(name)
    return F.array(*[F.struct(F.lit(i).cast("long").alias("phase_id"), named(p, "phase"), named(s, "shift"), named(t, "period")) for i, (p, s, t) in enumerate(zip(at, shifts, periods, strict=True))])


def served(df: DataFrame, at: Sequence[float], period: float = PERIOD, margin: float | Column = 0.0, n: str = "n", shifts: Sequence[float] | None = None, periods: Sequence[float] | None = None) -> DataFrame:
    """df with a row for each variant and symbol that its frame lies in: phase_id, k, lo, hi. Needs the column n.

    With shifts: __shift, of the threshold.
    """
    rows = df.withColumn("__p", F.explode(settings(at, period, shifts, periods)))
    phase, own = F.col("__p.phase"), F.col("__p.period")
    middle = F.floor((F.col("frame") - phase) / own)
    rows = rows.withColumn("k", F.explode(F.array(middle - 1, middle, middle + 1)))
    low, high = window(phase, F.col("k"), own, margin)
    count = F.floor((F.col(n) - phase - 1) / own)
    rows = rows.withColumns({"lo": low, "hi": high, "phase_id": F.col("__p.phase_id")})
    if shifts:
        rows = rows.withColumn("__shift", F.col("__p.shift"))
    inside = (F.col("k") >= 0) & (F.col("k") < count) & (F.col("frame") >= F.col("lo")) & (F.col("frame") <= F.col("hi"))
    return rows.filter(inside).drop("__p")


def windowed(df: DataFrame, value: Column, at: Sequence[float], period: float = PERIOD, margin: float | Column = 0.0, keys: Sequence[str] = KEYS, n: str = "n", shifts: Sequence[float] | None = None, periods: Sequence[float] | None = None, chunk: int = DEALT) -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """One row for each symbol and variant, df's first row in the symbol's window: df with phase_id, k, lo, hi (see served).

    Also returns, of that row and those after it, frame and value, null beyond the window.
    """
    width = int(max(periods or [period])) + 1
    rows = df.withColumn("__v0", value)

    def near(w) -> dict[str, Column]:
        after = {f"__{c}{j}": F.lead(of, j).over(w) for j in range(1, width) for c, of in (("f", "frame"), ("v", "__v0"))}
        return after | {"__was": F.lag("frame").over(w)}

    # the frames a window reaches back over decide which row is its first
    rows = served(chunked(rows, keys, "frame", width, width, near, chunk), at, period, margin, n, shifts, periods)
    first = rows.filter(F.col("__was").isNull() | (F.col("__was") < F.col("lo")))
    seen = [(F.col("frame"), F.col("__v0"))]
    for j in range(1, width):
        inside = F.col(f"__f{j}") <= F.col("hi")
        seen.append((F.when(inside, F.col(f"__f{j}")), F.when(inside, F.col(f"__v{j}"))))
    return first, seen


def decode(df: DataFrame, rule: str, at: Sequence[float] = (0.0,), period: float = PERIOD, margin: float | Column = 0.0, thr: Column | None = None, keys: Sequence[str] = KEYS, n: str = "n", shifts: Sequence[float] | None = None, periods: Sequence[float] | None = None) -> DataFrame:
    """One bit for each symbol and variant: keys, phase_id, k, bit, margin. df: keys, frame, v, thr, and n frames.

    nearest: the frame at the centre; average: the mean over the window; confident: the frame furthest from the
    threshold, the earliest of equals. A value at the threshold is 0. margin: distance of the deciding value. Variants
    are phases (at) and, beside each, a shift of the threshold in shares of the column span, and a period.
    """
    level = F.col("thr") if thr is None else thr
    if rule == "nearest":
        rows = df.withColumn("__p", F.explode(settings(at, period, shifts, periods)))
        phase, own = F.col("__p.phase"), F.col("__p.period")
        middle = F.floor((F.col("frame") - phase) / own)
        # the last frame can be the centre of symbols whose own one is cut off
        rows = rows.withColumn("k", F.explode(F.sequence(middle - 2, middle + 1)))
        centre = F.least(F.greatest(F.rint(F.ceil(phase + F.col("k") * own) - F.lit(0.5) + own / 2), F.lit(0.0)), F.col(n) - 1.0)
        count = F.floor((F.col(n) - phase - 1) / own)
        rows = rows.filter((F.col("k") >= 0) & (F.col("k") < count) & (centre == F.col("frame")))
        d = F.col("v") - (level + F.col("__p.shift") * F.col("span") if shifts else level)
        value = rows.select(*keys, F.col("__p.phase_id").alias("phase_id"), "k", d.alias("__v"))
    elif rule in ("average", "confident"):
        # the threshold is that of each frame
        own = F.struct(F.col("v").alias("v"), level.alias("l"), F.col("span").alias("s")) if shifts else F.col("v") - level
        rows, seen = windowed(df, own, at, period, margin, keys, n, shifts, periods)
        far = [x["v"] - (x["l"] + F.col("__shift") * x["s"]) if shifts else x for _, x in seen]
        parts = [F.col(f"__d{j}") for j in range(len(seen))]
        rows = rows.select(*keys, "phase_id", "k", *[d.alias(f"__d{j}") for j, d in enumerate(far)])
        value = rows.select(*keys, "phase_id", "k", (mean_of if rule == "average" else furthest)(parts).alias("__v"))
    else:
        raise ValueError(f"rule {rule!r} is none of nearest, average, confident")
    return value.select(*keys, "phase_id", "k", (F.col("__v") > 0).cast("long").alias("bit"), F.abs("__v").alias("margin"))


def mean_of(parts: Sequence[Column]) -> Column:
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    return total / sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int"))


def furthest(parts: Sequence[Column]) -> Column:
    """The value furthest from 0, the first of equals."""
    best = parts[0]
    for p in parts[1:]:
        best = F.when(best.isNull() | (F.abs(p) > F.abs(best)), p).otherwise(best)
    return best


def ensemble(bits: DataFrame, n_phases: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Of bits at several phases: k, b0 (at the first phase), votes (share of ones), safe (equal at all phases)."""
    whole = bits.groupBy(*keys, "k").agg(F.count("*").alias("__n"), F.max(F.when(F.col("phase_id") == 0, F.col("bit"))).alias("b0"), F.avg("bit").alias("votes"), (F.min("bit") == F.max("bit")).alias("safe"))
    return whole.filter(F.col("__n") == n_phases).drop("__n")


def agreement(a: DataFrame, b: DataFrame, reach: int = 1, keys: Sequence[str] = KEYS, more: Sequence[str] = ()) -> DataFrame:
    """Share of equal bits of two streams (keys, k, bit), the best over offsets of up to reach symbols.

    more: columns of b alone, whose streams are all held against a's; the result has them too.
    """
    sums = packed.offset_sums(packed.pack(b, [*keys, *more]), packed.pack(a, keys), reach, keys, more)
    return sums.groupBy(*keys, *more).agg(F.max((F.col("m") - F.col("wrong")) / F.col("m")).alias("agreement"))


def symbol_means(df: DataFrame, period: float, phase: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean of each symbol's frames; frames before the first edge belong to symbol 0."""
    k = F.greatest(F.floor((F.col("frame") - phase) / period), F.lit(0))
    return df.groupBy(*keys, k.alias("k")).agg(F.avg("v").alias("mean"))


def sized(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """df with n, the frames of its key."""
    return df if "n" in df.columns else with_stats(df, keys, n=F.count("*"))
