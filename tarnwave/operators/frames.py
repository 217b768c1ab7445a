"""Frames of pixels: per-frame statistics, regions, masks, components and perceptual hashes.

Frames are arrays (frame, pixels) or one row for each pixel (frame, x, y, v).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwave.sources.stage import staged


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def bright_mean(pixels: Column, share: float, ceil: bool = False) -> Column:
    """Mean of the brightest share of an array: max(1, int(n * share)) of them, or the ceiling of it."""
    raw = F.size(pixels) * F.lit(share)
    k = F.greatest(F.lit(1), (F.ceil(raw) if ceil else F.floor(raw)).cast("int"))
    return total(F.slice(F.sort_array(pixels, asc=False), 1, k)) / k


def quantile(pixels: Column, p: float) -> Column:
    """Linear quantile of an array."""
    s = F.sort_array(pixels)
    at = F.lit(p) * (F.size(pixels) - 1)
    low = F.element_at(s, F.floor(at).cast("int") + 1)
    high = F.element_at(s, F.ceil(at).cast("int") + 1)
    return low + (high - low) * (at - F.floor(at))


def mean(pixels: Column) -> Column:
    return total(pixels) / F.size(pixels)


def spread(pixels: Column) -> Column:
    m = mean(pixels)
    return F.sqrt(total(F.transform(pixels, lambda x: (x - m) * (x - m))) / F.size(pixels))


def above(pixels: Column, level: Column) -> Column:
    return F.size(F.filter(pixels, lambda x: x > level)).cast("long")


STATISTICS = {
    "mean": mean,
    "median": lambda p: quantile(p, 0.5),
    "max": F.array_max,
    "p90": lambda p: quantile(p, 0.9),
    "top10": lambda p: bright_mean(p, 0.1),
    "top25": lambda p: bright_mean(p, 0.25),
    "top50": lambda p: bright_mean(p, 0.5),
}


def frame_statistic(pixels: Column, name: str) -> Column:
    """A statistic of a frame by its name."""
    if name not in STATISTICS:
        raise ValueError(f"statistic {name!r} is none of {', '.join(STATISTICS)}")
    return STATISTICS[name](pixels)


def variance_map(pixels: DataFrame) -> DataFrame:
    """x, y, var: population variance of each pixel over all frames."""
    return pixels.groupBy("x", "y").agg(F.var_pop("v").alias("var"))


def crop(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Rows of pixels inside boxes (box, x0, y0, w, h, clipped to the frame): one row for each pixel and box.

    boxes is a table of parameters, some rows at most; it is sent to all executors and meets one scan of the pixels.
    """
    b = F.broadcast(boxes)
    inside = (F.col("x") >= F.greatest(F.col("x0"), F.lit(0))) & (F.col("x") < F.col("x0") + F.col("w")) & (F.col("y") >= F.greatest(F.col("y0"), F.lit(0))) & (F.col("y") < F.col("y0") + F.col("h"))
    return pixels.join(b, inside)


def hash_long(hash_: Column) -> Column:
    """A hash of 64 characters 0 and 1 as a long, the first character in the top bit."""
    half = lambda at: F.conv(F.substring(hash_, at, 32), 2, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(33))


def average_hash(pixels: Column) -> Column:
    """Which of 64 pixels exceed their mean, as a string of 0 and 1."""
    m = mean(pixels)
    return F.array_join(F.transform(pixels, lambda x: F.when(x > m, "1").otherwise("0")), "")


def hamming(a: Column, b: Column) -> Column:
    """Places where two equally long strings differ."""
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d)).cast("long")


def brightest_spot(pixels: DataFrame, keys: list[str], width: int, height: int, reach: int = 7, sigma: float = 2.6) -> DataFrame:
    """keys, cx, cy: where a frame of each key is brightest after a Gaussian blur over 2 * reach + 1 pixels, mirrored at the border.

    pixels: keys, x, y, v of one frame each, at least reach + 1 wide and high. Of equals, the first row, then column.
    """
    raw = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    table = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w / sum(raw)).alias("w")) for d, w in zip(range(-reach, reach + 1), raw)])
    spread = pixels.select(*keys, "x", "y", F.explode(table).alias("a")).withColumn("b", F.explode(table))

    def mirrored(at: Column, size: int) -> Column:
        return F.when(at < 0, -at).when(at >= size, 2 * (size - 1) - at).otherwise(at)

    near = spread.select(*keys, F.col("x").alias("cx"), F.col("y").alias("cy"), (F.col("a.w") * F.col("b.w")).alias("w"), mirrored(F.col("x") + F.col("a.d"), width).alias("x"), mirrored(F.col("y") + F.col("b.d"), height).alias("y"))
    blur = near.join(pixels.select(*keys, "x", "y", "v"), [*keys, "x", "y"]).groupBy(*keys, "cx", "cy").agg(F.round(F.sum(F.col("w") * F.col("v")), 9).alias("blur"))
    best = blur.groupBy(*keys).agg(F.max_by(F.struct("cx", "cy"), F.struct("blur", -F.col("cy"), -F.col("cx"))).alias("s"))
    return best.select(*keys, "s.cx", "s.cy")


def components(mask: DataFrame) -> DataFrame:
    """Cells (x, y) of a mask with label: the smallest cell number of their 8-connected component.

    Rounds in which each cell takes the smallest label around it, then that label's own, as written tables, until
    nothing changes. Masks are as small as one frame.
    """
    around = F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    cell = F.col("y") * 1_000_000 + F.col("x")
    labels = staged(mask.select("x", "y", cell.alias("label")))
    while True:
        near = labels.select("label", around.alias("c")).groupBy(F.col("c.x").alias("x"), F.col("c.y").alias("y")).agg(F.min("label").alias("near"))
        jump = labels.select(cell.alias("near"), F.col("label").alias("next"))
        after = staged(labels.join(near, ["x", "y"]).join(jump, "near").select("x", "y", F.col("label").alias("was"), F.least("near", "next").alias("label")))
        labels = after.select("x", "y", "label")
        if after.filter("label <> was").isEmpty():
            return labels
