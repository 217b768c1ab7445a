"""Block means and lit shares of a stream of samples, by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_means(samples: DataFrame, block: str, late: str, key: str = "lamp") -> DataFrame:
    """key, window, mean, n of tumbling blocks of event time; samples (key, ts, v) may come as late as `late`.

    Works on a stream and on a table alike; on a stream, a block comes out when the watermark has passed it.
    """
    return samples.withWatermark("ts", late).groupBy(F.window("ts", block), key).agg(F.avg("v").alias("mean"), F.count("*").alias("n"))


def lit_shares(samples: DataFrame, level: float, width: str, step: str, late: str, key: str = "lamp") -> DataFrame:
    """key, window, share of samples above level, in windows that slide by step."""
    return samples.withWatermark("ts", late).groupBy(F.window("ts", width, step), key).agg(F.avg((F.col("v") > level).cast("double")).alias("share"), F.count("*").alias("n"))
