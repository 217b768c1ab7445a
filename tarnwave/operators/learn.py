"""Learned models: a symbol classifier, and clusters of pixels that blink together."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwave.operators import newton
from tarnwave.operators.order import numbered, with_stats
from tarnwave.sources.stage import staged

FEATURES = ("d_m1", "d_0", "d_1", "d_2", "d_3", "frac")


def fit_and_score(train: DataFrame, rows: DataFrame, features: Sequence[str] = FEATURES, c: float = 1.0) -> DataFrame:
    """rows with bit and confidence under a logistic regression fitted to train's label, with an L2 penalty of 1 / c."""
    return newton.fit(staged(train), features, penalties=(c,)).scored(rows, F.lit(0))


def leave_one_out(table: DataFrame, key: str, features: Sequence[str] = FEATURES, c: float = 1.0) -> DataFrame:
    """table with bit and confidence, each key's rows by a model that hasn't seen that key. All models are fitted together.

    Beyond newton.FOLDS keys, keys share a fold, which is left out as a whole.
    """
    dealt = staged(newton.fold_of(table, key))
    folds = (dealt.agg(F.max("__folds")).first()[0]) or 1
    return newton.fit(dealt, features, folds, (c,), fold="fold").scored(dealt, F.col("fold")).drop("fold", "__folds")


def pixel_clusters(pixels: DataFrame, frames: int = 600, most: int = 6, least_share: float = 0.05, apart: float = 0.02, seed: int = 0) -> DataFrame:
    """x, y, cluster, k: pixels (z-scored over time) in the largest k, from 1 on, whose clusters are big enough and apart.

    A pixel is one row of at most `frames` values: the sample of evenly strided frames that the clusters are made of.
    """
    stamps = pixels.select("frame").distinct()
    stride = max(1, -(-stamps.count() // frames))
    chosen = numbered(stamps.withColumn("__one", F.lit(1)), ["__one"], ["frame"], "__i").filter(F.col("__i") % stride == 0).select("frame")
    sample = staged(pixels.join(F.broadcast(chosen), "frame"))
    z = with_stats(sample, ["x", "y"], __m=F.avg("v"), __s=F.stddev_pop("v")).withColumn("z", (F.col("v") - F.col("__m")) / (F.col("__s") + 1e-6))
    rows = staged(z.groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("frame", "z"))).alias("s")).select("x", "y", F.transform("s", lambda p: p["z"]).alias("z"))).withColumn("features", array_to_vector("z"))
    n, different, best = rows.count(), rows.select("z").distinct().count(), None
    for k in range(2, min(most, different) + 1):
        model = KMeans(k=k, seed=seed, maxIter=20).fit(rows)
        c = model.clusterCenters()
        if min(model.summary.clusterSizes) >= least_share * n and (1 - np.corrcoef(c)[np.triu_indices(len(c), 1)]).min() > apart:
            best = model
    if best is None:
        return rows.select("x", "y", F.lit(0).cast("long").alias("cluster"), F.lit(1).cast("long").alias("k"))
    return best.transform(rows).select("x", "y", F.col("prediction").cast("long").alias("cluster"), F.lit(best.getK()).cast("long").alias("k"))
