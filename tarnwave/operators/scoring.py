"""Error rates of bit streams over polarity and alignment, and tolerance bands. Streams: keys, k, bit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwave.operators import packed


def aligned(pred: DataFrame, ref: DataFrame, reach: int, keys: Sequence[str]) -> DataFrame:
    """Overlap and differing bits for each offset: keys, off, m, wrong, n_ref. Streams are packed, so a word is one row."""
    sums = packed.offset_sums(packed.pack(pred, keys), packed.pack(ref, keys), reach, keys)
    return sums.join(ref.groupBy(*keys).agg(F.count("*").alias("n_ref")), list(keys))


def polar(sums: DataFrame) -> DataFrame:
    """Both polarities of each alignment: err, polarity (1 as it is, 0 inverted). Overlaps below half the reference go."""
    two = F.explode(F.array(F.struct(F.lit(1).cast("long").alias("p"), F.col("wrong").alias("w")), F.struct(F.lit(0).cast("long").alias("p"), (F.col("m") - F.col("wrong")).alias("w"))))
    rows = sums.filter(F.col("m") >= F.floor(F.col("n_ref") / 2)).withColumn("__t", two)
    return rows.withColumns({"polarity": F.col("__t.p"), "err": F.col("__t.w") / F.col("m")}).drop("__t")


def ber(pred: DataFrame, ref: DataFrame, reach: int = 3, keys: Sequence[str] = ("stream",)) -> DataFrame:
    """keys, ber, polarity, offset: the lowest error rate; of equals, as it is before inverted, then the smallest offset.

    Without an alignment of at least half the reference: 1, 1, 0.
    """
    best = polar(aligned(pred, ref, reach, keys)).groupBy(*keys).agg(F.min(F.struct("err", (-F.col("polarity")).alias("p"), "off")).alias("b"))
    best = best.filter("b.err < 1")
    full = ref.select(*keys).distinct().join(best, list(keys), "left")
    return full.select(*keys, F.coalesce("b.err", F.lit(1.0)).alias("ber"), F.coalesce(-F.col("b.p"), F.lit(1)).cast("long").alias("polarity"), F.coalesce("b.off", F.lit(0)).cast("long").alias("offset"))


def ber_padded(pred: DataFrame, ref: DataFrame, reach: int = 2, keys: Sequence[str] = ("stream",)) -> DataFrame:
    """The variant that fills a shift to the right with zeros, which count; indel: symbols too many or too few."""
    sizes = pred.groupBy(*keys).agg(F.count("*").alias("n_pred")).join(ref.groupBy(*keys).agg(F.count("*").alias("__n_ref"), F.sum("bit").alias("__ones")), list(keys))
    sums = aligned(pred, ref, reach, keys).join(sizes.drop("__ones"), list(keys))
    heads = ref.filter(F.col("k") < reach).groupBy(*keys).agg(*[F.sum(F.when(F.col("k") < o, F.col("bit")).otherwise(0)).alias(f"__h{o}") for o in range(1, reach + 1)])
    pad = F.greatest(-F.col("off"), F.lit(0))
    head = F.coalesce(*[F.when(pad == o, F.col(f"__h{o}")) for o in range(1, reach + 1)], F.lit(0))
    rows = sums.join(heads, list(keys))
    # padding zeros are wrong where the reference is 1, in either polarity
    two = F.explode(F.array(F.lit(1).cast("long"), F.lit(0).cast("long")))
    rows = rows.withColumn("polarity", two).withColumn("total", F.col("m") + pad)
    wrong = F.when(F.col("polarity") == 1, F.col("wrong")).otherwise(F.col("m") - F.col("wrong")) + head
    rows = rows.withColumn("err", wrong / F.col("total")).filter(F.col("total") >= F.floor(F.col("n_ref") / 2))
    best = rows.groupBy(*keys).agg(F.min(F.struct("err", (-F.col("polarity")).alias("p"), "off")).alias("b"), F.first(F.col("n_pred") - F.col("n_ref")).alias("indel"))
    return best.select(*keys, F.col("b.err").alias("ber"), (-F.col("b.p")).alias("polarity"), F.col("b.off").alias("offset"), "indel")


def band(points: DataFrame, index: str, ok: str, centre: int, keys: Sequence[str], last: int) -> DataFrame:
    """The contiguous stretch of good points around the centre: keys, lo, hi; both null where the centre isn't good."""
    bad = ~F.col(ok)
    out = points.groupBy(*keys).agg(F.max(F.when(bad & (F.col(index) < centre), F.col(index))).alias("__l"), F.min(F.when(bad & (F.col(index) > centre), F.col(index))).alias("__r"), F.bool_or((F.col(index) == centre) & F.col(ok)).alias("__c"))
    lo, hi = F.coalesce(F.col("__l") + 1, F.lit(0)), F.coalesce(F.col("__r") - 1, F.lit(last))
    return out.select(*keys, F.when(F.col("__c"), lo).alias("lo"), F.when(F.col("__c"), hi).alias("hi"))


def edit_rate(a: Column, b: Column) -> Column:
    """Edit distance in shares of the reference's length."""
    return F.levenshtein(a, b) / F.length(b)
