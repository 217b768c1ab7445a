"""Views of the driver's tables in the shapes that the signal operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwave.operators.order import numbered, small
from tarnwave.operators.thresholds import levels, with_levels
from tarnwave.sources.stage import stored


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def signal(spark: SparkSession, sf_dir: str, by: str = "event_type") -> DataFrame:
    """lamp string, frame long, v double: one channel for each event type (or another column of events).

    Numbered and stored, in ranges of lamp and time, by the first query of a session that asks.
    """

    def made() -> DataFrame:
        rows = read(spark, sf_dir, "events").select(F.col(by).cast("string").alias("lamp"), "ts", "event_id", F.col("value").alias("v"))
        return numbered(rows, ["lamp"], ["ts", "event_id"], "frame").select("lamp", "frame", "v")

    return stored(spark, f"signal-{by}", f"{sf_dir}/events.parquet", made)


def thresholded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal with thr, n and span: thresholds.fixed, its channels' figures stored beside the signal."""
    rows = signal(spark, sf_dir)
    return with_levels(rows, small(stored(spark, "levels", f"{sf_dir}/events.parquet", lambda: levels(rows))))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame long, label int, pixels array of double (8 x 8)."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), "label", F.col("embedding").cast("array<double>").alias("pixels"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, label, x, y, v: frames with one row for each pixel."""
    rows = frames(spark, sf_dir).select("frame", "label", F.posexplode("pixels").alias("pos", "v"))
    return rows.select("frame", "label", (F.col("pos") % 8).cast("long").alias("x"), F.floor(F.col("pos") / 8).cast("long").alias("y"), "v")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream string, k long, bit long: two bit streams from the labels, in the order of doc_id."""
    rows = read(spark, sf_dir, "labels").select(F.lit("labels").alias("one"), "doc_id", "quality", "toxic")
    both = numbered(rows, ["one"], ["doc_id"], "k").select("k", F.explode(F.array(F.struct(F.lit("quality").alias("stream"), F.col("quality").alias("bit")), F.struct(F.lit("toxic").alias("stream"), F.col("toxic").alias("bit")))).alias("s"))
    return both.select("s.stream", "k", F.col("s.bit").cast("long").alias("bit"))


#: The same views in SQL, for the oracles.
SIGNAL = "signal AS (SELECT event_type AS lamp, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS frame, value AS v FROM events)"
PIXELS = "pixels AS (SELECT vec_id AS frame, label, CAST((i - 1) % 8 AS BIGINT) AS x, CAST((i - 1) // 8 AS BIGINT) AS y, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i))"
TRUTH = "base AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS k, quality, toxic FROM labels), truth AS (SELECT 'quality' AS stream, k, CAST(quality AS BIGINT) AS bit FROM base UNION ALL SELECT 'toxic', k, CAST(toxic AS BIGINT) FROM base)"
ARR_LABEL = "fr AS (SELECT vec_id AS frame, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS px FROM embeddings)"
