"""Tables that a session keeps: read again, made anew when the source or the table changes."""

import shutil

from pyspark.sql import functions as F

from tarnwave.operators import thresholds
from tarnwave.sources import stage, views


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_stored_follows_its_source(spark, tmp_path):
    source, made = str(tmp_path / "in.parquet"), []

    def make():
        made.append(1)
        return spark.read.parquet(source).withColumn("twice", F.col("id") * 2)

    spark.range(5).write.parquet(source)
    one, two = (stage.stored(spark, "twice", source, make) for _ in range(2))
    assert len(made) == 1 and rows(one) == rows(two) == [(i, 2 * i) for i in range(5)]
    assert one.join(two, one.id == two.twice).count() == 3  # two relations, not one with itself
    spark.range(5, 7).write.mode("append").parquet(source)
    assert rows(stage.stored(spark, "twice", source, make)) == [(i, 2 * i) for i in range(7)] and len(made) == 2
    path = next(p for (_, name, at, _), (p, _) in reversed(stage._STORED.items()) if name == "twice" and at == source)
    shutil.rmtree(path.removeprefix("file:").replace("//", "/"))
    assert rows(stage.stored(spark, "twice", source, make)) == [(i, 2 * i) for i in range(7)] and len(made) == 3
    assert rows(stage.stored(spark, "other", source, make)) == [(i, 2 * i) for i in range(7)] and len(made) == 4


def test_stored_empty_source(spark, tmp_path):
    source = str(tmp_path / "events.parquet")
    spark.createDataFrame([], "event_id long, ts timestamp, event_type string, value double").write.parquet(source)
    assert rows(views.thresholded(spark, str(tmp_path))) == []


def test_thresholded_is_the_fixed_threshold(spark, sf):
    got = views.thresholded(spark, sf)
    want = thresholds.fixed(views.signal(spark, sf)).select(*got.columns)
    assert rows(got) == rows(want) and got.count() > 0
