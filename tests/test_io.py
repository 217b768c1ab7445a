import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tarnwave.sources import io, views
from tarnwave.streaming import blocks


def test_freeze_and_verify(spark, sf, tmp_path):
    path = str(tmp_path / "frozen")
    signal = views.signal(spark, sf)
    manifest = io.freeze(signal, path)
    assert manifest.agg(F.sum("frames")).first()[0] == signal.count()
    assert io.verify(spark, path).collect() == []
    with pytest.raises(AnalysisException):
        io.freeze(signal, path)
    changed = io.load(spark, path).withColumn("v", F.when((F.col("lamp") == "view") & (F.col("frame") == 3), F.col("v") + 1).otherwise(F.col("v")))
    from tarnwave.operators.governance import compare_manifests, fingerprint

    state = compare_manifests(manifest, fingerprint(changed.filter("lamp <> 'click'")), "lamp", "sha256").collect()
    assert {(r["lamp"], r["state"]) for r in state} == {("view", "changed"), ("click", "missing")}


def test_fingerprints_do_not_depend_on_partitions(spark, sf):
    from tarnwave.operators.governance import fingerprint

    signal = views.signal(spark, sf)
    assert fingerprint(signal.repartition(7)).exceptAll(fingerprint(signal.coalesce(1))).isEmpty()


def test_listing_guard_and_tables(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.mp4").write_bytes(b"abc")
    (tmp_path / "in" / "deep" / "b.mp4").write_bytes(b"abc")
    (tmp_path / "in" / "c.txt").write_bytes(b"x")
    files = io.list_files(spark, str(tmp_path / "in"), "*.mp4")
    assert sorted(r["name"] for r in files.collect()) == ["a.mp4", "b.mp4"]
    assert files.groupBy("sha256").count().filter("count > 1").count() == 1
    with pytest.raises(ValueError):
        io.guard_output(str(tmp_path / "in"), str(tmp_path / "in" / "out"))
    io.guard_output(str(tmp_path / "in"), str(tmp_path / "inside"))
    io.write_table(files, str(tmp_path / "csv"), ["name", "bytes"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["name", "bytes"]


def test_stream_equals_table(spark, sf):
    def shape(df):
        return df.select(F.col("event_type").alias("lamp"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v"))

    table = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    q = blocks.block_means(shape(stream), "7 days", "1 day").writeStream.outputMode("complete").format("memory").queryName("tw_blocks").start()
    q.processAllAvailable()
    q.stop()
    whole = blocks.block_means(shape(table), "7 days", "1 day")
    got, want = (sorted((r["lamp"], r["window"]["start"], r["n"], round(r["mean"], 6)) for r in x.collect()) for x in (spark.table("tw_blocks"), whole))
    assert got == want and len(got) > 5
    shares = blocks.lit_shares(shape(table), 100.0, "7 days", "1 day", "1 day")
    assert shares.filter("share < 0 or share > 1").isEmpty()
