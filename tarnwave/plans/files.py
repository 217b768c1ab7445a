"""Queries of what goes to files and comes back: listings, frozen signals with manifests, tables, and their checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwave.operators import thresholds
from tarnwave.operators.governance import compare_manifests, fingerprint
from tarnwave.operators.order import small
from tarnwave.plans.base import Book, r6
from tarnwave.sources import arrays, io, views
from tarnwave.sources.stage import shared_dir, staged
from tarnwave.sources.views import SIGNAL

book = Book()
query = book.query


def prints(src: str = "signal", out: str = "f", part: str = "p") -> str:
    """CTEs of the fingerprint of each channel of src (lamp, frame, v)."""
    return f"""{part} AS (SELECT lamp, frame // 1000 AS part, sha256(string_agg(CAST(CAST(round(v * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY frame)) AS h FROM {src} GROUP BY ALL),
    {out} AS (SELECT lamp, sha256(string_agg(h, ',' ORDER BY part)) AS sha256 FROM {part} GROUP BY lamp)"""


PRINTS = f"WITH {SIGNAL}, {prints()}"


def folder(spark, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/tarnwave/{name}-{uuid.uuid4().hex}"


@query("s1_list_files", None)
def s1(spark, sf):
    """The tables' files: name, bytes, fingerprint, and whether another file has the same content (S1, S5, F1)."""
    files = staged(io.list_files(spark, sf, "*.parquet").select("name", "bytes", "sha256"))
    same = files.groupBy("sha256").agg((F.count("*") > 1).alias("twice"))
    return files.join(same, "sha256").select("name", "bytes", "sha256", "twice")


@query("s8_load_frozen", f"{PRINTS} SELECT lamp, frame, round(v, 6) AS v, n AS frames, sha256 FROM signal JOIN (SELECT lamp, count(*) AS n FROM signal GROUP BY lamp) USING (lamp) JOIN f USING (lamp)")
def s8(spark, sf):
    """A frozen signal, loaded with what its manifest says of each channel."""
    at = folder(spark, "frozen")
    io.freeze(views.signal(spark, sf), at)
    return io.load_with_manifest(spark, at).select("lamp", "frame", r6("v"), "frames", "sha256")


@query("s12_named_arrays", f"WITH {SIGNAL} SELECT lamp, name, count(*) AS n, round(sum(x), 4) AS total, round(max(x) FILTER (frame = 700), 6) AS at_700 FROM (SELECT lamp, frame, 'level' AS name, v AS x FROM signal UNION ALL SELECT lamp, frame, 'square', v * v FROM signal) GROUP BY ALL")
def s12(spark, sf):
    """Named arrays of a signal's array files, written and loaded by name: every level, and its square."""
    at = folder(spark, "arrays")
    made = views.signal(spark, sf).withColumns({"level": F.col("v"), "square": F.col("v") * F.col("v"), "unread": -F.col("v")})
    manifest = small(arrays.save_arrays(made, at, ["level", "square", "unread"], chunk=1 << 14))
    rows = arrays.load_arrays(spark, at, ["level", "square"]).join(manifest, "file")
    there = F.col("first") + F.col("frame") == 700
    return rows.groupBy("lamp", "name").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"), r6(F.max(F.when(there, F.col("v"))), "at_700"))


@query("k1_partitioned_write", f"WITH {SIGNAL} SELECT lamp, count(*) AS frames, round(avg(v), 6) AS mean FROM signal WHERE lamp >= 'p' GROUP BY lamp")
def k1(spark, sf):
    """A signal written with one folder a channel; the channels asked for are the folders that are read."""
    at = folder(spark, "by-lamp")
    views.signal(spark, sf).write.partitionBy("lamp").parquet(at)
    return spark.read.parquet(at).filter("lamp >= 'p'").groupBy("lamp").agg(F.count("*").alias("frames"), r6(F.avg("v"), "mean"))


@query("k2_csv_manifest", f"WITH {SIGNAL} SELECT lamp, CAST(count(*) AS VARCHAR) AS frames FROM signal GROUP BY lamp")
def k2(spark, sf):
    """A manifest as csv with fixed columns; others are left out. Read back as text."""
    at = folder(spark, "csv")
    table = views.signal(spark, sf).groupBy("lamp").agg(F.count("*").alias("frames"), F.max("v").alias("extra"))
    io.write_table(table, at, ["lamp", "frames"])
    return spark.read.option("header", True).csv(at)


@query("k9_freeze_manifest", f"{PRINTS} SELECT lamp, sha256, count(*) AS frames, round(min(v), 6) AS low, round(max(v), 6) AS high FROM signal JOIN f USING (lamp) GROUP BY ALL")
def k9(spark, sf):
    """What freezing a signal writes down (F3): fingerprint and figures of each channel."""
    return io.freeze(views.signal(spark, sf), folder(spark, "frozen")).select("lamp", "sha256", "frames", r6("low"), r6("high"))


@query("k10_verify_copy", f"""{PRINTS}, copy AS (SELECT lamp, frame, CASE WHEN lamp = 'view' AND frame = 3 THEN v + 1 ELSE v END AS v FROM signal WHERE lamp <> 'click' UNION ALL SELECT 'other', frame, v FROM signal WHERE lamp = 'view'), {prints("copy", "g", "q")}
    SELECT coalesce(f.lamp, g.lamp) AS lamp, CASE WHEN g.lamp IS NULL THEN 'missing' WHEN f.lamp IS NULL THEN 'new' ELSE 'changed' END AS state FROM f FULL JOIN g ON f.lamp = g.lamp WHERE f.sha256 IS DISTINCT FROM g.sha256""")
def k10(spark, sf):
    """A frozen signal against a copy that lost a channel, changed one and got another on purpose."""
    at = folder(spark, "frozen")
    manifest = io.freeze(views.signal(spark, sf), at)
    copy = io.load(spark, at).filter("lamp <> 'click'").withColumn("v", F.when((F.col("lamp") == "view") & (F.col("frame") == 3), F.col("v") + 1).otherwise(F.col("v")))
    more = io.load(spark, at).filter("lamp = 'view'").withColumn("lamp", F.lit("other"))
    return compare_manifests(manifest, fingerprint(copy.unionByName(more)), "lamp", "sha256")


@query("f5_determinism", f"""{PRINTS}, mixed AS (SELECT event_type AS lamp, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS frame, value AS v FROM (SELECT * FROM events ORDER BY md5(CAST(event_id AS VARCHAR)))), {prints("mixed", "g", "q")}
    SELECT lamp, f.sha256 = g.sha256 AS same FROM f JOIN g USING (lamp)""")
def f5(spark, sf):
    """Whether two runs over differently dealt rows give each channel the same fingerprint."""

    def run(parts: int) -> DataFrame:
        rows = views.read(spark, sf, "events").repartition(parts)
        rows.write.parquet(at := folder(spark, "events") + "/events.parquet")
        return fingerprint(thresholds.fixed(views.signal(spark, at.rpartition("/")[0])))

    one, two = run(3), run(7)
    return one.join(two.withColumnRenamed("sha256", "again"), "lamp").select("lamp", (F.col("sha256") == F.col("again")).alias("same"))


QUERIES, ORACLES = book.queries, book.oracles
