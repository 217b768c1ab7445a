"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it.

    Only a session in one process (local[...], as in tests) may leave it unset; it gets a temporary folder of its own.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="tarnwave-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known


def staged(df: DataFrame, name: str = "table") -> DataFrame:
    """df written once and read back, so that what follows neither repeats its work nor loses it with an executor.

    The table goes when the driver ends: results are lazy, and may read it until then.
    """
    spark = df.sparkSession
    path = written(df, name)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str, by: Sequence[str] = ()) -> str:
    """The folder that df is written to, with one folder for each value of the columns `by`, until the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarnwave/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    files, at = file_system(spark, path)
    files.deleteOnExit(at)
    return path


def file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the path as it takes it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


#: Tables that later queries of a session read again: (application, name, source, its state) to folder and schema.
_STORED: dict[tuple, tuple] = {}


def stored(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that make derives from the files at source alone, written by the first query that asks for it.

    Later queries of the session read it, unless files came, went or changed (number, bytes and time are compared) or
    the table is gone; then it is made anew. Each call gives a new relation, so tables can be joined with themselves.
    """
    files, at = file_system(spark, source)
    size = files.getContentSummary(at)
    state = (size.getFileCount(), size.getLength(), max([files.getFileStatus(at).getModificationTime(), *(x.getModificationTime() for x in files.listStatus(at))]))
    key = (spark.sparkContext.applicationId, name, source, state)
    if key in _STORED:
        path, schema = _STORED[key]
        kept, where = file_system(spark, path + "/_SUCCESS")
        if kept.exists(where):
            return spark.read.schema(schema).parquet(path)
    made = make()
    _STORED[key] = written(made, name), made.schema
    return spark.read.schema(made.schema).parquet(_STORED[key][0])
