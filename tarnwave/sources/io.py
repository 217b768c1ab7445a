"""Files in and out: listings with fingerprints, frozen signals with their manifest, tables for reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwave.operators.governance import compare_manifests, fingerprint
from tarnwave.operators.order import small
from tarnwave.sources import digests


#: Bytes of a file that one task reads as a whole at most, where the rest of the digest can be handed on.
WHOLE = 64 << 20
#: Endings of files that text readers unpack; they are read as a whole.
PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst|zstd|xz|passthrough)$"


def list_files(spark: SparkSession, folder: str, pattern: str = "*", whole: int = WHOLE, reach: int = digests.REACH) -> DataFrame:
    """path, name, bytes, modified, sha256 of all files below a folder whose names fit; contents stay on the executors.

    Spark lists no empty files. Files of more than `whole` bytes are read in ranges, `reach` bytes of them in a round of
    digests; not so packed ones (by their ending), and none where Python lacks OpenSSL: these have to be below 2 GB, and
    one task reads each.
    """

    def read(form: str) -> DataFrame:
        return spark.read.format(form).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "\n").load(folder)

    files = read("binaryFile")
    shown = ["path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")]
    digest = F.sha2("content", 256).alias("sha256")
    far = (F.col("_metadata.file_size") > whole) & ~F.lower("_metadata.file_path").rlike(PACKED)  # chosen when files are listed, before any is opened
    count, longest = files.filter(far).agg(F.count("*"), F.max("length")).first() if digests.library() else (0, 0)
    if not count:
        return files.select(*shown, digest)
    lines = read("text").filter(far).select(F.col("_metadata.file_path").alias("at"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("data"))
    named = files.filter(far).select(F.col("_metadata.file_path").alias("at"), *shown)
    made = digests.long_digests(lines, named.select("at", "bytes"), count, longest, reach)
    return files.filter(~far).select(*shown, digest).unionByName(named.join(made, "at").drop("at"))


def guard_output(source: str, target: str) -> None:
    """Refuses to write inside the folder that is read."""
    inside = lambda p: p.rstrip("/").removeprefix("file://") + "/"
    if inside(target).startswith(inside(source)):
        raise ValueError(f"{target} lies inside {source}, which is read only")


def freeze(signal: DataFrame, path: str, keys: Sequence[str] = ("lamp",)) -> DataFrame:
    """Writes a signal, partitioned by its keys, with a manifest; an existing one is never overwritten. Returns the manifest."""
    signal.write.partitionBy(*keys).parquet(f"{path}/signal")
    back = signal.sparkSession.read.parquet(f"{path}/signal")
    sizes = back.groupBy(*keys).agg(F.count("*").alias("frames"), F.min("v").alias("low"), F.max("v").alias("high"))
    fingerprint(back, keys).join(sizes, list(keys)).write.parquet(f"{path}/manifest")
    return signal.sparkSession.read.parquet(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/signal")


def load_with_manifest(spark: SparkSession, path: str, key: str = "lamp") -> DataFrame:
    """The frozen signal with the columns of its manifest (one short row for each channel)."""
    return load(spark, path).join(small(spark.read.parquet(f"{path}/manifest")), key)


def verify(spark: SparkSession, path: str, key: str = "lamp") -> DataFrame:
    """key, state of what is missing, new or changed against the manifest; no rows if all is as it was."""
    return compare_manifests(spark.read.parquet(f"{path}/manifest"), fingerprint(load(spark, path), [key]), key, "sha256")


def write_table(df: DataFrame, path: str, columns: Sequence[str], form: str = "csv") -> None:
    """The named columns, in their order, as csv (with a header) or json; other columns are left out."""
    out = df.select(*columns).write
    out.option("header", True).csv(path) if form == "csv" else out.json(path)
