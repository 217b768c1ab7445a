"""Order-dependent operators that don't put a whole channel into one task.

A channel can hold a third of all rows, so windows are partitioned by (channel, chunk of frames), not by channel.
Neighbouring rows come along as a halo; what runs through a whole channel (numbering, running sums, the last known
state) is done within chunks and then carried over with one summary row for each chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwave.sources.stage import staged

#: Frames of a chunk.
CHUNK = 1 << 16
#: Rows of a small table that goes to all executors at most; larger ones are joined by a shuffle.
SMALL = 100_000


def fetched(df: DataFrame, most: int = SMALL) -> pa.Table | None:
    """df as a local table if it has `most` rows or fewer, in one job; else null."""
    table = df.limit(most + 1).toArrow()
    return table if table.num_rows <= most else None


def small(df: DataFrame) -> DataFrame:
    """df, a table of summaries, computed once: sent to all executors if it has SMALL rows or fewer, else a written table."""
    table = fetched(df)
    return staged(df, "summary") if table is None else F.broadcast(df.sparkSession.createDataFrame(table, df.schema))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with a dense index from 0 within keys, by order (which must tell rows of a key apart).

    Rows are range-partitioned by keys and order, numbered inside their partition, and shifted by the rows of their key
    in the partitions before; only one count for each partition and key goes through a join. The numbered partitions
    are written once: range bounds come from a sample, so a second evaluation could draw others.
    """
    pid, local, shift, rows = "__pid", "__local", "__shift", "__rows"
    sorted_ = df.repartitionByRange(*keys, *order).withColumn(pid, F.spark_partition_id())
    local_rows = staged(sorted_.withColumn(local, F.row_number().over(Window.partitionBy(pid, *keys).orderBy(*order)) - 1))
    counts = local_rows.groupBy(*keys, pid).agg(F.count("*").alias(rows))
    before = Window.partitionBy(*keys).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    shifts = small(counts.withColumn(shift, F.coalesce(F.sum(rows).over(before), F.lit(0))).drop(rows))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, pid)]
    joined = local_rows.alias("l").join(shifts.alias("r"), same)
    return joined.select(*[F.col(f"l.{c}").alias(c) for c in df.columns], (F.col(f"l.{local}") + F.col(f"r.{shift}")).cast("long").alias(name))


def chunked(df: DataFrame, keys: Sequence[str], frame: str, left: int, right: int, add: Callable[[Window], dict[str, Column]], chunk: int = CHUNK) -> DataFrame:
    """df with columns from windows of bounded reach: left frames before, right frames after a row.

    add gets the window's specification (partitioned and ordered) and returns the new columns. Each row also goes to the
    neighbouring chunk whose rows can see it, so no task holds more than a chunk and its halo.
    """
    c, own = "__chunk", "__own"
    at = F.floor(F.col(frame) / chunk)
    seen_by = F.array_distinct(F.array(at, F.floor((F.col(frame) - right) / chunk), F.floor((F.col(frame) + left) / chunk)))
    if max(left, right) > chunk:
        seen_by = F.sequence(F.floor((F.col(frame) - right) / chunk), F.floor((F.col(frame) + left) / chunk))
    spread = df.withColumn(own, at).withColumn(c, F.explode(seen_by))
    w = Window.partitionBy(*keys, c).orderBy(frame)
    return spread.withColumns(add(w)).filter(F.col(c) == F.col(own)).drop(c, own)


def carried(df: DataFrame, keys: Sequence[str], frame: str, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """df with the last non-null value up to and including each row (null before the first one)."""
    c, here, last, before = "__chunk", "__here", "__last", "__before"
    rows = df.withColumn(c, F.floor(F.col(frame) / chunk)).withColumn(here, value)
    w = Window.partitionBy(*keys, c).orderBy(frame)
    rows = rows.withColumn(name, F.last(here, ignorenulls=True).over(w))
    ends = rows.filter(F.col(here).isNotNull()).groupBy(*keys, c).agg(F.max_by(here, frame).alias(last))
    all_chunks = rows.select(*keys, c).distinct().join(ends, [*keys, c], "left")
    past = Window.partitionBy(*keys).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    carry = all_chunks.select(*keys, c, F.last(last, ignorenulls=True).over(past).alias(before))
    return rows.join(carry, [*keys, c]).withColumn(name, F.coalesce(name, before)).drop(c, here, before)


def running_sum(df: DataFrame, keys: Sequence[str], frame: str, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """df with the sum of value up to and including each row."""
    c, here, before = "__chunk", "__here", "__before"
    rows = df.withColumn(c, F.floor(F.col(frame) / chunk)).withColumn(here, value)
    rows = rows.withColumn(name, F.sum(here).over(Window.partitionBy(*keys, c).orderBy(frame)))
    past = Window.partitionBy(*keys).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, c).agg(F.sum(here).alias("__sum")).select(*keys, c, F.coalesce(F.sum("__sum").over(past), F.lit(0)).alias(before))
    return rows.join(sums, [*keys, c]).withColumn(name, F.col(name) + F.col(before)).drop(c, here, before)


def with_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """df with grouped statistics of its keys joined to each row (aggregated first, so a hot key costs one row a task)."""
    return df.join(df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()]), list(keys))
