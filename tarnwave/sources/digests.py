"""SHA-256 of files that are too long for one task.

The digest is sequential, but its state is short. All tasks read ranges of the files and write them, in pieces, as a table;
rounds then go through all files at once, a range further each: a task gets one range of a file and the state after those
before it. So no task reads more of a file than a range, whatever the file's length; rounds grow with the longest file.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwave.operators.order import numbered, small
from tarnwave.sources.stage import file_system, staged, written

#: Bytes of a file that a round reads.
REACH = 128 << 20
#: What a text reader takes from the start of a file.
BOM = b"\xef\xbb\xbf"


class State(ctypes.Structure):
    """SHA256_CTX of OpenSSL."""

    _fields_ = [("h", ctypes.c_uint32 * 8), ("bits", ctypes.c_uint32 * 2), ("data", ctypes.c_uint32 * 16), ("num", ctypes.c_uint), ("length", ctypes.c_uint)]


@cache
def library() -> ctypes.CDLL | None:
    """The library under hashlib, whose state can be handed on (hashlib's own objects keep theirs); null where there is none."""
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        lib.SHA256_Init.argtypes = [ctypes.POINTER(State)]
        lib.SHA256_Update.argtypes = [ctypes.POINTER(State), ctypes.c_char_p, ctypes.c_size_t]
        lib.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.POINTER(State)]
    except (ImportError, AttributeError, OSError):
        return None
    known = bytes(range(200))
    return lib if digest(lib, further(lib, further(lib, begun(lib), known[:70]), known[70:])) == hashlib.sha256(known).hexdigest() else None


def begun(lib: ctypes.CDLL) -> bytes:
    state = State()
    lib.SHA256_Init(state)
    return bytes(state)


def further(lib: ctypes.CDLL, before: bytes, data: bytes) -> bytes:
    """The state after data."""
    state = State.from_buffer_copy(before)
    lib.SHA256_Update(state, data, len(data))
    return bytes(state)


def digest(lib: ctypes.CDLL, state: bytes) -> str:
    out = ctypes.create_string_buffer(32)
    lib.SHA256_Final(out, State.from_buffer_copy(state))
    return out.raw.hex()


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """at, block, i, size, data of lines (at, block, data): those of a batch and block with their line feeds, numbered by i."""
    last, i = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        at, block, data = batch.column("at"), batch.column("block"), batch.column("data")
        other = np.diff(at.dictionary_encode().indices.to_numpy()) | np.diff(block.to_numpy())
        cuts = [0, *(np.flatnonzero(other) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = at[a].as_py(), block[a].as_py()
            last, i = now, i + 1 if now == last else 0
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), data.slice(a, b - a)), b"\n")[0].as_py() + b"\n"
            yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([i]), pa.array([len(joined)]), pa.array([joined], pa.binary())], names=["at", "block", "i", "size", "data"])


def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """at, bytes, done, state after a range; batches: first the state of a file, then the pieces of its range in order."""
    lib, now = library(), None
    if lib is None:
        raise RuntimeError("this executor's Python has no OpenSSL whose SHA-256 can be carried on, but the driver's has")

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in now], names=["at", "bytes", "done", "state"])

    for batch in batches:
        for r in range(batch.num_rows):
            at, total, done, data = (batch.column(c)[r].as_py() for c in ("at", "bytes", "done", "data"))
            if total is not None:
                if now:
                    yield row()
                now = [at, total, done, data]
            else:
                data = data[: now[1] - now[2]]  # a line feed that the file's end doesn't have
                now[2:] = now[2] + len(data), further(lib, now[3], data)
    if now:
        yield row()


def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, total, done in zip(*(batch.column(c).to_pylist() for c in ("at", "bytes", "done")), strict=True):
            if total != done:
                raise ValueError(f"{at}: {done} of {total} bytes were read")
        yield pa.RecordBatch.from_arrays([batch.column("at"), pa.array([digest(library(), x) for x in batch.column("state").to_pylist()], pa.string())], names=["at", "sha256"])


def long_digests(lines: DataFrame, files: DataFrame, count: int, longest: int, reach: int = REACH) -> DataFrame:
    """at, sha256 of files (at, bytes), count of them, the longest of so many bytes.

    lines: at, block, data, what Spark's text reader makes of them, cut at line feeds alone (a file's path, the start of
    the range that a task read, the bytes of a line), so files come from wherever Spark reads. A line has to fit a task.
    """
    spark = files.sparkSession
    table = lines.mapInArrow(pieces, "at string, block long, i long, size long, data binary").withColumn("round", F.floor(F.col("block") / reach).cast("int"))
    place = written(table, "pieces", ["round"])
    table = spark.read.schema(table.schema).parquet(place)
    lost = F.col("bytes") - F.coalesce("size", F.lit(0))  # 0, or -1 without a line feed at the end; more by a byte order mark
    first = files.join(table.groupBy("at").agg(F.sum("size").alias("size")), "at", "left").withColumn("bom", lost >= len(BOM) - 1)
    start = begun(library())
    done, begin = F.when(F.col("bom"), len(BOM)).otherwise(0).cast("long"), F.when(F.col("bom"), F.lit(further(library(), start, BOM))).otherwise(F.lit(start))
    state = staged(first.select("at", "bytes", done.alias("done"), begin.alias("state")), "digests")
    none = F.lit(None).cast("long")
    ids = small(numbered(files.select("at"), [], ["at"], "id").withColumn("id", F.col("id").cast("int")))  # so that no task gets two files
    for r in range((longest - 1) // reach + 1):
        ranges = table.filter(F.col("round") == r).select("at", none.alias("bytes"), none.alias("done"), "block", "i", "data")
        before = state.select("at", "bytes", "done", F.lit(-1).alias("block"), F.lit(0).alias("i"), F.col("state").alias("data"))
        dealt = before.unionByName(ranges).join(ids, "at").repartitionById(count, "id").sortWithinPartitions("at", "block", "i")
        state = staged(dealt.mapInArrow(carried, "at string, bytes long, done long, state binary"), "digests")
    kept, where = file_system(spark, place)
    kept.delete(where, True)
    return state.mapInArrow(finished, "at string, sha256 string")
