"""NumPy array files (.npy, and the named arrays of .npz) as a data source, and a writer of signals in that form.

    spark.dataSource.register(arrays.ArraySource)
    spark.read.format("arrays").option("path", folder).option("names", "level,square").option("first", 1000).load()

Rows: file, name (empty for .npy), frame (place along the first axis), cell (place in the rest, 0 for a plain series), v.
A task reads a range of bytes: arrays are laid out row by row, so a range of frames is one. Only compressed members of an
.npz have to be unpacked from their start. names, first and last (frames, last included) leave other bytes unread.
"""

from __future__ import annotations

import io
import posixpath
import struct
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tarnwave.operators.order import CHUNK

SCHEMA = "file string, name string, frame long, cell long, v double"
#: Bytes of an array that a task reads at most, and rows of an Arrow batch.
SPLIT, ROWS = 64 << 20, 1 << 16


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Header:
    """Where an array's values start in its file, and how they are laid out."""

    start: int
    shape: tuple[int, ...]
    kind: np.dtype

    @property
    def cells(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64))

    @property
    def frame_bytes(self) -> int:
        return self.cells * self.kind.itemsize


def header_of(file, at: int) -> Header:
    """The header of an array that begins at a place of an open file."""
    file.seek(at)
    version = np.lib.format.read_magic(file)
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
    if read is None:
        raise ValueError(f"array format {version} isn't supported")
    shape, by_column, kind = read(file)
    if kind.hasobject or kind.kind not in "biuf" or (by_column and len(shape) > 1) or not shape:
        raise ValueError(f"arrays of {kind} with shape {shape} aren't supported: numbers, row by row")
    return Header(file.tell(), shape, kind)


def members(file) -> list[tuple[str, int, bool]]:
    """Name, place of the array, and whether it is compressed, of each array of an open .npz."""
    out = []
    for m in zipfile.ZipFile(file).infolist():
        if m.filename.endswith(".npy"):
            file.seek(m.header_offset + 26)
            name, extra = struct.unpack("<HH", file.read(4))
            out.append((m.filename.removesuffix(".npy"), m.header_offset + 30 + name + extra, m.compress_type != zipfile.ZIP_STORED))
    return out


@dataclass
class Range(InputPartition):
    """Frames of one array."""

    file: str
    name: str
    at: int
    packed: bool
    first: int
    last: int


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.names = {x.strip() for x in options["names"].split(",")} if options.get("names") else None
        self.first, self.last = int(options.get("first", 0)), int(options.get("last", 1 << 62))
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> Sequence[InputPartition]:
        """Ranges of frames, from the headers alone."""
        system, root = opened(self.path)
        info = system.get_file_info(root)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        out = []
        for f in sorted((x.path for x in found if x.is_file and x.path.endswith((".npy", ".npz")) and not posixpath.basename(x.path).startswith((".", "_")))):
            with system.open_input_file(f) as file:
                for name, at, packed in members(file) if f.endswith(".npz") else [("", 0, False)]:
                    if self.names is not None and name not in self.names:
                        continue
                    if packed:
                        out.append(Range(f, name, at, True, self.first, self.last))
                        continue
                    h = header_of(file, at)
                    step, end = max(1, self.split // max(1, h.frame_bytes)), min(self.last + 1, h.shape[0])
                    out += [Range(f, name, at, False, a, min(a + step, end) - 1) for a in range(self.first, end, step)]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was planned
            return
        system, _ = opened(self.path)
        with system.open_input_file(partition.file) as file:
            if partition.packed:
                file = io.BytesIO(zipfile.ZipFile(file).read(f"{partition.name}.npy"))
            h = header_of(file, 0 if partition.packed else partition.at)
            last = min(partition.last, h.shape[0] - 1)
            step = max(1, ROWS // max(1, h.cells))
            for a in range(partition.first, last + 1, step):
                n = min(step, last + 1 - a)
                file.seek(h.start + a * h.frame_bytes)
                v = np.frombuffer(file.read(n * h.frame_bytes), h.kind).astype(float)
                frame, cell = np.divmod(np.arange(len(v)), max(1, h.cells))
                same = lambda x: pa.repeat(pa.scalar(x, pa.string()), len(v))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(partition.file), same(partition.name), pa.array(frame + a), pa.array(cell), pa.array(v)], names=["file", "name", "frame", "cell", "v"])


class ArraySource(DataSource):
    """The format `arrays`; options: path, and names, first, last, split."""

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArrayReader(dict(self.options))


def load_arrays(spark: SparkSession, path: str, names: Sequence[str] = (), first: int = 0, last: int | None = None, split: int = SPLIT) -> DataFrame:
    """file, name, frame, cell, v of the arrays below a folder (or of one file); names: of the arrays of .npz that are read."""
    spark.dataSource.register(ArraySource)
    read = spark.read.format("arrays").option("path", path).option("first", str(first)).option("split", str(split))
    if names:
        read = read.option("names", ",".join(names))
    return (read if last is None else read.option("last", str(last))).load()


def save_arrays(signal: DataFrame, path: str, names: Sequence[str], key: str = "lamp", chunk: int = CHUNK) -> DataFrame:
    """Writes each channel's columns `names` as the named arrays of .npz files, a file for each chunk of its frames.

    Returns the manifest: key, file, first (frame of the file's first place), frames. A task that runs again writes the
    same file again; a file shows under its name only when it is whole. Frames must have no gaps.
    """
    kind = signal.schema[key].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.take(np.argsort(table["frame"].to_numpy(), kind="stable"))
        first = table["frame"][0].as_py()
        system, root = opened(path)
        system.create_dir(root, recursive=True)
        raw = io.BytesIO()
        np.savez(raw, **{c: table[c].to_numpy() for c in names})
        # channels are told apart by a hash, as their names may not do for files
        at = f"{root}/{table['__id'][0].as_py()}-{first // chunk:08d}.npz"
        with system.open_output_stream(at + ".part") as out:
            out.write(raw.getvalue())
        system.move(at + ".part", at)
        return pa.table({key: table[key][:1], "file": [at], "first": pa.array([first], pa.int64()), "frames": pa.array([table.num_rows], pa.int64())})

    rows = signal.select(key, F.sha2(F.col(key).cast("string"), 256).alias("__id"), F.col("frame").cast("long").alias("frame"), *[F.col(c).cast("double").alias(c) for c in names])
    return rows.groupBy(key, F.floor(F.col("frame") / chunk).alias("__c")).applyInArrow(run, f"`{key}` {kind}, file string, first long, frames long")
