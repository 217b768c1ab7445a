"""Shared pieces of the text operators: slices of batches, values of substrings and words, and held-out rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwave.sources.stage import staged as staged  # noqa: PLC0414  used by the operators

#: Bytes of text handled at once inside a task; a longer text is a slice of its own.
SLICE_BYTES = 1_000_000
U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], text: int = 1, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cuts Arrow batches into slices of about `size` bytes of text, before any becomes Python; a null text counts as empty."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right")))
            part = batch.slice(start, stop - start)
            yield part, [t or "" for t in part.column(text).to_pylist()]
            start = stop


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; at the task's end, its worker gives free memory back, as Spark keeps workers for later stages."""

    @wraps(run)
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return go


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and starts.max(initial=0) < 1 << 30 else np.int64
    return np.arange(total, dtype=kind) + np.repeat((starts - (ends - lengths)).astype(kind), lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds) over uint64 values."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xA0761D6478BD642F)
    x ^= x >> U(32)
    return x


class Hashes:
    """64-bit values of all substrings of a flat buffer of bytes or code points, by polynomial prefix sums (base: odd)."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, flat: np.ndarray, base: int = BASE):
        n = len(flat)
        if base not in Hashes.powers or len(Hashes.powers[base][0]) < n + 1:
            size = max(n + 1, SLICE_BYTES + (1 << 16))
            Hashes.powers[base] = tuple(np.cumprod(np.r_[U(1), np.full(size, b, np.uint64)]) for b in (base, pow(base, -1, 1 << 64)))
        powers, self.inverses = Hashes.powers[base]
        self.sums = np.zeros(n + 1, np.uint64)
        part = flat.astype(np.uint64)
        part += U(1)
        part *= U(0xC2B2AE3D27D4EB4F)
        part *= powers[:n]
        np.cumsum(part, out=self.sums[1:])

    def __call__(self, at: np.ndarray, length) -> np.ndarray:
        return mix((self.sums[at + length] - self.sums[at]) * self.inverses[at])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.inverses[:n])


def word_values(flat: np.ndarray, inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the words of a flat buffer: the maximal runs where inside holds, which the buffer's texts must not share.

    Returns the values, one text after the other, and each text's number of words. ends: of the texts in the buffer.
    """
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False]))
    start, stop = edge[::2], edge[1::2]
    n = np.diff(np.r_[0, np.searchsorted(start, ends)])
    return Hashes(flat)(start, stop - start), n


@cache
def space_tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: its lower case (A-Z alone), and whether it is inside a word (none of 0x20, 0x09 to 0x0D)."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    inside = np.ones(256, bool)
    inside[[0x20, *range(0x09, 0x0E)]] = False
    return low, inside


def spaced_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Values of the words between white space, A-Z in lower case: of all texts; words of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    flat = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    low, inside = space_tables()
    return word_values(low[flat], inside[flat], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1))


@cache
def letter_table() -> np.ndarray:
    """Of each code point: whether it is a letter or digit, as [^\\W_] in regular expressions."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def letter_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Values of the runs of letters and digits in lower case: of all texts; words of each text."""
    low = [t.lower() for t in texts]
    flat = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    return word_values(flat, letter_table()[flat], np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + 1))


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels no model may learn from: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
