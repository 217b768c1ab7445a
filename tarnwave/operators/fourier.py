"""Fourier transforms and all-lag correlations of streams longer than a task, by rows and columns of a matrix.

A stream of n samples, padded to N = rows x columns, lies in a matrix row by row. Its transform is a transform of each
column, a turn of each entry by its own angle, and a transform of each row; the inverse goes the same way back. Blocks
of neighbouring columns, then of neighbouring rows, are the groups of a shuffle, so a task holds `cells` entries at most
(or one column or row, some sqrt(N)). Work grows as n log n, and each entry is shuffled once for a direction.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwave.operators.order import small

#: Entries (16 bytes each) that a task holds.
CELLS = 1 << 21


@dataclass(frozen=True)
class Layout:
    """The matrix of a stream of n samples: room for all its lags, sides that are powers of 2, blocks of columns and rows."""

    n: int
    cells: int

    @property
    def size(self) -> int:
        return 1 << max(2, (2 * self.n - 1).bit_length())

    @property
    def rows(self) -> int:
        return 1 << (self.size.bit_length() - 1) // 2

    @property
    def columns(self) -> int:
        return self.size // self.rows

    @property
    def wide(self) -> int:
        """Columns of a block."""
        return min(self.columns, max(1, self.cells // self.rows))

    @property
    def high(self) -> int:
        """Rows of a block."""
        return min(self.rows, max(1, self.cells // self.columns))

    def turns(self, first_row: int, rows: int, first_column: int, columns: int) -> np.ndarray:
        """The angles' unit numbers of a part of the matrix (rows are frequencies here)."""
        r, c = np.arange(first_row, first_row + rows), np.arange(first_column, first_column + columns)
        return np.exp(-2j * np.pi * ((r[:, None] * c[None, :]) % self.size) / self.size)


def column_block(n: Column, k: Column, cells: int) -> Column:
    """The block of columns that sample k of a stream of n lies in; Layout in terms of columns."""
    bits = F.greatest(F.length(F.bin(2 * n - 1)), F.lit(2))
    row_bits = F.floor(bits / 2)
    columns = F.pow(F.lit(2.0), bits - row_bits).cast("long")
    wide = F.least(columns, F.greatest(F.lit(1).cast("long"), F.floor(F.lit(cells) / F.pow(F.lit(2.0), row_bits))))
    return F.floor(F.pmod(k, columns) / wide)


def lag_sums(rows: DataFrame, value: Column, keys: Sequence[str], k: str = "k", cells: int = CELLS, whole: bool = False) -> DataFrame:
    """keys, lag (from 0 to n - 1), s, n: the sum of products of samples so far apart, and the stream's length.

    rows: one for each sample, k from 0 on without gaps (a missing one counts as 0). Keys are taken as they are, null
    among them. whole: samples are whole numbers, so sums are rounded to whole numbers.
    """
    cells = 1 << (cells.bit_length() - 1)  # blocks divide sides, all powers of 2
    size = small(rows.groupBy(*keys).agg((F.max(k) + 1).alias("__n")))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
    samples = rows.select(*keys, F.col(k).cast("long").alias("__k"), value.cast("double").alias("__x")).alias("a").join(size.alias("b"), same)
    samples = samples.select(*[F.col(f"a.{c}").alias(c) for c in keys], "__k", "__x", "__n")
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    part = f"{kinds}, __n long, __cb long, __rb long, __m binary"

    def told(table: pa.Table, more: dict) -> pa.Table:
        """A table with the group's keys repeated beside the columns of more."""
        m = len(next(iter(more.values())))
        return pa.table({c: pa.chunked_array([pa.repeat(table[c][0], m)]) for c in (*keys, "__n")} | more)

    def shape(table: pa.Table) -> Layout:
        return Layout(table["__n"][0].as_py(), cells)

    def forward(table: pa.Table) -> pa.Table:
        """Columns of samples to parts of blocks of rows."""
        at, block = shape(table), table["__cb"][0].as_py()
        place, first = table["__k"].to_numpy(), block * at.wide
        x = np.zeros((at.rows, at.wide))
        x[place // at.columns, place % at.columns - first] = table["__x"].to_numpy()
        y = np.fft.fft(x, axis=0) * at.turns(0, at.rows, first, at.wide)
        parts = y.reshape(at.rows // at.high, at.high, at.wide)
        return told(table, {"__cb": pa.array([block] * len(parts)), "__rb": pa.array(np.arange(len(parts))), "__m": pa.array([p.tobytes() for p in parts], pa.binary())})

    def power(table: pa.Table) -> pa.Table:
        """Rows of the transform, their squares, and the way back as far as rows go: parts of blocks of columns."""
        at, block = shape(table), table["__rb"][0].as_py()
        y = np.zeros((at.high, at.columns), complex)
        for cb, m in zip(table["__cb"].to_pylist(), table["__m"], strict=True):
            y[:, cb * at.wide : (cb + 1) * at.wide] = np.frombuffer(m.as_buffer(), complex).reshape(at.high, at.wide)
        y = np.fft.fft(y, axis=1)
        z = np.fft.ifft(y.real**2 + y.imag**2, axis=1) * np.conj(at.turns(block * at.high, at.high, 0, at.columns))
        parts = [z[:, a : a + at.wide].tobytes() for a in range(0, at.columns, at.wide)]
        return told(table, {"__cb": pa.array(np.arange(len(parts))), "__rb": pa.array([block] * len(parts)), "__m": pa.array(parts, pa.binary())})

    def back(table: pa.Table) -> pa.Table:
        """Columns of lags."""
        at, block = shape(table), table["__cb"][0].as_py()
        z = np.zeros((at.rows, at.wide), complex)
        for rb, m in zip(table["__rb"].to_pylist(), table["__m"], strict=True):
            z[rb * at.high : (rb + 1) * at.high] = np.frombuffer(m.as_buffer(), complex).reshape(at.high, at.wide)
        s = np.fft.ifft(z, axis=0).real
        lag = np.arange(at.rows)[:, None] * at.columns + np.arange(block * at.wide, (block + 1) * at.wide)[None, :]
        inside = lag < at.n
        s = np.rint(s[inside]) if whole else s[inside]
        return told(table, {"lag": pa.array(lag[inside]), "s": pa.array(s)})

    out = samples.withColumn("__cb", column_block(F.col("__n"), F.col("__k"), cells))
    out = out.groupBy(*keys, "__cb").applyInArrow(forward, part)
    out = out.groupBy(*keys, "__rb").applyInArrow(power, part)
    out = out.groupBy(*keys, "__cb").applyInArrow(back, f"{kinds}, __n long, lag long, s double")
    return out.select(*keys, "lag", "s", F.col("__n").alias("n"))
