"""Sums over many settings (periods, phases) of rows that are read once.

Trying a setting means sums over all rows. Multiplying rows by settings before a shuffle would cost that many times the
table; here each task folds its rows into sums for all settings at once, so what is shuffled is one row for each setting,
key and task. Where a setting groups neighbouring rows into symbols, a chunk of frames sums the symbols inside it, and
only those across its border travel on their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwave.operators.order import CHUNK

#: Keys whose sums a task holds before it sends them on.
HELD = 256


def kinds_of(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def runs_of_keys(batch: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Each combination of keys in a batch, and its rows."""
    code = np.zeros(batch.num_rows, np.int64)
    for c in keys:
        names = batch.column(c).dictionary_encode(null_encoding="encode")
        code = code * max(1, len(names.dictionary)) + names.indices.to_numpy(zero_copy_only=False)
        code = np.unique(code, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(order) else ():
        yield tuple(batch.column(c)[int(part[0])].as_py() for c in keys), part


def folded(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], sums: Sequence[str], size: int, run: Callable[..., np.ndarray]) -> DataFrame:
    """keys, i (0 to size - 1), and sums: what run gives, added up over all rows of the keys.

    run gets the columns of some rows as arrays and returns size rows of sums.
    """
    kinds = kinds_of(rows, keys)
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        schema = None

        def told() -> pa.RecordBatch:
            k = len(held)
            own = {c: pa.array([x for key in held for x in [key[j]] * size], schema.field(c).type) for j, c in enumerate(keys)}
            values = np.concatenate(list(held.values()))
            return pa.RecordBatch.from_pydict(own | {"i": pa.array(np.tile(np.arange(size), k), pa.int32())} | {c: pa.array(values[:, j]) for j, c in enumerate(sums)})

        for batch in batches:
            schema = batch.schema
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            for key, part in runs_of_keys(batch, keys):
                found = run(*(c[part] for c in cols))
                held[key] = held[key] + found if key in held else found
            if len(held) > HELD:
                yield told()
                held = {}
        if held:
            yield told()

    per = rows.select(*keys, *columns).mapInArrow(go, ", ".join([*([kinds] if kinds else []), "i int", *(f"{c} double" for c in sums)]))
    return per.groupBy(*keys, "i").agg(*[F.sum(c).alias(c) for c in sums])


def sampled(frame: np.ndarray, n: np.ndarray, first: np.ndarray, period: np.ndarray) -> np.ndarray:
    """For each setting (first, period) and row: whether its frame is the one nearest to first + k * period before n - 1."""
    first, period = first[:, None], period[:, None]
    k = np.rint((frame[None, :] - first) / period)
    return (k >= 0) & (k < np.ceil((n[None, :] - 1 - first) / period)) & (np.rint(first + k * period) == frame[None, :])


def symbol_moments(signal: DataFrame, settings: Sequence[tuple[float, float]], keys: Sequence[str] = ("lamp",), v: str = "v", chunk: int = CHUNK) -> DataFrame:
    """keys, i (of the setting), n (symbols), m1, m2 (sums of their means and squared means), within (squared deviations
    inside symbols), c (frames). settings: (period, phase); frames before the first edge belong to symbol 0.
    """
    kinds = kinds_of(signal, keys)

    def run(table: pa.Table) -> pa.Table:
        frame, value = table["__f"].to_numpy(), table["__v"].to_numpy()
        order = np.argsort(frame, kind="stable")
        frame, value = frame[order].astype(float), value[order]
        square = value * value
        out: dict[str, list] = {c: [] for c in ("i", "k", "n", "m1", "m2", "within", "c", "s1", "s2")}

        def add(**row: float | None) -> None:
            for c, x in out.items():
                x.append(row.get(c))

        for i, (period, phase) in enumerate(settings):
            k = np.maximum(np.floor((frame - phase) / period), 0).astype(np.int64)
            head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            s1, s2, c = np.add.reduceat(value, head), np.add.reduceat(square, head), np.diff(np.r_[head, len(k)])
            for j in {0, len(head) - 1}:  # may go on in a neighbouring chunk
                add(i=i, k=int(k[head[j]]), c=float(c[j]), s1=s1[j], s2=s2[j])
            inside = slice(1, len(head) - 1)
            mean = s1[inside] / c[inside]
            add(i=i, n=float(len(mean)), m1=mean.sum(), m2=(mean * mean).sum(), within=(s2[inside] - s1[inside] * mean).sum(), c=float(c[inside].sum()))
        types = {"i": pa.int32(), "k": pa.int64()}
        m = len(out["i"])
        return pa.table({q: pa.chunked_array([pa.repeat(table[q][0], m)]) for q in keys} | {c: pa.array(x, types.get(c, pa.float64())) for c, x in out.items()})

    rows = signal.select(*keys, F.col("frame").cast("long").alias("__f"), F.col(v).cast("double").alias("__v"))
    sums = "n double, m1 double, m2 double, within double, c double"
    parts = rows.groupBy(*keys, F.floor(F.col("__f") / chunk).alias("__c")).applyInArrow(run, f"{kinds}, i int, k long, {sums}, s1 double, s2 double")
    # a symbol's parts meet; whole chunks pass as they are, one row for each setting
    whole = parts.groupBy(*keys, "i", "k").agg(*[F.sum(c).alias(c) for c in ("n", "m1", "m2", "within", "c", "s1", "s2")])
    mean, cut = F.col("s1") / F.col("c"), F.col("k").isNotNull()
    whole = whole.select(*keys, "i", F.when(cut, 1.0).otherwise(F.col("n")).alias("n"), F.when(cut, mean).otherwise(F.col("m1")).alias("m1"), F.when(cut, mean * mean).otherwise(F.col("m2")).alias("m2"), F.when(cut, F.col("s2") - F.col("s1") * mean).otherwise(F.col("within")).alias("within"), "c")
    return whole.groupBy(*keys, "i").agg(*[F.sum(c).alias(c) for c in ("n", "m1", "m2", "within", "c")])
