"""Edit distances of long streams, with their insertions, deletions and substitutions.

The table of all prefixes is walked along its anti-diagonals, a whole diagonal at a time, inside a band around the main
diagonal. A script that leaves a band of half-width k has more than k insertions or deletions, so a distance of at most k
is proved; else the band widens to twice its width. So two streams of n symbols with d edits cost some n * d steps, not
n * n. Of all cheapest scripts, those with the fewest insertions and deletions count.

Long streams that differ much are not one task's work: their table is cut into tiles, and all tiles of an anti-diagonal
are walked at once, each by a task that holds two blocks of symbols and the costs along its borders.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwave.sources.stage import staged

#: One edit, in units of which an insertion or deletion costs one more: costs compare by edits, then by these.
EDIT = 1 << 32
FAR = 1 << 62
#: Symbols of a tile's side at least, and tiles along the longer stream at most.
SIDE, TILES = 1 << 14, 24


def edits(a: np.ndarray, b: np.ndarray, band: int = 64) -> tuple[int, int, int, int]:
    """distance, insertions, deletions, substitutions that turn a into b."""
    n, m = len(a), len(b)
    band = max(band, abs(n - m))
    while True:
        cost = within(a, b, band)
        if cost // EDIT <= band or band >= max(n, m):
            break
        band *= 2
    distance, moved = divmod(cost, EDIT)
    return distance, (moved + m - n) // 2, (moved - m + n) // 2, distance - moved


def within(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The least cost of a script that stays in the band: edits * EDIT + insertions and deletions."""
    n, m = len(a), len(b)
    step = EDIT + 1
    # by place j - i + band + 1, with a border on either side; last: of the anti-diagonal before, older: of the one before that
    older = np.full(2 * band + 3, FAR, np.int64)
    last, now = older.copy(), older.copy()
    last[band + 1] = 0
    if n == m == 0:
        return 0
    back = a[::-1]
    for s in range(1, n + m + 1):
        # diagonals d = j - i of this sum that lie inside the band and the table
        low, high = max(-band, -s, s - 2 * n), min(band, s, 2 * m - s)
        low += (low + s) % 2
        high -= (high + s) % 2
        if low > high:
            older, last, now = last, now, older
            continue
        at = slice(low + band + 1, high + band + 2, 2)
        best = np.minimum(last[low + band : high + band + 1 : 2], last[low + band + 2 : high + band + 3 : 2]) + step
        # the diagonal step needs a symbol of each
        d0, d1 = max(low, 2 - s), min(high, s - 2)
        d0 += (d0 + s) % 2
        d1 -= (d1 + s) % 2
        if d0 <= d1:
            i0, j0, count = (s - d0) // 2, (s + d0) // 2, (d1 - d0) // 2 + 1
            x, y = back[n - i0 : n - i0 + count], b[j0 - 1 : j0 - 1 + count]
            part = best[(d0 - low) // 2 : (d0 - low) // 2 + count]
            np.minimum(part, older[d0 + band + 1 : d1 + band + 2 : 2] + np.where(x == y, 0, EDIT), out=part)
        now[:] = FAR
        now[at] = best
        older, last, now = last, now, older
    return int(last[m - n + band + 1])


def with_edits(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with distance, insertions, deletions, substitutions (longs) of turning text a into text b, by code points.

    Null where either text is null.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    names = ("distance", "insertions", "deletions", "substitutions")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                x, y = batch.column(a)[i].as_py(), batch.column(b)[i].as_py()
                found.append((None,) * 4 if x is None or y is None else edits(code(x), code(y)))
            more = {c: pa.array([r[j] for r in found], pa.int64()) for j, c in enumerate(names)}
            yield pa.RecordBatch.from_pydict(dict(zip(batch.schema.names, batch.columns, strict=True)) | more)

    return pairs.mapInArrow(run, f"{kinds}, {', '.join(f'{c} long' for c in names)}")


def texts_of(bits: DataFrame, keys: Sequence[str], symbol: Column, name: str, k: str = "k") -> DataFrame:
    """keys and a text: a stream's symbols in their order. A stream is one value, a byte for each symbol."""
    rows = bits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(k, symbol.cast("string").alias("__s")))).alias("__x"))
    return rows.select(*keys, F.array_join(F.transform("__x", lambda p: p["__s"]), "").alias(name))


def stream_edits(pred: DataFrame, ref: DataFrame, keys: Sequence[str], side: int = SIDE) -> DataFrame:
    """keys, n_ref, distance, insertions, deletions, substitutions, rate: what turns ref's bits into pred's.

    Streams of up to `side` symbols, and those within the first band, take one task; others are dealt to tiles.
    """
    both = texts_of(ref, keys, F.col("bit"), "__a").join(texts_of(pred, keys, F.col("bit"), "__b"), list(keys))
    looked = staged(with_bounds(both, side), "edits-bounds")
    costs = looked.filter("__exact").select(*keys, "__n", "__m", "__cost")
    far = looked.filter("not __exact")
    if not far.isEmpty():
        costs = costs.unionByName(tiled(far, keys, side))
    distance, moved = F.expr(f"__cost div {EDIT}"), F.col("__cost") % EDIT
    found = costs.withColumns({"distance": distance, "__moved": moved, "n_ref": F.col("__n")})
    ways = [F.expr("(__moved + __m - __n) div 2").alias("insertions"), F.expr("(__moved - __m + __n) div 2").alias("deletions"), (F.col("distance") - F.col("__moved")).alias("substitutions")]
    return found.select(*keys, "n_ref", "distance", *ways, F.try_divide("distance", "n_ref").alias("rate"))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def with_bounds(pairs: DataFrame, side: int) -> DataFrame:
    """pairs (__a, __b) with __n, __m (symbols), __cost of a script that turns a into b, and __exact: whether none is cheaper."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)

    def look(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, bool]:
        n, m = len(a), len(b)
        if max(n, m) <= side:
            distance, more, less, _ = edits(a, b)
            return n, m, distance * EDIT + more + less, True
        both = min(n, m)
        plain = (int((a[:both] != b[:both]).sum()) + abs(n - m)) * EDIT + abs(n - m)
        if abs(n - m) > 64:
            return n, m, plain, False
        cost = min(plain, within(a, b, 64))
        return n, m, cost, cost // EDIT <= 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [look(codes(batch.column("__a")[i].as_py()), codes(batch.column("__b")[i].as_py())) for i in range(batch.num_rows)]
            more = {c: pa.array([r[j] for r in found], k) for j, (c, k) in enumerate((("__n", pa.int64()), ("__m", pa.int64()), ("__cost", pa.int64()), ("__exact", pa.bool_())))}
            yield pa.RecordBatch.from_pydict(dict(zip(batch.schema.names, batch.columns, strict=True)) | more)

    return pairs.mapInArrow(run, f"{kinds}, __n long, __m long, __cost long, __exact boolean")


def walked(a: np.ndarray, b: np.ndarray, top: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The costs along a tile's lower border (with its left corner) and its right one (without the upper corner), of
    those along the upper (with the left corner) and the left one (without it). a: symbols of its rows, b: of its columns.
    """
    step, rows, columns = EDIT + 1, len(a), len(b)
    # costs less one step for each row and column: a step down or to the right is free, a diagonal one saves
    now = top - np.arange(columns + 1) * step
    down = left - np.arange(1, rows + 1) * step
    saved = {x: np.where(b == x, -2 * step, EDIT - 2 * step) for x in np.unique(a).tolist()}
    right, way = np.empty(rows, np.int64), np.empty(columns, np.int64)
    for i, x in enumerate(a.tolist()):
        np.add(now[:-1], saved[x], out=way)
        np.minimum(now[1:], way, out=now[1:])
        now[0] = down[i]
        np.minimum.accumulate(now, out=now)
        right[i] = now[-1]
    return now + (np.arange(columns + 1) + rows) * step, right + (np.arange(1, rows + 1) + columns) * step


def tiled(pairs: DataFrame, keys: Sequence[str], side: int) -> DataFrame:
    """keys, __n, __m and the least __cost of pairs (of with_bounds), by tiles.

    A script no dearer than the known one stays within as many diagonals of the main one as that has edits; tiles
    beyond are left out. The borders of each anti-diagonal of tiles are a written table.
    """
    pairs = pairs.withColumn("__side", F.greatest(F.lit(side), F.ceil(F.greatest("__n", "__m") / TILES)).cast("long"))
    pairs = pairs.withColumn("__band", F.expr(f"__cost div {EDIT}"))
    known = [*keys, "__n", "__m", "__side", "__band"]

    def blocks(n: str, text: str, at: str, name: str) -> DataFrame:
        cut = pairs.select(*keys, "__side", text, F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col(n) / F.col("__side")) - 1, F.lit(0)).cast("long"))).alias(at))
        return staged(cut.select(*keys, at, F.substring(F.col(text), (F.col(at) * F.col("__side") + 1).cast("int"), F.col("__side").cast("int")).alias(name)), "edits-blocks")

    rows, columns = blocks("__n", "__a", "__i", "__x"), blocks("__m", "__b", "__j", "__y")
    where = pairs.select(*known).join(rows.select(*keys, "__i"), list(keys)).join(columns.select(*keys, "__j"), list(keys))
    least = (F.col("__j") - F.col("__i") - 1) * F.col("__side"), (F.col("__i") - F.col("__j") - 1) * F.col("__side")
    where = staged(where.filter(F.greatest(*least) <= F.col("__band")).withColumn("__wave", F.col("__i") + F.col("__j")), "edits-tiles")
    kinds = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = EDIT + 1
        for batch in batches:
            for r in range(batch.num_rows):
                i, j, size, n, m = (batch.column(c)[r].as_py() for c in ("__i", "__j", "__side", "__n", "__m"))
                a, b = (codes(batch.column(c)[r].as_py()) for c in ("__x", "__y"))
                top, left = (batch.column(c).slice(r, 1) for c in ("__top", "__left"))
                # along the table's own edges costs are insertions or deletions alone; beyond the band nothing comes in
                top = top.flatten().to_numpy() if top.null_count == 0 else (np.arange(len(b) + 1) + j * size) * step if i == 0 else np.full(len(b) + 1, FAR)
                left = left.flatten().to_numpy() if left.null_count == 0 else (np.arange(1, len(a) + 1) + i * size) * step if j == 0 else np.full(len(a), FAR)
                low, right = walked(a, b, top, left)
                end = (i + 1) * size >= n and (j + 1) * size >= m
                out = [(i, j, "end", low[-1:])] if end else [(i + 1, j, "top", low), (i, j + 1, "left", right)]
                own = {c: pa.array([batch.column(c)[r].as_py()] * len(out), batch.schema.field(c).type) for c in keys}
                to, by, kind, cost = zip(*out, strict=True)
                yield pa.RecordBatch.from_pydict(own | {"__i": pa.array(to, pa.int64()), "__j": pa.array(by, pa.int64()), "__kind": pa.array(kind), "__costs": pa.array(cost, pa.list_(pa.int64()))})

    at = [*keys, "__i", "__j"]
    borders, ends = None, []
    for wave, tiles in sorted(map(tuple, where.groupBy("__wave").count().collect())):
        now = where.filter(F.col("__wave") == wave).join(rows, [*keys, "__i"]).join(columns, [*keys, "__j"])
        for kind in ("top", "left"):
            if borders is None:
                now = now.withColumn(f"__{kind}", F.lit(None).cast("array<bigint>"))
            else:
                now = now.join(borders.filter(F.col("__kind") == kind).select(*at, F.col("__costs").alias(f"__{kind}")), at, "left")
        now = now.select(*at, "__side", "__n", "__m", "__x", "__y", "__top", "__left").repartition(tiles)
        borders = staged(now.mapInArrow(run, f"{kinds}, __i long, __j long, __kind string, __costs array<bigint>"), "edits-borders")
        ends.append(borders.filter("__kind = 'end'").select(*keys, F.col("__costs")[0].alias("__cost")))
    found = ends[0]
    for more in ends[1:]:
        found = found.unionByName(more)
    return pairs.select(*keys, "__n", "__m").join(found, list(keys))
