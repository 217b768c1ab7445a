"""How plans name their queries and say them in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Book:
    """Queries by name, and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable:
        def add(fn: Callable) -> Callable:
            self.queries[name] = fn
            if sql:
                self.oracles[name] = sql
            return fn

        return add


def r6(column: str | Column, name: str | None = None) -> Column:
    """A figure rounded to 6 decimals, so that the order of additions doesn't show."""
    col = F.col(column) if isinstance(column, str) else column
    return F.round(col, 6).alias(name or column)


#: The symbol period and shared steps in SQL.
T = "(CAST(260 AS DOUBLE) / CAST(92 AS DOUBLE))"
THR = "stats AS (SELECT lamp, count(*) AS n, (quantile_cont(v, 0.1) + quantile_cont(v, 0.9)) / 2 AS thr, max(v) - min(v) AS span FROM signal GROUP BY lamp)"
DEV = "dev AS (SELECT lamp, frame, v, v - thr AS d, n, thr, span FROM signal JOIN stats USING (lamp))"


def windows(phases: int = 1, margin: str = "0") -> str:
    """CTE win: lamp, phase_id, phase, k, lo, hi of all symbols at so many phases."""
    return f"""ph AS (SELECT CAST(i AS BIGINT) AS phase_id, i * ({T} / {phases}) AS phase FROM range({phases}) t(i)),
    win0 AS (SELECT lamp, n, phase_id, phase, unnest(range(CAST(floor((n - phase - 1) / {T}) AS BIGINT))) AS k FROM stats, ph),
    win AS (SELECT lamp, n, phase_id, phase, k, CAST(ceil(phase + k * {T}) AS BIGINT) AS lo,
      CAST(greatest(floor((phase + k * {T}) + {T} - CAST({margin} AS DOUBLE)), ceil(phase + k * {T})) AS BIGINT) AS hi FROM win0)"""


NEAREST = f"""val AS (SELECT w.lamp, phase_id, k, d AS x FROM win w JOIN dev d ON d.lamp = w.lamp AND d.frame = CAST(least(greatest(round_even(w.lo - CAST(0.5 AS DOUBLE) + {T} / 2, 0), 0), w.n - 1) AS BIGINT))"""
AVERAGE = "val AS (SELECT w.lamp, phase_id, k, avg(d) AS x FROM win w JOIN dev d ON d.lamp = w.lamp AND d.frame BETWEEN w.lo AND w.hi GROUP BY ALL)"
CONFIDENT = "val AS (SELECT lamp, phase_id, k, d AS x FROM (SELECT w.lamp, phase_id, k, d, row_number() OVER (PARTITION BY w.lamp, phase_id, k ORDER BY abs(d) DESC, d.frame) AS i FROM win w JOIN dev d ON d.lamp = w.lamp AND d.frame BETWEEN w.lo AND w.hi) WHERE i = 1)"
BITS = "bits AS (SELECT lamp, phase_id, k, CAST(x > 0 AS BIGINT) AS bit, abs(x) AS margin FROM val)"
