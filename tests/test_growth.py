"""What grows with the variants or the stream stays inside tasks: plans of decodes, moving averages and synthetic streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwave.operators import symbols, synth, windows


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def brute(rows, rule, phases, shifts, n):
    """(phase_id, k) to bit; rows: frame to (v, thr, span)."""
    out = {}
    for i, (phase, shift) in enumerate(zip(phases, shifts, strict=True)):
        for k in range(int(np.floor((n - phase - 1) / symbols.PERIOD))):
            lo = int(np.ceil(phase + k * symbols.PERIOD))
            hi = max(int(np.floor(phase + k * symbols.PERIOD + symbols.PERIOD)), lo)
            d = [v - (t + shift * s) for f in range(lo, hi + 1) if f in rows for v, t, s in [rows[f]]]
            if d:
                x = sum(d) / len(d) if rule == "average" else max(d, key=abs)
                out[i, k] = int(x > 0)
    return out


@pytest.mark.parametrize("rule", ["average", "confident"])
def test_decodes_shuffle_no_row_for_each_variant(spark, rule):
    r = np.random.default_rng(3)
    n = 3 * symbols.DEALT + 77
    keep = np.flatnonzero(r.random(n) > 0.1).tolist()  # windows with missing frames as well
    rows = {f: (float(v), float(t), 2.0) for f, v, t in zip(keep, r.normal(size=len(keep)), r.normal(size=len(keep)) / 4, strict=True)}
    df = spark.createDataFrame([("a", f, *x, n) for f, x in rows.items()], "lamp string, frame long, v double, thr double, span double, n long")
    phases, shifts = [*symbols.phases(5), 0.3], [0.0, 0.1, -0.1, 0.0, 0.2, 0.0]
    got = symbols.decode(df, rule, phases, shifts=shifts)
    assert "Aggregate" not in plan(got)
    assert {(x.phase_id, x.k): x.bit for x in got.collect()} == brute(rows, rule, phases, shifts, n)


def test_moving_averages_deal_rows_once(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=300)
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "lamp string, frame long, v double")
    made = windows.moving_averages(df, {f"m{w}": ("v", w) for w in (1, 4, 9)})
    assert plan(made).count("Window [") == 1
    got = made.orderBy("frame").toPandas()
    for w in (1, 4, 9):
        pad = np.r_[np.repeat(v[0], w // 2), v, np.repeat(v[-1], w - 1 - w // 2)]
        assert np.allclose(got[f"m{w}"], np.convolve(pad, np.ones(w) / w, "valid"))


def test_rolling_z_repeats_no_step(spark):
    df = spark.createDataFrame([("a", i, float(i * 7 % 5)) for i in range(120)], "lamp string, frame long, v double")
    made = windows.rolling_zs(df, {"z": 10, "odd": 11})
    assert plan(made).count("Window [") == 1  # what comes before is written
    both = windows.rolling_z(df, 10, odd=True).select("frame", F.col("z").alias("one")).join(made, "frame")
    assert both.filter("abs(one - odd) > 1e-12").count() == 0 and both.count() == 120


def test_streams_are_not_unrolled_from_one_row(spark):
    bits = spark.range(3000, numPartitions=6).select(F.lit("s").alias("stream"), F.col("id").alias("k"), (F.col("id") * 7 % 3 % 2).cast("long").alias("bit"))
    made = synth.synthesise(bits, symbols.PERIOD, 0.7)
    said = plan(made)
    assert said.count("Generate") == 1 and said.count("Aggregate") == 1
    known = [int(b) for b in (np.arange(3000) * 7 % 3 % 2)]
    got = {x.frame: x.v for x in made.collect()}
    assert len(got) == int(np.floor(3000 * symbols.PERIOD + 0.7))
    for f in [*range(40), *range(4000, 4040), *range(len(got) - 40, len(got))]:
        at = [min(max(int(np.floor((f + (j + 0.5) / 16.0 * 0.3 - 0.7) / symbols.PERIOD)), 0), 2999) for j in range(16)]
        assert got[f] == sum(245.0 if known[k] else 1.0 for k in at) / 16
