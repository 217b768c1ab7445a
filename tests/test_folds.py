"""Sums over many settings against direct versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwave.operators import clock, folds

RNG = np.random.default_rng(21)
SIGNALS = {"a": RNG.uniform(0, 255, 700), "b": RNG.uniform(0, 255, 91), None: RNG.uniform(0, 9, 40), "one": np.array([3.0])}
EDGES = {"a": np.flatnonzero(RNG.random(900) < 0.3), "b": np.array([0, 7, 50]), None: np.array([11])}


@pytest.fixture(scope="module")
def signal(spark):
    return spark.createDataFrame([(k, i, float(v), len(x)) for k, x in SIGNALS.items() for i, v in enumerate(x)], "lamp string, frame long, v double, n long").repartition(4).cache()


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(k, int(e)) for k, x in EDGES.items() for e in x], "lamp string, frame long").repartition(3).cache()


@pytest.mark.parametrize("chunk", [7, 64, 1 << 16])
def test_symbol_moments(signal, chunk):
    settings = [(2.0, 0.0), (2.826, 1.3), (30.5, 2.0), (1000.0, 0.0)]
    got = {(r["lamp"], r["i"]): r for r in folds.symbol_moments(signal, settings, chunk=chunk).collect()}
    assert len(got) == len(SIGNALS) * len(settings)
    for name, x in SIGNALS.items():
        for i, (period, phase) in enumerate(settings):
            k = np.maximum(np.floor((np.arange(len(x)) - phase) / period), 0)
            parts = [x[k == j] for j in np.unique(k)]
            want = (len(parts), sum(p.mean() for p in parts), sum(p.mean() ** 2 for p in parts), sum(((p - p.mean()) ** 2).sum() for p in parts), len(x))
            r = got[name, i]
            assert np.allclose([r[c] for c in ("n", "m1", "m2", "within", "c")], want, atol=1e-6)


@pytest.mark.parametrize("phases", [2, 8, 40])
def test_grid_score(edges, phases):
    periods = clock.period_grid(1.2, 30, 0.137)
    got = {(r["lamp"], round(r["period"], 9)): r["score"] for r in clock.grid_score(edges, periods, phases).collect()}
    for name, e in EDGES.items():
        for p in periods:
            r = [(e - j * p / phases) / p for j in range(phases)]
            assert abs(got[name, round(p, 9)] - min(np.abs(x - np.rint(x)).mean() * p for x in r)) < 1e-9
    with pytest.raises(ValueError):
        clock.grid_score(edges, periods, 3)


def test_concentration_and_gaps(edges):
    periods = clock.period_grid(2.0, 20, 0.31)
    got = {(r["lamp"], round(r["period"], 9)): r["r"] for r in clock.concentration(edges, periods).collect()}
    cost = {(r["lamp"], round(r["period"], 9)): r["c"] for r in clock.gap_cost(edges.withColumnRenamed("frame", "gap"), periods, ["lamp"]).collect()}
    for name, e in EDGES.items():
        for p in periods:
            assert abs(got[name, round(p, 9)] - abs(np.exp(2j * np.pi * e / p).mean())) < 1e-9
            assert abs(cost[name, round(p, 9)] - np.abs(e / p - np.rint(e / p)).mean()) < 1e-9


def test_sampled_mean(signal):
    settings = [(1.0, 2.0), (1.413, 2.826), (3.3, 7.1)]
    got = {(r["lamp"], r["i"]): r["mean"] for r in clock.sampled_mean(signal, settings, F.col("v")).collect()}
    for name, x in SIGNALS.items():
        for i, (first, period) in enumerate(settings):
            at = np.rint(first + np.arange(max(0, np.ceil((len(x) - 1 - first) / period))) * period).astype(int)
            want = x[at].mean() if len(at) else None
            assert got[name, i] == want or abs(got[name, i] - want) < 1e-9


def test_many_keys_are_sent_on(spark, monkeypatch):
    monkeypatch.setattr(folds, "HELD", 3)
    df = spark.range(2000).select((F.col("id") % 50).alias("k"), F.col("id").alias("x"))
    got = folds.folded(df, ["k"], ["x"], ("s", "c"), 2, lambda x: np.array([[x.sum(), len(x)], [0.0, 1.0 * len(x)]]))
    rows = {(r["k"], r["i"]): (r["s"], r["c"]) for r in got.collect()}
    assert rows[7, 0] == (sum(range(7, 2000, 50)), 40) and rows[7, 1] == (0, 40) and len(rows) == 100


def test_shuffles_don_t_grow_with_settings(spark):
    signal = spark.range(1000).select(F.lit("a").alias("lamp"), F.col("id").alias("frame"), F.rand(3).alias("v"), F.lit(1000).alias("n"))
    for count in (2, 200):
        df = clock.sampled_mean(signal, [(0.5 + i / 500, 2.8) for i in range(count)], F.col("v"))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan
