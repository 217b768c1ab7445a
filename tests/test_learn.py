"""Learned operators on cases whose answer is known."""

import random

import numpy as np

from pyspark.sql import functions as F

from tarnwave.operators import clock, learn, newton


def test_classifier_learns_a_plane(spark):
    r = random.Random(1)
    rows = []
    for i in range(600):
        x = [r.uniform(-1, 1) for _ in range(6)]
        rows.append((i, *x, int(2 * x[1] + 3 * x[2] - x[5] > 0.2)))
    df = spark.createDataFrame(rows, "id long, d_m1 double, d_0 double, d_1 double, d_2 double, d_3 double, frac double, label long")
    got = learn.fit_and_score(df.filter("id < 400"), df.filter("id >= 400")).collect()
    assert len(got) == 200 and sum(g["bit"] == g["label"] for g in got) >= 194
    assert all(0 <= g["confidence"] <= 1 for g in got)


def numpy_fit(x, y, c):
    """Gradient steps of Newton's method on the whole matrix, to the end."""
    x, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    ridge = np.diag(np.r_[np.ones(x.shape[1] - 1), 0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve(c * (x.T * (p * (1 - p))) @ x + ridge, c * x.T @ (p - y) + ridge @ w)
    return w


def test_all_folds_and_penalties_in_the_same_passes(spark):
    rng = np.random.default_rng(9)
    rows = []
    for channel in range(5):
        x = rng.normal(channel / 3, 1, (60, 3))
        y = (x @ [1.0, -2.0, 0.5] + rng.normal(0, 1, 60) > 0.3).astype(int)
        rows += [(f"c{channel}", *map(float, r), int(b)) for r, b in zip(x, y)]
    df = newton.fold_of(spark.createDataFrame(rows, "lamp string, p double, q double, r double, label long").repartition(3), "lamp")
    models = newton.fit(df, ["p", "q", "r"], 5, (0.1, 1.0, 10.0), fold="fold")
    assert models.passes < 20
    for fold in range(5):
        own = [r for r in rows if r[0] != f"c{fold}"]
        for j, c in enumerate((0.1, 1.0, 10.0)):
            assert np.allclose(models.weights[fold, j], numpy_fit(np.array([r[1:4] for r in own]), np.array([r[4] for r in own]), c), atol=1e-6)
    scored = models.scored(df, F.col("fold"), 1).collect()
    for r in scored:
        w = models.weights[r["fold"], 1]
        p = 1 / (1 + np.exp(-(w[:3] @ [r["p"], r["q"], r["r"]] + w[3])))
        assert r["bit"] == (p > 0.5) and abs(r["confidence"] - 2 * abs(p - 0.5)) < 1e-9


def test_separable_missing_and_empty_rows(spark):
    df = spark.createDataFrame([(float(i), int(i > 9)) for i in range(20)] + [(None, 1), (3.0, None)], "x double, label long")
    models = newton.fit(df, ["x"], penalties=(1e6,))
    assert np.isfinite(models.weights).all() and np.allclose(models.weights[0, 0], numpy_fit(np.arange(20.0)[:, None], np.arange(20) > 9, 1e6), rtol=1e-2)
    assert models.scored(df, F.lit(0)).count() == 21
    assert (newton.fit(df.limit(0), ["x"]).weights == 0).all()


def test_many_channels_share_folds(spark):
    df = newton.fold_of(spark.range(500).select(F.col("id").alias("lamp")), "lamp", most=7)
    got = df.groupBy("fold").count().collect()
    assert len(got) == 7 and {r["__folds"] for r in df.collect()} == {7}


def test_penalty_shrinks_weights(spark):
    rows = [(float(i % 2), i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "d_0 double, label long")
    weak, strong = (learn.fit_and_score(df, df, ["d_0"], c).selectExpr("avg(confidence)").first()[0] for c in (100.0, 0.01))
    assert weak > strong


def test_pixels_that_blink_together_are_one_cluster(spark):
    r = random.Random(2)
    series = [[r.random() for _ in range(80)] for _ in range(2)]
    rows = [(f, x, y, series[x // 2][f] + 0.01 * r.random()) for f in range(80) for x in range(4) for y in range(4)]
    got = learn.pixel_clusters(spark.createDataFrame(rows, "frame long, x long, y long, v double"), frames=40, most=2).collect()
    assert {g["k"] for g in got} == {2} and len({(g["x"] // 2, g["cluster"]) for g in got}) == 2


def test_one_cluster_where_none_are_apart(spark):
    r = random.Random(3)
    level = [r.random() for _ in range(30)]
    rows = [(f, x, 0, level[f]) for f in range(30) for x in range(8)]
    got = learn.pixel_clusters(spark.createDataFrame(rows, "frame long, x long, y long, v double"), most=3).collect()
    assert {g["k"] for g in got} == {1}


def test_block_correlation_equals_numpy(spark):
    r = np.random.default_rng(4)
    sizes = {f"c{i}": int(r.integers(30, 60)) for i in range(9)}
    v = {c: r.normal(size=n) for c, n in sizes.items()}
    df = spark.createDataFrame([(c, f, float(x)) for c in v for f, x in enumerate(v[c])], "lamp string, frame long, v double")
    got = {(g["a"], g["b"]): (g["corr"], g["n"]) for g in clock.block_correlation(df, channels=2, frames=16).collect()}
    assert len(got) == 36
    for (a, b), (c, n) in got.items():
        m = min(sizes[a], sizes[b])
        assert n == m and abs(c - np.corrcoef(v[a][:m], v[b][:m])[0, 1]) < 1e-9


def test_all_lags_equal_a_loop(spark):
    r = random.Random(5)
    bits = {c: [r.randrange(2) for _ in range(n)] for c, n in (("a", 70), ("b", 33))}
    df = spark.createDataFrame([(c, k, b) for c in bits for k, b in enumerate(bits[c])], "lamp string, k long, bit long")
    got = {(g["lamp"], g["lag"]): g["s"] for g in clock.all_lags(df, cells=16).collect()}
    for c, bs in bits.items():
        x = [2 * b - 1 for b in bs]
        for lag in range(len(x)):
            assert got[c, lag] == sum(p * q for p, q in zip(x, x[lag:]))
