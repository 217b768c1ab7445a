"""All-lag sums by rows and columns of a distributed transform, against numpy's direct sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwave.operators import clock, fourier


def streams():
    rng = np.random.default_rng(8)
    return {"long": rng.integers(0, 2, 5000), "odd": rng.integers(0, 2, 777), "seven": rng.integers(0, 2, 7), "one": np.array([1]), "two": np.array([0, 1]), None: np.tile(rng.integers(0, 2, 130), 3)}


@pytest.fixture(scope="module")
def bits(spark):
    rows = [(s, i, int(b)) for s, x in streams().items() for i, b in enumerate(x)]
    return spark.createDataFrame(rows, "lamp string, k long, bit int").repartition(3).cache()


@pytest.mark.parametrize("cells", [1, 64, 1000, fourier.CELLS])
def test_all_lags_at_several_block_sizes(bits, cells):
    got = {}
    for r in clock.all_lags(bits, cells=cells).collect():
        got.setdefault(r["lamp"], {})[r["lag"]] = (r["s"], r["n"])
    for name, x in streams().items():
        x = 2.0 * x - 1
        direct = np.correlate(x, x, "full")[len(x) - 1 :]
        assert [got[name][i] for i in range(len(x))] == [(s, len(x)) for s in direct]
        assert len(got[name]) == len(x)


@pytest.mark.parametrize("cells", [16, fourier.CELLS])
def test_sums_of_real_values_with_missing_samples(spark, cells):
    x = np.random.default_rng(2).normal(5, 2, 301)
    x[[3, 40, 41]] = 0
    rows = [("a", i, float(v)) for i, v in enumerate(x) if v]
    df = spark.createDataFrame(rows, "lamp string, k long, v double")
    got = {r["lag"]: r["s"] for r in fourier.lag_sums(df, F.col("v"), ["lamp"], cells=cells).collect()}
    assert np.allclose([got[i] for i in range(301)], np.correlate(x, x, "full")[300:])


def test_centred(spark):
    x = np.random.default_rng(3).normal(5, 2, 200)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("flat", i, 1.0) for i in range(4)], "lamp string, k long, v double")
    got = clock.all_lags_of(df, "v").collect()
    y = x - x.mean()
    want = np.correlate(y, y, "full")[199:] / (y @ y)
    assert np.allclose([r["ac"] for r in sorted((r for r in got if r["lamp"] == "a"), key=lambda r: r["lag"])], want)
    assert {r["ac"] for r in got if r["lamp"] == "flat"} == {None}


def test_rows_of_a_shuffle_grow_with_blocks_not_pairs(bits):
    # 16 times the symbols: 16 times the samples that go through, no join on the channel alone
    plan = clock.all_lags(bits, cells=1000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 3 and "SortMergeJoin" not in plan


def test_empty(spark):
    assert clock.all_lags(spark.createDataFrame([], "lamp string, k long, bit int")).collect() == []
