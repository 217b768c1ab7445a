"""Recordings with planted faults, against figures computed in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwave.operators import governance, recordings


def recording(key, values, steps):
    """The last 12 frames show three regions in turn, all others the first one."""
    us, n = np.concatenate([[0], np.cumsum(steps)])[: len(values)].astype(int).tolist(), len(values)
    return [(key, i, us[i], "r0" if i < n - 12 else f"r{1 + i % 3}", float(v)) for i, v in enumerate(values)]


def blinking(n, seed=1):
    """A wave of 16 frames in the first region, noise in the others."""
    i, rng = np.arange(n), np.random.default_rng(seed)
    return 100 + 60 * np.sin(i * np.pi / 8) * (i < n - 12) + rng.random(n) * 2


@pytest.fixture(scope="module")
def judged(spark):
    even = [1000] * 400
    rng = np.random.default_rng(3)
    late = [1000] * 30 + [60_000] + [1000] * 60
    rows = recording(1, blinking(70), even)  # region r0 blinks, the others don't
    rows += recording(2, 40 + rng.random(70) * 100, even)  # noise alone
    rows += recording(3, blinking(20), even)  # too short
    rows += recording(4, np.full(70, 30.0), even)  # nothing changes
    rows += recording(5, blinking(70), late)  # a hole
    rows += recording(6, blinking(90), late)  # a hole, but ends beyond the limit
    rows += recording(7, np.where(np.arange(70) == 5, 0.0, blinking(70)) + 100 * (np.arange(70) == 4), even)  # dark and clipped frames
    rows += recording(8, [5.0], even)
    df = spark.createDataFrame(rows, "key long, frame long, us long, region string, v double")
    truth = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 6, 7)], "key long")
    level, reasons = governance.verdict(recordings.rules())
    got = recordings.measured(df, truth, "key").select("*", level.alias("level"), reasons.alias("reasons")).collect()
    return {r["key"]: r for r in got}, rows


def test_planted_faults(judged):
    got, _ = judged
    assert (got[1]["level"], got[1]["reasons"]) == ("green", ["nothing to object to"])
    assert got[2]["level"] == "red" and "the busiest region is hardly busier than others" in got[2]["reasons"]
    assert got[3]["level"] == "red" and got[3]["reasons"][0] == "few frames: 20"
    assert got[4]["level"] == "red" and "no region changes" in got[4]["reasons"] and got[4]["ratio"] is None
    assert got[5]["reasons"] == ["announced 129, found 70", "uneven frame times"] and got[5]["level"] == "amber"
    assert got[6]["reasons"] == ["ends at the limit of 90", "uneven frame times"]
    assert got[7]["reasons"][0] == "dark frames: 1" and "top levels are clipped" in got[7]["reasons"]
    assert got[8]["level"] == "red" and got[8]["jitter"] is None and got[8]["told"] is None and not got[8]["has_truth"]


def test_figures(judged):
    got, rows = judged
    for key in (1, 2, 5, 6, 7):
        mine = [r for r in rows if r[0] == key]
        v, us = np.array([r[4] for r in mine]), np.array([r[2] for r in mine])
        dt = np.diff(us)
        assert got[key]["told"] == round((us[-1] - us[0]) / np.median(dt)) + 1
        assert got[key]["jitter"] == pytest.approx(dt.std() / dt.mean(), abs=1e-12)
        by = [np.var([r[4] for r in mine if r[3] == x]) for x in ("r0", "r1", "r2", "r3")]
        assert got[key]["ratio"] == pytest.approx(max(by) / np.median(by))
        parts = [v[i : i + 32] for i in range(0, len(v) - 31, 32)]
        power = sum(np.abs(np.fft.rfft((p - p.mean()) * np.hanning(32))) ** 2 for p in parts)
        a = np.sqrt(power[1:])
        assert got[key]["strength"] == pytest.approx(a.max() / np.median(a))


def test_empty(spark):
    rows = spark.createDataFrame([], "key long, frame long, us long, region string, v double")
    assert recordings.measured(rows, rows.select("key"), "key").count() == 0
    assert recordings.measured(rows, rows.select("key"), "key").filter(F.col("told") > 0).count() == 0
