"""Packed bit streams against plain counting, over gaps, borders of words, offsets and several streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwave.operators import packed, scoring, symbols


def streams(seed, n, gaps):
    rng = np.random.default_rng(seed)
    out = {}
    for name, m in (("a", n), ("b", max(1, n // 3)), ("c", 64), ("d", 1)):
        ks = [int(k) for k in np.arange(m) if rng.random() > gaps]
        out[name] = {k: int(rng.integers(0, 2)) for k in ks}
    return out


def table(spark, found, name="key"):
    return spark.createDataFrame([(s, k, b) for s, bits in found.items() for k, b in bits.items()], f"{name} string, k long, bit long").repartition(3)


@pytest.mark.parametrize("reach", [0, 1, 3, 63])
@pytest.mark.parametrize("gaps", [0.0, 0.2])
def test_offsets(spark, reach, gaps):
    pred, ref = streams(1, 300, gaps), streams(2, 290, gaps)
    got = packed.offset_sums(packed.pack(table(spark, pred), ["key"]), packed.pack(table(spark, ref), ["key"]), reach, ["key"])
    want = {}
    for s in pred:
        for off in range(-reach, reach + 1):
            both = [(pred[s][k + off], b) for k, b in ref[s].items() if k + off in pred[s]]
            if both:
                want[s, off] = (len(both), sum(x != y for x, y in both))
    assert {(r["key"], r["off"]): (r["m"], r["wrong"]) for r in got.collect()} == want


def test_more_streams_against_one(spark):
    ref, rows = streams(3, 200, 0.1), []
    for i in range(5):
        rows += [(s, i, k, b) for s, bits in streams(10 + i, 200, 0.1).items() for k, b in bits.items()]
    pred = spark.createDataFrame(rows, "key string, i long, k long, bit long")
    words = packed.pack(pred, ["key", "i"])
    assert words.count() < len(rows) / 20
    got = {(r["key"], r["i"]): r["share"] for r in packed.same_share(words, packed.pack(table(spark, ref), ["key"]), ["key"], ["i"]).collect()}
    for (s, i), share in got.items():
        own = {k: b for x, j, k, b in rows if (x, j) == (s, i)}
        both = [own[k] == b for k, b in ref[s].items() if k in own]
        assert abs(share - np.mean(both)) < 1e-12


def test_rates_and_agreement(spark):
    rng = np.random.default_rng(7)
    ref = rng.integers(0, 2, 500)
    pred = 1 - np.r_[rng.integers(0, 2, 2), ref][:470]  # inverted, two symbols late
    frame = lambda x: spark.createDataFrame([("s", i, int(b)) for i, b in enumerate(x)], "stream string, k long, bit long")
    got = scoring.ber(frame(pred), frame(ref)).first()
    assert (got["ber"], got["polarity"], got["offset"]) == (0.0, 0, 2)
    sums = packed.offset_sums(packed.pack(frame(pred), ["stream"]), packed.pack(frame(ref), ["stream"]), 3, ["stream"])
    assert packed.best_rate(sums, ["stream"], spark.createDataFrame([("s", 500)], "stream string, n_ref long")).first()["ber"] == 0.0
    assert packed.best_rate(sums, ["stream"], spark.createDataFrame([("s", 5000)], "stream string, n_ref long")).first()["ber"] == 1.0
    late = np.r_[ref[:1], ref][:500]
    assert symbols.agreement(frame(ref), frame(late), keys=["stream"]).first()["agreement"] == 1.0
    assert symbols.agreement(frame(ref), frame(late), 0, keys=["stream"]).first()["agreement"] == np.mean(ref == late)


def test_masks_of_conditions_and_empty_tables(spark):
    df = spark.createDataFrame([("s", k, k % 2) for k in range(130)], "key string, k long, bit long")
    got = packed.pack(df, ["key"], more={"big": F.col("k") > 100}).orderBy("word").collect()
    assert [r["word"] for r in got] == [0, 1, 2]
    assert [bin(r["big"] & (2**64 - 1)).count("1") for r in got] == [0, 27, 2]
    assert [bin(r["bit"] & (2**64 - 1)).count("1") for r in got] == [32, 32, 1]
    none = df.limit(0)
    assert packed.offset_sums(packed.pack(none, ["key"]), packed.pack(df, ["key"]), 2, ["key"]).collect() == []
    with pytest.raises(ValueError):
        packed.offset_sums(packed.pack(df, ["key"]), packed.pack(df, ["key"]), 64, ["key"])
