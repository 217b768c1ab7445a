"""Array files: headers, ranges, names, and signals written and read back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwave.sources import arrays


def rows(df):
    return sorted((r["name"], r["frame"], r["cell"], r["v"]) for r in df.collect())


@pytest.mark.parametrize("split", [16, 1000, arrays.SPLIT])
def test_plain_arrays(spark, tmp_path, split):
    x = np.arange(257, dtype=np.float32) / 7
    np.save(tmp_path / "a.npy", x)
    np.save(tmp_path / "b.npy", np.arange(12, dtype=np.uint8).reshape(4, 3))
    got = arrays.load_arrays(spark, str(tmp_path / "a.npy"), split=split)
    assert rows(got) == [("", i, 0, float(v)) for i, v in enumerate(x)]
    got = arrays.load_arrays(spark, f"file://{tmp_path}", first=1, last=2, split=split).filter(F.col("file").endswith("b.npy"))
    assert rows(got) == [("", 1, 0, 3.0), ("", 1, 1, 4.0), ("", 1, 2, 5.0), ("", 2, 0, 6.0), ("", 2, 1, 7.0), ("", 2, 2, 8.0)]


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_named_arrays(spark, tmp_path, save):
    save(tmp_path / "two.npz", level=np.arange(50.0), flag=np.arange(50) % 2 == 0, other=np.zeros((3, 2)))
    got = arrays.load_arrays(spark, str(tmp_path), ["level", "flag"], first=40, split=32)
    assert rows(got) == sorted([("level", i, 0, float(i)) for i in range(40, 50)] + [("flag", i, 0, float(i % 2 == 0)) for i in range(40, 50)])
    assert arrays.load_arrays(spark, str(tmp_path), ["none"]).collect() == []


def test_only_the_asked_ranges_are_planned(tmp_path):
    np.savez(tmp_path / "x.npz", level=np.arange(1000.0), square=np.arange(1000.0))
    plan = arrays.ArrayReader({"path": str(tmp_path), "names": "level", "first": "100", "last": "899", "split": "800"}).partitions()
    assert [(p.name, p.first, p.last) for p in plan] == [("level", a, a + 99) for a in range(100, 900, 100)]


def test_what_isn_t_numbers_is_refused(spark, tmp_path):
    np.save(tmp_path / "text.npy", np.array(["a", "b"]))
    with pytest.raises(Exception, match="supported"):
        arrays.load_arrays(spark, str(tmp_path)).collect()


def test_a_signal_there_and_back(spark, tmp_path):
    v = np.random.default_rng(3).normal(0, 1, 700)
    df = spark.createDataFrame([("a/b", i, float(x)) for i, x in enumerate(v)] + [("c", i, float(x)) for i, x in enumerate(v[:10])], "lamp string, frame long, v double").withColumn("w", F.col("v") * 2).repartition(3)
    manifest = arrays.save_arrays(df, str(tmp_path / "out"), ["v", "w"], chunk=128).collect()
    assert sorted((m["lamp"], m["first"], m["frames"]) for m in manifest) == [("a/b", a, min(128, 700 - a)) for a in range(0, 700, 128)] + [("c", 0, 10)]
    at = {m["file"]: (m["lamp"], m["first"]) for m in manifest}
    got = {}
    for r in arrays.load_arrays(spark, str(tmp_path / "out"), ["w"]).collect():
        lamp, first = at[r["file"]]
        got[lamp, first + r["frame"]] = r["v"]
    assert got == {("a/b", i): 2 * x for i, x in enumerate(v.tolist())} | {("c", i): 2 * x for i, x in enumerate(v[:10].tolist())}
