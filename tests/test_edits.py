"""Edit distances by bands against the whole table, and long streams."""

import random
import time

import numpy as np
import pytest

from tarnwave.operators import edits


def whole(a, b):
    """(edits, insertions and deletions) of the best script, by the table of all prefixes."""
    row = [(j, j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [(i, i)]
        for j, y in enumerate(b, 1):
            ways = [(row[j][0] + 1, row[j][1] + 1), (new[-1][0] + 1, new[-1][1] + 1), (row[j - 1][0] + (x != y), row[j - 1][1])]
            new.append(min(ways))
        row = new
    return row[-1]


def code(t):
    return np.frombuffer(t.encode("utf-32-le"), np.uint32)


@pytest.mark.parametrize("band", [1, 2, 5, 64])
def test_against_the_whole_table(band):
    r = random.Random(band)
    for _ in range(150):
        a = "".join(r.choice("01é") for _ in range(r.randrange(0, 24)))
        b = "".join(r.choice("01é") for _ in range(r.randrange(0, 24)))
        if r.random() < 0.5:
            at = r.randrange(len(a) + 1)
            b = a[:at] + r.choice(["", "0", "11"]) + a[at + r.randrange(3) :]
        distance, moved = whole(a, b)
        got = edits.edits(code(a), code(b), band)
        assert got[0] == distance and got[1] + got[2] == moved
        assert got[1] - got[2] == len(b) - len(a) and got[1] + got[2] + got[3] == distance and min(got) >= 0


def test_long_streams_with_known_edits(spark):
    rng = np.random.default_rng(1)
    ref = rng.integers(0, 2, 100_000)
    pred = np.delete(ref, [10, 50_000, 90_001])
    pred = np.insert(pred, [300, 70_000], [2, 2])  # a symbol that ref doesn't have
    pred[[40_000, 60_000]] = 3
    frame = lambda x: spark.createDataFrame([("s", i, int(b)) for i, b in enumerate(x)], "stream string, k long, bit long")
    begun = time.perf_counter()
    got = edits.stream_edits(frame(pred), frame(ref), ["stream"]).first()
    assert (got["insertions"], got["deletions"], got["substitutions"], got["n_ref"]) == (2, 3, 2, 100_000)
    assert time.perf_counter() - begun < 90


def test_odd_texts(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", ""), (3, "", "abc"), (4, "日本", "日"), (5, "same", "same")], "i long, a string, b string")
    got = {r["i"]: tuple(r)[3:] for r in edits.with_edits(df, "a", "b").collect()}
    assert got == {1: (None,) * 4, 2: (0, 0, 0, 0), 3: (3, 3, 0, 0), 4: (1, 0, 1, 0), 5: (0, 0, 0, 0)}


@pytest.mark.parametrize("side", [7, 16])
def test_tiles_of_streams_that_differ_much(spark, side):
    r = random.Random(side)
    streams = {}
    for i, (n, m) in enumerate([(150, 150), (160, 90), (40, 230), (100, 101), (3, 200), (16, 17), (5, 0), (400, 400)]):
        a = [r.randrange(2) for _ in range(n)]
        streams[str(i)] = (a, [r.randrange(2) for _ in range(m)] if i < 7 else a[5:] + a[:5])
    frame = lambda at: spark.createDataFrame([(s, k, b) for s, pair in streams.items() for k, b in enumerate(pair[at])], "stream string, k long, bit long")
    got = {r["stream"]: r for r in edits.stream_edits(frame(1), frame(0), ["stream"], side).collect()}
    assert set(got) == {s for s, (a, b) in streams.items() if a and b}
    for s, x in got.items():
        a, b = streams[s]
        distance, moved = whole(a, b)
        assert (x["n_ref"], x["distance"], x["insertions"] + x["deletions"]) == (len(a), distance, moved)
        assert x["insertions"] - x["deletions"] == len(b) - len(a) and x["substitutions"] == distance - moved
        assert abs(x["rate"] - distance / len(a)) < 1e-12


def test_a_tile_of_long_streams_takes_one_pass_of_its_cells():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2, 3000), rng.integers(0, 2, 2500)
    step = edits.EDIT + 1
    low, right = edits.walked(a, b, np.arange(2501) * step, np.arange(1, 3001) * step)
    cost = edits.within(a, b, 3000)
    assert low[-1] == right[-1] == cost and low[0] == 3000 * step
