import re
from collections import defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from tarnwave.llm import near_dedup

from .fixtures import frame, odd_rows, prose


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return text.translate(LOWER)


def brute(rows, size=5, percent=75):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            up[find(i)] = find(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)].append(d)
    out = []
    for i, (d, t) in enumerate(rows):
        own = d if not sets[i] else min(low[find(i)], default=None)
        out.append((d, len(sets[i]), own, d == own))
    return sorted(out, key=repr)


def edited(text, seed, share):
    w = text.split(" ")
    step = max(1, round(1 / share))
    return " ".join("changed%d" % (i + seed) if i % step == seed % step else x for i, x in enumerate(w))


def test_against_brute_force(spark):
    rows = odd_rows()
    base = prose(50, 120)
    rows += [(100 + i, edited(base, i, 0.02 + 0.002 * (i % 5))) for i in range(40)]
    rows += [(200 + i, prose(60, 90) + " " + prose(300 + i, 10 + i)) for i in range(30)]
    rows += [(300 + i, prose(400 + i // 2, 50) + " tail" * (i % 2)) for i in range(30)]
    got = near_dedup.near_groups(frame(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_large_group_of_near_copies_gives_few_rows(spark):
    base = prose(70, 200)
    rows = [(i, base + f" end{i} of{i} it{i}") for i in range(300)]
    got = near_dedup.near_groups(frame(spark, rows)).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_one_of_each_keeps_one(spark):
    rows = [(3, prose(1, 50)), (2, prose(1, 50)), (2, prose(1, 50)), (4, prose(5, 50)), (4, prose(1, 50)), (None, prose(1, 50))]
    got = near_dedup.one_of_each(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["text"] == prose(5, 50)) for r in got) == [(2, False), (4, True)]


def test_parities_never_exceed_the_difference():
    import numpy as np

    rng = np.random.default_rng(1)
    for common, a, b in ((600, 100, 100), (5, 0, 3), (3000, 900, 10), (0, 40, 60)):
        parts = [rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in (common, a, b)]
        two = [np.sort(np.concatenate([parts[0], p])) for p in parts[1:]]
        x, y = near_dedup.parities(np.concatenate(two), np.array([len(t) for t in two]), 1024)
        cells = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
        assert cells <= a + b and (cells > 0.7 * (a + b) or a + b > 200)


def test_first_shared_key(spark):
    import numpy as np

    rules = near_dedup.NearRules()
    rng = np.random.default_rng(2)
    a = rng.integers(-(1 << 63), (1 << 63) - 1, (200, 10))
    b = a ^ np.where(rng.random((200, 10)) < 0.4, 0, rng.integers(1, 1 << 15, (200, 10)) << (16 * rng.integers(0, 4, (200, 10)))) ^ np.where(rng.random((200, 10)) < 0.7, rng.integers(1, 9, (200, 10)) << (16 * rng.integers(0, 4, (200, 10))), 0)
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b))], "i long, a array<long>, b array<long>")
    keys = [df.select("i", near_dedup.chunk_keys(F.col(c), rules).alias("place", "key")) for c in "ab"]
    want = {r["i"]: r["p"] for r in keys[0].join(keys[1], ["i", "place", "key"]).groupBy("i").agg(F.min("place").alias("p")).collect()}
    got = near_dedup.first_shared(a.view("<u2"), b.view("<u2"), rules)
    assert {i: p for i, p in enumerate(got.tolist()) if p >= 0} == want and len(want) > 50


def test_rows_without_doc_id_bridge_near_copies(spark):
    said = [f"w{i}" for i in range(240)]
    rows = [(1, " ".join(said[:200])), (None, " ".join(said[20:220])), (2, " ".join(said[40:]))]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (None, 1), (2, 1)}


def test_only_pairs_that_cannot_be_links_are_refused():
    import numpy as np

    rules = near_dedup.NearRules()
    rng = np.random.default_rng(3)
    refused = 0
    for _ in range(300):
        common, a, b = (int(rng.integers(0, m)) for m in (800, 200, 200))
        parts = [rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in (common, a, b)]
        two = [np.sort(np.concatenate([parts[0], p])) for p in parts[1:]]
        x, y = (near_dedup.parities(t, np.array([len(t)]), rules.bits).view(np.uint64) for t in two)
        may = near_dedup.may_link(np.array([common + a]), np.array([common + b]), x, y, rules)[0, 0]
        assert may or 100 * common < 75 * (common + a + b)
        refused += not may
    assert refused > 100


def test_rows_of_joins_follow_the_members(spark):
    # near copies in a chain of changes: few rows for each member, whatever the group's size
    for n in (100, 1000):
        base = prose(70, 120)
        docs = frame(spark, [(i, edited(base, i, 0.03)) for i in range(n)])
        rules = near_dedup.NearRules()
        rows = near_dedup.signed(docs, rules)
        known = rows.select("id", F.struct(F.col("doc_id").alias("d"), "id.a", "id.b").alias("comp"), near_dedup.chunk_keys(F.col("sig"), rules).alias("place", "key"))
        assert near_dedup.star_pairs(known, 0).count() <= n


def test_cells_of_a_bucket_lose_no_pair(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:i] + ["x"] + base[i + 1 :])) for i in range(0, 60)]
    one, two = (sorted(map(tuple, near_dedup.near_groups(frame(spark, rows), near_dedup.NearRules(turns=0, block=b)).select("doc_id", "component_id").collect())) for b in (4096, 7))
    assert one == two and {c for _, c in one} == {0}


def test_other_ids_are_refused(spark):
    import pytest

    with pytest.raises(TypeError):
        near_dedup.near_groups(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_members_of_two_components_link_them_once(spark, monkeypatch):
    node, comp = "struct<a:long,b:long>", "struct<d:long,a:long,b:long>"
    ids = [(i, i) for i in range(20)]
    sets = spark.createDataFrame([(i, list(range(8))) for i in ids], f"id {node}, shingles array<long>")
    comps = [(i % 2, i % 2, i % 2) for i in range(20)]
    labels = spark.createDataFrame(list(zip(ids, comps, strict=True)), f"id {node}, comp {comp}")
    pairs = [(ids[i], ids[j], comps[i], comps[j]) for i in range(0, 20, 2) for j in range(1, 20, 2)]
    seen, whole = [], near_dedup.components
    monkeypatch.setattr(near_dedup, "components", lambda edges, small: seen.append(edges.count()) or whole(edges, small))
    after, n = near_dedup.linked(spark.createDataFrame(pairs, f"a {node}, b {node}, ca {comp}, cb {comp}"), labels, sets, True, near_dedup.NearRules())
    assert seen == [1] and n == 1
    assert {tuple(r["comp"]) for r in after.collect()} == {(0, 0, 0)}
