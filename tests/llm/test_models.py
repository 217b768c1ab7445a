import zlib
from itertools import product

import numpy as np

from tarnwave.llm import decontaminate, licenses, quality, toxicity

from .fixtures import frame, prose


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 5, 1, 4])
    trans = rng.normal(size=(2, 2))
    score = [rng.normal(size=n) for n in lengths]
    packed = toxicity.Packed(lengths)
    flat = np.empty(int(lengths.sum()))
    flat[packed.place] = np.concatenate(score)
    got = toxicity.sigmoid(toxicity.forward_backward(flat, trans, packed)[0])[packed.place]
    want = []
    for s in score:
        paths = list(product((0, 1), repeat=len(s)))
        w = np.exp([sum(s[i] for i in range(len(s)) if p[i]) + sum(trans[a, b] for a, b in zip(p, p[1:])) for p in paths])
        want += [sum(x for x, p in zip(w, paths) if p[i]) / w.sum() for i in range(len(s))]
    assert np.allclose(got, want)


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_toxicity_held_out(spark):
    bad = ["vilewort", "grimsot", "foulbane"]
    rows = []
    for i in range(400):
        w = prose(i, 60).split(" ")
        if i % 4 == 0:
            w[i % 50] = bad[i % 3].upper()
        rows.append((i, " ".join(w)))
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0) if not held(i) else 1 - int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    tagger = toxicity.fit_tagger(docs, labels)  # held-out labels are wrong on purpose: they mustn't be learned
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, tagger).collect()}
    wrong = [i for i in range(400) if (got[i]["score"] >= 0.7) != (i % 4 == 0)]
    assert len(wrong) <= 4
    for i in range(0, 400, 4):
        text = rows[i][1]
        assert [text[s["start"] : s["end"]].lower() for s in got[i]["spans"]] == [bad[i % 3]] or i in wrong
    kept = {r["doc_id"] for r in toxicity.filter_toxic(docs, tagger, 0.7).collect()}
    assert kept == {i for i in range(400) if got[i]["score"] < 0.7}


def test_quality_shrinks_sparse_sites(spark):
    rows = [(i, prose(i, 50) if i % 5 else "spam " * 60) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "big" if i < 590 else f"small{i}") for i, t in rows], "doc_id long, text string, host string").withColumnRenamed("host", "site")
    docs = docs.selectExpr("*", "site as page")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(600)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score_quality(docs, labels, "site", "page").collect()}
    good = [i for i in range(600) if got[i]["keep"] == bool(i % 5)]
    assert len(good) >= 590
    small = got[597]
    assert abs(small["host_share"] - got[0]["host_share"]) < 0.3  # one label alone doesn't move a site to 0 or 1


def test_leaks_against_brute_force(spark):
    items = [(i, prose(700 + i, 12 + 3 * i)) for i in range(12)] + [(20, "one two three"), (21, "")]

    def edit(t, at):
        w = t.split(" ")
        w[at % len(w)] = "edited"
        return " ".join(w)

    rows = []
    for i in range(60):
        t = prose(i, 80)
        if i % 3 == 0:
            t += " " + items[i % 12][1].replace("a", "A") + " " + prose(i + 99, 30)
        if i % 7 == 0:
            t = prose(i, 10) + " " + edit(items[(i + 5) % 12][1], i) + " " + t
        if i == 31:
            t += " One, two: three!"
        rows.append((i, t))
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), decontaminate.LeakRules(items=5)).collect()}
    from collections import Counter

    want = {}
    for i, t in rows:
        w = decontaminate.WORD.findall(t.lower())
        for j, x in items:
            x = decontaminate.WORD.findall(x.lower())
            k = min(5, len(x))
            if not k:
                continue
            own = Counter(tuple(x[a : a + k]) for a in range(len(x) - k + 1))
            sh = [tuple(w[a : a + k]) for a in range(len(w) - k + 1)]
            m = sum(own.values())
            best = 0.0
            for a in range(max(1, len(sh) - m + 1)):
                part = Counter(sh[a : a + m])
                both = sum(min(n, own[y]) for y, n in part.items())
                best = max(best, both / (sum(part.values()) + m - both))
            if best >= 0.75:
                want[i, j] = round(best, 6)
    assert {k: r["similarity"] for k, r in got.items()} == want
    one = got[0, 0]
    assert rows[0][1][one["start"] : one["end"]].lower() == items[0][1]


def test_multi_index_misses_nothing():
    rules = decontaminate.LeakRules()
    rng = np.random.default_rng(5)
    words = [(i, rng.integers(0, 1 << 60, 20).astype(np.uint64)) for i in range(60)]
    index = decontaminate.LeakIndex(words, 5, rules)
    prints = np.array([int(index.prints[i % 60]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 24), replace=False)) for i in range(400)], np.uint64)
    got = set(zip(*(x.tolist() for x in index.near(prints)[:2])))
    assert got == {(i, j) for i in range(400) for j in range(60) if bin(int(prints[i]) ^ int(index.prints[j])).count("1") <= rules.radius}


def test_licences(spark):
    rows = [(1, prose(1, 40) + "\nReleased under the MIT License.\n" + prose(2, 30)), (2, "licensed under the apache license version 2.0"), (3, prose(3, 50)), (4, "This work is licensed under the GNU General Public License, version 3."), (5, "A licence to thrill"), (6, "Licensed under the GNU Lesser General Public License, version 3. " + prose(4, 400))]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert {i: r["license_id"] for i, r in got.items()} == {1: "MIT", 2: "Apache-2.0", 4: "GPL-3.0", 6: "LGPL-3.0"}
    assert rows[0][1][got[1]["start"] : got[1]["end"]] == "Released under the MIT License"
    assert all(r["bytes_given"] < r["bytes_alone"] for r in got.values())


def test_quality_against_brute_force(spark):
    import math
    import random
    from collections import defaultdict

    r = random.Random(8)
    rows = []
    for i in range(400):
        host = f"h{min(r.randrange(12), 5)}"
        good = r.random() < (0.9 if host in ("h0", "h5") else 0.4)
        rows.append((i, prose(i, 40) if good else "win! " * 30 + prose(i, 6), host, f"{host}/{r.randrange(3)}", int(good)))
    docs = spark.createDataFrame([x[:4] for x in rows] + [(900, None, None, None), (None, "a b", "h1", "new")], "doc_id long, text string, site string, page string")
    labels = spark.createDataFrame([(x[0], x[4]) for x in rows if x[0] % 3], "doc_id long, quality int")
    got = {x["doc_id"]: x for x in quality.score_quality(docs, labels, "site", "page").collect()}
    learned = [x for x in rows if x[0] % 3 and not held(x[0])]

    # shares: each level shrunk toward the one above by a strength from the spread between sites
    def strength(sites):
        ss = sum(n * (g / n - p) ** 2 for g, n, p in sites)
        pq, npq = sum(p * (1 - p) for _, _, p in sites), sum(n * p * (1 - p) for _, n, p in sites)
        return 1 / min(max((ss - pq) / max(npq - pq, 1e-9), 1e-3), 0.5) - 1

    count = [defaultdict(lambda: [0, 0]) for _ in range(2)]
    for _, _, host, path, good in learned:
        for c, key in zip(count, (host, (host, path))):
            c[key][0] += good
            c[key][1] += 1
    whole = (sum(x[4] for x in learned) + 1) / (len(learned) + 2)
    m = strength([(g, n, whole) for g, n in count[0].values()])
    hosts = {h: (g + m * whole) / (n + m) for h, (g, n) in count[0].items()}
    m = strength([(g, n, hosts[h]) for (h, _), (g, n) in count[1].items()])
    paths = {k: (g + m * hosts[k[0]]) / (n + m) for k, (g, n) in count[1].items()}

    # the classifier: penalised likelihood, by plain gradient steps
    x, y = np.array([quality.traits(t[1]) for t in learned]), np.array([t[4] for t in learned], float)
    w, penalty = np.zeros(x.shape[1]), np.r_[1e-6, np.ones(x.shape[1] - 1)]
    for _ in range(60_000):
        w -= 2e-3 * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) + penalty * w)
    prior = math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    for i, text, host, path, _ in rows:
        one = got[i]
        assert abs(one["host_share"] - hosts[host]) < 1e-9 and abs(one["path_share"] - paths.get((host, path), hosts[host])) < 1e-9
        evidence = float(np.array(quality.traits(text)) @ w) - prior
        assert abs(one["evidence"] - evidence) < 0.05
        score = 1 / (1 + math.exp(-(math.log(one["path_share"] / (1 - one["path_share"])) + one["evidence"])))
        assert abs(one["score"] - score) < 1e-9 and one["keep"] == (score >= 0.5)
    assert abs(got[900]["host_share"] - whole) < 1e-9 and abs(got[None]["path_share"] - hosts["h1"]) < 1e-9


def test_quality_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = frame(spark, [(1, prose(1, 20)), (2, None)])
    got = quality.score_quality(docs, none, "host", "path").collect()
    assert [(g["evidence"], g["host_share"], g["path_share"], g["score"]) for g in got] == [(0.0, 0.5, 0.5, 0.5)] * 2
    assert quality.score_quality(frame(spark, []), none, "host", "path").collect() == []


def test_tagger_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = frame(spark, [(1, prose(1, 20)), (2, None)])
    for d, labels in ((docs, none), (frame(spark, []), none), (frame(spark, []), spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))):
        tagger = toxicity.fit_tagger(d, labels)
        assert all(r["score"] < 0.7 for r in toxicity.score_toxicity(docs, tagger).collect())
