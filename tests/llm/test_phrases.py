"""Phrase mining: filters as lossless round trips, results against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tarnwave.llm import phrases as P

from .fixtures import frame


@pytest.mark.parametrize("bits", [2, 7, 13, 25, 31, 33])
@pytest.mark.parametrize("n", [2, 3, 5])
def test_packing_and_permuting_lose_nothing(bits, n):
    words = np.random.default_rng(bits * n).integers(0, 1 << bits, (500, n))
    lanes = P.packed(words, bits)
    assert all(int(x.max()) < 1 << w for x, w in zip(lanes, P.widths(n * bits), strict=True))
    mixed = P.permuted(lanes, n * bits)
    assert all(int(x.max()) < 1 << w for x, w in zip(mixed, P.widths(n * bits), strict=True))
    back = P.permuted(mixed, n * bits, back=True)
    assert all((a == b).all() for a, b in zip(lanes, back, strict=True))
    assert (P.unpacked(back, n, bits) == words).all()


@pytest.mark.parametrize("cut", [0, 3])
@pytest.mark.parametrize("size", [0, 1, 5, 3000])
def test_filters_lose_nothing(cut, size):
    rng = np.random.default_rng(size)
    bits, n = 11, 3
    lanes, counts, entry = P.sorted_counts(P.permuted(P.packed(rng.integers(0, 12, (size, n)), bits), n * bits))
    assert counts.sum() == size and len(entry) == size
    part = (lanes[0] >> np.uint64(P.widths(n * bits)[0] - cut)).astype(int)
    for p in set(part.tolist()):
        own = [x[part == p] for x in lanes]
        back, again = P.restored(P.stored(own, counts[part == p] * 1000, n * bits, cut), n * bits, cut, p)
        assert all((a == b).all() for a, b in zip(own, back, strict=True))
        assert (again == counts[part == p] * 1000).all()


def test_varints():
    values = np.array([0, 1, 127, 128, 300, 1 << 20, (1 << 50) + 3, 0])
    assert (P.from_varints(P.varints(values)) == values).all()
    assert len(P.from_varints(P.varints(values[:0]))) == 0


def brute(rows, rules):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, rules.longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    cand = {k: a for k, a in f.items() if a >= rules.least and len(k[1]) > 1}
    out = {}
    for (lang, p), a in cand.items():
        if any(m == lang and len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (m, q), b in cand.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[: rules.top]))


@pytest.mark.parametrize("rules", [P.PhraseRules(least=4, top=30, shard=2000, entries=50), P.PhraseRules(least=3, longest=3, top=1000)], ids=["small shards", "whole"])
def test_against_counting(spark, rules):
    r = random.Random(5)
    fixed = ["of the old town", "in spite of all", "e pluribus unum", "de la Mañana", "x y x y x"]
    words = [f"w{i}" for i in range(30)] + ["The", "THE", "é", "日本", "a-b", "\u00a0", "\x1c"]
    rows = []
    for i in range(300):
        parts = [r.choice(fixed) if r.random() < 0.3 else " ".join(r.choices(words, k=r.randrange(1, 5))) for _ in range(r.randrange(12))]
        rows.append((i, r.choice([" ", "  ", "\t", ", ", ".\n", " ! "]).join(parts), r.choice(["en", "en", "de", None, ""])))
    rows += [(1, None, "en"), (2, "", None), (3, " \t\n", "fr"), (4, "long tail " * 3000, "en"), (5, "to be or not", "xx"), (5, "to be or not", "xx")] * 2
    df = frame(spark, rows, "doc_id long, text string, lang string").repartition(4)
    got = sorted(tuple(x) for x in P.collocations(df, rules).collect())
    want = brute(rows, rules)
    assert got == want and len(want) > 20


def test_empty_table(spark):
    assert P.collocations(frame(spark, [], "doc_id long, text string, lang string")).collect() == []
    assert P.collocations(frame(spark, [(1, None, "en"), (2, "rare words", None)], "doc_id long, text string, lang string")).collect() == []
