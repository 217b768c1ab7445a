import hashlib
from collections import Counter

import pytest

from tarnwave.llm.repeats import RepeatRules, without_repeats

from .fixtures import frame, prose


def brute(rows, depth):
    raw = [(i, (t or "").encode("utf-8", "surrogatepass")) for i, t in rows]
    seen = Counter(b[k : k + depth] for _, b in raw for k in range(len(b) - depth + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - depth + 1):
            if seen[b[k : k + depth]] > 1:
                gone[k : k + depth] = b"\1" * depth
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rules", [RepeatRules(), RepeatRules(crowd=3, rows=5), RepeatRules(depth=60, gram=20, crowd=2, digits=3, rows=40), RepeatRules(depth=60, gram=20, crowd=2, bits=2)], ids=["as it is", "crowds", "short", "grams by text"])
def test_against_brute_force(spark, rules):
    shared = [prose(900 + i, 110) for i in range(4)]
    rows = [(i, prose(i, 20 + 3 * i) + (shared[i % 4] + prose(i + 500, 30) if i % 3 == 0 else "")) for i in range(40)]
    rows += [(50, shared[0] + " " + shared[0]), (51, "Eron, " * 300), (52, "a" * 900), (53, rows[3][1]), (3, rows[3][1]), (54, None), (55, ""), (56, "é" * 199 + "x"), (57, "é" * 199 + "x")]
    got = without_repeats(frame(spark, rows).repartition(3), rules, with_text=False).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, rules.depth)
