"""Conversation repair against an exhaustive search and a plain walk over rows."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

from tarnwave.llm import dialogue

SPACE = " \t\n\v\f\r"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns, found):
    """Dijkstra over (rows used, role initials so far up to the grammar's state, audit): (cost, audit, repaired)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, kept = heapq.heappop(heap)
        state = roles[-1:]
        if i == len(turns) and GRAMMAR.fullmatch(roles):
            return cost, audit, "\n".join(kept)
        if (i, state) in done:
            continue
        done.add((i, state))
        legal = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for name in ("user", "assistant"):
            if name[0] in legal:
                heapq.heappush(heap, (cost + 5, audit + "I", i, roles + name[0], (*kept, f"{name}:")))
        if i == len(turns):
            continue
        _, role, text = turns[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles, kept))
        if found[i] not in ("blank", "duplicate"):
            more = 5 if found[i] else 0
            if role[:1] and role[0] in legal:
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + role[0], (*kept, f"{role}:{text}")))
            for name in ("user", "assistant"):
                if name[0] in legal:
                    heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, roles + name[0], (*kept, f"{name}:{text}")))
    raise AssertionError("no repair")


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted([r[1:] for r in damage(rows) if r[0] == conv], key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.sha256(t[2].encode()).digest()))
        found = faults(turns)
        known = {t for t, _, _ in turns if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, text = cheapest(turns, found)
        out[conv] = (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def made(seed, n):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "so it goes", " ", "", None, "Why?", "é\n.", "x" * 3000 + "."]
    roles = ["system", "user", "assistant", "tool", "", None, "user", "assistant"]
    for conv in range(n):
        for turn in range(r.randrange(1, 14)):
            yield (conv, None if r.random() < 0.03 else turn + r.randrange(2), r.choice(roles), r.choice(texts) if r.random() < 0.5 else f"words {r.random()}.")


def check(spark, rows, parts):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)
    df = df.select("*", *[F.lit("clash").alias(c) for c in ("n", "kind", "sig", "cost", "audit", "part", "h", "k")])
    got = dialogue.repair_report(dialogue.damaged(df)).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == brute(rows)
    assert len(got) == len({r[0] for r in rows})


def test_against_search(spark):
    rows = list(made(1, 150))
    rows += [(None, t, "user", "Hm.") for t in range(4)] + [(900, None, None, None)] * 3
    check(spark, rows, 3)


def test_conversation_with_a_third_of_all_rows(spark):
    r = random.Random(3)
    rows = [(7, t, r.choice(["user", "assistant", "system"]), f"{r.randrange(300)}.") for t in range(1500)]
    rows += [(1000 + i, t, role, f"{role}.") for i in range(300) for t, role in enumerate(("user", "assistant"))]
    check(spark, rows, 5)


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert dialogue.repair_report(dialogue.damaged(none)).collect() == []
    assert dialogue.repair_turns(none).collect() == []


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (1, 2, "assistant", "Hello."), (2, 0, "assistant", "cut off"), (3, 5, "tool", " ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in dialogue.repair_turns(df).collect())
    assert got == [(1, 0, 1, "user", "Again.", "K"), (1, 1, 2, "assistant", "Hello.", "K")]
    report = {r["conv_id"]: (r["cost"], r["audit"]) for r in dialogue.repair_report(df).collect()}
    assert report == {1: (2, "DKK"), 2: (2, "D"), 3: (2, "D")}


def test_nodes_are_shared():
    dawg = dialogue.Suffixes()
    first = dawg.solve("EIEIEI")
    held = list(dawg.path)
    assert dawg.solve("EIEIEI") == first
    assert list(dawg.path) == held
    assert dawg.solve("EIEI") == dialogue.Suffixes().solve("EIEI")
    assert dialogue.shared_prefix("abcab", "abcxx") == 3
    assert dialogue.shared_prefix("a" * 9000, "a" * 8999 + "b") == 8999
    assert dialogue.shared_prefix("", "a") == 0
