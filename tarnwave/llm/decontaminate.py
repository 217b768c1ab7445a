"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Every benchmark item has a 64-bit SimHash over its word shingles, weighted by their counts. Windows of the items' sizes
slide over each document; a window's SimHash is looked up in a multi-index: the 64 bits are split into BLOCKS blocks,
and by pigeonhole any item within RADIUS differs in at most RADIUS // BLOCKS bits of some block, so items are posted
under all such variants and no fingerprint within the radius is missed. What is found is verified by exact weighted
similarity: sum of smaller over sum of larger shingle counts.

Only windows that could pass are fingerprinted: of their shingles, as many must be shingles of some item as the
similarity asks for. That bound loses nothing, since shared shingles are shingles of items.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, U, lean, letter_words, mix, ragged, slices, staged

WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class LeakRules:
    """size: words of a shingle (items with fewer words are one shingle). percent: least similarity. radius, blocks: of
    the multi-index (at 0.75, 11 of 64 bits differ on average, more than 19 for fewer than 1 in 200 pairs that only just
    reach it). items: benchmark rows held at once; more are taken in further passes over the documents.
    """

    size: int = 5
    percent: int = 75
    radius: int = 19
    blocks: int = 5
    items: int = 8192


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Values of all runs of size words of a flat array (fewer than size at the end are left out)."""
    n = max(0, len(words) - size + 1)
    value = words[:n].copy()
    for k in range(1, size):
        value *= U(BASE)
        value += words[k : k + n]
    return value


def signs(values: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of 64 bits of each value."""
    return np.unpackbits(mix(values).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view("<u8").ravel().astype(np.uint64)


class LeakIndex:
    """Benchmark items of one pass that share a shingle size: gate, window sizes, and the multi-index."""

    def __init__(self, items: list[tuple[int, np.ndarray]], size: int, rules: LeakRules):
        self.size, self.rules = size, rules
        self.ids = [i for i, _ in items]
        self.sets = [Counter(shingles(w, size).tolist()) for _, w in items]
        self.totals = np.array([sum(s.values()) for s in self.sets])
        self.lengths = sorted({len(w) for _, w in items})
        self.known = np.unique(np.array([x for s in self.sets for x in s], np.uint64))
        self.gate = np.zeros(1 << 22, bool)
        self.gate[(self.known & U(len(self.gate) - 1)).astype(np.int64)] = True
        self.prints = fingerprints(np.stack([(signs(np.fromiter(s.keys(), np.uint64, len(s))) * np.fromiter(s.values(), np.int32, len(s))[:, None]).sum(0) for s in self.sets]))
        width = -(-64 // rules.blocks)
        self.blocks = [(at, min(width, 64 - at)) for at in range(0, 64, width)]
        errors = rules.radius // len(self.blocks)
        self.posted = []
        for at, bits in self.blocks:
            masks = np.array([sum(1 << b for b in c) for e in range(errors + 1) for c in combinations(range(bits), e)], np.int64)
            own = ((self.prints >> U(at)) & U((1 << bits) - 1)).astype(np.int64)
            keys = (own[:, None] ^ masks).ravel()
            order = np.argsort(keys, kind="stable")
            self.posted.append((np.searchsorted(keys[order], np.arange((1 << bits) + 1)), (order // len(masks)).astype(np.int32)))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs of a fingerprint and an item within the radius: numbers of both, distances; by fingerprint, then item."""
        found = []
        for (at, bits), (begin, items) in zip(self.blocks, self.posted, strict=True):
            keys = ((prints >> U(at)) & U((1 << bits) - 1)).astype(np.int64)
            n = begin[keys + 1] - begin[keys]
            i, item = np.repeat(np.arange(len(prints)), n), items[ragged(begin[keys], n)]
            ok = np.bitwise_count(self.prints[item] ^ prints[i]) <= self.rules.radius
            found.append(i[ok] * len(self.ids) + item[ok])
        pair = np.unique(np.concatenate(found))
        i, items = np.divmod(pair, len(self.ids))
        return i, items, np.bitwise_count(self.prints[items] ^ prints[i])

    def hits(self, values: np.ndarray) -> np.ndarray:
        """Places of the values that are shingles of some item."""
        at = np.flatnonzero(self.gate[(values & U(len(self.gate) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.known, values[at]), len(self.known) - 1)
        return at[self.known[place] == values[at]]

    def search(self, values: np.ndarray, hit: np.ndarray) -> list[tuple[int, int, int, float, int]]:
        """Leaks in one document: (item, first word, word after the last, similarity, distance), the best for each item.

        values: of all shingles of the document; hit: which are some item's.
        """
        n, rules = len(values), self.rules
        count = np.r_[0, np.cumsum(hit)]
        first, last, own_size = [], [], []
        for length in self.lengths:
            m = length - self.size + 1
            need = -(-rules.percent * m // 100)
            if count[-1] < need:
                continue
            s = np.arange(max(1, n - m + 1))
            e = np.minimum(s + m, n)
            ok = count[e] - count[s] >= need
            first.append(s[ok])
            last.append(e[ok])
            own_size.append(np.full(int(ok.sum()), m))
        first, last, own_size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, last, own_size))
        best: dict[int, tuple] = {}
        for part in np.array_split(np.arange(len(first)), -(-len(first) // 512) or 1):
            if not len(part):
                continue
            a, b = first[part], last[part]
            # prefix sums over the stretch of the document that these windows cover
            low, high = int(a.min()), int(b.max())
            use = np.zeros(high - low, bool)
            delta = np.zeros(high - low + 1, np.int64)
            np.add.at(delta, a - low, 1)
            np.add.at(delta, b - low, -1)
            use = np.cumsum(delta[:-1]) > 0
            place = np.r_[0, np.cumsum(use)]
            sums = np.r_[np.zeros((1, 64), np.int32), np.cumsum(signs(values[low:high][use]), axis=0, dtype=np.int32)]
            prints = fingerprints(sums[place[b - low]] - sums[place[a - low]])
            todo: dict[int, list] = defaultdict(list)
            i, items, far = self.near(prints)
            fit = self.totals[items] == own_size[part[i]]  # an item is looked for in windows of its own size
            for w, item, f in zip(i[fit].tolist(), items[fit].tolist(), far[fit].tolist(), strict=True):
                todo[item].append((w, f))
            for item, windows in todo.items():
                own = np.isin(values[low:high], np.fromiter(self.sets[item].keys(), np.uint64, len(self.sets[item])))
                inside = np.r_[0, np.cumsum(own)]
                i = np.array([w for w, _ in windows])
                shared = inside[b[i] - low] - inside[a[i] - low]
                bound = shared / (b[i] - a[i] + self.totals[item] - np.minimum(shared, self.totals[item]))
                # windows by what they can reach at most; the first that no later one can beat is the best
                for j in np.lexsort((a[i], -bound)):
                    if bound[j] * 100 < rules.percent or item in best and bound[j] <= best[item][2]:
                        break
                    sim = similarity(values[a[i[j]] : b[i[j]]], self.sets[item], int(self.totals[item]))
                    if 100 * sim >= rules.percent and (item not in best or sim > best[item][2]):
                        best[item] = (int(a[i[j]]), int(b[i[j]]) + self.size - 1, sim, windows[j][1])
        return [(item, a, b, sim, far) for item, (a, b, sim, far) in sorted(best.items())]


def similarity(window: np.ndarray, item: Counter, total: int) -> float:
    got = Counter(window.tolist())
    both = sum(min(n, item[x]) for x, n in got.items() if x in item)
    return both / (len(window) + total - both)


def indexes(items: list[tuple[int, str]], rules: LeakRules) -> list[LeakIndex]:
    by_size = defaultdict(list)
    for i, t in items:
        words, n = letter_words([t or ""])
        if n[0]:
            by_size[min(rules.size, int(n[0]))].append((i, words))
    return [LeakIndex(own, size, rules) for size, own in sorted(by_size.items())]


LEAKS = "item_id long, start long, end long, similarity double, distance int"


def leaks_against(docs: DataFrame, found: list[LeakIndex], text: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            words, n = letter_words(texts)
            ends = np.cumsum(n)
            rows = []
            for index in sent.value:
                values = shingles(words, index.size)
                at = index.hits(values)
                doc = np.searchsorted(ends, at, side="right")
                own = at + index.size <= ends[doc]  # not across the end of a text
                at, doc = at[own], doc[own]
                for d in np.unique(doc):
                    a, b = int(ends[d] - n[d]), int(ends[d]) - index.size + 1
                    hit = np.zeros(b - a, bool)
                    hit[at[np.searchsorted(doc, d) : np.searchsorted(doc, d, side="right")] - a] = True
                    for item, s, e, sim, far in index.search(values[a:b], hit):
                        rows.append((int(d), index.ids[item], *char_span(texts[d], s, e), round(sim, 6), far))
            cols = list(zip(*rows)) or [[]] * 6
            names = {"item_id": pa.int64(), "start": pa.int64(), "end": pa.int64(), "similarity": pa.float64(), "distance": pa.int32()}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).take(pa.array(cols[0], pa.int64()))} | {k: pa.array(c, kind) for (k, kind), c in zip(names.items(), cols[1:], strict=True)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(lean(run), f"doc_id {kind}, {LEAKS}")


def char_span(text: str, first: int, end: int) -> tuple[int, int]:
    """Code points of words first to end - 1; the whole text where lower case splits letters of it."""
    if len(low := text.lower()) != len(text):
        return 0, len(text)
    places = [m.span() for m in WORD.finditer(low)][first:end]
    return places[0][0], places[-1][1]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rules: LeakRules = LeakRules(), text: str = "text") -> DataFrame:
    """Benchmark items that documents hold: doc_id, item_id, start, end (code points), similarity, distance.

    One row for each document row and item, with its best window; documents without leaks have none. Words are runs of
    letters and digits in lower case. Null, empty and wordless texts or items match nothing; repeated rows and items
    (and null ids) give their own rows; ties go to the first window; empty tables give an empty one. Other columns are
    ignored. The benchmark goes out in blocks of rules.items rows, whose size doesn't depend on the documents.
    """
    rows = benchmark.select(F.col("item_id").cast("long"), "text").filter("text is not null")
    out, held = None, []

    def add(out: DataFrame | None, held: list) -> DataFrame | None:
        found = indexes(held, rules)
        one = leaks_against(docs, found, text) if found else None
        return one if out is None else out if one is None else out.unionByName(one)

    for r in rows.toLocalIterator():
        held.append((r[0], r[1]))
        if len(held) == rules.items:
            out, held = add(out, held), []
    out = add(out, held) if held else out
    if out is None:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, {LEAKS}")
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, rules: LeakRules = LeakRules(), text: str = "text", most: int = 200_000) -> DataFrame:
    """docs without the rows that hold a benchmark item; columns as they were. Rows with null doc_id are judged by text.

    Up to `most` leaky texts are sent to all executors; beyond that, both sides are shuffled.
    """
    keyed = docs.select(F.xxhash64(text, F.length(text)).alias("doc_id"), F.col(text).alias("text"))
    bad = staged(find_leaks(keyed, benchmark, rules, "text").select(F.col("doc_id").alias("__tw_key")).distinct(), "leaky")
    few = bad.count() <= most
    return docs.join(F.broadcast(bad) if few else bad, F.xxhash64(docs[text], F.length(docs[text])) == F.col("__tw_key"), "left_anti")
