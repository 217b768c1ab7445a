"""Repeated byte windows: depth-limited radix sort of suffixes, and removal of what repeats.

Suffixes are ordered through DEPTH bytes only, by most-significant-digit passes; groups that are still equal after the
last digit are exactly the windows that repeat. Sorting every suffix of a corpus would shuffle many times its size, so
the first pass deals suffixes out by an anchor: the smallest hashed gram among those inside their window. Equal windows
have equal anchors at equal offsets, and neighbouring suffixes mostly share theirs, so one row carries a run of them:

1. count the anchors' grams over all texts; a gram that one text alone holds can't be part of a repeat between texts;
2. send the runs of shared grams (bytes of the run) to their gram's group, where the digit passes sort them; repeats
   inside one text are found in the same scan;
3. grams that very many texts share would make one large group: their suffixes go on their own, as rows that Spark
   counts before it shuffles them.

Digits are compared by 64-bit values; what is then grouped is held against its bytes. Suffixes under crowded grams take
no digit passes: they are grouped by 128 bits of the whole window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE, Hashes, U, lean, mix, ragged, slices, staged

#: Base of the second 64 bits of a window's value.
SECOND = 0xD1342543DE82EF95
#: Bits of a flat position inside a packed (hash, position) value.
POSITION_BITS = 32


@dataclass(frozen=True)
class RepeatRules:
    """depth: bytes of a window. gram: bytes of an anchor. digits: passes. crowd: texts from which a gram's suffixes go
    on their own. bits: most bits of the filter that tells scans which grams are shared; where it is too small, each text
    gets its own shared grams by a join. rows: runs sorted at once.
    """

    depth: int = 400
    gram: int = 128
    digits: int = 2
    crowd: int = 1000
    bits: int = 27
    rows: int = 4000


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width neighbours, from running minima of blocks in both directions."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(x)] = x
    two = blocks.reshape(-1, width)
    forth = np.minimum.accumulate(two, axis=1).ravel()
    back = np.minimum.accumulate(two[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], forth[width - 1 : width - 1 + n])


@dataclass
class Runs:
    """Runs of suffixes that share their anchor: text, gram value, anchor's and first suffix' place, suffixes."""

    text: np.ndarray
    gram: np.ndarray
    anchor: np.ndarray
    first: np.ndarray
    n: np.ndarray


def anchored(hashes: Hashes, begin: np.ndarray, size: np.ndarray, rules: RepeatRules) -> Runs:
    """The runs of all texts in a flat buffer. begin, size: of the texts, each of depth bytes at least."""
    grams = hashes.all(rules.gram)
    mask = U((1 << POSITION_BITS) - 1)
    packed = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    low = sliding_min(packed, rules.depth - rules.gram + 1)
    starts = ragged(begin, size - rules.depth + 1)
    anchor = (low[starts] & mask).astype(np.int64)
    text = np.repeat(np.arange(len(begin)), size - rules.depth + 1)
    head = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]) if len(starts) else np.zeros(0, np.int64)
    return Runs(text[head], grams[anchor[head]], anchor[head], starts[head].astype(np.int64), np.diff(np.r_[head, len(starts)]))


def long_texts(texts: list[str], rules: RepeatRules, seen: set[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], list[tuple], np.ndarray]:
    """Flat bytes, begins and sizes of the texts of depth bytes or more that this task meets first; their keys; keys and
    sizes of those met again; the rows of the first ones.
    """
    raw, keys, again, rows = [], [], [], []
    for r, t in enumerate(texts):
        if len(t) * 4 < rules.depth or len(b := t.encode("utf-8", "surrogatepass")) < rules.depth:
            continue
        key = hashlib.md5(b, usedforsecurity=False).digest()
        if key in seen:
            again.append((key, len(b)))
        else:
            seen.add(key)
            raw.append(b)
            keys.append(key)
            rows.append(r)
    size = np.array([len(b) for b in raw], np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size, keys, again, np.array(rows, np.int64)


def grams_of(docs: DataFrame, rules: RepeatRules, text: str) -> DataFrame:
    """Each gram that anchors a run and is held by several texts (or several tasks): gram, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for _, texts in slices(batches, text=0):
            flat, begin, size, *_ = long_texts(texts, rules, seen)
            if len(begin):
                runs = anchored(Hashes(flat), begin, size, rules)
                at = np.lexsort((runs.gram, runs.text))
                g, t = runs.gram[at], runs.text[at]
                fresh = np.r_[True, (g[1:] != g[:-1]) | (t[1:] != t[:-1])]
                yield pa.RecordBatch.from_pydict({"gram": pa.array(g[fresh].view(np.int64))})

    counted = docs.select(text).mapInArrow(lean(run), "gram long").groupBy("gram").agg(F.count("*").alias("n"))
    return counted.filter("n > 1")


def with_grams(docs: DataFrame, grams: DataFrame, rules: RepeatRules) -> DataFrame:
    """docs (text) with the shared grams of each text: text, grams (array of gram, hot). Grams are joined, not sent to all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches, text=0):
            flat, begin, size, keys, _, _ = long_texts(texts, rules, set())
            if len(begin):
                runs = anchored(Hashes(flat), begin, size, rules)
                yield pa.RecordBatch.from_pydict({"key": pa.array([keys[i] for i in runs.text], pa.binary()), "gram": pa.array(runs.gram.view(np.int64))})

    pairs = docs.mapInArrow(lean(run), "key binary, gram long").distinct().join(grams.select("gram", (F.col("n") > rules.crowd).alias("hot")), "gram")
    own = pairs.groupBy("key").agg(F.collect_list(F.struct("gram", "hot")).alias("grams"))
    return docs.withColumn("key", text_key("text")).join(own, "key", "left").select("text", "grams")


def text_key(text: str):
    return F.unhex(F.md5(F.col(text).cast("binary")))


def bit_filter(grams: DataFrame, bits: int) -> np.ndarray:
    """A filter of 2^bits bits over grams, as words of 64; its size doesn't depend on how many there are."""
    at = F.pmod("gram", F.lit(1 << bits))
    words = grams.select(F.shiftright(at, 6).alias("word"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("set")).toPandas()
    out = np.zeros(max(1, (1 << bits) // 64), np.int64)
    out[got["word"].to_numpy(np.int64)] = got["set"].to_numpy(np.int64)
    return out


def in_filter(words: np.ndarray, grams: np.ndarray) -> np.ndarray:
    at = grams.view(np.int64) % (len(words) * 64)
    return (words[at >> 6] >> (at & 63)) & 1 == 1


def starts_to_ranges(text: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal ranges of neighbouring starts: text, first, last. Sorted by text and start."""
    if not len(start):
        return text, start, start
    cut = np.flatnonzero((text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1))
    head, tail = np.r_[0, cut + 1], np.r_[cut, len(start) - 1]
    return text[head], start[head], start[tail]


def own_repeats(flat: np.ndarray, hashes: Hashes, runs: Runs, begin: np.ndarray, size: np.ndarray, rules: RepeatRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of starts whose window starts elsewhere in the same text; only texts that repeat an anchor can have any."""
    at = np.lexsort((runs.gram, runs.text))
    g, t = runs.gram[at], runs.text[at]
    some = np.unique(t[1:][(g[1:] == g[:-1]) & (t[1:] == t[:-1])])
    n = size[some] - rules.depth + 1
    starts, text = ragged(begin[some], n).astype(np.int64), np.repeat(some, n)
    value = hashes(starts, rules.depth)
    at = np.lexsort((value, text))
    same = (value[at][1:] == value[at][:-1]) & (text[at][1:] == text[at][:-1])
    x, y = starts[at[:-1][same]], starts[at[1:][same]]
    ok = same_bytes(flat, x, y, rules.depth)
    hit = np.zeros(len(starts), bool)
    hit[at[1:][same][ok]] = hit[at[:-1][same][ok]] = True
    return starts_to_ranges(text[hit], starts[hit])


def same_bytes(flat: np.ndarray, x: np.ndarray, y: np.ndarray, depth: int) -> np.ndarray:
    """Whether the depth bytes from each x equal those from its y. Neighbouring pairs are compared as one stretch."""
    ok = np.ones(len(x), bool)
    order = np.lexsort((x, y - x))
    cut = np.flatnonzero((np.diff(x[order]) != 1) | (np.diff((y - x)[order]) != 0)) + 1
    for part in np.split(order, cut) if len(order) else []:
        a, b, n = int(x[part[0]]), int(y[part[0]]), len(part) + depth - 1
        if not np.array_equal(flat[a : a + n], flat[b : b + n]):
            ok[part] = [np.array_equal(flat[i : i + depth], flat[j : j + depth]) for i, j in zip(x[part], y[part])]
    return ok


ROW = "kind int, gram long, more long, key binary, first long, last long, off int, bytes binary"


def runs_of(docs: DataFrame, shared: np.ndarray | None, crowded: np.ndarray | None, rules: RepeatRules) -> DataFrame:
    """The second scan. kind 0: a run of suffixes (first, last; off of the anchor; bytes) under a shared gram.
    kind 1: a range of starts that repeat inside their text or whose text comes again in the task. kind 2: one suffix
    (first) under a crowded gram, with 128 bits of its window as gram and more.

    shared, crowded: filters of these grams. Without them, docs has beside its text (first) the text's own, as grams.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((shared, crowded))

    def told(batch: pa.RecordBatch, runs: Runs, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the gram of each run is shared, and crowded."""
        shared, crowded = sent.value
        if shared is not None:
            return in_filter(shared, runs.gram), in_filter(crowded, runs.gram)
        own = [{g["gram"]: g["hot"] for g in batch.column(1)[int(r)].as_py() or ()} for r in rows]
        found = [own[t].get(g) for t, g in zip(runs.text.tolist(), runs.gram.view(np.int64).tolist(), strict=True)]
        return np.array([f is not None for f in found], bool), np.array([bool(f) for f in found], bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch, texts in slices(batches, text=0):
            flat, begin, size, keys, again, rows = long_texts(texts, rules, seen)
            if again:
                yield row(1, None, None, [k for k, _ in again], np.zeros(len(again), np.int64), np.array([n - rules.depth for _, n in again]))
            if not len(begin):
                continue
            hashes = Hashes(flat)
            runs = anchored(hashes, begin, size, rules)
            t, a, b = own_repeats(flat, hashes, runs, begin, size, rules)
            if len(t):
                yield row(1, None, None, [keys[i] for i in t], a - begin[t], b - begin[t])
            is_shared, is_hot = told(batch, runs, rows)
            use = np.flatnonzero(is_shared)
            # a run that comes again in its text is covered above; one of them is enough for other texts
            end = runs.first[use] + runs.n[use] - 1 + rules.depth
            value = hashes(runs.first[use], end - runs.first[use])
            at = np.lexsort((value, runs.n[use], runs.gram[use], runs.text[use]))
            same = [x[use][at] for x in (runs.text, runs.gram, runs.n)] + [value[at]]
            fresh = np.r_[True, np.any([x[1:] != x[:-1] for x in same], axis=0)] if len(use) else np.zeros(0, bool)
            use = np.sort(use[at[fresh]])
            hot = is_hot[use]
            for i in np.array_split(use[~hot], max(1, int((~hot).sum()) // 5000)):
                if len(i):
                    parts = [flat[p:q].tobytes() for p, q in zip(runs.first[i], runs.first[i] + runs.n[i] - 1 + rules.depth, strict=True)]
                    first = runs.first[i] - begin[runs.text[i]]
                    yield row(0, runs.gram[i], None, [keys[x] for x in runs.text[i]], first, first + runs.n[i] - 1, runs.anchor[i] - runs.first[i], parts)
            more = Hashes(flat, SECOND) if hot.any() else hashes
            for i in np.array_split(use[hot], max(1, int(hot.sum()) // 500)):
                if len(i):
                    starts, owner = ragged(runs.first[i], runs.n[i]).astype(np.int64), np.repeat(runs.text[i], runs.n[i])
                    first = starts - begin[owner]
                    yield row(2, hashes(starts, rules.depth), more(starts, rules.depth), [keys[x] for x in owner], first, first)

    return docs.mapInArrow(lean(run), ROW)


def row(kind: int, gram, more, keys: list[bytes], first: np.ndarray, last: np.ndarray, off=None, parts=None) -> pa.RecordBatch:
    n = len(keys)
    return pa.RecordBatch.from_pydict(
        {
            "kind": pa.array(np.full(n, kind, np.int32)),
            "gram": pa.nulls(n, pa.int64()) if gram is None else pa.array(gram.view(np.int64)),
            "more": pa.nulls(n, pa.int64()) if more is None else pa.array(more.view(np.int64)),
            "key": pa.array(keys, pa.binary()),
            "first": pa.array(first.astype(np.int64)),
            "last": pa.array(last.astype(np.int64)),
            "off": pa.nulls(n, pa.int32()) if off is None else pa.array(off.astype(np.int32)),
            "bytes": pa.nulls(n, pa.binary()) if parts is None else pa.array(parts, pa.binary()),
        }
    )


def radix_repeats(gram: np.ndarray, off: np.ndarray, n: np.ndarray, parts: list[bytes], rules: RepeatRules) -> tuple[np.ndarray, np.ndarray]:
    """Of runs, the (run, suffix) that are still grouped with another after the last digit.

    A suffix' group is its gram and its distance to the anchor, then each digit in turn; a suffix alone leaves at once.
    """
    flat = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts], np.int64)
    begin = np.cumsum(size) - size
    hashes = Hashes(flat)
    owner = np.repeat(np.arange(len(n)), n)
    suffix = ragged(np.zeros(len(n), np.int64), n).astype(np.int64)
    group = mix(gram[owner] + (off[owner] - suffix).astype(np.uint64) * U(0xA0761D6478BD642F))
    digit = rules.depth // rules.digits
    for d in range(rules.digits):
        if not len(group):
            break
        at = begin[owner] + suffix + d * digit
        group = mix(group * U(BASE) + hashes(at, digit if d < rules.digits - 1 else rules.depth - d * digit))
        order = np.argsort(group, kind="stable")
        same = group[order][1:] == group[order][:-1]
        x, y = order[:-1][same], order[1:][same]
        if d == rules.digits - 1:
            ok = same_bytes(flat, (begin[owner] + suffix)[x], (begin[owner] + suffix)[y], rules.depth)
            x, y = x[ok], y[ok]
        keep = np.zeros(len(group), bool)
        keep[x] = keep[y] = True
        owner, suffix, group = owner[keep], suffix[keep], group[keep]
    return owner, suffix


def sorted_runs(rows: DataFrame, rules: RepeatRules) -> DataFrame:
    """Ranges of repeated starts of the runs of kind 0: key, first, last."""

    def flush(cols: list) -> pa.RecordBatch:
        gram, key, first, last, off, parts = cols
        first, n = np.array(first, np.int64), np.array(last, np.int64) - np.array(first, np.int64) + 1
        owner, suffix = radix_repeats(np.array(gram, np.int64).view(np.uint64), np.array(off, np.int64), n, parts, rules)
        t, a, b = starts_to_ranges(owner, suffix)
        return pa.RecordBatch.from_pydict({"key": pa.array([key[i] for i in t], pa.binary()), "first": pa.array(first[t] + a), "last": pa.array(first[t] + b)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(6)]
        for batch in batches:
            for at in range(0, batch.num_rows, rules.rows):
                for h, c in zip(held, batch.slice(at, rules.rows).columns, strict=True):
                    h += c.to_pylist()
                # whole groups only; the last one may go on in the next rows
                cut = len(held[0])
                while cut and held[0][cut - 1] == held[0][-1]:
                    cut -= 1
                if cut and len(held[0]) >= rules.rows:
                    yield flush([h[:cut] for h in held])
                    held = [h[cut:] for h in held]
        if held[0]:
            yield flush(held)

    own = rows.filter("kind = 0").select("gram", "key", "first", "last", "off", "bytes")
    return own.repartition("gram").sortWithinPartitions("gram").mapInArrow(lean(run), "key binary, first long, last long")


def crowded_starts(rows: DataFrame) -> DataFrame:
    """Ranges of the suffixes of kind 2 whose window others have too: key, first, last. Neighbouring starts become one range."""
    own = rows.filter("kind = 2").select("gram", "more", "key", "first")
    crowd = own.groupBy("gram", "more").agg(F.count("*").alias("n")).filter("n > 1").select("gram", "more")
    starts = own.join(crowd, ["gram", "more"]).select("key", "first").distinct()
    island = F.col("first") - F.row_number().over(Window.partitionBy("key").orderBy("first"))
    return starts.withColumn("island", island).groupBy("key", "island").agg(F.min("first").alias("first"), F.max("first").alias("last")).drop("island")


def repeated_ranges(docs: DataFrame, rules: RepeatRules = RepeatRules(), text: str = "text") -> DataFrame:
    """Starts whose window of depth bytes starts elsewhere too: key (md5 of the text's bytes), ranges (array of first, last).

    Texts that come several times, in whichever tasks, have all their starts.
    """
    docs = docs.select(F.col(text).alias("text"))
    grams = staged(grams_of(docs, rules, "text"), "repeat-grams")
    n = grams.count()
    if n <= 1 << (rules.bits - 2):
        bits = max(16, (n * 256).bit_length())
        shared = bit_filter(grams, min(bits, rules.bits))
        crowded = bit_filter(grams.filter(F.col("n") > rules.crowd), min(bits, 22))
        found = runs_of(docs, shared, crowded, rules)
    else:
        found = runs_of(with_grams(docs, grams, rules), None, None, rules)
    rows = staged(found, "repeat-runs")
    ranges = rows.filter("kind = 1").select("key", "first", "last").unionByName(sorted_runs(rows, rules)).unionByName(crowded_starts(rows))
    return ranges.distinct().groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))


def without_repeats(docs: DataFrame, rules: RepeatRules = RepeatRules(), text: str = "text", with_text: bool = True) -> DataFrame:
    """Each document without the bytes of its repeated windows.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (bytes left; left out without with_text),
    kept_sha256. A start counts as repeated if the depth bytes from it start anywhere else, in the same text or another
    row's; overlaps count, and all is judged on the texts as they came. Null, empty or shorter texts lose nothing.
    Repeated rows are copies of each other and lose all (from depth bytes on); null doc_ids and ties keep their rows;
    an empty table gives an empty one; other columns are ignored.
    """
    # written, so that the join with them is a stage of its own, whose hot texts (copies) Spark can split
    ranges = staged(repeated_ranges(docs, rules, text), "repeat-ranges")
    keyed = docs.select("doc_id", F.col(text).alias("text")).withColumn("key", text_key("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            out: list[tuple] = []
            for t, found in zip(texts, batch.column(2).to_pylist(), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                spans = removed_spans(found or [], rules.depth)
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                left = b"".join([*kept, raw[at:]])
                out.append((len(raw), len(raw) - len(left), len(spans), left, hashlib.sha256(left).hexdigest()))
            n, gone, spans, left, sha = zip(*out)
            cols = {"doc_id": batch.column(0), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(spans, pa.int64())}
            if with_text:
                cols["kept"] = pa.array(left, pa.binary())
            yield pa.RecordBatch.from_pydict(cols | {"kept_sha256": pa.array(sha)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = keyed.join(ranges, "key", "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, " + "kept binary, " * with_text + "kept_sha256 string")


def removed_spans(ranges: list[dict], depth: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that ranges of starts cover."""
    out: list[list[int]] = []
    for r in sorted((r["first"], r["last"]) for r in ranges):
        if out and r[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r[1] + depth)
        else:
            out.append([r[0], r[1] + depth])
    return [(a, b) for a, b in out]
