"""Phrases whose words keep company, counted exactly by counting quotient filters.

Texts are cut into pieces and words; a shard is a stretch of one language's texts as word ids. Only words that are
frequent enough themselves get global ids (no phrase is more frequent than its words), as small as can be. An
n-gram is its packed ids, permuted by an invertible Feistel network over exactly those bits. The leading bits of the
result (the quotient) choose the range and a run inside it, the rest (the full remainder) is stored, so a filter loses
nothing: entry and count come back by the inverse permutation. A shard sends one sorted filter for each range; a range
merges the sorted filters of all shards, keeps what is frequent, and tells each shard by a bitmap over the shard's own
filter which of its entries are. Only where both (n-1)-grams of an n-gram are frequent does the next level count it.

So nothing that grows with the corpus is broadcast or meets in one task: shards have a bounded size, and the permutation
spreads n-grams evenly over ranges, whose number grows with the corpus. A very frequent n-gram is one entry a shard.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwave.operators.order import small

from .common import U, lean, mix, staged

#: A-Z in lower case; tabs as spaces, the characters that end a piece as line feeds.
PLAIN = bytes({**dict(zip(range(65, 91), range(97, 123), strict=True)), 9: 32, **dict.fromkeys(b".,;:!?\x0a\x0b\x0c\r", 10)}.get(b, b) for b in range(256))
#: Bits of a lane of a packed n-gram at most, and rounds of the Feistel network over the lanes.
LANE, ROUNDS = 60, 6


@dataclass(frozen=True)
class PhraseRules:
    """least: occurrences of a phrase. longest: words of a phrase. top: phrases of each language. shard: bytes of a
    shard's texts. entries: n-gram occurrences that a range of a filter gets on average.
    """

    least: int = 100
    longest: int = 5
    top: int = 2000
    shard: int = 8_000_000
    entries: int = 1_000_000


# --- filters ---------------------------------------------------------------------------------------------------------


def widths(bits: int) -> list[int]:
    """The lanes' bits for packed n-grams of `bits` bits in all: two lanes or more, as even as can be, none above LANE."""
    n = max(2, -(-bits // LANE))
    return [bits // n + (i < bits % n) for i in range(n)]


def packed(words: np.ndarray, bits: int) -> list[np.ndarray]:
    """n-grams (a row each, ids of `bits` bits) as lanes; the first word is in the leading bits."""
    n = words.shape[1]
    lanes, total, at = [], n * bits, 0
    for width in widths(total):
        lane = np.zeros(len(words), np.uint64)
        for i in range(n):  # bits [at, at + width) from the left, of word i the bits that fall into them
            lo, hi = max(at, i * bits), min(at + width, (i + 1) * bits)
            if lo < hi:
                part = (words[:, i].astype(np.uint64) >> U((i + 1) * bits - hi)) & U((1 << (hi - lo)) - 1)
                lane |= part << U(at + width - hi)
        lanes.append(lane)
        at += width
    return lanes


def unpacked(lanes: list[np.ndarray], n: int, bits: int) -> np.ndarray:
    """The words of packed n-grams."""
    out, at = np.zeros((len(lanes[0]), n), np.uint64), 0
    for lane, width in zip(lanes, widths(n * bits), strict=True):
        for i in range(n):
            lo, hi = max(at, i * bits), min(at + width, (i + 1) * bits)
            if lo < hi:
                out[:, i] |= ((lane >> U(at + width - hi)) & U((1 << (hi - lo)) - 1)) << U((i + 1) * bits - hi)
        at += width
    return out.astype(np.int64)


def permuted(lanes: list[np.ndarray], bits: int, back: bool = False) -> list[np.ndarray]:
    """The Feistel network over lanes of `bits` bits in all, or its inverse: each step changes one lane by another."""
    lanes, size = list(lanes), widths(bits)
    steps = [(r, i) for r in range(ROUNDS) for i in range(len(lanes))]
    for r, i in reversed(steps) if back else steps:
        other = lanes[(i + 1) % len(lanes)]
        lanes[i] = lanes[i] ^ (mix(other + U(0x51ED2701 + 977 * r)) & U((1 << size[i]) - 1))
    return lanes


def sorted_counts(lanes: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct permuted n-grams in order, their counts, and the entry that each input has become."""
    order = np.lexsort(lanes[::-1])
    sorted_ = [x[order] for x in lanes]
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_])
    head = np.flatnonzero(fresh)
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(fresh) - 1
    n = np.diff(np.r_[head, len(order)]) if counts is None else np.add.reduceat(counts[order], head) if len(head) else np.zeros(0, np.int64)
    return [x[head] for x in sorted_], n.astype(np.int64), entry


def varints(values: np.ndarray) -> bytes:
    """Values as little-endian groups of 7 bits; the top bit says that more follow."""
    size = np.ones(len(values), np.int64)
    for k in range(1, -(-int(values.max(initial=1)).bit_length() // 7)):
        size += values >> (7 * k) > 0
    at, out = np.cumsum(size) - size, np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[at[has] + k] = ((values[has] >> (7 * k)) & 127) | np.where(size[has] > k + 1, 128, 0)
    return out.tobytes()


def from_varints(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).astype(np.int64)
    ends = np.flatnonzero(b < 128)
    if not len(ends):
        return np.zeros(0, np.int64)
    starts = np.r_[0, ends[:-1] + 1]
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127) << (7 * place), starts)


def stored(lanes: list[np.ndarray], counts: np.ndarray, bits: int, range_bits: int) -> tuple[bytes, bytes, bytes]:
    """A filter of one range: entries sorted, quotients as sizes of their runs, remainders in whole bytes, counts.

    The quotient inside the range takes as many bits as give some four entries a run; the remainder is all that is left.
    """
    first = widths(bits)[0]
    quotient = min(first - range_bits, max(0, len(counts).bit_length() - 3))
    rest = first - range_bits - quotient
    inside = lanes[0] & U((1 << (first - range_bits)) - 1)
    runs = np.bincount((inside >> U(rest)).astype(np.int64), minlength=1 << quotient)
    parts = [(inside & U((1 << rest) - 1), rest), *zip(lanes[1:], widths(bits)[1:], strict=True)]
    raw = [x.astype("<u8").view(np.uint8).reshape(len(x), 8)[:, : -(-width // 8)].T.tobytes() for x, width in parts]
    return bytes([quotient]) + varints(runs), b"".join(raw), varints(counts)


def restored(blob: tuple[bytes, bytes, bytes], bits: int, range_bits: int, at: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Permuted n-grams and counts of the filter of range `at`."""
    counts, first = from_varints(blob[2]), widths(bits)[0]
    quotient = blob[0][0]
    rest = first - range_bits - quotient
    runs = from_varints(blob[0][1:])
    lead = np.repeat(np.arange(len(runs)).astype(np.uint64), runs)
    lanes, raw, start = [], np.frombuffer(blob[1], np.uint8), 0
    for width in (rest, *widths(bits)[1:]):
        size = -(-width // 8)
        lane = np.zeros((len(counts), 8), np.uint8)
        lane[:, :size] = raw[start : start + size * len(counts)].reshape(size, len(counts)).T
        lanes.append(lane.view("<u8").ravel().astype(np.uint64))
        start += size * len(counts)
    lanes[0] |= (U(at) << U(first - range_bits)) | (lead << U(rest))
    return lanes, counts


def stream(ids: np.ndarray) -> bytes:
    """Word ids and -1 (the end of a piece) in few bytes: dictionaries give small ids to frequent words, zstandard the rest."""
    return zstandard.compress(varints(ids + 1), 1)


def from_stream(raw: bytes) -> np.ndarray:
    return from_varints(zstandard.decompress(raw)) - 1


# --- shards ----------------------------------------------------------------------------------------------------------


def shards(docs: DataFrame, rules: PhraseRules, text: str, lang: str) -> DataFrame:
    """Texts as shards: shard (unique), lang, total (words), ids (a stream, see there, of the shard's own dictionary), and
    the dictionary by the words' hashes: words (one text, by spaces), n (counts), places (own ids), as varints.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[defaultdict, list[np.ndarray], int]] = {}

        def flush(of: str) -> pa.RecordBatch:
            own, parts, _ = known.pop(of)
            raw = np.concatenate(parts)
            raw = raw[raw != 0].astype(np.int64) - 2  # 0: between two spaces; 1: the end of a piece
            words = list(own)[2:]
            n = np.bincount(raw[raw >= 0], minlength=len(words))
            order = np.argsort(hashes(words), kind="stable")
            return pa.RecordBatch.from_pydict({"shard": [uuid.uuid4().hex], "lang": [of], "total": pa.array([int(n.sum())], pa.int64()), "ids": [stream(raw)], "words": [b" ".join([words[i] for i in order.tolist()])], "n": [varints(n[order])], "places": [varints(order)]})

        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_pylist()
            for at, of in enumerate(batch.column(1).to_pylist()):
                if not size[at]:
                    continue
                if of not in known:
                    own = defaultdict()
                    own.default_factory = own.__len__
                    own[b""], own[b"\n"]
                    known[of] = (own, [], 0)
                own, parts, held = known[of]
                words = batch.column(0)[at].as_buffer().to_pybytes().translate(PLAIN).replace(b"\n", b" \n ").split(b" ")
                parts += [np.fromiter(map(own.__getitem__, words), np.int32, len(words)), np.ones(1, np.int32)]
                known[of] = (own, parts, held + size[at])
                if held + size[at] >= rules.shard:
                    yield flush(of)
        for of in list(known):
            yield flush(of)

    rows = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    return rows.mapInArrow(lean(run), "shard string, lang string, total long, ids binary, words binary, n binary, places binary")


def hashes(words: list[bytes]) -> np.ndarray:
    """32 bits of each word, whose leading bits tell the range that it is counted in."""
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words))


def words_of(raw: bytes) -> list[bytes]:
    return raw.split(b" ") if raw else []


def dictionaries(cut: DataFrame) -> DataFrame:
    """The shards' dictionaries by ranges: shard, lang, range_bits, part, words, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            words, n = words_of(row["words"]), from_varints(row["n"])
            part = hashes(words) >> (32 - row["range_bits"])
            heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
            spans = list(zip(heads.tolist(), [*heads[1:].tolist(), len(part)], strict=True)) if len(part) else []
            if spans:
                k = len(spans)
                yield pa.RecordBatch.from_pydict({"shard": [row["shard"]] * k, "lang": [row["lang"]] * k, "range_bits": pa.array([row["range_bits"]] * k, pa.int32()), "part": pa.array(part[heads]), "words": [b" ".join(words[a:b]) for a, b in spans], "n": [varints(n[a:b]) for a, b in spans]})

    return cut.select("shard", "lang", "range_bits", "words", "n").mapInArrow(lean(run), "shard string, lang string, range_bits int, part long, words binary, n binary")


def vocabulary_of(sent: DataFrame, least: int) -> DataFrame:
    """Of each range: its dictionaries merged. Rows of frequent words (lang, word, id, f; the more frequent, the smaller
    the id, which is near dense as hashes are even) and of answers (shard, part, ids: the word's id + 1, 0 for none).
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        part, bits = table["part"][0].as_py(), table["range_bits"][0].as_py()
        own = [words_of(table["words"][i].as_py()) for i in range(table.num_rows)]
        total: dict[bytes, int] = {}
        for words, n in zip(own, table["n"].to_pylist(), strict=True):
            for w, c in zip(words, from_varints(n).tolist(), strict=True):
                total[w] = total.get(w, 0) + c
        often = sorted((w for w, f in total.items() if f >= least), key=lambda w: (-total[w], w))
        ids = {w: (i << bits) + part for i, w in enumerate(often)}
        told = [varints(np.fromiter((ids.get(w, -1) + 1 for w in words), np.int64, len(words))) for words in own]
        k, m = len(often), table.num_rows
        return pa.table({
            "shard": pa.chunked_array([pa.nulls(k, pa.string()), table["shard"].combine_chunks().cast(pa.string())]),
            "lang": pa.array([table["lang"][0].as_py()] * (k + m), pa.string()),
            "part": pa.array([part] * (k + m), pa.int64()),
            "ids": pa.chunked_array([pa.nulls(k, pa.binary()), pa.array(told, pa.binary())]),
            "word": pa.chunked_array([pa.array([w.decode("utf-8", "replace") for w in often], pa.string()), pa.nulls(m, pa.string())]),
            "id": pa.chunked_array([pa.array([ids[w] for w in often], pa.int64()), pa.nulls(m, pa.int64())]),
            "f": pa.chunked_array([pa.array([total[w] for w in often], pa.int64()), pa.nulls(m, pa.int64())]),
        })

    return sent.groupBy("lang", "part").applyInArrow(run, "shard string, lang string, part long, ids binary, word string, id long, f long")


def with_ids(cut: DataFrame, answers: DataFrame) -> DataFrame:
    """Shards (shard, lang, ids) with global ids (-1: the end of a piece or a word that isn't frequent)."""
    told = answers.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("told"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            order = from_varints(row["places"])
            table = np.full(len(order) + 1, -1, np.int64)  # the last one stands for -1
            table[order] = np.concatenate([from_varints(t["ids"]) for t in row["told"]]) - 1
            ids = once_ended(table[from_stream(row["ids"])])
            yield pa.RecordBatch.from_pydict({"shard": [row["shard"]], "lang": [row["lang"]], "ids": [stream(ids)]})

    return cut.select("shard", "lang", "ids", "places").join(told, "shard").mapInArrow(lean(run), "shard string, lang string, ids binary")


def once_ended(ids: np.ndarray) -> np.ndarray:
    """Of several ends in a row, one is enough."""
    return ids[~((ids < 0) & np.r_[True, ids[:-1] < 0][: len(ids)])]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as dicts, one at a time, as a row may be large."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def places(ids: np.ndarray, n: int, marks: np.ndarray) -> np.ndarray:
    """Where an n-gram may be frequent: all its words have ids, and both its (n-1)-grams are marked (n > 2)."""
    if n == 2:
        return np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    good = np.zeros(len(ids) + 1, bool)
    good[marks] = True
    return marks[good[marks + 1]]


def filters(state: DataFrame, n: int) -> DataFrame:
    """The filters of all shards: shard, lang, part (range), quotients, remainders, counts, entries.

    state: shard, ids, marks (int64 places of frequent (n-1)-grams) and the language's lang, bits, range_bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            lanes, counts, _, _ = counted(row, n)
            total, cut = n * row["bits"], row["range_bits"]
            part = (lanes[0] >> U(widths(total)[0] - cut)).astype(np.int64)
            heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
            out = {"part": [], "quotients": [], "remainders": [], "counts": []}
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(part)], strict=True) if len(part) else ():
                blob = stored([x[a:b] for x in lanes], counts[a:b], total, cut)
                for c, v in zip(out, (int(part[a]), *blob), strict=True):
                    out[c].append(v)
            k = len(out["part"])
            if k:
                yield pa.RecordBatch.from_pydict({"shard": [row["shard"]] * k, "lang": [row["lang"]] * k, "bits": pa.array([row["bits"]] * k, pa.int32()), "range_bits": pa.array([cut] * k, pa.int32()), **out})

    return state.select("shard", "lang", "bits", "range_bits", "ids", "marks").mapInArrow(lean(run), "shard string, lang string, bits int, range_bits int, part long, quotients binary, remainders binary, counts binary")


def counted(row: dict, n: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """A shard's n-grams: sorted permuted lanes, counts; places, and the entry at each place."""
    ids = from_stream(row["ids"])
    at = places(ids, n, np.frombuffer(row["marks"] or b"", "<i8"))
    words = np.stack([ids[at + k] for k in range(n)], 1) if len(at) else np.zeros((0, n), np.int64)
    lanes, counts, entry = sorted_counts(permuted(packed(words, row["bits"]), n * row["bits"]))
    return lanes, counts, at, entry


def merged(sent: DataFrame, n: int, least: int) -> DataFrame:
    """Of each range: its filters merged. Rows of phrases (lang, ids, f) and of answers (shard, part, frequent: a bitmap)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bits, cut, part = table["bits"][0].as_py(), table["range_bits"][0].as_py(), table["part"][0].as_py()
        own = [restored(tuple(table[c][i].as_py() for c in ("quotients", "remainders", "counts")), n * bits, cut, part) for i in range(table.num_rows)]
        ends = np.cumsum([len(c) for _, c in own])
        lanes, counts, entry = sorted_counts([np.concatenate(x) for x in zip(*(k for k, _ in own), strict=True)], np.concatenate([c for _, c in own]))
        often = counts >= least
        told = [np.packbits(x).tobytes() for x in np.split(often[entry], ends[:-1])]
        words = unpacked(permuted([x[often] for x in lanes], n * bits, back=True), n, bits)
        k, m = int(often.sum()), table.num_rows
        none = lambda size, kind: pa.nulls(size, kind)
        return pa.table({
            "shard": pa.chunked_array([none(k, pa.string()), table["shard"].combine_chunks().cast(pa.string())]),
            "lang": pa.chunked_array([pa.array([table["lang"][0].as_py()] * k, pa.string()), none(m, pa.string())]),
            "part": pa.chunked_array([none(k, pa.int64()), table["part"].combine_chunks().cast(pa.int64())]),
            "frequent": pa.chunked_array([none(k, pa.binary()), pa.array(told, pa.binary())]),
            "ids": pa.chunked_array([pa.array(list(words), pa.list_(pa.int64())), none(m, pa.list_(pa.int64()))]),
            "f": pa.chunked_array([pa.array(counts[often], pa.int64()), none(m, pa.int64())]),
        })

    return sent.groupBy("lang", "part").applyInArrow(run, "shard string, lang string, part long, frequent binary, ids array<long>, f long")


def marked(state: DataFrame, answers: DataFrame, n: int) -> DataFrame:
    """Shards that have frequent n-grams, their places as marks: shard, lang, bits, range_bits, ids, marks.

    Words outside of all frequent n-grams turn into ends, as no longer phrase holds them.
    """
    told = answers.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("part", "frequent"))).alias("told"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            lanes, _, at, entry = counted(row, n)
            part = (lanes[0] >> U(widths(n * row["bits"])[0] - row["range_bits"])).astype(np.int64)
            often = np.zeros(len(part), bool)
            for t in row["told"]:
                a, b = np.searchsorted(part, [t["part"], t["part"] + 1])
                often[a:b] = np.unpackbits(np.frombuffer(t["frequent"], np.uint8), count=int(b - a)).astype(bool)
            marks = at[often[entry]]
            if not len(marks):
                continue
            ids = from_stream(row["ids"])
            inside = np.zeros(len(ids), bool)
            for k in range(n):
                inside[marks + k] = True
            ids = np.where(inside, ids, -1)
            stays = ~((ids < 0) & np.r_[True, ids[:-1] < 0])
            marks = (np.cumsum(stays) - 1)[marks]
            yield pa.RecordBatch.from_pydict({**{c: [row[c]] for c in ("shard", "lang")}, **{c: pa.array([row[c]], pa.int32()) for c in ("bits", "range_bits")}, "ids": [stream(ids[stays])], "marks": [marks.astype("<i8").tobytes()]})

    return state.join(told, "shard").select("shard", "lang", "bits", "range_bits", "ids", "marks", "told").mapInArrow(lean(run), "shard string, lang string, bits int, range_bits int, ids binary, marks binary")


# --- phrases ---------------------------------------------------------------------------------------------------------


def frequent_phrases(docs: DataFrame, rules: PhraseRules = PhraseRules(), text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact counts: (phrases: lang, ids, f of 1 to rules.longest words; vocabulary: lang, word, id; sizes: lang, n)."""
    cut = staged(shards(docs, rules, text, lang), "phrases-shards")
    sizes = small(cut.groupBy("lang").agg(F.sum("total").alias("n")))
    ranges = F.greatest(F.ceil(F.log2(F.greatest(F.col("n") / rules.entries, F.lit(1.0)))), F.lit(0)).cast("int")
    ranged = sizes.select("lang", ranges.alias("range_bits"))
    level = staged(vocabulary_of(dictionaries(cut.join(ranged, "lang")), rules.least), "phrases-words")
    vocabulary = level.filter("word is not null").select("lang", "word", "id", "f")
    bits = small(vocabulary.groupBy("lang").agg(F.greatest(F.length(F.bin(F.max("id"))), F.lit(2)).alias("bits")))
    # a range can't have more bits than the first lane of a pair of ids
    per_lang = bits.join(ranged, "lang").select("lang", "bits", F.least("range_bits", "bits").alias("range_bits"))
    state = with_ids(cut, level.filter("ids is not null").select("shard", "part", "ids")).join(small(per_lang), "lang")
    state = staged(state.select("shard", "lang", "bits", "range_bits", "ids", F.lit(None).cast("binary").alias("marks")), "phrases-state")
    found = [vocabulary.select("lang", F.array("id").alias("ids"), "f")]
    for n in range(2, rules.longest + 1):
        level = staged(merged(filters(state, n), n, rules.least), f"phrases-level{n}")
        found.append(level.filter("ids is not null").select("lang", "ids", "f"))
        if n < rules.longest:
            state = staged(marked(state, level.filter("frequent is not null").select("shard", "part", "frequent"), n), "phrases-state")
    phrases = found[0]
    for more in found[1:]:
        phrases = phrases.unionByName(more)
    return phrases, vocabulary, sizes


def collocations(docs: DataFrame, rules: PhraseRules = PhraseRules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """The first phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    Words are what stands between spaces and tabs within pieces, which end at .,;:!? and line ends (A-Z in lower case).
    A phrase of 2 to rules.longest words that occurs rules.least times is cut where floor(1000 * a * n / (l * r)) is
    least (the first such cut counts); phrases inside a longer one that occurs as often drop out. Null texts count as
    empty, null languages as und; repeated rows count again. Empty tables and texts without words give no row, other
    columns are ignored whatever their names. Counts are exact, products are decimals of 38 digits.
    """
    phrases, vocabulary, sizes = frequent_phrases(docs, rules, text, lang)
    phrases = staged(phrases, "phrases-all")
    long_ = phrases.filter("size(ids) > 1")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("ids") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("ids") - k + 1), lambda i: F.slice("ids", i, k))))
    covered = long_.filter("size(ids) > 2").select("lang", F.explode(inner).alias("ids"), "f").distinct()
    left = long_.join(covered, ["lang", "ids", "f"], "left_anti")
    cut = left.select("lang", "ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cut = cut.withColumns({"head": F.slice("ids", 1, F.col("k")), "tail": F.slice("ids", F.col("k") + 1, F.size("ids"))})
    known = lambda ids, f: phrases.select("lang", F.col("ids").alias(ids), F.col("f").alias(f))
    cut = cut.join(known("head", "l"), ["lang", "head"]).join(known("tail", "r"), ["lang", "tail"]).join(sizes, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("cast(top div bottom as bigint)")
    cut = cut.withColumns({"top": (F.lit(1000).cast("decimal(4,0)") * exact("a")).cast("decimal(23,0)") * exact("n"), "bottom": exact("l") * exact("r")}).withColumn("score", score)
    best = cut.groupBy("lang", "ids", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "ids", "a", "n", "b.l", "b.r", "b.score")
    # ranks tie, so no phrase that could be among the first is lost before words are put in
    some = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = staged(best.withColumn("rank", F.rank().over(some)).filter(F.col("rank") <= rules.top).drop("rank"), "phrases-best")
    word = best.select("lang", "ids", F.posexplode("ids").alias("at", "id")).join(vocabulary.select("lang", "id", "word"), ["lang", "id"])
    said = word.groupBy("lang", "ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.join(said, ["lang", "ids"]).withColumn("rank", F.row_number().over(first).cast("long")).filter(F.col("rank") <= rules.top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
