"""MinHash near-duplicates by a multi-index Hamming join.

A signature has K symbols of 16 bits, each the minimum of one hash over a document's shingles; its distance is the
number of symbols that differ. It is split into chunks of CHUNK symbols. By pigeonhole, two signatures of a distance of
at most (errors + 1) * chunks - 1 differ in at most `errors` symbols of some chunk; so each chunk is a key once for
every choice of symbols left out, and all pairs within that distance share a key. Links are confirmed on full sets.

Only classes of equal sets enter. Buckets never give all their pairs: in each of a few turns, a member is held against
one member that a bucket names for the turn, links are merged into components, and only buckets that still span several
components go on, for as long as turns bring links. In the end their pairs across components are compared by an exact bound: the parities of a set's
values in `bits` cells differ in no more cells than two sets differ in values, so pairs that differ in too many cells
can't be links. So a large group of near copies costs a few rows for each member, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import BASE, U, lean, mix, slices, spaced_words, staged

#: Stands for a missing doc_id, so that it sorts last.
NO_ID = (1 << 63) - 1
#: A turn that links fewer than one in so many of the components left is the last one.
WORTH = 50


@dataclass(frozen=True)
class NearRules:
    """size: words of a shingle. percent: 100 * intersection >= percent * union. errors: symbols left out of a chunk.
    bits: parities of each set (a power of 2, 64 at least). turns: in which members meet one member of their buckets, at least.
    block: members of a bucket that one task compares with the others at once. small: most rows sent to all executors.
    """

    size: int = 5
    percent: int = 75
    chunks: int = 10
    chunk: int = 4
    errors: int = 1
    bits: int = 1024
    turns: int = 2
    block: int = 4096
    small: int = 50_000

    @property
    def symbols(self) -> int:
        return self.chunks * self.chunk


def shingle_sets(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle values of all texts, sorted within each; the size of each text's set."""
    words, n = spaced_words(texts)
    stop = np.cumsum(n)
    room = np.repeat(stop, n) - np.arange(len(words))  # words from here to the end of the text
    value = words.copy()
    for k in range(1, size):
        value = np.where(room > k, value * U(BASE) + np.roll(words, -k), value)
    value = mix(value + np.minimum(room, size).astype(np.uint64))
    # a shingle starts at each word with size - 1 more behind it; a shorter text is one shingle
    value = value[(room >= size) | (room == np.repeat(n, n))]
    sizes = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    stop = np.cumsum(sizes)
    for a, b in zip((stop - sizes).tolist(), stop.tolist(), strict=True):
        value[a:b].sort()
    doc = np.repeat(np.arange(len(n)), sizes)
    fresh = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])][: len(value)]
    return value[fresh], np.bincount(doc[fresh], minlength=len(n))


def signatures(sets: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """k symbols of 16 bits for each set; zeros for an empty one."""
    full = sizes > 0
    at = (np.cumsum(sizes) - sizes)[full]
    add, times = np.random.default_rng(20_07).integers(1, 1 << 63, (2, k), dtype=np.uint64) | U(1)
    out = np.zeros((len(sizes), k), np.uint16)
    for i in range(k if len(at) else 0):
        x = sets ^ add[i]
        x *= times[i]
        x ^= x >> U(31)
        out[full, i] = (mix(np.minimum.reduceat(x, at)) & U(0xFFFF)).astype(np.uint16)
    return out


def parities(sets: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """Of each set, as longs: which of `bits` cells hold an odd number of its values. sets: sorted within each."""
    cell = np.repeat(np.arange(len(sizes)) * bits, sizes) + (sets >> U(65 - bits.bit_length())).astype(np.int64)
    head = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]][: len(cell)])
    odd = cell[head][np.diff(np.r_[head, len(cell)]) % 2 == 1]
    out = np.zeros(len(sizes) * bits // 8, np.uint8)
    np.bitwise_or.at(out, odd >> 3, (1 << (odd & 7)).astype(np.uint8))
    return out.view("<i8").reshape(len(sizes), bits // 64)


def set_sums(sets: np.ndarray, sizes: np.ndarray, salt: int) -> np.ndarray:
    """64 bits of each set: the sum of its mixed values; 0 where it is empty."""
    out = np.zeros(len(sizes), np.uint64)
    full = sizes > 0
    if full.any():
        out[full] = np.add.reduceat(mix(sets + U(salt)), (np.cumsum(sizes) - sizes)[full])
    return out.view(np.int64)


def lists(rows: np.ndarray) -> pa.ListArray:
    """A list column of the rows of a table of longs."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def signed(docs: DataFrame, rules: NearRules, text: str = "text") -> DataFrame:
    """Of each row: doc_id, text_key (64 bits of the text), n_shingles, id (128 bits of the set: a, b; null where empty),
    sig (longs of 4 symbols each), bits (longs of parities).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            sets, n = shingle_sets(texts, rules.size)
            a, b = (pa.array(set_sums(sets, n, salt), mask=n == 0) for salt in (1, 2))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text_key": batch.column(2), "n_shingles": pa.array(n, pa.int64()), "a": a, "b": b, "sig": lists(signatures(sets, n, rules.symbols).view(np.int64)), "bits": lists(parities(sets, n, rules.bits))})

    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be an integer: component_id is the smallest one")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.xxhash64(text).alias("text_key")).mapInArrow(lean(run), "doc_id long, text_key long, n_shingles long, a long, b long, sig array<long>, bits array<long>")
    return rows.select("doc_id", "text_key", "n_shingles", F.when(F.col("a").isNotNull(), F.struct("a", "b")).alias("id"), "sig", "bits")


def symbol(sig: Column, i: int) -> Column:
    return F.shiftrightunsigned(sig[i // 4], 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF))


def chunk_keys(sig: Column, rules: NearRules) -> Column:
    """The keys of a signature as rows (place, key): for each chunk, each choice of chunk - errors of its symbols."""
    keys = []
    for c in range(rules.chunks):
        own = range(c * rules.chunk, (c + 1) * rules.chunk)
        for kept in combinations(own, rules.chunk - rules.errors):
            keys.append(F.xxhash64(F.lit(".".join(map(str, kept))), *(symbol(sig, i) for i in kept)))
    return F.posexplode(F.array(*keys))


def first_shared(a: np.ndarray, b: np.ndarray, rules: NearRules) -> np.ndarray:
    """The place of the first key that the signatures of each pair share (-1: none); a pair is taken in that bucket alone.

    a, b: symbols, a row for each pair.
    """
    assert rules.errors == 1, "written for one symbol left out"
    same = (a == b).reshape(len(a), rules.chunks, rules.chunk)
    chunk = (same.sum(2) >= rules.chunk - 1).argmax(1)
    own = same[np.arange(len(a)), chunk]
    # choices leave out the last symbol first; if all agree, the first choice is shared
    choice = np.where(own.all(1), 0, rules.chunk - 1 - own.argmin(1))
    return np.where(own.sum(1) >= rules.chunk - 1, chunk * rules.chunk + choice, -1)


def may_link(na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray, rules: NearRules) -> np.ndarray:
    """Of each set of one side against each of the other: False only for pairs that can't be links, by their sizes
    (na, nb) or by their parities (a, b: a row of unsigned longs each).

    At percent p, two sets differ in (100 - p) / (100 + p) of the sum of their sizes at most, and their parities in no
    more cells than that.
    """
    na, nb = na[:, None], nb[None, :]
    cells = np.zeros((len(a), len(b)), np.int64)
    for i in range(a.shape[1]):
        cells += np.bitwise_count(a[:, i, None] ^ b[None, :, i])
    return (100 * np.minimum(na, nb) >= rules.percent * np.maximum(na, nb)) & ((100 + rules.percent) * cells <= (100 - rules.percent) * (na + nb))


def confirmed(pairs: DataFrame, sets: DataFrame, rules: NearRules) -> DataFrame:
    """Of pairs (a, b, ca, cb), the components (a, b) of those whose full sets are similar enough. sets: id, shingles."""
    two = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("xs")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("ys")), "b")
    both = F.size(F.array_intersect("xs", "ys"))
    return two.filter(100 * both >= rules.percent * (F.size("xs") + F.size("ys") - both)).select(F.col("ca").alias("a"), F.col("cb").alias("b"))


def sent(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def components(edges: DataFrame, small: int) -> DataFrame:
    """Of each node of edges (a, b): id, comp (the smallest node it is connected to).

    Rounds of neighbours' minima, each followed by a jump to the label's own label, until nothing changes; every round
    is a written table. Labels of up to `small` edges are sent to the edges; beyond that, both are shuffled.
    """
    ends = F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba", "aa", "bb")]))
    both = staged(edges.select(ends.alias("e")).select("e.a", "e.b").distinct(), "near-edges")
    few = both.count() <= small
    comp = staged(both.groupBy("a").agg(F.min("b").alias("comp")).withColumnRenamed("a", "id"), "near-comp")
    while True:
        labels = comp.select(F.col("id").alias("b"), "comp")
        near = both.join(sent(labels, few), "b").groupBy("a").agg(F.min("comp").alias("comp"), F.max(F.when(F.col("a") == F.col("b"), F.col("comp"))).alias("was"))
        jump = comp.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        after = staged(near.join(sent(jump, few), "comp").select(F.col("a").alias("id"), "was", F.least("comp", "next").alias("comp")), "near-comp")
        comp = after.select("id", "comp")
        if after.filter("comp <> was").isEmpty():
            return comp


def shingles_of(docs: DataFrame, wanted: DataFrame, rules: NearRules, text: str) -> DataFrame:
    """Full sets of the wanted texts (text_key): id (of the set), shingles. Few keys go to the texts, else both are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches, text=0):
            sets, n = shingle_sets(texts, rules.size)
            at = pa.array(np.r_[0, np.cumsum(n)], pa.int32())
            yield pa.RecordBatch.from_pydict({"a": pa.array(set_sums(sets, n, 1)), "b": pa.array(set_sums(sets, n, 2)), "shingles": pa.ListArray.from_arrays(at, pa.array(sets.view(np.int64)))})

    wanted = wanted.select("text_key").distinct()
    few = wanted.count() <= 4 * rules.small
    rows = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("text_key")).join(sent(wanted, few), "text_key", "left_semi")
    return rows.select("text").mapInArrow(lean(run), "a long, b long, shingles array<long>").select(F.struct("a", "b").alias("id"), "shingles").dropDuplicates(["id"])


def near_groups(docs: DataFrame, rules: NearRules = NearRules(), text: str = "text") -> DataFrame:
    """Near-duplicate components: doc_id, text_key, n_shingles, component_id, kept, one row for each row of docs.

    Words are runs of other than spaces (A-Z in lower case), shingles 5 words, links 75 % of the union. Fewer words
    make one shingle; without words or text, the set is empty and linked with nothing (component_id is the doc_id).
    component_id is the smallest doc_id reachable; kept, whether it is the row's own. Copies form one class by their
    sets first. Rows that repeat a doc_id each get the component of their own text. A row with null doc_id gets the
    component of its text, null where no other row has one, and is never kept in a component that has a doc_id. An
    empty table gives an empty one; extra columns are ignored. doc_id is of an integer type; others raise TypeError.
    """
    rows = staged(signed(docs, rules, text), "near-signed")
    own = F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("d")
    classes = staged(rows.filter("id is not null").groupBy("id").agg(own, F.count("*").alias("copies"), F.min("text_key").alias("text_key"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bits").alias("bits")), "near-classes")
    # dealt out once: the count of a key's members and its rows both read this exchange
    keyed = classes.select("id", chunk_keys(F.col("sig"), rules).alias("place", "key")).repartition("key")
    shared = keyed.groupBy("key").agg(F.min("id.a").alias("lo"), F.max("id.a").alias("hi")).filter("lo < hi").select("key")
    buckets = staged(keyed.join(shared, "key").select("id", "place", "key"), "near-buckets")
    known = staged(classes.join(buckets.select("id").distinct(), "id", "left_semi"), "near-known")
    few = known.count() <= rules.small
    sets = staged(shingles_of(docs, known, rules, text), "near-sets")
    labels = known.select("id", F.struct("d", "id.a", "id.b").alias("comp"))
    turn, going = 0, True
    while going or turn < rules.turns:
        now = staged(mixed(buckets, labels, few), "near-mixed")
        labels, n = linked(star_pairs(now, turn), labels, sets, few, rules)
        # turns are cheap: they go on for as long as they bring down the components whose pairs are compared in the end
        going = n * WORTH > now.select("comp").distinct().count()
        turn += 1
    now = staged(mixed(buckets, labels, few), "near-mixed")
    labels, _ = linked(all_pairs(now, known, few, rules), labels, sets, few, rules)
    new = classes.select("id", "d", "copies").join(labels, "id", "left").select("id", F.coalesce("comp.d", "d").alias("component"), "d", "copies")
    new = staged(new.filter("copies > 1 or component <> d").select("id", F.nullif("component", F.lit(NO_ID)).alias("component")), "near-components")
    out = rows.select("doc_id", "text_key", "n_shingles", "id").join(sent(new, new.count() <= rules.small), "id", "left")
    out = out.select("doc_id", "text_key", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def linked(pairs: DataFrame, labels: DataFrame, sets: DataFrame, few: bool, rules: NearRules) -> tuple[DataFrame, int]:
    """labels after the links among pairs, and the number of linked pairs of components. Each such pair counts once,
    however many members link it.
    """
    found = staged(confirmed(pairs, sets, rules).distinct(), "near-links")
    n = found.count()
    return (merged(labels, components(found, rules.small), few), n) if n else (labels, 0)


def merged(labels: DataFrame, comps: DataFrame, few: bool) -> DataFrame:
    """labels (id, comp) with components renamed by comps (id, comp)."""
    new = comps.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
    return staged(labels.join(sent(new, few), "comp", "left").select("id", F.coalesce("next", "comp").alias("comp")), "near-labels")


def mixed(buckets: DataFrame, labels: DataFrame, few: bool) -> DataFrame:
    """Members (id, place, key, comp) of the buckets that hold several components: only these can bring a link that matters."""
    now = buckets.join(sent(labels, few), "id").withColumn("h", F.xxhash64("comp"))
    keys = now.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo < hi").select("key")
    return now.join(keys, "key").select("id", "place", "key", "comp")


def star_pairs(now: DataFrame, turn: int) -> DataFrame:
    """One pair (a, b, ca, cb) at most for each member: with that member of another component that most of its buckets name.

    A bucket names its smallest member in an order of the turn, so that a group's buckets agree on few of them.
    """
    pick = F.struct(F.xxhash64(F.lit(turn), "id").alias("h"), F.col("id").alias("rep"), F.col("comp").alias("rep_comp"))
    reps = now.groupBy("key").agg(F.min(pick).alias("r"))
    votes = now.join(reps, "key").filter(F.col("comp") != F.col("r.rep_comp")).groupBy("id", "comp", "r").agg(F.count("*").alias("n"))
    best = votes.groupBy("id", "comp").agg(F.max(F.struct("n", "r")).alias("best"))
    return best.select(F.col("id").alias("a"), F.col("best.r.rep").alias("b"), F.col("comp").alias("ca"), F.col("best.r.rep_comp").alias("cb"))


def all_pairs(now: DataFrame, known: DataFrame, few: bool, rules: NearRules) -> DataFrame:
    """What is left: pairs (a, b, ca, cb) of a bucket across components that may_link allows, each in one bucket alone.

    A bucket of more than rules.block members is dealt to cells; each cell's members are held, and the whole bucket
    streams past them, so that neither a task's memory nor its work grows with the square of a bucket.
    """
    cells = F.ceil(F.col("n_key") / rules.block).cast("int")
    sized = now.join(now.groupBy("key").agg(F.count("*").alias("n_key")), "key")
    full = staged(sized.join(sent(known.select("id", "n", "sig", "bits"), few), "id").select("key", "place", cells.alias("cells"), F.col("id.a").alias("a"), F.col("id.b").alias("b"), "comp.d", F.col("comp.a").alias("ca"), F.col("comp.b").alias("cb"), "n", "sig", "bits"), "near-left")
    held = full.withColumns({"cell": F.pmod(F.xxhash64("b"), "cells").cast("int"), "part": F.lit(0)})
    past = full.filter("cells > 1").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).withColumn("part", F.lit(1))
    dealt = held.unionByName(past).repartition("key", "cell").sortWithinPartitions("key", "cell", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, cell = None, []
        for part in (g for batch in batches for g in grouped(members(batch, rules))):
            now = (part["key"][0], part["cell"][0])
            if now != group:
                yield from unlike(joined(cell), joined(cell), rules) if cell and cell[0]["cells"][0] == 1 else ()
                group, cell = now, []
            streams = part["part"] == 1
            if not streams.all():
                cell.append({c: v[~streams] for c, v in part.items()})
            if streams.any():
                cell = [joined(cell)] if cell else []
                for own in cell:
                    yield from unlike(own, {c: v[streams] for c, v in part.items()}, rules)
        yield from unlike(joined(cell), joined(cell), rules) if cell and cell[0]["cells"][0] == 1 else ()

    node = "struct<d:long,a:long,b:long>"
    return dealt.select("key", "cell", "cells", "part", "place", "a", "b", "d", "ca", "cb", "n", "sig", "bits").mapInArrow(lean(run), f"a struct<a:long,b:long>, b struct<a:long,b:long>, ca {node}, cb {node}")


def members(batch: pa.RecordBatch, rules: NearRules) -> dict[str, np.ndarray]:
    """The columns of a batch; signatures as rows of symbols, parities as rows of unsigned longs."""
    out = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c not in ("sig", "bits")}
    lists_ = {c: batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("sig", "bits")}
    return out | {"sig": lists_["sig"].view("<u2").reshape(batch.num_rows, rules.symbols), "bits": lists_["bits"].view("<u8").reshape(batch.num_rows, -1)}


def grouped(rows: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
    """Stretches of rows of one key and cell."""
    n = len(rows["key"])
    cut = np.flatnonzero((rows["key"][1:] != rows["key"][:-1]) | (rows["cell"][1:] != rows["cell"][:-1])) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), n], strict=True) if n else ():
        yield {c: v[a:b] for c, v in rows.items()}


def joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def unlike(x: dict[str, np.ndarray], y: dict[str, np.ndarray], rules: NearRules) -> Iterator[pa.RecordBatch]:
    """Pairs of members of x and y in different components that may be links and are met in this bucket first."""
    for at in range(0, len(x["key"]), 256):
        own = {c: v[at : at + 256] for c, v in x.items()}
        pair = lambda c: (own[c][:, None], y[c][None, :])
        (xa, ya), (xb, yb) = pair("a"), pair("b")
        apart = np.logical_or.reduce([u != v for u, v in map(pair, ("d", "ca", "cb"))])
        ok = ((xa < ya) | ((xa == ya) & (xb < yb))) & apart & may_link(own["n"], y["n"], own["bits"], y["bits"], rules)
        i, j = np.nonzero(ok)
        once = first_shared(own["sig"][i], y["sig"][j], rules) == own["place"][i]
        i, j = i[once], j[once]
        if len(i):
            sides = ((own, i), (y, j))
            ids = [pa.StructArray.from_arrays([pa.array(t["a"][k]), pa.array(t["b"][k])], ["a", "b"]) for t, k in sides]
            comps = [pa.StructArray.from_arrays([pa.array(t["d"][k]), pa.array(t["ca"][k]), pa.array(t["cb"][k])], ["d", "a", "b"]) for t, k in sides]
            yield pa.RecordBatch.from_arrays([*ids, *comps], names=["a", "b", "ca", "cb"])


def one_of_each(docs: DataFrame, rules: NearRules = NearRules(), text: str = "text", most: int = 200_000) -> DataFrame:
    """The rows of docs, with all their columns, that near_groups keeps; rows that repeat a doc_id and text become one.

    Up to `most` dropped rows' keys are sent to all executors; beyond that, both sides are shuffled.
    """
    groups = staged(near_groups(docs, rules, text).select("doc_id", "text_key", "kept"), "near-groups")
    gone = groups.filter("not kept").select(F.col("doc_id").alias("__tw_id"), F.col("text_key").alias("__tw_key")).distinct()
    few = gone.count() <= most
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__tw_id")) & (F.xxhash64(docs[text]) == F.col("__tw_key"))
    left = docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
    again = groups.filter("kept and doc_id is not null").groupBy("doc_id", "text_key").count().filter("count > 1")
    return left if again.isEmpty() else left.dropDuplicates(["doc_id", text])
