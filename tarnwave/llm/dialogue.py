"""Cheapest repair of conversations, by an automaton of suffixes that all conversations share.

A conversation becomes a signature: one character a row that says its role and its first fault. What a repair still
costs depends on the suffix ahead and on the state of the role grammar `(s?(ua)+)?`. Distinct signatures are sorted by
their reverse, so equal suffixes stand together: each is one node of a suffix-shared automaton (a DAWG), whose costs and
best edits in each grammar state are computed once, when the first signature that ends in it comes along. Only the path
of the signature at hand is held. Nodes that differ in nothing but a constant cost are one class, so a node is a look-up.

Rows of a conversation may lie in several tasks: pieces of signatures are put together from ranges of the sort order.
A hash over a whole conversation's text is sequential by its nature; its rows stream through one task, none is kept.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import lean, staged

#: Roles s, u, a and others by the faults none, truncated, blank, duplicate: the characters of a signature.
ROLES, FAULTS = "sua?", ("", "truncated", "blank", "duplicate")
CODES = {(r, f): "ABCDEFGHIJKLMNOP"[4 * i + k] for i, r in enumerate(ROLES) for k, f in enumerate(FAULTS)}
#: For the automaton, rows that must go are alike whatever their role.
MERGED = str.maketrans({c: "X" for (_, f), c in CODES.items() if f in ("blank", "duplicate")})
PAIRS = {a + b for a in (CODES["s", f] for f in FAULTS) for b in (CODES["u", f] for f in FAULTS)}
PAIRS |= {a + b for x, y in ("ua", "au") for a in (CODES[x, f] for f in FAULTS) for b in (CODES[y, f] for f in FAULTS)}
#: Costs of edits; an undeleted truncated row adds CUT.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: Grammar states: nothing yet, after s, u, a. Of each: the role that an inserted or rerolled row takes, and the state then.
START, SYSTEM, USER, ASSISTANT = range(4)
FORCED = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The state that a kept row of each of ROLES leads to.
STATES = (SYSTEM, USER, ASSISTANT, None)
NEVER = 1 << 40


class Suffixes:
    """The automaton along one path. Classes: normalised costs of the four states. A step puts a row before a suffix."""

    def __init__(self) -> None:
        # behind the last row: done at the start or after an assistant; else insertions
        self.costs: list[tuple[int, ...]] = []
        self.known: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, str], tuple[int, int, str]] = {}
        base, ops = self.closed([(0, "."), (NEVER, ""), (NEVER, ""), (0, ".")])
        self.path, self.ops, self.total = array("i", [self.class_of(base)[0]]), [ops], array("q", [self.class_of(base)[1]])
        self.last = ""

    def class_of(self, costs: tuple[int, ...]) -> tuple[int, int]:
        least = min(costs)
        key = tuple(c - least for c in costs)
        if key not in self.known:
            self.known[key] = len(self.costs)
            self.costs.append(key)
        return self.known[key], least

    @staticmethod
    def closed(direct: list[tuple[int, str]]) -> tuple[tuple[int, ...], str]:
        """Costs and edits of the states once insertions are allowed. Of equal costs, the first letter decides: D, I, K, R."""
        out = []
        for q in range(4):
            one = FORCED[q]
            two = FORCED[one]
            ways = [direct[q], (direct[one][0] + INSERT, "I"), (direct[two][0] + 2 * INSERT, "I")]
            out.append(min(ways))
        return tuple(c for c, _ in out), "".join(op for _, op in out)

    def step(self, below: int, code: str) -> tuple[int, int, str]:
        """Class, added cost and edits (one letter a state) of a row with this code before a suffix of class below."""
        if (below, code) not in self.steps:
            costs, direct = self.costs[below], []
            at = "ABCDEFGHIJKLMNOP".find(code)  # -1: a row that must go
            after, more = STATES[at // 4], CUT if at % 4 else 0
            for q in range(4):
                ways = [(costs[q] + DELETE, "D")]
                if at >= 0:
                    ways.append((costs[FORCED[q]] + more + REROLE, "R"))
                    if after == FORCED[q] or (after == SYSTEM and q == START):
                        ways.append((costs[after] + more, "K"))
                direct.append(min(ways))
            found, ops = self.closed(direct)
            self.steps[below, code] = (*self.class_of(found), ops)
        return self.steps[below, code]

    def solve(self, reverse: str) -> tuple[int, str]:
        """Cost and edits of a signature, given from its end. Nodes shared with the signature before are kept."""
        same = shared_prefix(self.last, reverse)
        del self.path[same + 1 :], self.ops[same + 1 :], self.total[same + 1 :]
        for code in reverse[same:]:
            to, more, ops = self.step(self.path[-1], code)
            self.path.append(to)
            self.total.append(self.total[-1] + more)
            self.ops.append(ops)
        self.last = reverse
        audit, q, at = [], START, len(reverse)
        while True:
            op = self.ops[at][q]
            if op == ".":
                break
            audit.append(op)
            if op == "K":
                q = SYSTEM if reverse[at - 1] in "ABCD" else FORCED[q]
            elif op != "D":
                q = FORCED[q]
            at -= op != "I"
        return self.total[-1] + self.costs[self.path[-1]][START], "".join(audit)


def shared_prefix(a: str, b: str) -> int:
    n, size = 0, 1 << 12
    while size:
        while a[n : n + size] == b[n : n + size] and n + size <= min(len(a), len(b)):
            n += size
        size >>= 1
    return n


def solutions(signatures: DataFrame) -> DataFrame:
    """Of each distinct signature: sig, blank, duplicate, truncated, illegal, cost, audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dawg = Suffixes()
        for batch in batches:
            rows = []
            for sig, reverse in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cost, audit = dawg.solve(reverse)
                counts = {f: sum(sig.count(CODES[r, f]) for r in ROLES) for f in FAULTS[1:]}
                rows.append({"sig": sig, **counts, "illegal": sum(x + y not in PAIRS for x, y in zip(sig, sig[1:], strict=False)), "cost": cost, "audit": audit})
            yield pa.RecordBatch.from_pylist(rows, schema)

    distinct = signatures.select("sig").distinct().withColumn("reverse", F.reverse(F.translate("sig", "".join(map(chr, MERGED)), "X" * len(MERGED))))
    out, schema = row_type([StructField("sig", StringType()), *longs(*FAULTS[1:], "illegal", "cost"), StructField("audit", StringType())])
    return distinct.repartitionByRange("reverse").sortWithinPartitions("reverse").mapInArrow(lean(run), out)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, n): n copies are left of a row, 0 for one that was dropped; the damage that op11 asks for."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("k"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    body = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", role.alias("role"), body.alias("text"), F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1).alias("n"))


def fault_of(text: Column) -> Column:
    """blank (nothing but white space) or truncated (the last character but white space is none of .!?), else empty."""
    end = F.substring(F.rtrim(text, F.lit(" \t\n\v\f\r")), -1, 1)
    return F.when(end == "", "blank").when(~end.isin(".", "!", "?"), "truncated").otherwise("")


def text_key() -> Column:
    """256 bits that stand for the text."""
    return F.unhex(F.sha2("text", 256))


def longs(*names: str) -> list[StructField]:
    return [StructField(n, LongType()) for n in names]


def row_type(fields: list[StructField]) -> tuple[StructType, pa.Schema]:
    """The Spark and the Arrow schema of these fields."""
    return StructType(fields), pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])


def signed(rows: DataFrame) -> DataFrame:
    """Of each conversation: conv_id, sig, gaps. rows: conv_id, turn, role, text, n."""
    light = staged(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", text_key().alias("h"), fault_of(F.col("text")).alias("fault"), "n"), "turns")
    # the first place of each text that comes again; one row for each distinct text of a conversation is shuffled
    place = F.struct("turn")
    again = light.filter("n > 0").groupBy("conv_id", "role", "h").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last")
    same = F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l.role") == F.col("r.role")) & (F.col("l.h") == F.col("r.h"))
    marked = light.alias("l").join(again.alias("r"), same, "left").select("l.conv_id", "l.turn", "l.role", "l.h", "l.fault", "l.n", F.coalesce(F.struct("l.turn") > F.col("r.first"), F.lit(False)).alias("repeat"))
    cut = marked.repartitionByRange("conv_id", "turn", "role", "h").sortWithinPartitions("conv_id", "turn", "role", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, sig, turns, before = TaskContext.get().partitionId(), None, [], None, None
        made: list[dict] = []

        def flush() -> dict:
            first, last, n = turns or (None, None, 0)
            return {"conv_id": now[0], "part": part, "sig": "".join(sig), "first": first, "last": last, "turns": n}

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for conv, turn, role, h, fault, n, repeat in zip(*columns, strict=True):
                if now is None or conv != now[0]:
                    if now is not None:
                        made.append(flush())
                    now, sig, turns, before = (conv,), [], None, None
                if not n:
                    continue
                initial, row = role[0] if role and role[0] in "sua" else "?", (turn, role, h)
                for _ in range(n):
                    sig.append(CODES[initial, "blank" if fault == "blank" else "duplicate" if repeat or row == before else fault])
                    before = row
                if turn is not None:
                    turns = (turn, turn, 1) if turns is None else (turns[0], turn, turns[2] + (turn != turns[1]))
            if made:
                yield pa.RecordBatch.from_pylist(made, pieces)
                made = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([flush()], pieces)

    out, pieces = row_type([rows.schema["conv_id"], *longs("part"), StructField("sig", StringType()), *longs("first", "last", "turns")])
    found = cut.mapInArrow(lean(run), out)
    # a turn that ends one piece and begins the next one counts once
    w = Window.partitionBy("conv_id").orderBy("part")
    met = F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("turns", F.col("turns") - F.coalesce((met == F.col("first")).cast("int"), F.lit(0)))
    gaps = F.coalesce(F.max("last") - F.min("first") + 1 - F.sum("turns"), F.lit(0)).alias("gaps")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "sig"))), lambda p: p["sig"]), "")
    return found.groupBy("conv_id").agg(joined.alias("sig"), gaps)


#: What a plan holds beside conv_id.
FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def planned(rows: DataFrame) -> DataFrame:
    """Of each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit."""
    own = staged(signed(rows), "signatures")
    # a signature that many conversations share is one row on the right
    return staged(own.join(solutions(own), "sig").select("conv_id", *FIGURES), "plans")


def streamed(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Plans and rows of a conversation in one task, the plan first, rows in their order."""
    head = plans.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(1).alias("n"), *FIGURES)
    body = rows.filter("n > 0").select("conv_id", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", "text", "n", *[F.lit(None).cast(plans.schema[f].dataType).alias(f) for f in FIGURES])
    return head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", text_key())


def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, object]]:
    """("plan", dict) for each conversation, then ("turn", (edit, turn, role, text)) for each row of its repair."""
    audit, at, q = "", 0, START

    def inserted() -> Iterator[tuple[str, object]]:
        nonlocal at, q
        while at < len(audit) and audit[at] == "I":
            q = FORCED[q]
            at += 1
            yield "turn", ("I", None, NAMES[q], "")

    for batch in batches:
        # a slice of the batch at a time, so that texts don't all become Python strings together
        ends = pc.cumulative_sum(pc.fill_null(pc.cast(pc.binary_length(batch.column("text")), pa.int64()), 0)).to_pylist()
        start = 0
        while start < batch.num_rows:
            stop = start + 1
            while stop < batch.num_rows and ends[stop] - (ends[start - 1] if start else 0) <= 1_000_000:
                stop += 1
            for row in batch.slice(start, stop - start).to_pylist():
                if row["kind"] == 0:
                    yield from inserted()
                    audit, at, q = row["audit"], 0, START
                    yield "plan", row
                    continue
                for _ in range(row["n"]):
                    yield from inserted()
                    op = audit[at]
                    at += 1
                    if op == "D":
                        continue
                    q = FORCED[q] if op == "R" or row["role"][:1] != "s" else SYSTEM
                    yield "turn", (op, row["turn"], NAMES[q] if op == "R" else row["role"], row["text"])
            start = stop
    yield from inserted()


def repair_report(rows: DataFrame) -> DataFrame:
    """Of each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    rows: conv_id, turn (an integer type), role, text, n (copies of the row side by side; 0: the row is gone, but its
    conversation is told of). Null roles and texts count as one space, null turns come first, a null conv_id is a
    conversation of its own. Rows of equal turn are taken by role, then by the SHA-256 of the text, so equal rows stand
    together. Faults: see fault_of; a row whose role and text came before is a duplicate. A conversation without rows
    has zeros, an empty audit and the hash of the empty text; an empty table gives an empty one. Other columns are
    ignored. A conversation's audit is one value, so it may have up to 2^31 rows; its texts stream.
    """
    rows = tidy(rows)
    kinds = [rows.schema["conv_id"], *longs(*FIGURES[:-1]), StructField("audit", StringType()), StructField("repaired_sha256", StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, first, made = None, None, True, []
        for what, x in edits(batches):
            if what == "plan":
                if now is not None:
                    made.append({**now, "repaired_sha256": sha.hexdigest()})
                if len(made) >= 1000:
                    yield pa.RecordBatch.from_pylist(made, schema)
                    made = []
                now, sha, first = {c: x[c] for c in ("conv_id", *FIGURES)}, hashlib.sha256(), True
            else:
                _, _, role, text = x
                sha.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                first = False
        if now is not None:
            made.append({**now, "repaired_sha256": sha.hexdigest()})
        if made:
            yield pa.RecordBatch.from_pylist(made, schema)

    out, schema = row_type(kinds)
    return streamed(rows, planned(rows)).mapInArrow(lean(run), out)


def repair_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), turn (null for an inserted one), role, text, edit (K, R, I).

    rows and odd inputs as in repair_report; conversations without a repaired row have none here.
    """
    rows = tidy(rows)
    kinds = [rows.schema["conv_id"], *longs("place", "turn"), *(StructField(c, StringType()) for c in ("role", "text", "edit"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place, made, held = None, 0, [], 0
        for what, x in edits(batches):
            if what == "plan":
                conv, place = x["conv_id"], 0
                continue
            edit, turn, role, text = x
            made.append({"conv_id": conv, "place": place, "turn": turn, "role": role, "text": text, "edit": edit})
            place, held = place + 1, held + len(text) + 100
            if held > 1_000_000:
                yield pa.RecordBatch.from_pylist(made, schema)
                made, held = [], 0
        if made:
            yield pa.RecordBatch.from_pylist(made, schema)

    out, schema = row_type(kinds)
    return streamed(rows, planned(rows)).mapInArrow(lean(run), out)


def tidy(rows: DataFrame) -> DataFrame:
    """The columns that count, without nulls in role, text and n."""
    n = F.coalesce("n", F.lit(1)).alias("n") if "n" in rows.columns else F.lit(1).alias("n")
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), n)
