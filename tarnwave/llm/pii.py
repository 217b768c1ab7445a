"""Personal data: patterns for what identifies someone, and terms that the corpus shows to give it away.

A protected entity is a found value (an address, a number, a secret) or the group it belongs to (a mail domain, a
network, an issuer; secrets have none). A group that holds most documents of its kind is no more than the kind, and what
gives it away is a label such as "email": such groups are not weighed. Terms are words, and names: two capitalised words
side by side, which may give someone away where neither does. A name beside found values is an entity as well (someone
may have several values), if the values recur with it; beside ever new values it is a label. Terms that stand near an
entity's mentions are weighed over the documents of the whole corpus:
disclosure = PMI(term; entity) / IC(entity), 1 where the term stands in no document without the entity; rare counts are
shrunk toward the entity's own share. Terms above a threshold are generalised wherever they stand in the corpus, above a
higher one removed. Secrets are found by their information: runs of letters and digits of many bits.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, staged

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")  # never begun again inside a run of digits
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]{3,}")
#: Capitalised words in a row; begun at a word's first letter only.
CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ](?<![^\W\d_][A-ZÀ-ÖØ-Þ])[^\W\d_]{2,}+(?: [A-ZÀ-ÖØ-Þ][^\W\d_]{2,}+)+")
TOKEN = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+")
#: Kinds of found spans; those after the base ones are the method's.
SECRET, TERM = len(KINDS), len(KINDS) + 1
NAMES = (*KINDS, "secret", "term")


@dataclass(frozen=True)
class PiiRules:
    """reach: words looked at on each side of a mention. support: different texts in which a term must stand near an
    entity. shrink: documents' worth of weight of the entity's own share. beyond: least information (bits) of a group
    once its kind is known. bits: least information of a secret.
    """

    reach: int = 4
    support: int = 3
    shrink: float = 1.0
    generalise: float = 0.9
    remove: float = 0.98
    beyond: float = 1.0
    bits: float = 64.0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: the local part can't hold one, so runs are read once."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", at + 1)


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Of each chain of dotted numbers, every four of them in turn."""
    for m in DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def find_base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all base spans, by start, then kind."""
    found = [(a, 0, b) for a, b in emails(text)] + [(a, 1, b) for a, b in ips(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdecimal() for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def secrets(text: str, bits: float) -> list[tuple[int, int, int]]:
    """(start, SECRET, end) of runs with letters and digits whose characters carry `bits` and 3 bits each on average."""
    out = []
    for m in TOKEN.finditer(text):
        n, count = m.end() - m.start(), Counter(m.group())
        each = math.log2(n) - sum(c * math.log2(c) for c in count.values()) / n
        if each >= 3 and n * each >= bits and any(c.isdigit() for c in count) and any(c.isalpha() for c in count):
            out.append((m.start(), SECRET, m.end()))
    return out


def find_all(text: str, bits: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and secrets that touch none of them."""
    base = find_base(text)
    found = secrets(text, bits)
    if base and found:
        found = [f for f in found if not any(a < f[2] and f[0] < b for a, _, b in base)]
    return base, found


def entities(kind: int, value: str) -> tuple[str, ...]:
    """The protected entities of a found value: itself, and its group (kind and s before the colon)."""
    if kind == SECRET:
        return ("secret:" + value,)
    name = KINDS[kind]
    if kind == 0:
        return f"{name}:{value.lower()}", f"{name}s:{value.lower().rpartition('@')[2]}"
    if kind == 1:
        return f"{name}:{value}", f"{name}s:{'.'.join(value.split('.')[:2])}"
    digits = re.sub("[^0-9]", "", value)
    return f"{name}:{digits}", f"{name}s:{digits[:6]}"


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
RISKY = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("removed", pa.bool_())]))
#: Of each row: the terms that give something away and stand in its text, with whether they are removed.
TERMS = "array<struct<term:string,removed:boolean>>"


def names(text: str) -> Iterator[tuple[int, int]]:
    """Every two capitalised words side by side; longer names overlap in their pairs."""
    for m in CAPITALS.finditer(text):
        words = [w.span() for w in WORD.finditer(text, m.start(), m.end())]
        yield from ((a, b) for (a, _), (_, b) in zip(words, words[1:], strict=False))


def terms_in(text: str) -> set[str]:
    """The words and names of a text, in lower case."""
    return {w.lower() for w in WORD.findall(text)} | {text[a:b].lower() for a, b in names(text)}


def near_mentions(text: str, spans: list[tuple[int, int, int]], reach: int) -> set[tuple[str, str]]:
    """(entity, term): the reach words on each side of each span, and the names among them, in lower case, without words
    that touch a span. The names are entities too: name: with these terms, a null term, and = with the value beside.
    """
    starts, ends = [a for a, _, _ in spans], list(accumulate((b for _, _, b in spans), max))
    words = [m.span() for m in WORD.finditer(text)]
    words = [(s, e) for s, e in words if not ((j := bisect.bisect_left(starts, e)) and ends[j - 1] > s)]
    pairs, out = {a: b for a, b in names(text)}, set()
    for a, k, b in spans:
        at = bisect.bisect_left(words, (a, 0))
        seen = words[max(0, at - reach) : at + reach]
        near = {text[s:e].lower() for s, e in seen}
        named = {text[s:e].lower() for (s, _), (_, e) in zip(seen, seen[1:], strict=False) if pairs.get(s) == e}
        own = entities(k, text[a:b])
        out.update((entity, term) for entity in own for term in near | named)
        out.update(("name:" + name, term) for name in named for term in (*near, *named, None, "=" + own[0]))
    return out


def mentions(docs: DataFrame, rules: PiiRules, text: str = "text") -> DataFrame:
    """What each document mentions: text_key, entity, term; once each, and once with a null term for the entity itself
    and for its kind ("kind:s", the s standing for the groups of it).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            rows = []
            for key, t in zip(batch.column(0).to_pylist(), texts, strict=True):
                spans = sorted([x for f in find_all(t, rules.bits) for x in f])
                if spans:
                    said = {e for a, k, b in spans for e in entities(k, t[a:b])} | {f"kind:{NAMES[k]}s" for _, k, _ in spans}
                    pairs = near_mentions(t, spans, rules.reach) | {(e, None) for e in said}
                    rows += [(key, e, term) for e, term in pairs]
            keys, found, terms = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({"text_key": pa.array(keys, pa.int64()), "entity": pa.array(found, pa.string()), "term": pa.array(terms, pa.string())})

    return docs.select(F.xxhash64(text).alias("key"), text).mapInArrow(lean(run), "text_key long, entity string, term string")


def term_counts(docs: DataFrame, text: str = "text", keep: int = 100_000) -> DataFrame:
    """In how many documents each term stands. Tasks add up before the shuffle, in a table of about keep terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"term": pa.array(c.keys(), pa.string()), "n": pa.array(c.values(), pa.int64())})

        total: Counter = Counter()
        for _, texts in slices(batches, text=0):
            for t in texts:
                total.update(set(WORD.findall(t.lower())) | {t[a:b].lower() for a, b in names(t)})
            if len(total) > keep:
                yield out(total)
                total.clear()
        yield out(total)

    return docs.select(text).mapInArrow(lean(run), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def disclosures(docs: DataFrame, near: DataFrame, rules: PiiRules, text: str = "text") -> DataFrame:
    """Terms that give entities away: entity, term, disclosure. near: of mentions(docs), staged.

    p(entity) is its share of all documents, p(entity | term) that among the documents with the term in which the term
    stands near it, shrunk: (documents near + shrink * p(entity)) / (documents with the term + shrink);
    disclosure = log2(p(entity | term) / p(entity)) / -log2 p(entity). A group whose share of its kind's documents is
    above 2^-beyond is left out, and so is a name that has more than one value for two texts.
    """
    pairs = near.filter("term is not null").groupBy("entity", "term", "text_key").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n_near"), F.count("*").alias("texts"))
    per_entity = near.filter("term is null").groupBy("entity", "text_key").agg(F.count("*").alias("n")).groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("n_texts"))
    values = pairs.filter("term like '=%'").groupBy("entity").agg(F.count("*").alias("n_values"))
    # as many kinds as there are in NAMES
    kinds = per_entity.filter("entity like 'kind:%'").select(F.substring_index("entity", ":", -1).alias("kind"), F.col("n_entity").alias("n_kind"))
    known = per_entity.withColumn("kind", F.substring_index("entity", ":", 1)).join(F.broadcast(kinds), "kind", "left").join(values, "entity", "left")
    apart = F.col("n_kind").isNull() | (-F.log2(F.col("n_entity") / F.col("n_kind")) >= rules.beyond)
    told = known.filter(apart & (F.col("n_values").isNull() | (F.col("n_texts") >= 2 * F.col("n_values")))).select("entity", "n_entity")
    often = pairs.filter((F.col("texts") >= rules.support) & ~F.col("term").startswith("="))
    terms = staged(often.join(told, "entity"), "pii-pairs")
    n_docs = docs.count()
    counts = term_counts(docs, text).join(terms.select("term").distinct(), "term", "left_semi")
    share = F.least(F.lit(1 - 1e-9), F.col("n_entity") / n_docs)
    given = F.least(F.lit(1.0), (F.col("n_near") + rules.shrink * share) / (F.col("n_term") + rules.shrink))
    return terms.join(counts, "term").select("entity", "term", (F.log2(given / share) / -F.log2(share)).alias("disclosure"))


def risky_terms(docs: DataFrame, rules: PiiRules, text: str = "text") -> DataFrame:
    """Terms that give some entity away, staged: term, removed (by the strongest disclosure)."""
    near = staged(mentions(docs, rules, text), "pii-near")
    found = disclosures(docs, near, rules, text).filter(F.col("disclosure") >= rules.generalise)
    return staged(found.groupBy("term").agg((F.max("disclosure") >= rules.remove).alias("removed")), "pii-terms")


def terms_by_text(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """The risky terms of each text: __tw_key (of the whole text), __tw_terms. Pairs of a text and a term are joined to terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text=0):
            said = [list(terms_in(t)) for t in texts]
            yield pa.RecordBatch.from_pydict({"__tw_key": batch.column(1), "words": pa.array(said, pa.list_(pa.string()))})

    words = docs.select(text, F.xxhash64(text).alias("__tw_key")).mapInArrow(lean(run), "__tw_key long, words array<string>")
    pairs = words.select("__tw_key", F.explode("words").alias("term")).join(terms, "term")
    return pairs.groupBy("__tw_key").agg(F.collect_set(F.struct("term", "removed")).alias("__tw_terms"))


def with_terms(docs: DataFrame, rules: PiiRules, text: str, broadcast_terms: int) -> tuple[DataFrame, dict[str, bool]]:
    """docs with __tw_terms, and the terms that all tasks get. Up to broadcast_terms terms all tasks get them, and the
    column is null; beyond, each row has its own terms, by two shuffled joins.
    """
    terms = risky_terms(docs, rules, text)
    if terms.count() <= broadcast_terms:
        return docs.withColumn("__tw_terms", F.lit(None).cast(TERMS)), dict(map(tuple, terms.collect()))
    own = terms_by_text(docs, terms.hint("shuffle_merge"), text).hint("shuffle_merge")
    return docs.withColumn("__tw_key", F.xxhash64(text)).join(own, "__tw_key", "left").drop("__tw_key"), {}


def term_spans(text: str, spans: list[tuple[int, int, int]], terms: Mapping[str, bool]) -> list[dict]:
    """Every occurrence of the terms in a text, without those that a found span touches: start, kind, end, removed."""
    if not terms or terms_in(text).isdisjoint(terms):
        return []
    # spans of several kinds may overlap: the furthest end so far goes with each start
    starts, ends = [a for a, _, _ in spans], list(accumulate((b for _, _, b in spans), max))
    out = []
    for a, b in sorted([*(m.span() for m in WORD.finditer(text)), *names(text)], key=lambda at: (at[0], -at[1])):
        removed = terms.get(text[a:b].lower())
        if removed is not None and not ((j := bisect.bisect_left(starts, b)) and ends[j - 1] > a):
            out.append({"start": a, "kind": TERM, "end": b, "removed": removed})
    return out


def row_terms(terms, common: Mapping[str, bool]) -> Mapping[str, bool]:
    return common if terms is None else {x["term"]: x["removed"] for x in terms}


def found_in(text: str, rules: PiiRules, terms: Mapping[str, bool]) -> tuple[list[dict], list[dict]]:
    """Base spans and risky ones of a text."""
    base, more = find_all(text, rules.bits)
    risky = [{"start": a, "kind": k, "end": b, "removed": False} for a, k, b in more]
    risky += term_spans(text, sorted(base + more), terms)
    return [{"start": a, "kind": k, "end": b} for a, k, b in base], sorted(risky, key=lambda r: r["start"])


def find_pii(docs: DataFrame, rules: PiiRules = PiiRules(), text: str = "text", broadcast_terms: int = 100_000) -> DataFrame:
    """All personal data of each row of docs: doc_id, base, risky.

    base: array of struct of start, kind (number in NAMES), end, by start, then kind. risky: what the method adds,
    array of struct of start, kind, end, removed, by start: secrets, and every occurrence of a term that gives some
    entity away. Positions are code points, ends exclusive. Null or empty text: empty arrays. Repeated rows, repeated
    ids and null ids keep their rows, and each has its own text's spans. An empty table gives an empty one; other
    columns of docs are ignored. broadcast_terms: see with_terms.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found, common = with_terms(docs.select("doc_id", text), rules, text, broadcast_terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            both = [found_in(t, rules, row_terms(own, common)) for t, own in zip(texts, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "base": pa.array([b for b, _ in both], SPANS), "risky": pa.array([r for _, r in both], RISKY)})

    columns = f"doc_id {kind}, base array<struct<start:int,kind:int,end:int>>, risky array<struct<start:int,kind:int,end:int,removed:boolean>>"
    return found.select("doc_id", text, "__tw_terms").mapInArrow(lean(run), columns)


def clean_text(text: str | None, base: list, risky: list) -> str | None:
    """A text with spans as [KIND] and removed terms gone; overlaps go to the earlier start."""
    if text is None or not (len(base) or len(risky)):
        return text
    marks = [(s["start"], s["end"], "" if s.get("removed") else f"[{NAMES[s['kind']].upper()}]") for s in [*base, *risky]]
    out, at = [], 0
    for a, b, say in sorted(marks):
        if a >= at:
            out += [text[at:a], say]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, rules: PiiRules = PiiRules(), text: str = "text", broadcast_terms: int = 100_000) -> DataFrame:
    """docs with its columns, the text cleaned of personal data and of every term that gives some away; texts without
    any stay as they are. See find_pii; broadcast_terms: see with_terms.
    """
    found, common = with_terms(docs, rules, text, broadcast_terms)
    kept = docs.columns
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text=at):
            owns = batch.column(len(kept)).to_pylist()
            clean = [clean_text(t, *found_in(t, rules, row_terms(own, common))) for t, own in zip(texts, owns, strict=True)]
            new = pa.array(clean, pa.string(), mask=pc.is_null(batch.column(at)).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([new if i == at else batch.column(i) for i in range(len(kept))], names=kept)

    return found.select(*kept, "__tw_terms").mapInArrow(lean(run), docs.schema)


def luhn_check_digit(digits: str) -> str:
    """The digit that completes a card number; for tests and synthetic data."""
    return str(next(d for d in range(10) if luhn(digits + str(d))))
