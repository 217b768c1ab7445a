"""Exact token counts at every prefix of a text, for a lower-casing BPE with word ends.

Prefix dynamic programming over each word: the encoding of a prefix ends in exactly one token t whose neighbour, the
last token of the prefix before it, stays apart from it when the two are encoded together; so
count(prefix) = count(prefix without t) + 1. Two lanes are kept, since the last character of a word carries the word
end: tokens inside a word, and tokens that close it. Truncation and budget questions read the stored counts.

The words of a slice go through the recurrence together, one prefix length at a time: for each word, the tokens that end
there are tried from the longest on.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Hashes, lean, mix, ragged, slices

#: Words, and code points of a word, that a worker remembers at most.
MEMORY_WORDS, MEMORY_CHARS = 150_000, 48
#: Places of the table of judged pairs; a pair that another one has displaced is looked up in a dictionary.
PAIR_BITS = 20
#: Letters and numbers below U+0100, in lower case as the normaliser leaves them.
LATIN_L, LATIN_N = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next code point from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts of all prefixes of texts under the BPE in a tokenizers .json file; see the module's text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        self.end = model["end_of_word_suffix"]
        split = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.vocab = model["vocab"].keys()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.longest = max(len(v.removesuffix(self.end)) for v in self.vocab)
        self.letters = byte_letters()
        self.special = {t["content"] for t in told["added_tokens"]}
        marks = "|".join(re.escape(s) for s in sorted(self.special))
        self.marked = re.compile(f"({marks})")
        import regex

        self.wide = regex.compile(rf" ?(?:{split})| ")
        self.latin = re.compile(f" ?(?:'s|'t|'re|'ve|'m|'ll|'d|[{LATIN_L}]+|[{LATIN_N}]|[^ {LATIN_L}{LATIN_N}]+)| ")
        self.spaces = re.compile("  +")
        #: Texts of tokens without word ends, and of each: 1 if it stands inside a word, 2 if it closes one, 3 if both.
        kinds: dict[str, int] = {}
        for v in self.vocab:
            closes = v.endswith(self.end) and v != self.end
            body = v.removesuffix(self.end) if closes else v
            kinds[body] = kinds.get(body, 0) | (2 if closes else 1)
        bytes_of = {c: b for b, c in self.letters.items()}
        self.bodies = ["", *(b for b in kinds if all(c in bytes_of for c in b))]  # others can't come out of bytes
        self.kinds = np.array([0, *(kinds[b] for b in self.bodies[1:])], np.int8)
        raw = [bytes(map(bytes_of.__getitem__, b)) for b in self.bodies]
        size = np.array([len(r) for r in raw])
        values = Hashes(np.frombuffer(b"".join(raw), np.uint8))(np.cumsum(size) - size, size)
        order = np.argsort(values[1:]) + 1
        self.body_values, self.body_ids = values[order], order
        # by the top bits of a value, where it would stand among the sorted ones
        self.body_begin = np.searchsorted(self.body_values, np.arange((1 << 18) + 1, dtype=np.uint64) << np.uint64(46)) if len(order) else np.zeros((1 << 18) + 1, np.int64)
        self.body_begin[-1] = len(order)
        self.widest = int(np.diff(self.body_begin).max(initial=0))
        self.judged: dict[int, bool] = {}
        self.pairs = np.full(1 << PAIR_BITS, -1, np.int64)
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.flat, self.at, self.n, self.low = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode_symbols(self, symbols: list[str]) -> list[str]:
        """Plain BPE of a few symbols: the best-ranked pair first, leftmost of equals."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best, i = min((self.rank.get(p, 1 << 40), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if best == 1 << 40:
                break
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def symbols(self, token: str) -> list[str]:
        if not token.endswith(self.end):
            return list(token)
        body = token.removesuffix(self.end)
        return [*body[:-1], body[-1] + self.end]

    def bodies_at(self, values: np.ndarray) -> np.ndarray:
        """The number of the token text with each value, 0 where there is none."""
        top = (values >> np.uint64(46)).astype(np.int64)
        at, stop = self.body_begin[top], self.body_begin[top + 1]
        out = np.zeros(len(values), np.int64)
        some = np.flatnonzero(at < stop)
        for step in range(self.widest):
            place = at[some] + step
            hit = self.body_values[place] == values[some]
            out[some[hit]] = self.body_ids[place[hit]]
            some = some[~hit & (place + 1 < stop[some])]
            if not len(some):
                break
        return out

    def apart(self, before: np.ndarray, body: np.ndarray, closes: int) -> np.ndarray:
        """Whether each token text (closing the word, or not) stands as it is after the token before (0 at the start)."""
        pair = (before * len(self.bodies) + body) * 2 + closes
        slot = (mix(pair.astype(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        held = self.pairs[slot]
        out = (held & 1).astype(bool)
        miss = np.flatnonzero(held >> 1 != pair)
        if len(miss):
            new, where = np.unique(pair[miss], return_inverse=True)
            if len(self.judged) > 4 * MEMORY_WORDS:
                self.judged.clear()
            ok = np.array([self.judge(p) for p in new.tolist()], bool)[where]
            out[miss] = ok
            self.pairs[slot[miss]] = pair[miss] * 2 + ok
        return out

    def judge(self, pair: int) -> bool:
        ok = self.judged.get(pair)
        if ok is None:
            pair_, closes = divmod(pair, 2)
            before, body = (self.bodies[i] for i in divmod(pair_, len(self.bodies)))
            full = body + self.end if closes else body
            got = self.encode_symbols([*before, *self.symbols(full)])
            self.judged[pair] = ok = got == ([before, full] if before else [full])
        return ok

    def word_tables(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each prefix of each word by code points, each prefix closed as a word: of all words; prefixes of each."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        stop = np.cumsum(size)
        word = np.repeat(np.arange(len(raw)), size)
        left = np.repeat(stop, size) - np.arange(len(flat))  # bytes from here to the word's end
        hashes, spans = Hashes(flat), []
        for length in range(1, min(self.longest, int(size.max(initial=0))) + 1):
            start = np.flatnonzero(left >= length)
            body = self.bodies_at(hashes(start, length))
            hit = np.flatnonzero(body)
            spans.append((start[hit], np.full(len(hit), length), body[hit]))
        start, length, body = map(np.concatenate, zip(*spans)) if spans else [np.zeros(0, np.int64)] * 3
        own = word[start]
        ends = start + length - (stop - size)[own]  # length of the prefix that the token ends
        order = np.argsort(ends * (len(flat) + 1) + start, kind="stable")  # within a word: the longest token first
        start, body, own, ends = start[order], body[order], own[order], ends[order]
        kind = self.kinds[body]
        here, there = start + own, start + length[order] + own  # states before and after the token; each word has one more than bytes
        inner, last, closed = np.zeros(len(flat) + len(raw), np.int32), np.zeros(len(flat) + len(raw), np.int64), np.zeros(len(flat) + len(raw), np.int32)
        # a prefix ends where no continuation byte follows
        whole = np.r_[(flat[1:] & 0xC0) != 0x80, True][: len(flat)]
        whole[stop[size > 0] - 1] = True
        steps = np.searchsorted(ends, np.arange(1, int(size.max(initial=0)) + 2))
        for a, b in zip(steps[:-1], steps[1:]):
            for closes in (0, 1):
                use = a + np.flatnonzero(kind[a:b] & (2 if closes else 1))
                if closes:
                    use = use[whole[start[use] + length[order[use]] - 1]]
                # the first token of a word that stays apart from the one before it
                while len(use):
                    head = np.r_[True, own[use[1:]] != own[use[:-1]]]
                    first = use[head]
                    ok = self.apart(last[here[first]], body[first], closes)
                    done = first[ok]
                    if closes:
                        closed[there[done]] = inner[here[done]] + 1
                    else:
                        inner[there[done]], last[there[done]] = inner[here[done]] + 1, body[done]
                    group = np.cumsum(head) - 1
                    use = use[~head & ~ok[group]]
        n = np.bincount(word[whole], minlength=len(raw))
        return closed[(np.arange(len(flat)) + word + 1)[whole]], n

    def word_counts(self, word: str) -> list[int]:
        return self.word_tables([word])[0].tolist()

    def odd_counts(self, word: str) -> list[int]:
        """Counts of the prefixes of a special string or a contraction: as they end, their parts are ordinary text, cut anew."""
        return [self.plain(word[:i]) for i in range(1, len(word))] + [1 if word in self.special else self.word_counts(word)[-1]]

    def learn(self, pieces: list[str]) -> None:
        """Stores the prefix counts of matches of the split pattern, each with a space in front or not."""
        lead = np.array([p[:1] == " " for p in pieces], np.int64)
        words = [p[1:] if p[:1] == " " else p for p in pieces]
        odd = {i: self.odd_counts(w) for i, w in enumerate(words) if w in self.special or w[:1] == "'" and len(w) > 1 and w[1:].isalpha()}
        table, n = self.word_tables(["" if i in odd else w for i, w in enumerate(words)])
        own = n.copy()
        own[list(odd)] = [len(c) for c in odd.values()]
        size = lead + own
        begin = np.cumsum(size) - size
        flat = np.zeros(int(size.sum()), np.int32)
        flat[ragged(begin + lead, np.where(own == n, n, 0))] = table
        for i, counts in odd.items():
            flat[begin[i] + lead[i] : begin[i] + size[i]] = counts
        self.seen.update(zip(pieces, range(len(self.at), len(self.at) + len(pieces)), strict=True))
        self.at, self.n = np.r_[self.at, len(self.flat) + begin], np.r_[self.n, size]
        self.low = np.r_[self.low, np.minimum.reduceat(flat, begin)]
        self.flat = np.r_[self.flat, flat]

    def plain(self, text: str) -> int:
        return sum(self.word_counts(w)[-1] for p in self.wide.findall(text) if (w := p.removeprefix(" ")))

    def normal(self, text: str) -> tuple[str, bool]:
        """The normalised text, and whether all of it lies below U+0100."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.tokenizer.normalizer.normalize_str(text), False
        for c in "\t\n\v\f\r\x85\xa0":
            text = text.replace(c, " ")
        return (self.spaces.sub(" ", text) if "  " in text else text).lower(), True

    def cut(self, text: str) -> tuple[str, list[str]]:
        """The normalised text and its matches, each with the space before it; special strings are taken first."""
        if not any(s in text for s in self.special):
            text, latin = self.normal(text)
            return text, (self.latin if latin else self.wide).findall(text)
        whole, pieces = [], []
        for part in self.marked.split(text):
            if part in self.special:
                whole.append(part)
                pieces.append(part)
            elif part:
                more, found = self.cut(part)
                whole.append(more)
                pieces += found
        return "".join(whole), pieces

    def measure(self, texts: list[str]) -> Measured:
        """The stored prefix counts of all texts."""
        cut = [self.cut(t)[1] for t in texts]
        if len(self.seen) > MEMORY_WORDS:
            self.forget()
        new = list(set(chain.from_iterable(cut)).difference(self.seen))
        if new:
            self.learn(new)
        pieces = np.fromiter(map(len, cut), np.int64, len(cut))
        index = np.fromiter(map(self.seen.__getitem__, chain.from_iterable(cut)), np.int64, int(pieces.sum()))
        for p in [p for p in new if len(p) > MEMORY_CHARS]:
            del self.seen[p]
        return Measured(self.flat, self.low, self.at[index], self.n[index], pieces, index)

    def tables(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts at all prefixes of all texts, one text after the other; prefixes and tokens of each text."""
        m = self.measure(texts)
        return m.table(), m.chars, m.tokens


class Measured:
    """Prefix counts of texts: the counts of their matches (slices of a shared table), and what came before each."""

    def __init__(self, flat: np.ndarray, low: np.ndarray, at: np.ndarray, size: np.ndarray, pieces: np.ndarray, index: np.ndarray):
        self.flat, self.at, self.size, self.pieces = flat, at, size, pieces
        self.low = low[index] if len(index) else np.zeros(0, np.int32)
        total = flat[at + size - 1] if len(at) else np.zeros(0, np.int32)
        base, chars = np.r_[0, np.cumsum(total)], np.r_[0, np.cumsum(size)]
        self.stop = np.cumsum(pieces)
        self.start = self.stop - pieces
        self.tokens, self.chars = base[self.stop] - base[self.start], chars[self.stop] - chars[self.start]
        self.base, self.before = base, chars

    def table(self) -> np.ndarray:
        own = (self.base[:-1] - np.repeat(self.base[self.start], self.pieces)).astype(np.int32)
        return self.flat[ragged(self.at, self.size)] + np.repeat(own, self.size)

    def fits(self, budget: int) -> list[int]:
        """Code points of the longest prefix of each text that has at most budget tokens."""
        out = self.chars.tolist()
        for i in np.flatnonzero(self.tokens > budget).tolist():
            a, b = int(self.start[i]), int(self.stop[i])
            ok = np.flatnonzero(self.base[a:b] - self.base[a] + self.low[a:b] <= budget)
            out[i] = 0
            if len(ok):
                k = a + int(ok[-1])
                own = self.flat[self.at[k] : self.at[k] + self.size[k]] + (self.base[k] - self.base[a])
                out[i] = int(self.before[k] - self.before[a] + np.flatnonzero(own <= budget)[-1] + 1)
        return out


_COUNTERS: dict[str, PrefixCounter] = {}


def prefix_counts(docs: DataFrame, tokenizer: str, budget: int, with_table: bool = True, text: str = "text") -> DataFrame:
    """The prefix table of each document, and what it answers for a token budget.

    Returns doc_id, n_bytes (UTF-8), n_tokens, fits (code points of the longest prefix of at most budget tokens) and,
    with_table, prefix_tokens: array of int whose item i is the exact token count of the first i code points of the
    normalised text (NFC, white space folded to one space, lower case). A null text counts as empty: zeros and an empty
    array. Repeated rows, ties and null doc_id keep their rows; an empty table gives an empty one; texts have no limit;
    other columns of docs are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _COUNTERS:
            _COUNTERS[tokenizer] = PrefixCounter(tokenizer)
        c = _COUNTERS[tokenizer]
        for batch, texts in slices(batches):
            m = c.measure(texts)
            out = {"doc_id": batch.column(0), "n_bytes": pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), "n_tokens": pa.array(m.tokens, pa.int64()), "fits": pa.array(m.fits(budget), pa.int64())}
            if with_table:
                out["prefix_tokens"] = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(m.chars)], pa.int32()), pa.array(m.table(), pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, n_tokens long, fits long" + ", prefix_tokens array<int>" * with_table)


def tokens_at(prefix_tokens: Column, chars: Column) -> Column:
    """Tokens of the first `chars` code points, from a stored table; beyond the text, the whole count."""
    return F.when(F.size(prefix_tokens) == 0, 0).when(chars < 1, 0).otherwise(F.element_at(prefix_tokens, F.least(chars, F.size(prefix_tokens)).cast("int")))
