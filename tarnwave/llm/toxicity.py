"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are per document, so token labels are derived first: a token of a toxic training document counts as toxic where
the lower confidence bound of its odds, counted over distinct neighbourhoods (copies count once), is high enough.
The field has two states, word and affix features hashed into a fixed table, and transitions; it is trained by
minibatch gradient steps. Forward-backward gives each token's marginal; the document score is a logistic function of
the strongest marginal and of their sum, fitted on the training documents.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, held_out, lean, slices

WORD = re.compile(r"[^\W_]+")
#: Features of a word.
FEATURES = 6
#: Bytes of text handled at once: a step of the recurrences covers all texts of a slice, so many of them share its cost.
SLICE = 4 * SLICE_BYTES


@dataclass(frozen=True)
class ToxicityRules:
    """train_docs: bound of the labelled sample, for each of toxic and other documents. support, ratio: what makes a
    token toxic in training: distinct neighbourhoods in toxic documents, and the lower bound (z) of its odds there
    against those of all words.
    clean: share of the training windows without toxic tokens that the field learns from.
    buckets: of hashed features. remembered: words whose features a worker keeps. span: least marginal of a toxic span.
    """

    train_docs: int = 1200
    support: int = 5
    ratio: float = 8.0
    z: float = 1.96
    clean: float = 0.15
    buckets: int = 1 << 18
    epochs: int = 6
    rate: float = 0.5
    l2: float = 1e-4
    remembered: int = 150_000
    span: float = 0.5


def features(word: str, buckets: int) -> list[int]:
    """Hashed features of a word: itself, its first and last letters, its length class, and a bias."""
    named = ("w:" + word, "p:" + word[:3], "q:" + word[:5], "s:" + word[-3:], "n:" + str(min(len(word), 12)), "b")
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % buckets for f in named]


def token_labels(docs: list[list[str]], toxic: list[bool], rules: ToxicityRules) -> set[str]:
    """Tokens that training takes as toxic; see the module's text."""
    near: tuple[dict, dict] = (defaultdict(set), defaultdict(set))
    for words, bad in zip(docs, toxic, strict=True):
        for before, word, after in zip(["", *words], words, [*words[1:], ""]):
            near[bad][word].add(hash((before, after)))
    out, z = set(), rules.z
    base = sum(map(len, near[True].values())) / max(1, sum(map(len, near[False].values())))
    for word, places in near[True].items():
        a = len(places)
        n = a + len(near[False].get(word, ()))
        if a >= rules.support:
            p = a / n
            low = (p + z * z / (2 * n) - z * ((p * (1 - p) + z * z / (4 * n)) / n) ** 0.5) / (1 + z * z / n)
            if low >= rules.ratio * base * (1 - low):
                out.add(word)
    return out


class Packed:
    """Sequences laid out step by step, longest first: step t holds the t-th items of all that are long enough."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        n = lengths[self.order]
        steps = int(n[0]) if len(n) else 0
        self.width = np.searchsorted(-n, -np.arange(1, steps + 1), side="right") if steps else np.zeros(0, int)
        self.begin = np.r_[0, np.cumsum(self.width)]
        starts = np.cumsum(lengths) - lengths
        seq = np.repeat(np.arange(len(n)), n)
        t = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.place = np.empty(int(n.sum()), np.int64)  # of each item, in the order of the sequences as given
        self.place[np.repeat(starts[self.order], n) + t] = self.begin[t] + seq


def forward_backward(score: np.ndarray, trans: np.ndarray, packed: Packed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log marginal odds of state 1, forward and backward messages. score: log odds of state 1, packed.

    With two states, each message is one number: the log odds of state 1.
    """
    f, b = np.empty_like(score), np.zeros_like(score)
    begin, width = packed.begin, packed.width
    for t in range(len(width)):
        own = score[begin[t] : begin[t] + width[t]]
        if t:
            x = f[begin[t - 1] : begin[t - 1] + width[t]]
            own = own + np.logaddexp(x + trans[1, 1], trans[0, 1]) - np.logaddexp(x + trans[1, 0], trans[0, 0])
        f[begin[t] : begin[t] + width[t]] = own
    for t in range(len(width) - 2, -1, -1):
        w = width[t + 1]
        x = b[begin[t + 1] : begin[t + 1] + w] + score[begin[t + 1] : begin[t + 1] + w]
        b[begin[t] : begin[t] + w] = np.logaddexp(x + trans[1, 1], trans[1, 0]) - np.logaddexp(x + trans[0, 1], trans[0, 0])
    return f + b, f, b


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Tagger:
    """A trained field: feature weights, transitions, and the logistic function of the document score."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, final: np.ndarray, rules: ToxicityRules):
        self.used = np.flatnonzero(weights).astype(np.int32)
        self.values, self.trans, self.final, self.rules = weights[self.used].astype(np.float32), trans, final, rules

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("seen", "table", "weights")}

    def start(self) -> None:
        self.weights = np.zeros(self.rules.buckets)
        self.weights[self.used] = self.values
        self.seen: dict[str, int] = {}
        self.table = np.zeros(0)

    def word_scores(self, cut: list[list[str]], n: int) -> np.ndarray:
        if not hasattr(self, "weights") or len(self.seen) > self.rules.remembered:
            self.start()
        new = sorted(set(chain.from_iterable(cut)).difference(self.seen))
        if new:
            self.seen.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.r_[self.table, [self.weights[features(w, self.rules.buckets)].sum() for w in new]]
        return self.table[np.fromiter(map(self.seen.__getitem__, chain.from_iterable(cut)), np.int64, n)]

    def marginals(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Marginal of the toxic state of each word of all texts, one after the other; words of each text."""
        n = np.array([len(c) for c in cut], np.int64)
        packed = Packed(n)
        score = np.empty(int(n.sum()))
        score[packed.place] = self.word_scores(cut, int(n.sum()))
        return sigmoid(forward_backward(score, self.trans, packed)[0])[packed.place], n

    def summary(self, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of each text: 1, its strongest marginal (log odds, bounded), and log(1 + sum of marginals over the span level)."""
        top, mass = np.zeros(len(n)), np.zeros(len(n))
        full = np.flatnonzero(n)
        if len(full):
            at = (np.cumsum(n) - n)[full]
            top[full] = np.maximum.reduceat(p, at)
            mass[full] = np.add.reduceat(np.where(p >= self.rules.span, p, 0), at)
        top = np.clip(top, 1e-3, 1 - 1e-3)
        return np.c_[np.ones(len(n)), np.log(top / (1 - top)), np.log1p(mass)]

    def scores(self, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        return sigmoid(self.summary(p, n) @ self.final)


def train(texts: list[str], toxic: list[bool], rules: ToxicityRules) -> Tagger:
    """Fits the field and the document score. Without both classes, every document scores 0.5 at most."""
    docs = [WORD.findall(t.lower()) for t in texts]
    bad = token_labels(docs, toxic, rules)
    keep = [i for i, d in enumerate(docs) if d]
    # windows of 64 words bound a step's size; toxic ones and a share of the others take part
    seqs, marks, rng = [], [], np.random.default_rng(7)
    for i in keep:
        for at in range(0, len(docs[i]), 64):
            part = docs[i][at : at + 64]
            y = [toxic[i] and w in bad for w in part]
            if any(y) or rng.random() < rules.clean:
                seqs.append(part)
                marks.append(y)
    w, gw = np.zeros(rules.buckets), np.full(rules.buckets, 1e-8)
    trans, gt = np.zeros((2, 2)), np.full((2, 2), 1e-8)
    names = {x: features(x, rules.buckets) for x in set(chain.from_iterable(seqs))}
    for _ in range(rules.epochs if bad else 0):
        for part in np.array_split(rng.permutation(len(seqs)), max(1, len(seqs) // 200)):
            lengths = np.array([len(seqs[i]) for i in part])
            packed = Packed(lengths)
            idx, y = np.empty((int(lengths.sum()), FEATURES), np.int64), np.empty(int(lengths.sum()))
            idx[packed.place] = [names[x] for i in part for x in seqs[i]]
            y[packed.place] = [m for i in part for m in marks[i]]
            score = w[idx].sum(1)
            odds, f, b = forward_backward(score, trans, packed)
            grad = np.zeros(rules.buckets)
            np.add.at(grad, idx.ravel(), np.repeat(sigmoid(odds) - y, FEATURES))
            pair = np.zeros((2, 2))
            for t in range(1, len(packed.width)):
                k = packed.width[t]
                p, q = slice(packed.begin[t - 1], packed.begin[t - 1] + k), slice(packed.begin[t], packed.begin[t] + k)
                e = np.stack([np.stack([np.zeros(k) + trans[0, 0], b[q] + score[q] + trans[0, 1]]), np.stack([f[p] + trans[1, 0], f[p] + b[q] + score[q] + trans[1, 1]])])
                e = np.exp(e - e.max((0, 1)))
                pair += (e / e.sum((0, 1))).sum(2)
                for u in (0, 1):
                    for v in (0, 1):
                        pair[u, v] -= ((y[p] == u) & (y[q] == v)).sum()
            grad, pair = grad / len(part) + rules.l2 * w, pair / len(part) + rules.l2 * trans
            gw, gt = gw + grad**2, gt + pair**2
            w -= rules.rate * grad / np.sqrt(gw)
            trans -= rules.rate * pair / np.sqrt(gt)
    w[np.abs(w) < 1e-3] = 0
    tagger = Tagger(w, trans, np.zeros(3), rules)
    y = np.array(toxic, float)
    if 0 < y.sum() < len(y):
        x = tagger.summary(*tagger.marginals(docs))
        tagger.final = logistic(x, y)
    return tagger


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_tagger(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules(), text: str = "text") -> Tagger:
    """Trains on at most rules.train_docs labelled documents of each class, none of them held out by crc32."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", F.col(text).alias("text")).filter(F.length(text) > 0)
    got = []
    for bad in (True, False):
        # the sample is drawn from the labels, so that no text moves but its own
        ids = known.filter((F.col("toxic") > 0) == bad).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.train_docs).select("doc_id")
        one = rows.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rules.train_docs)
        got += [(r["text"], bad) for r in one.select("text").toLocalIterator()]
    return train([t for t, _ in got], [b for _, b in got], rules)


def score_toxicity(docs: DataFrame, tagger: Tagger, text: str = "text", with_spans: bool = True) -> DataFrame:
    """Each document's toxicity: doc_id, score (0 to 1) and, with_spans, spans of toxic words (array of start, end, p).

    spans: maximal runs of words whose marginal reaches rules.span, in code points, ends exclusive, p the largest
    marginal. A null, empty or wordless text has the score of one without toxic words and no spans. Repeated rows and
    null doc_id keep their rows; equal texts score equal; an empty table gives an empty one; texts have no limit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, size=SLICE):
            low = [t.lower() for t in texts]
            cut = [WORD.findall(t) for t in low]
            p, n = tagger.marginals(cut)
            out = {"doc_id": batch.column(0), "score": pa.array(tagger.scores(p, n))}
            if with_spans:
                at = np.r_[0, np.cumsum(n)]
                out["spans"] = pa.array([toxic_spans(t, p[a:b], tagger.rules.span) for t, a, b in zip(texts, at[:-1], at[1:], strict=True)], SPANS)
            yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(lean(run), f"doc_id {kind}, score double" + ", spans array<struct<start:int,end:int,p:double>>" * with_spans)


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def toxic_spans(text: str, p: np.ndarray, level: float) -> list[dict]:
    """Runs of toxic words as offsets in the text as it stands (lower case may change its length)."""
    hot = np.flatnonzero(p >= level)
    if not len(hot):
        return []
    places = [(m.start(), m.end()) for m in WORD.finditer(text if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text))]
    if len(places) != len(p):  # words differ where lower case splits a letter; then the whole text is the span
        return [{"start": 0, "end": len(text), "p": float(p.max())}]
    cut = np.flatnonzero(np.diff(hot) > 1) + 1
    return [{"start": places[r[0]][0], "end": places[r[-1]][1], "p": float(p[r].max())} for r in np.split(hot, cut)]


def filter_toxic(docs: DataFrame, tagger: Tagger, level: float, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is below level; see score_toxicity."""

    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text=at, size=SLICE):
            score = tagger.scores(*tagger.marginals([WORD.findall(t.lower()) for t in texts]))
            yield batch.filter(pa.array(score < level))

    return docs.mapInArrow(lean(run), docs.schema)
