"""Document quality by hierarchical empirical Bayes.

A classifier over the shape of a text gives evidence (a log likelihood ratio); hosts and paths give priors: the share
of good documents at a path is shrunk toward its host's, a host's toward the whole corpus, by strengths fitted to the
spread between sites (method of moments). Posterior log odds = prior log odds of the path + evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, lean, slices

TRAITS = ("bias", "log words", "symbols", "digits", "upper", "lines", "bars", "repeats", "repeated lines", "word length", "distinct")


@dataclass(frozen=True)
class QualityRules:
    """train_rows: bound of the labelled sample that the classifier is fitted on. keep: least posterior that stays."""

    train_rows: int = 4000
    rounds: int = 30
    ridge: float = 1.0
    keep: float = 0.5



def traits(text: str) -> list[float]:
    """The shape of a whole text: shares of kinds of characters, repeated words and lines."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(len(raw), 1)
    count = np.bincount(raw, minlength=256)
    words = text.split()
    w = max(len(words), 1)
    lines = text.split("\n")
    symbols = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum() - count[44] - count[46]
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    return [1.0, np.log1p(len(words)) / 5, symbols / n * 10, count[48:58].sum() / n * 10, count[65:91].sum() / n * 5, len(lines) / w * 5, count[124] / w * 2, repeats / w * 2, 1 - len(set(lines)) / len(lines), min(n / w / 6, 5.0), len(set(words)) / w]


def trait_table(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text=len(columns)):
            rows = [traits(t) for t in texts]
            cols = {c: batch.column(i) for i, c in enumerate(columns)}
            yield pa.RecordBatch.from_pydict(cols | {"traits": pa.array(rows, pa.list_(pa.float64()))})

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, text).mapInArrow(lean(run), f"{schema}, traits array<double>")


def fit(x: np.ndarray, y: np.ndarray, rules: QualityRules) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the bias carries no penalty. Without both classes, all weights are 0."""
    w = np.zeros(x.shape[1])
    if len(np.unique(y)) < 2:
        return w
    penalty = np.full(len(w), rules.ridge)
    penalty[0] = 1e-6
    for _ in range(rules.rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def logit(p):
    return F.log(p / (1 - p))


def strength(sites: DataFrame, parent: str, good: str, n: str) -> float:
    """How many documents' worth of weight the share of the level above has (method of moments over all sites)."""
    m = sites.agg(F.sum(n).alias("n"), F.sum(F.col(n) * F.pow(F.col(good) / F.col(n) - F.col(parent), 2)).alias("ss"), F.sum(F.col(parent) * (1 - F.col(parent))).alias("pq"), F.sum(F.col(n) * F.col(parent) * (1 - F.col(parent))).alias("npq"), F.count("*").alias("k")).first()
    if not m["n"] or not m["npq"]:
        return 10.0
    # E[ss] = sum pq (1 + (n - 1) rho), rho = 1 / (strength + 1)
    rho = (m["ss"] - m["pq"]) / max(m["npq"] - m["pq"], 1e-9)
    return 1 / min(max(rho, 1e-3), 0.5) - 1


def score_quality(docs: DataFrame, labels: DataFrame, host: str, path: str, rules: QualityRules = QualityRules(), text: str = "text") -> DataFrame:
    """Posterior quality of each document of docs: doc_id, evidence, host_share, path_share, score, keep.

    labels: doc_id and quality (1 good); rows held out by crc32 are never learned from. host and path: columns of docs;
    a null is a site of its own. Documents without labels at their site get the site above, in the end the corpus. A
    null or empty text has the traits of an empty one. Repeated rows keep their rows; a null doc_id has no label;
    without labels, evidence is 0 and all shares 0.5; an empty table gives an empty one.
    """
    # one label per document: repeated labels are averaged, so that they can't multiply rows
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("__q"))
    base = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), text)
    # the sample is drawn from the labels, so that no text moves but its own
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.train_rows)
    sample = base.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.train_rows)
    got = trait_table(sample, ["doc_id", "__q"], text).toPandas()
    x = np.array(got["traits"].tolist()).reshape(len(got), len(TRAITS)) if len(got) else np.zeros((0, len(TRAITS)))
    y = (got["__q"].to_numpy(float) >= 0.5).astype(float) if len(got) else np.zeros(0)
    w = fit(x, y, rules)
    prior = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))) if len(y) and 0 < y.mean() < 1 else 0.0

    labelled = base.drop(text).join(known, "doc_id").groupBy("host", "path").agg(F.sum("__q").alias("good"), F.count("*").alias("n"))
    whole = labelled.agg(F.sum("good"), F.sum("n")).first()
    share = (whole[0] + 1) / (whole[1] + 2) if whole[1] else 0.5
    hosts = labelled.groupBy("host").agg(F.sum("good").alias("good_h"), F.sum("n").alias("n_h")).withColumn("all", F.lit(float(share)))
    m_host = strength(hosts, "all", "good_h", "n_h")
    hosts = hosts.select("host", ((F.col("good_h") + m_host * F.lit(float(share))) / (F.col("n_h") + m_host)).alias("host_share"))
    paths = labelled.join(hosts, "host")
    m_path = strength(paths, "host_share", "good", "n")
    paths = paths.select("host", "path", ((F.col("good") + m_path * F.col("host_share")) / (F.col("n") + m_path)).alias("path_share"))

    scored = trait_table(base, ["doc_id", "host", "path"], text)
    evidence = sum((F.col("traits")[i] * float(v) for i, v in enumerate(w)), F.lit(0.0)) - (prior if len(y) else 0.0)
    out = scored.select("doc_id", "host", "path", evidence.alias("evidence")).join(hosts, "host", "left").join(paths, ["host", "path"], "left")
    host_share = F.coalesce("host_share", F.lit(float(share)))
    out = out.withColumn("host_share", host_share).withColumn("path_share", F.coalesce("path_share", "host_share"))
    score = 1 / (1 + F.exp(-(logit(F.col("path_share")) + F.col("evidence"))))
    return out.select("doc_id", "evidence", "host_share", "path_share", score.alias("score"), (score >= rules.keep).alias("keep"))
