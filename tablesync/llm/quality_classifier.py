"""Quality classifier by hierarchical empirical Bayes: document evidence and site posteriors.

Two classifiers, for quality and for toxicity, are logistic regressions on words: hashed words,
their beginnings and their punctuation, of which only those that tell the classes apart beyond
chance are used, and the signals of the quality rules. They are fitted on at most ``fit_rows``
labelled documents, chosen by a hash of the id; all else covers all documents. A classifier's output
without the prior of its sample is the document's evidence, a log-likelihood ratio.

Sites form a hierarchy: all documents, hosts (``source``), paths (host and ``lang``). A grouped
aggregation of all documents' probabilities gives each site its number and its sum. A host's rate is
shrunk toward the global one, a path's toward its host's, as beta priors whose strength is estimated
by the method of moments from how much sites differ beyond sampling. A document's posterior joins
its evidence with the rate of its path without itself.

Defined cases: a null or empty text has the evidence of no words; null hosts and languages are sites
of their own; with too few labels of a class the evidence is zero, and so documents of equal sites
are equal; labels of unknown documents are left out before the sample is drawn; repeated labels count as good, or as toxic, if
any says so; rows that repeat count as often.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import byte_texts, mix, stored, word_hashes
from tablesync.llm.quality_rules import SIGNALS, measured, signals
from tablesync.session import broadcast_if_small

HEADS = ("quality", "toxic")
BUCKETS = 1 << 20
STRIP = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
EVEN = 1e-9  # a document about which nothing is known stays
MARKS = bytes(32 if b >= 128 or chr(b).isalnum() else b for b in range(256))


@dataclass(frozen=True)
class Fit:
    fit_rows: int = 12_000  # labelled documents the classifiers are fitted on, at most
    features: int = 4_000  # words a classifier uses, at most
    z: float = 4.5  # how far beyond chance a word must tell the classes apart
    least: int = 30  # documents each class must have
    sites: int = 100_000  # rows of the site table that are broadcast, else it is joined by shuffle


@dataclass(frozen=True)
class Head:
    """One logistic regression: bucket numbers (sorted) and weights, signal weights, constant."""

    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    dense: np.ndarray = field(default_factory=lambda: np.zeros(len(SIGNALS)))
    constant: float = 0.0


def word_buckets(text: bytes) -> np.ndarray:
    """Distinct buckets of a text's words, their first five bytes and its runs of punctuation."""
    low = text.lower()
    words = set(low.translate(STRIP).split())
    parts = list(words) + [b"^" + w[:5] for w in words] + [b"~" + m for m in set(low.translate(MARKS).split())]
    return np.unique(mix(word_hashes(parts)) % np.uint64(BUCKETS)).astype(np.int64)


def dense_signals(texts: list[bytes]) -> np.ndarray:
    return np.sqrt(signals(measured(texts)) / 1000)


def fit_head(rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, f: Fit) -> Head:
    """Logistic regression with a ridge on the words that tell the classes apart, by gradient descent with momentum."""
    n1, n0 = int(y.sum()), int((1 - y).sum())
    if min(n1, n0) < f.least:
        return Head()
    c1 = np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t]), minlength=BUCKETS)
    c0 = np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if not t]), minlength=BUCKETS)
    pooled = (c1 + c0 + 1) / (n1 + n0 + 2)
    z = (c1 / n1 - c0 / n0) / np.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))
    chosen = np.flatnonzero(np.abs(z) >= f.z)
    chosen = np.sort(chosen[np.argsort(-np.abs(z[chosen]), kind="stable")[: f.features]])
    number = np.full(BUCKETS, -1)
    number[chosen] = np.arange(len(chosen))
    index = [number[r][number[r] >= 0] for r in rows]
    row, col = np.repeat(np.arange(len(rows)), [len(i) for i in index]), np.concatenate(index) if index else np.zeros(0, np.int64)
    # gradient descent with momentum; the ridge keeps rare words small
    w, d, c = np.zeros(len(chosen)), np.zeros(dense.shape[1]), float(np.log(n1 / n0))
    size = 1 / np.sqrt(np.maximum(np.bincount(col, minlength=len(chosen)), 1.0))
    velocity = [np.zeros_like(w), np.zeros_like(d), 0.0]
    for _ in range(300):
        logit = c + dense @ d + np.bincount(row, w[col], len(rows))
        error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y
        steps = (size * np.bincount(col, error[row], len(chosen)) + 0.5 * w, (dense.T @ error + 0.5 * d) / np.sqrt(len(rows)), error.sum() / np.sqrt(len(rows)))
        velocity = [0.9 * v - 0.02 * g for v, g in zip(velocity, steps, strict=True)]
        w, d, c = w + velocity[0], d + velocity[1], c + float(velocity[2])
    return Head(chosen, w, d, c - float(np.log(n1 / n0)))


def sampled(docs: DataFrame, labels: DataFrame, f: Fit) -> DataFrame:
    """Labelled documents to fit on, ``fit_rows`` rows at most: text, quality, toxic.

    Labels count only if their document exists. Of rows that repeat an id the one of the least text is taken.
    """
    marks = labels.select(labels["doc_id"].cast("long").alias("_id"), *[labels[h].cast("int").alias(h) for h in HEADS])
    marks = marks.filter("_id is not null and quality is not null and toxic is not null").groupBy("_id").agg(*[F.max(h).alias(h) for h in HEADS])
    rows = docs.select(docs["doc_id"].cast("long").alias("_doc"), docs["text"].cast("string").alias("text"))
    known = marks.join(rows.select("_doc").distinct(), F.col("_id") == F.col("_doc"), "left_semi")
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(f.fit_rows)
    found = rows.join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    return found.groupBy("_id", *HEADS).agg(F.min("text").alias("text")).select("text", *HEADS)


def fit(docs: DataFrame, labels: DataFrame, f: Fit = Fit()) -> list[Head]:
    """The two classifiers; the driver gets the word buckets of ``fit_rows`` documents."""

    def run(batches):
        for b in batches:
            texts = byte_texts(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("quality"), b.column("toxic"), pa.array([word_buckets(t).astype(np.int32).tobytes() for t in texts], pa.binary()),
                 pa.array([s.tobytes() for s in dense_signals(texts)], pa.binary())],
                ["quality", "toxic", "words", "dense"],
            )

    rows = sampled(docs, labels, f).mapInArrow(run, "quality int, toxic int, words binary, dense binary").toArrow()
    words = [np.frombuffer(x, np.int32).astype(np.int64) for x in rows.column("words").to_pylist()]
    dense = np.array([np.frombuffer(x, np.float64) for x in rows.column("dense").to_pylist()]).reshape(len(words), len(SIGNALS))
    return [fit_head(words, dense, (rows.column(h).to_numpy() > 0).astype(np.float64), f) for h in HEADS]


def evidence(docs: DataFrame, heads: list[Head]) -> DataFrame:
    """doc_id, host, path and the evidence of each classifier."""

    def run(batches):
        for b in batches:
            texts = byte_texts(b.column("text"))
            dense = dense_signals(texts)
            out = np.zeros((len(HEADS), len(texts)))
            for i, t in enumerate(texts):
                words = word_buckets(t)
                for h, head in enumerate(heads):
                    if len(head.buckets):
                        at = np.minimum(np.searchsorted(head.buckets, words), len(head.buckets) - 1)
                        out[h, i] = head.weights[at[head.buckets[at] == words]].sum()
            for h, head in enumerate(heads):
                out[h] += dense @ head.dense + head.constant
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("host"), b.column("path"), *[pa.array(x) for x in out]], ["doc_id", "host", "path", *HEADS]
            )

    host = F.coalesce(docs["source"].cast("string"), F.lit("\0"))
    path = F.concat_ws("/", host, F.coalesce(docs["lang"].cast("string"), F.lit("\0")))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), host.alias("host"), path.alias("path")).mapInArrow(
        run, "doc_id long, host string, path string, quality double, toxic double"
    )


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.ln(p) - F.ln(1 - p)


def strength(sites: DataFrame, rate: str, toward: str) -> float:
    """Beta prior strength of sites around ``toward``, by the method of moments over all sites."""
    m = sites.agg(
        F.sum("n").alias("n"), F.count("*").alias("sites"), F.sum(F.col("n") * (F.col(rate) - F.col(toward)) ** 2).alias("spread"),
        F.sum(F.col("n") * F.col(toward) * (1 - F.col(toward))).alias("noise"), F.sum(F.col("n").cast("double") ** 2).alias("squares"),
    ).first()
    if not m["n"] or m["sites"] < 2:
        return 100.0
    inside = m["noise"] / m["n"]
    between = (m["spread"] - inside * m["sites"]) / max(m["n"] - m["squares"] / m["n"], 1e-9)
    return float(min(max(inside / between - 1, 1.0), 1e6)) if between > 0 else 1e6


def classify(docs: DataFrame, labels: DataFrame, f: Fit = Fit()) -> DataFrame:
    """One row per document: evidence, site rates, posteriors, and whether it stays."""
    scored = stored(evidence(docs, fit(docs, labels, f)), "evidence")
    out = scored
    for h in HEADS:
        p = logistic(F.col(h))
        paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s"))
        hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
        overall = (total["s"] + 0.5) / (total["n"] + 1) if total["n"] else 0.5
        hosts = hosts.withColumn("rate", F.col("s") / F.col("n")).withColumn("toward", F.lit(float(overall)))
        k = strength(hosts, "rate", "toward")
        hosts = hosts.select(F.col("host").alias("_host"), ((F.col("s") + k * F.col("toward")) / (F.col("n") + k)).alias("host_rate"))
        paths = paths.join(broadcast_if_small(hosts, f.sites), F.col("host") == F.col("_host")).withColumn("rate", F.col("s") / F.col("n"))
        k = strength(paths, "rate", "host_rate")
        table = paths.select(F.col("path").alias("_path"), F.col("n").alias("_n"), F.col("s").alias("_s"), F.col("host_rate").alias("_host_rate"))
        out = out.join(broadcast_if_small(table, f.sites), F.col("path") == F.col("_path"))
        rate = (F.col("_s") - p + k * F.col("_host_rate")) / (F.col("_n") - 1 + k)
        rate = F.least(F.greatest(rate, F.lit(1e-6)), F.lit(1 - 1e-6))
        out = out.withColumn(f"{h}_site", rate).drop("_path", "_n", "_s", "_host_rate").withColumn(f"p_{h}", logistic(F.col(h) + logit(F.col(f"{h}_site"))))
    return out.select(
        "doc_id", *[F.col(h).alias(f"{h}_evidence") for h in HEADS], *[f"{h}_site" for h in HEADS], *[f"p_{h}" for h in HEADS],
        ((F.col("p_quality") > 0.5 - EVEN) & (F.col("p_toxic") < 0.5 + EVEN)).alias("kept"),
    )
