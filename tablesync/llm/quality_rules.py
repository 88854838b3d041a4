"""Quality rules whose cutoffs carry a guarantee on the share of good documents they reject.

Every document gets a few counts and, from them, signals in thousandths (0 to 1000). A rule rejects
a document whose signal reaches a cutoff. Labelled documents are the holdout: per stratum (language)
and signal, cutoffs are tested from the mildest on, and a cutoff is certified while the exact
binomial (Clopper-Pearson) upper bound of its false rejection rate stays within the budget; the
first failure ends the sequence, so no correction for the number of cutoffs is due. Confidence is
divided by strata times signals (Bonferroni) and the rejection budget by signals, so that with
probability ``1 - delta`` every stratum loses at most ``alpha`` of its good documents. Of the
certified cutoffs the one with the largest gain (bad minus good rejected) is used, if it gains.

Defined cases: a null text has no words and fails the base rules; null languages form no stratum and
get base rules only, as do strata with too few labels to certify anything; a null quality is no
label; repeated labels of a document count once, as good if any says so; labelled rows that repeat
a doc_id count once per row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import byte_texts, sequence_hashes, word_hashes

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SIGNALS = ("symbols", "dup_lines", "repeats", "capitals", "exclamations", "long_words")
STEP = 8  # cutoffs are multiples of this many thousandths


@dataclass(frozen=True)
class Risk:
    alpha: float = 0.05  # share of good documents a stratum may lose to all rules together
    delta: float = 0.05  # probability that any stratum loses more
    min_good: int = 200  # good labels a stratum must have to be tested at all


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words covered by windows that occur at least twice in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    grams = sequence_hashes(word_hashes(words), window)
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    cover[:n] += twice
    cover[window : window + n] -= twice
    return int((np.cumsum(cover) > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    """COUNTS of one text, then lines with a word, capitals, letters and exclamation marks."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    solid = text.translate(None, b" \t\n\x0b\x0c\r")
    ascii_bytes = solid.isascii()
    chars = len(solid) if ascii_bytes else len(solid.decode())
    capitals = len(solid) - len(solid.translate(None, UPPER))
    return (
        len(words), chars, len(solid) - len(solid.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), capitals, capitals + len(solid) - len(solid.translate(None, LOWER)),
        solid.count(b"!"),
    )


def signals(m: np.ndarray) -> np.ndarray:
    """Thousandths per document and signal, from rows of ``measure``."""
    words, chars, symbols, dups, repeats, lines, capitals, letters, bangs = m.T
    share = lambda part, whole: np.minimum(1000, 1000 * part // np.maximum(whole, 1))
    mean = chars / np.maximum(words, 1)
    return np.stack([
        share(symbols, words), share(dups, lines), share(repeats, words), share(capitals, letters),
        share(bangs, words), np.minimum(1000, (10 * mean).astype(np.int64)),
    ], axis=1)


def measured(batch_texts: list[bytes]) -> np.ndarray:
    return np.array([measure(t) for t in batch_texts], np.int64).reshape(len(batch_texts), 9)


def base_failed(m: np.ndarray) -> np.ndarray:
    return (m[:, 0] < 20) | (100 * m[:, 4] > 30 * m[:, 0])


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p)."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log((n - i[1:] + 1) / i[1:]))])
    terms = logs + i * math.log(p) + (n - i) * math.log1p(-p)
    top = terms.max()
    return float(min(1.0, math.exp(top) * np.exp(terms - top).sum()))


def certified_cutoff(good: np.ndarray, bad: np.ndarray, budget: float, delta: float) -> int | None:
    """The cutoff of one rule in one stratum, or None.

    ``good`` and ``bad`` count labelled documents by signal step; a cutoff at step ``t`` rejects all
    at or above ``t``. It is certified when the Clopper-Pearson upper bound at confidence
    ``1 - delta`` is at most ``budget``, that is, when P(X <= rejected) <= delta at rate ``budget``.
    """
    n = int(good.sum())
    if not n:
        return None
    lost, caught = np.cumsum(good[::-1])[::-1], np.cumsum(bad[::-1])[::-1]
    best, gain = None, 0
    for t in range(len(good) - 1, 0, -1):
        if binomial_tail(int(lost[t]), n, budget) > delta:
            break
        if caught[t] - lost[t] > gain:
            best, gain = t * STEP, int(caught[t] - lost[t])
    return best


def fit(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> dict[str, dict[str, int]]:
    """Cutoffs in thousandths by language and signal, from all labelled documents.

    The driver gets one small row per stratum that can be certified, signal and step.
    """
    schema = "doc_id long, stratum string, failed boolean, " + ", ".join(f"{s} long" for s in SIGNALS)

    def run(batches):
        for b in batches:
            m = measured(byte_texts(b.column("text")))
            s = signals(m)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("stratum"), pa.array(base_failed(m))] + [pa.array(s[:, i]) for i in range(len(SIGNALS))],
                ["doc_id", "stratum", "failed", *SIGNALS],
            )

    rows = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"), docs["lang"].cast("string").alias("stratum"))
    rows = rows.filter("doc_id is not null and stratum is not null").mapInArrow(run, schema).filter("not failed")
    marks = labels.select(labels["doc_id"].cast("long"), labels["quality"].cast("int").alias("quality")).filter("quality is not null")
    marks = marks.groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("signal"), F.col(s).alias("value")) for i, s in enumerate(SIGNALS)])).alias("x")
    counted = (
        rows.join(marks, "doc_id").select("stratum", "good", steps)
        .groupBy("stratum", F.col("x.signal").alias("signal"), (F.floor(F.col("x.value") / STEP)).cast("int").alias("step"))
        .agg(F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"))
    )
    testable = counted.filter("signal = 0").groupBy("stratum").agg(F.sum("n_good").alias("n")).filter(F.col("n") >= risk.min_good)
    table = counted.join(testable, "stratum", "left_semi").toPandas()
    strata = sorted(table["stratum"].unique())
    out: dict[str, dict[str, int]] = {}
    for stratum in strata:
        for i, name in enumerate(SIGNALS):
            part = table[(table["stratum"] == stratum) & (table["signal"] == i)]
            good, bad = np.zeros(1000 // STEP + 1, np.int64), np.zeros(1000 // STEP + 1, np.int64)
            good[part["step"].to_numpy()] = part["n_good"].to_numpy()
            bad[part["step"].to_numpy()] = part["n_bad"].to_numpy()
            cut = certified_cutoff(good, bad, risk.alpha / len(SIGNALS), risk.delta / (len(SIGNALS) * len(strata)))
            if cut is not None:
                out.setdefault(stratum, {})[name] = cut
    return out


def verdicts(m: np.ndarray, strata: list[str | None], cutoffs: dict[str, dict[str, int]]) -> tuple[np.ndarray, list[str | None]]:
    """Whether each document stays, and the first certified rule that rejects it."""
    s = signals(m)
    limits = np.array([[cutoffs.get(x or "", {}).get(name, 1001) for name in SIGNALS] for x in strata]).reshape(len(m), len(SIGNALS))
    hit = s >= limits
    rule = [SIGNALS[int(np.argmax(h))] if h.any() else None for h in hit]
    return ~base_failed(m) & ~hit.any(axis=1), rule


def apply(docs: DataFrame, cutoffs: dict[str, dict[str, int]]) -> DataFrame:
    """One row per document: its counts, the base verdict, the final verdict and the rejecting rule."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, rule string"

    def run(batches):
        for b in batches:
            m = measured(byte_texts(b.column("text")))
            kept, rule = verdicts(m, b.column("stratum").to_pylist(), cutoffs)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id")] + [pa.array(m[:, i]) for i in range(len(COUNTS))]
                + [pa.array(base_failed(m)), pa.array(kept), pa.array(rule, pa.string())],
                ["doc_id", *COUNTS, "base_failed", "kept", "rule"],
            )

    return docs.select(
        docs["doc_id"].cast("long"), docs["text"].cast("string"), docs["lang"].cast("string").alias("stratum")
    ).mapInArrow(run, schema)


def keep(docs: DataFrame, cutoffs: dict[str, dict[str, int]]) -> DataFrame:
    """The documents that stay, with all their columns."""
    at = {name: docs.columns.index(name) for name in ("text", "lang")}

    def run(batches):
        for b in batches:
            kept, _ = verdicts(measured(byte_texts(b.column(at["text"]))), b.column(at["lang"]).to_pylist(), cutoffs)
            yield b.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
