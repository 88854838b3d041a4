"""Removal of repeated passages, located by Aho-Corasick automata.

A window of ``length`` words that also starts anywhere else, the same document included, is a
recurring phrase, and every word it covers is removed. Windows are judged on the input.

Recurring phrases grow with the corpus, so neither can one automaton hold them all nor can every
document pass through every automaton. Both are dealt into shards by the phrase's anchor (see
``repeats``): a shard confirms the phrases that recur among its anchors, compiles them into automata
of bounded size with pyahocorasick, and streams through them the passages of all documents that have
one of those anchors. A passage without the anchor cannot hold the phrase, so every occurrence is
found. A phrase is compiled as its sequence of consecutive five-word grams, a passage is streamed
once for each of the five ways to cut it into grams. Passages whose segments are equal as a whole
are settled before and need no automaton.

Defined cases: a null text has no words, and the digest of no words is that of the empty string;
rows that repeat a text are occurrences of their own; a null doc_id stays null.
"""

from __future__ import annotations

from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablesync.llm.common import mix, word_hashes
from tablesync.llm.repeats import (
    COVERED, NAMES, NULL_ID, ROW, SETTLED, Hashed, Windows, batches_of, covered_mask, covered_rows, run_stages,
)

AUTOMATON_WORDS = 200_000  # words of passages whose phrases are compiled into one automaton


def rule_of(length: int) -> Windows:
    return Windows(length, min(8, length), mutual=True)


def codes_of(text: bytes) -> np.ndarray:
    return word_hashes(text.split())


def locate(passages: list[list[bytes]], settled: np.ndarray, length: int) -> list[tuple[int, int]]:
    """(passage, first word) of every recurring phrase in the passages that are not settled.

    A phrase recurs when it starts at two places, or in a settled passage.
    """
    sizes = np.array([len(p) for p in passages])
    offset = np.concatenate([[0], np.cumsum(sizes)])
    hashed = Hashed(mix(word_hashes([w for p in passages for w in p])))
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(passages)), counts)
    first = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offset[owner] + first
    phrase, code, n = np.unique(hashed(start, start + length), return_inverse=True, return_counts=True)
    known, open_ = np.zeros(len(phrase), bool), np.zeros(len(phrase), bool)
    known[code[settled[owner]]] = True
    open_[code[~settled[owner]]] = True
    recurring = np.flatnonzero(open_ & (known | (n > 1)))
    if not len(recurring):
        return []
    gram = next(g for g in (5, 4, 3, 2, 1) if length % g == 0)
    _, grams = np.unique(hashed.runs(gram), return_inverse=True)
    example = np.empty(len(phrase), np.int64)
    example[code] = start
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for key in grams[example[recurring][:, None] + np.arange(0, length, gram)].tolist():
        automaton.add_word(tuple(key), 1)
    automaton.make_automaton()
    out = []
    for p in np.flatnonzero(~settled).tolist():
        codes = grams[offset[p] : offset[p + 1] - gram + 1].tolist()
        for r in range(gram):
            for end, _ in automaton.iter(tuple(codes[r::gram])):
                out.append((p, r + gram * (end + 1) - length))
    return out


def compare(pieces: DataFrame, rule: Windows) -> DataFrame:
    """Covered rows from the requested passages, shard by shard."""

    def run(batches):
        tables = [pa.Table.from_batches([b]) for b in batches]
        if not tables:
            return
        table = pa.concat_tables(tables)
        rows = [table.column(n).to_numpy() for n in NAMES]
        done = rows[7] == COVERED
        yield from batches_of([c[done] for c in rows])
        order = np.flatnonzero(~done)
        order = order[np.argsort(rows[0][order], kind="stable")]
        rows = [c[order] for c in rows]
        passages = [c.split() for c in table.column("content").take(pa.array(order)).to_pylist()]
        a, words = 0, 0
        for i, p in enumerate(passages):
            words += len(p)
            last = i + 1 == len(passages)
            if last or (words >= AUTOMATON_WORDS and rows[0][i + 1] != rows[0][i]):
                found = locate(passages[a : i + 1], rows[7][a : i + 1] & SETTLED > 0, rule.length)
                if found:
                    who, where = (np.array(c, np.int64) for c in zip(*found, strict=True))
                    where = where + rows[4][a:][who]
                    yield from batches_of(covered_rows(rows[2][a:][who], rows[3][a:][who], where, where + rule.length))
                a, words = i + 1, 0

    return pieces.repartition("key").mapInArrow(run, ROW)


def removed(docs: DataFrame, length: int = 35) -> DataFrame:
    """One row per document: words, words removed, digest of the words kept."""
    rule = rule_of(length)
    texts = run_stages(
        docs, rule, lambda t: t.split(), codes_of, lambda words, a, b: b" ".join(words[a:b]), lambda p: compare(p, rule), "phrases"
    )

    def run(batches):
        for b in batches:
            out = []
            for doc_id, text, spans in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("ranges").to_pylist(), strict=True):
                words = text.split()
                mask = covered_mask(len(words), spans)
                kept = [w for w, gone in zip(words, mask.tolist(), strict=True) if not gone] if spans else words
                out.append((None if doc_id == NULL_ID else doc_id, len(words), len(words) - len(kept), sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"]
            )

    return texts.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


