"""Phrase and suffix dedup, and the n-gram join, against brute force."""

import collections
import hashlib
import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import ODD, SCHEMA, documents, frame, sortable

from tablesync.llm import ngram_join, phrase_automata, repeats, suffix_dedup
from tablesync.llm.common import connected_components


def phrases_brute(rows, length):
    split = [(d, (t or "").encode().split()) for d, t in rows]
    seen = collections.Counter(tuple(w[i : i + length]) for _, w in split for i in range(len(w) - length + 1))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sortable(out)


def suffixes_brute(rows, length):
    """``rows`` with distinct ids; rows that repeat another give its result."""
    seen, out = set(), {}
    for d, t in sorted(set((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(b[i : i + length])
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[d, t] = (d, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return sortable(out[d, t or ""] for d, t in rows)


@pytest.mark.parametrize("hot", [4000, 2])
@pytest.mark.parametrize("alphabet", [5, 60])
def test_phrases(spark, monkeypatch, hot, alphabet):
    monkeypatch.setattr(phrase_automata, "rule_of", lambda n: repeats.Windows(n, min(8, n), True, hot))
    rows = documents(70, seed=alphabet, alphabet=alphabet) + ODD
    assert sortable(phrase_automata.removed(frame(spark, rows, clashing=True), 10).collect()) == phrases_brute(rows, 10)


@pytest.mark.parametrize("hot", [4000, 2])
@pytest.mark.parametrize("alphabet", [5, 60])
def test_suffixes(spark, monkeypatch, hot, alphabet):
    monkeypatch.setattr(suffix_dedup, "rule_of", lambda n: repeats.Windows(n, min(16, n), False, hot))
    rows = documents(70, seed=alphabet + 1, alphabet=alphabet) + [r for r in ODD if r[0] is not None]
    assert sortable(suffix_dedup.removed(frame(spark, rows, clashing=True), 30).collect()) == suffixes_brute(rows, 30)


def test_grams_that_recur_by_chance_ask_for_no_suffixes(spark):
    rng = np.random.default_rng(5)
    word = lambda: bytes(rng.integers(97, 123, 40).astype(np.uint8)).decode()
    rows = [(i, " ".join(f"{word()} a phrase of thirty-odd bytes here {word()}" for _ in range(5))) for i in range(60)]
    shared = " ".join(word() for _ in range(4))
    rows += [(60 + i, f"{word()}{shared}{word()}") for i in range(2)]
    rule = repeats.Windows(100, 16, False, hot=4)
    found = repeats.resolve(repeats.occurrences(repeats.identified(frame(spark, rows)), suffix_dedup.codes_of, rule), rule)
    assert {r.doc_id for r in found.filter(f"tag <> {repeats.COVERED}").collect()} <= {60, 61}
    assert sortable(suffix_dedup.removed(frame(spark, rows)).collect()) == suffixes_brute(rows, 100)


def test_suffixes_of_very_common_surroundings(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "rule_of", lambda n: repeats.Windows(n, min(16, n), False, 3))
    line = "a line that very many documents have between other lines of theirs"
    rows = [(i, f"{'x' * (i % 5)}{i % 4} before {i % 6}. {line} {i % 3} after that {i % 7}{'y' * (i % 9)}" + " more" * (i % 5)) for i in range(60)]
    assert sortable(suffix_dedup.removed(frame(spark, rows), 30).collect()) == suffixes_brute(rows, 30)
    assert sortable(suffix_dedup.removed(frame(spark, rows), 90).collect()) == suffixes_brute(rows, 90)


def test_passage_in_many_documents_is_removed_everywhere(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(i, f"a{i} b{i} {passage} c{i} d{i}") for i in range(40)]
    out = {r.doc_id: r for r in phrase_automata.removed(frame(spark, rows)).collect()}
    assert all(r.n_removed == 55 for r in out.values())
    out = {r.doc_id: r for r in suffix_dedup.removed(frame(spark, rows)).collect()}
    assert out[0].n_removed == 0 and all(out[i].n_removed >= len(passage) for i in range(1, 40))


def test_multikey_order_is_the_sorted_order():
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 3, (400, 32)).astype(np.uint8)
    raw[200:] = raw[rng.integers(0, 200, 200)]
    words = raw.view(">u8").astype(np.uint64)
    order = suffix_dedup.multikey_order(words)
    assert [raw[i].tobytes() for i in order] == sorted(r.tobytes() for r in raw)
    shared = suffix_dedup.common_prefixes(words, order)
    for a, b, n in zip(order, order[1:], shared[1:], strict=False):
        assert os.path.commonprefix([raw[a].tolist(), raw[b].tolist()]) == raw[a].tolist()[:n]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert phrase_automata.removed(empty).count() == suffix_dedup.removed(empty).count() == ngram_join.components(empty).count() == 0


def join_brute(rows, t):
    sets = [set(ngram_join.shingles((x or "").encode(), t.words).tolist()) for _, x in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and t.den * len(a & b) >= t.num * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sortable((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("block", [2048, 3])
def test_join(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "UNIT_SHINGLES", 500)
    rows = documents(160, seed=9, alphabet=400) + ODD
    got = ngram_join.components(frame(spark, rows, clashing=True))
    assert sortable(got.select("doc_id", "n_shingles", "component_id").collect()) == join_brute(rows, ngram_join.Threshold())


def test_sketch_parts_agree_for_every_linked_pair():
    """Pigeonhole: sets within the bound share a key, whatever their sizes."""
    t, rng = ngram_join.Threshold(), np.random.default_rng(5)
    edges = ngram_join.bounds(10_000, t)
    for n in [1, 2, 5, 6, 7, 12, 13, 40, 41, 99, 300, 1000, 3000]:
        for _ in range(12):
            a = rng.integers(0, 1 << 62, n).astype(np.uint64)
            drop = rng.integers(0, int(n * (1 - t.num / t.den)) + 1)
            b = np.unique(a[drop:])
            extra = max(int(len(b) * t.den / t.num) - n, 0)
            b = np.unique(np.concatenate([b, rng.integers(0, 1 << 62, rng.integers(0, extra + 1)).astype(np.uint64)]))
            a = np.unique(a)
            if len(b) and t.den * len(np.intersect1d(a, b)) >= t.num * len(np.union1d(a, b)):
                assert set(ngram_join.bucket_keys(a, t, edges)) & set(ngram_join.bucket_keys(b, t, edges)), n


def test_parts_of_unlike_sets_do_not_agree_by_chance():
    """Parts of one set bit of 2**16 did, in some hundred of a few thousand sets and in ever more with more sets."""
    rng = np.random.default_rng(6)
    cut = np.stack([ngram_join.parts(rng.integers(0, 1 << 62, 60).astype(np.uint64), 20, 1) for _ in range(3000)])
    for column in cut.T:
        full = column[column != 0]
        assert len(np.unique(full)) == len(full)


def test_overlapping_groups_share_a_name_where_a_unit_holds_them(spark, monkeypatch):
    groups = [(1, 10, 1), (1, 10, 2), (2, 11, 2), (2, 11, 3), (2, 11, 2), (7, 12, 7), (7, 12, 8)]
    grouped = spark.createDataFrame(groups, "name long, part long, vertex long")
    holders = spark.createDataFrame([(v, 40) for v in (1, 2, 3, 7, 8)], "vertex long, n long")
    for limit, name in ((1000, 1), (100, 2)):  # 120 shingles under name 1, if they are put together
        monkeypatch.setattr(ngram_join, "UNIT_SHINGLES", limit)
        out = sorted(tuple(r) for r in ngram_join.gathered(grouped, holders).collect())
        assert out == sorted([(1, 10, 1), (1, 10, 2), (name, 11, 2), (name, 11, 3), (7, 12, 7), (7, 12, 8)])


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text), (3, text + " more"), (8, "something else entirely and long enough"), (None, text), (9, None)]
    docs = frame(spark, rows)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 8), (False, 9), (True, 0)]


def test_another_text_under_a_dropped_id_stays(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(3, text), (5, text + " more"), (5, "something else entirely and long enough"), (3, text + " other")]
    kept = {(r.doc_id, r.text) for r in ngram_join.keep_one(frame(spark, rows)).collect()}
    assert (5, rows[2][1]) in kept and len(kept) == 2 and {i for i, _ in kept} == {3, 5}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, j) for j in range(101, 140)] + [(-5, 200), (7, 7)]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(61)) and all(out[j] == 100 for j in range(100, 140)) and out[200] == out[-5] == -5
