"""Packing round trips and the language model against brute force."""

import collections
import math
import os
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import ODD, SCHEMA, documents, frame

from tablesync.llm import lm_trie, packing
from tablesync.llm.elias_fano import EliasFano, map_arrays, write_arrays

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_equals_the_tokenizer():
    texts = ["", " a", "a ", "a\n\nb", "a  b", "x\n y", "\n", "q \t z", "a b", "<|endoftext|> hi", " lead", "trail\n", "it's we'll, don't.", "a \n",
             "é\nö ü", "12 345  6", "wait... what?! ok.", "a. b, c; d: e! f?", "x.y,z", "'tis ' s", "naïve, façade."] + [t or "" for _, t in ODD]
    encode = packing.Encoder(TOKENIZER)
    for _ in range(2):
        for got, want in zip(encode(texts), encode.plain(texts), strict=True):
            assert np.array_equal(got, want)


def test_added_tokens_keep_their_id(spark):
    """Against the tokenizers library alone, as a text that holds an added token's literal gets its id."""
    plain = Tokenizer.from_file(TOKENIZER)
    texts = ["a<|endoftext|>b", "a <|endoftext|> b", "<|endoftext|>", "x.<|endoftext|>\ny, z", "<|endoftext", "|> <|end oftext|>", "no token. here",
             "w " * 600 + "<|endoftext|>" + " w" * 600]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 50256, 65]
    encode = packing.Encoder(TOKENIZER)
    for _ in range(2):
        assert [x.tolist() for x in encode(texts)] == want
    got = collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packing.pack(frame(spark, list(enumerate(texts))), TOKENIZER, packing.Layout(512, 8)).collect())
    pieces = [(i, start, np.array([*ids, 1], "<u4")[start : start + 512], len(ids) + 1) for i, ids in enumerate(want) for start in range(0, len(ids) + 1, 512)]
    assert got == collections.Counter((i, start, len(x), zlib.crc32(x.tobytes()), n) for i, start, x, n in pieces)


def test_encoder_with_a_full_cache(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_PIECES", 20)
    encode, texts = packing.Encoder(TOKENIZER), [t for _, t in documents(30, alphabet=300)]
    for lo in range(0, 30, 7):
        for got, want in zip(encode(texts[lo : lo + 7]), encode.plain(texts[lo : lo + 7]), strict=True):
            assert np.array_equal(got, want)


@pytest.mark.parametrize("seed", [1, 2])
def test_plan_holds_the_demand_with_little_waste(seed):
    rng = np.random.default_rng(seed)
    demand = rng.integers(0, 60, 64)
    demand[[5, 9]] = 0
    patterns = packing.plan(demand)
    assert (sum(n * p for p, n in patterns) == demand).all()
    assert all((p * np.arange(1, 65)).sum() <= 64 for p, _ in patterns)
    rooms = []  # first fit by decreasing size
    for size in np.repeat(np.arange(1, 65), demand)[::-1].tolist():
        at = next((i for i, r in enumerate(rooms) if r >= size), None)
        if at is None:
            rooms.append(64 - size)
        else:
            rooms[at] -= size
    assert sum(n for _, n in patterns) <= 1.005 * len(rooms)
    assert packing.plan(np.zeros(64, np.int64)) == []


def test_packing_round_trip(spark):
    rows = documents(120, seed=6, alphabet=500, high=2500) + ODD
    encode = packing.Encoder(TOKENIZER)
    layout = packing.Layout(512, 8)
    out = packing.pack(frame(spark, rows, clashing=True), TOKENIZER, layout).collect()
    want = collections.Counter()
    for (i, _), ids in zip(rows, encode.plain([t or "" for _, t in rows]), strict=True):
        data = np.append(ids, 1).astype("<u4")
        for start in range(0, len(data), 512):
            piece = data[start : start + 512]
            want[i, start, len(piece), zlib.crc32(piece.tobytes()), len(data)] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:], strict=False)) and sum(n for _, n in pieces) <= 512
    assert len(sequences) <= 1.05 * sum(r.length for r in out) / 512 + 3
    assert packing.pack(spark.createDataFrame([], SCHEMA), TOKENIZER).count() == 0


@pytest.mark.parametrize("universe, n", [((1 << 64) - 1, 3000), (10**6, 3000), (50, 40), (1000, 0), (1 << 40, 1)])
def test_elias_fano(tmp_path, universe, n):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, universe, n, dtype=np.uint64))
    write_arrays(str(tmp_path / "a"), {f"x.{k}": v for k, v in EliasFano.arrays(values, universe).items()})
    coded = EliasFano.of(map_arrays(str(tmp_path / "a")), "x")
    assert (coded.access(np.arange(len(values))) == values).all()
    queries = np.concatenate([values, rng.integers(0, universe, 500, dtype=np.uint64)])
    place = {int(v): i for i, v in enumerate(values)}
    assert coded.find(queries).tolist() == [place.get(int(q), -1) for q in queries]


def test_repeated_values_keep_their_places():
    values = np.array([0, 0, 0, 3, 3, 7], np.uint64)
    coded = EliasFano.of({f"x.{k}": v for k, v in EliasFano.arrays(values, 8).items()}, "x")
    assert coded.access(np.arange(6)).tolist() == values.tolist()


def test_scores(spark):
    rows = documents(80, seed=8, alphabet=40) + ODD
    docs, s = frame(spark, rows, clashing=True), lm_trie.Settings()
    out = collections.defaultdict(list)
    for r in lm_trie.score(docs, s).collect():
        out[r.doc_id].append(r)
    texts = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in rows]
    train = [w for i, w in texts if not lm_trie.is_held_out(i, s)]
    grams = [collections.Counter(tuple(w[i : i + k]) for w in train for i in range(len(w) - k + 1)) for k in (1, 2, 3)]
    n, v = sum(grams[0].values()), len(grams[0])
    kept = [grams[0]] + [{g: c for g, c in x.items() if c >= s.min_count} for x in grams[1:]]
    left = [{}, {}, {}]
    for k in (1, 2):
        for g, c in kept[k].items():
            left[k][g[:-1]] = left[k].get(g[:-1], 1.0) - (c - s.discount) / grams[k - 1][g[:-1]]

    def probability(word, context):
        if not context:
            return (grams[0].get((word,), 0) + 1) / (n + v + 1)
        k, lower = len(context), probability(word, context[1:])
        if context not in kept[k - 1]:
            return lower
        c = kept[k].get((*context, word), s.discount)
        return (c - s.discount) / grams[k - 1][context] + left[k].get(context, 1.0) * lower

    for i, w in texts:
        base = sum(math.log10((grams[0].get((x,), 0) + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10(probability(w[j], tuple(w[max(0, j - 2) : j]))) for j in range(len(w)))
        known = sum((x,) in grams[0] for x in w)
        assert any(
            (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (lm_trie.is_held_out(i, s), len(w), known, n)
            and r.base_score == pytest.approx(base) and r.score == pytest.approx(score, rel=0.03, abs=0.05) for r in out[i]
        ), i


def test_ngrams_seen_once_count(spark):
    """A held-out text whose word pairs and triples were seen once scores above the same words in an order never seen."""
    s = lm_trie.Settings()
    held = [i for i in range(200) if lm_trie.is_held_out(i, s)][:2]
    train = next(i for i in range(200) if not lm_trie.is_held_out(i, s))
    rows = [(train, "one two three four five six"), (held[0], "one two three four five six"), (held[1], "six two five one four three")]
    path, sizes, total, shards = fitted = lm_trie.fit(frame(spark, rows))
    assert [sum(x) for x in sizes] == [7, 6, 5]
    counts = [map_arrays(f"{path}/level{k}-{i}")["count"] for k in (2, 3) for i, n in enumerate(sizes[k - 1]) if n]
    assert (np.concatenate(counts) == 1).all()
    out = {r.doc_id: r.score for r in lm_trie.scored(frame(spark, rows), fitted).collect()}
    assert out[held[0]] > out[held[1]] + 1


def test_empty_table(spark):
    assert lm_trie.score(spark.createDataFrame([], SCHEMA)).count() == 0


def test_planes():
    for kind in (np.uint32, np.uint64):
        for x in (np.zeros(0, kind), np.arange(1000, dtype=kind) * kind(65537), np.array([np.iinfo(kind).max, 0, 1], kind)):
            back = lm_trie.from_planes(lm_trie.planes(x[::1].copy()), kind)
            assert back.dtype == kind and np.array_equal(back, x)
    assert np.array_equal(lm_trie.from_planes(lm_trie.planes(np.arange(20, dtype=np.uint32)[5:9]), np.uint32), np.arange(5, 9))


def test_select_finds_every_set_and_unset_bit_of_a_word():
    rng = np.random.default_rng(8)
    bits = np.concatenate([rng.integers(0, 256, (60, 8)), np.full((1, 8), 255), np.eye(8, dtype=int) * 128]).astype(np.uint8)
    coded = EliasFano(0, 0, bits[:, :0], bits, np.zeros(len(bits), np.uint32))
    flags = np.unpackbits(bits, axis=1, bitorder="little")
    for flip, wanted in ((0, 1), (255, 0)):
        block, place = np.nonzero(flags == wanted)
        rest = np.concatenate([np.arange(n) for n in (flags == wanted).sum(axis=1)])
        assert np.array_equal(coded._select(block, rest, flip), 64 * block + place)


def test_merged_blocks_are_sorted_by_context_and_word():
    rng = np.random.default_rng(9)
    for context in (rng.integers(0, 1 << 32, 500, np.uint64), rng.integers(0, 40, 500).astype(np.uint64)):
        word = rng.integers(0, 3, 500).astype(np.uint32)
        key = np.lexsort((word, context))
        halves = [key[::2], key[1::2]]
        rows = [b for k in halves for b in lm_trie.blocks(np.zeros(len(k), np.int64), context[k], word[k], np.ones(len(k), np.uint32))]
        got = lm_trie.merged(pa.Table.from_batches(rows))
        pairs, n = np.unique(np.stack([context, word.astype(np.uint64)]), axis=1, return_counts=True)
        assert all(np.array_equal(x, y) for x, y in zip(got, (pairs[0], pairs[1], n), strict=True))


def test_tokens_hash_each_different_word_once(monkeypatch):
    hashed = []
    hashes_of = lm_trie.word_hashes
    monkeypatch.setattr(lm_trie, "word_hashes", lambda words: hashed.extend(words) or hashes_of(words))
    texts = [(t or "").encode() for _, t in ODD] + ["Ab aB\x0bAB\x0c\r ab \x1c\x00 É é".encode(), b"tail \n", b"\n lead", b"a\nb  c"]
    for some in (texts, texts[:1], [b""], []):
        hashed.clear()
        hashes, codes, starts = lm_trie.tokens(some)
        want = [t.lower().split() + [b"\n"] for t in some]
        assert hashes[codes].tolist() == hashes_of([w for ws in want for w in ws]).tolist()
        assert starts.tolist() == np.cumsum([0] + [len(ws) for ws in want]).tolist()
        assert (np.diff(hashes) > 0).all() and len(hashed) == len(set(hashed))


@pytest.mark.parametrize("universe, n", [(1 << 40, 3000), (10**9, 200_000), (1000, 900)])
def test_few_values_share_a_high_part_and_none_lies_above(universe, n):
    """A search ends after few steps, also where the universe is no multiple of bytes, and finds nothing beyond it."""
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, universe, n, dtype=np.uint64))
    coded = EliasFano.of({f"x.{k}": v for k, v in EliasFano.arrays(values, int(values[-1]) + 1).items()}, "x")
    assert np.unique(values >> np.uint64(coded.shift), return_counts=True)[1].max() <= 64
    assert np.array_equal(coded.all(), values)
    queries = np.concatenate([values, values + np.uint64(1), values[-1] + np.array([1, 70, 1 << 20, 1 << 62], np.uint64)])
    at = np.searchsorted(values, queries)
    there = (at < len(values)) & (values[np.minimum(at, len(values) - 1)] == queries)
    assert np.array_equal(coded.find(queries), np.where(there, at, -1))
    half = len(values) // 2
    assert np.array_equal(coded.find(queries, 0, half), np.where(there & (at < half), at, -1))


def test_more_shards_than_words(spark):
    """Shards without a file: what ends a text is in the vocabulary and no context."""
    s = lm_trie.Settings()
    train = [i for i in range(40) if not lm_trie.is_held_out(i, s)][:2]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        out = {r.doc_id: r.score for r in lm_trie.score(frame(spark, [(train[0], "a"), (train[1], "")])).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # a: (1 + 1) / (3 + 2 + 1); end after a: 0.25 / 1 + 0.75 * (2 + 1) / 6
    assert out[train[0]] == pytest.approx(math.log10(2 / 6) + math.log10(0.25 + 0.75 * 0.5), abs=0.01)
    assert out[train[1]] == pytest.approx(math.log10(0.5))


@pytest.mark.parametrize("order, min_count", [(1, 1), (2, 1), (2, 2), (3, 2)])
def test_orders_and_pruning_in_two_counting_passes(spark, monkeypatch, order, min_count):
    passes = []
    built = lm_trie.built
    monkeypatch.setattr(lm_trie, "built", lambda *a: passes.append(1) or built(*a))
    s = lm_trie.Settings(order=order, min_count=min_count)
    rows = documents(60, seed=order + min_count, alphabet=25) + ODD
    out = collections.defaultdict(list)
    path, sizes, total, shards = fitted = lm_trie.fit(frame(spark, rows), s)
    assert len(passes) == min(order, 2)
    for r in lm_trie.scored(frame(spark, rows), fitted, s).collect():
        out[r.doc_id].append(r)
    texts = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in rows]
    train = [w for i, w in texts if not lm_trie.is_held_out(i, s)]
    grams = [collections.Counter(tuple(w[i : i + k]) for w in train for i in range(len(w) - k + 1)) for k in (1, 2, 3)]
    kept = [grams[0]] + [{g: c for g, c in x.items() if c >= min_count} for x in grams[1:order]]
    assert [sum(x) for x in sizes] == [len(x) for x in kept]
    for k, level in enumerate(kept, 1):
        stored = [map_arrays(f"{path}/level{k}-{i}")["count"] for i, n in enumerate(sizes[k - 1]) if n]
        assert sorted(np.concatenate(stored).tolist()) == sorted(level.values())
    left = collections.defaultdict(lambda: 1.0)
    for k in range(1, order):
        for g, c in kept[k].items():
            left[g[:-1]] -= (c - s.discount) / grams[k - 1][g[:-1]]

    def probability(word, context):
        if not context:
            return (grams[0].get((word,), 0) + 1) / (total + len(grams[0]) + 1)
        lower = probability(word, context[1:])
        if context not in kept[len(context) - 1]:
            return lower
        c = kept[len(context)].get((*context, word), s.discount)
        return (c - s.discount) / grams[len(context) - 1][context] + left[context] * lower

    for i, w in texts:
        score = sum(math.log10(probability(w[j], tuple(w[max(0, j - order + 1) : j]))) for j in range(len(w)))
        assert any(r.n_tokens == len(w) and r.train_tokens == total and r.score == pytest.approx(score, rel=0.03, abs=0.05) for r in out[i]), i
