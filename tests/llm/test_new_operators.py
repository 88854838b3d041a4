"""Whitening, the token automaton and conversation repair against brute force."""

import hashlib
import math
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from helpers import ODD, documents, frame
from tokenizers import Tokenizer

from tablesync.llm import bpe_automaton, conversation_repair, whitening

PATH = public_tokenizers.path("byte_bpe_50k.json")

# ------------------------------------------------------------ whitening

VECTORS = "vec_id long, embedding array<float>, label int, component string, key long"


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, 0, "c", 1) for i, v in rows], VECTORS).repartition(3)


def whole(v):
    return tuple(math.floor(256 * float(np.float32(c))) for c in v)


def check_whitening(spark, rows):
    got = whitening.whiten(embeddings(spark, rows)).collect()
    kept = [(i, whole(v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    away = np.array(fit, float) - np.array(sums) / n
    value, vector = np.linalg.eigh(away.T @ away / n)
    k = min(4, sum(value > 1e-9 * value.sum()))
    assert len(got) == k * len(kept)
    by_key = {}
    for r in got:
        by_key.setdefault((r.vec_id, r.deviation, r.component), []).append(r)
    for i, x in kept:
        deviation = sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True))
        for c in range(1, k + 1):
            mine = by_key[(i, deviation, c)]
            u, e = vector[:, -c], value[-c]
            want = (np.array(x) - np.array(sums) / n) @ u / np.sqrt(e)
            assert min(abs(abs(r.whitened) - abs(want)) for r in mine) < 1e-8
            for r in mine:
                assert r.n == n and abs(r.explained - e / value.sum()) < 1e-9 and r.identity_error < 1e-9


def test_whitening(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(7) * [3, 2, 1, 0.9, 0.5, 0.4, 0.1]).tolist()) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(100)] + [(7, rows[7][1])]
    rows += [(None, rows[1][1]), (500, None), (501, [None] * 7), (502, [float("nan")] * 7), (503, [float("inf"), *[0.0] * 6]), (504, [-0.0] * 7)]
    check_whitening(spark, rows)


def test_whitening_of_few_components(spark):
    check_whitening(spark, [(i, [float(i % 5), float(i % 5), 1.0]) for i in range(40)])


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(embeddings(spark, [])).count() == 0
    assert whitening.whiten(embeddings(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(embeddings(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(embeddings(spark, [(1, [1.0]), (2, [1.0, 3.0]), (3, [])])).count() == 6


def test_large_entries(spark):
    got = whitening.whiten(embeddings(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 3.0])])).collect()
    assert {r.vec_id for r in got} == {1, 2, 3} and {r.deviation for r in got if r.vec_id == 1} == {None}


@pytest.mark.parametrize("values", [[5, 5, 5, 1, 1, 0], [1] * 5, [1e12, 1, 1e-6], [3], list(np.geomspace(1, 1e-8, 60))])
def test_components(values):
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((len(values),) * 2))[0]
    for v in (q @ np.diag(values) @ q.T, np.diag(np.array(values, float))):
        v = (v + v.T) / 2
        e, c = whitening.components(v, 4)
        assert np.allclose(e, np.sort(values)[::-1][:4], rtol=0, atol=1e-13 * max(values))
        assert np.abs(v @ c - c * e).max() < 1e-13 * max(values) and np.abs(c.T @ c - np.eye(len(e))).max() < 1e-13


def test_matrices_add_up_in_rounds(spark):
    rows = [(i, np.full(4, float(i)).tobytes()) for i in range(700)]
    partial = spark.createDataFrame(rows, "slot long, m binary")
    assert whitening._added(partial, 2).tolist() == [sum(range(700))] * 4


# ------------------------------------------------------------ token automaton


@pytest.fixture(scope="module")
def coder():
    return bpe_automaton.Coder(bpe_automaton.compile_merges(bpe_automaton.Vocabulary.read(PATH)))


def odd_strings(n):
    rng = random.Random(11)
    parts = [
        "a", "the", " ", "  ", "\n", "ing", "<|endoftext|>", "é", "😀", "1", "23", "'s", "'", "!", "...", "\t", "ß", "́",
        "中", "‍", "ab", "in", "er", "e", "t", "h", "\x85", "\x1c", "٣", "½", "\U000136f9", "\U00010962", "ࢗ",
    ]
    out = ["", "x" * 500 + " " * 300 + "\n" * 99, "aaaa" * 900, "I'LL don't 'S", "\0\0a\0", "<|endoftext|>" * 3, "<|endoftext| >"]
    out += ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(n)]
    out += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(9)) for _ in range(n)]
    return out


def test_automaton_encodes_as_the_library(coder):
    texts = odd_strings(4000) + [t for _, t in documents(200)]
    plain = Tokenizer.from_file(PATH)
    for text, (joined, n, raw) in zip(texts, coder.coded(texts), strict=True):
        ids = plain.encode(text, add_special_tokens=False).ids
        assert (joined, n) == (",".join(map(str, ids)), len(ids))
        assert raw.decode() == plain.decode(ids, skip_special_tokens=False) == coder.decode(ids) == text


def test_long_words_alone_or_together(coder):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeing ") for _ in range(rng.randrange(1, 47))).encode() for _ in range(300)]
    assert coder.side_by_side(words) == [coder.walk(w) for w in words]


def test_partial_characters_decode_as_the_library(coder):
    plain, rng = Tokenizer.from_file(PATH), random.Random(6)
    for _ in range(300):
        ids = [rng.randrange(256) if rng.random() < 0.7 else rng.randrange(50257) for _ in range(8)]
        assert coder.decode(ids) == plain.decode(ids, skip_special_tokens=False)


def test_small_automata_against_merging():
    """Every sequence of tokens is accepted exactly if merging its text gives that sequence."""
    rng = random.Random(8)
    for _ in range(40):
        labels, merges = [bytes([b]) for b in range(256)], []
        pool = [97, 98, 99]
        while len(merges) < 9:
            u, v = rng.choice(pool), rng.choice(pool)
            if labels[u] + labels[v] not in labels:
                labels.append(labels[u] + labels[v])
                merges.append((u, v, len(labels) - 1))
                pool.append(len(labels) - 1)
        small = bpe_automaton.compile_merges(bpe_automaton.Vocabulary(labels, list(range(len(labels))), merges, {}, {}))
        code = bpe_automaton.Coder(small)
        for _ in range(60):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 14)))
            have = list(word)
            for u, v, w in merges:
                i, out = 0, []
                while i < len(have):
                    pair = have[i : i + 2] == [u, v]
                    out.append(w if pair else have[i])
                    i += 2 if pair else 1
                have = out
            assert [int(small.ids[t]) for t in code.walk(word)] == have
            assert code.side_by_side([word]) == [code.walk(word)]


def test_bpe_digests_and_round_trip(spark):
    rows = [*ODD, (950, "a<|endoftext|>b"), (951, "x" * 20000)]
    docs = frame(spark, rows, clashing=True)
    plain = Tokenizer.from_file(PATH)

    def digest(text):
        ids = plain.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return len(ids), sha(",".join(map(str, ids))), sha(plain.decode(ids, skip_special_tokens=False))

    got = bpe_automaton.digests(docs, PATH).collect()
    order = lambda rs: sorted(rs, key=str)
    assert order(map(tuple, got)) == order((i, *digest(t)) for i, t in rows)
    back = bpe_automaton.decode(bpe_automaton.encode(docs, PATH), PATH).collect()
    assert order(map(tuple, back)) == order((i, t or "") for i, t in rows)
    assert bpe_automaton.digests(docs.limit(0), PATH).count() == 0


# ------------------------------------------------------------ conversation repair

SPACE = " \t\n\x0b\x0c\r"


def repair_plainly(rows):
    """Result rows by trying every edit, and the repaired rows, from (conv_id, turn, role, text)."""
    one = lambda v: " " if v is None else str(v)
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        convs[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, rs in convs.items():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, fault = set(), []
        for _, role, text in rs:
            bare = text.rstrip(SPACE)
            fault.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in rs if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in rs]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        move = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
        long = {"u": "user", "a": "assistant"}

        @lru_cache(None)
        def best(i, state, inserts, rs=rs, fault=fault, move=move, long=long):
            options = []
            if inserts:
                for r in "ua":
                    if (state, r) in move:
                        c, a, t = best(i, move[(state, r)], inserts - 1)
                        options.append((2 + c, "I" + a, ((long[r], ""), *t)))
            if i == len(rs):
                if state in ("", "a"):
                    options.append((0, "", ()))
                return min(options, default=(10**9, "", ()))
            c, a, t = best(i + 1, state, 3)
            options.append((3 + c, "D" + a, t))
            if fault[i] in ("", "truncated"):
                extra = fault[i] == "truncated"
                role, text = rs[i][1], rs[i][2]
                if (state, role[:1]) in move:
                    c, a, t = best(i + 1, move[(state, role[:1])], 3)
                    options.append((extra + c, "K" + a, ((role, text), *t)))
                for r in "ua":
                    if (state, r) in move:
                        c, a, t = best(i + 1, move[(state, r)], 3)
                        options.append((2 + extra + c, "R" + a, ((long[r], text), *t)))
            return min(options, key=lambda o: o[:2])

        for i in range(len(rs), -1, -1):  # from the end, so that the recursion stays shallow
            for state in ("", "s", "u", "a"):
                best(i, state, 3)
        cost, audit, fixed = best(0, "", 3)
        lines = "\n".join(f"{r}:{t}" for r, t in fixed)
        counts = [sum(f == kind for f in fault) for kind in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest(), fixed))
    return out


def talks(n, seed, longest=9):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "what", "", " \n", None, f"text {turn}.", f"{conv} é?", "a. "])
            rows.append((conv if rng.random() < 0.99 else None, turn if rng.random() < 0.9 else rng.choice([None, turn + 3]), role, text))
    return rows


CONVERSATIONS = "conv_id long, turn long, role string, text string, code int, chunk string, edits long"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", 2) for r in rows], CONVERSATIONS).repartition(4)


@pytest.mark.parametrize("chunk_rows", [2, 8192])
def test_repair(spark, chunk_rows):
    rows = talks(40, 1)
    got = conversation_repair.report(conversations(spark, rows), chunk_rows).collect()
    assert sorted(map(tuple, got), key=str) == sorted((r[:-1] for r in repair_plainly(rows)), key=str)


def test_repair_of_one_long_conversation(spark):
    rng = random.Random(9)
    rows = [(5, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "cut", f"{t}!"])) for t in range(400)]
    rows += [(6, t, "ua"[t % 2] + "x", f"{t}.") for t in range(40)] + [(7, 0, "user", "Same.")] * 30
    df = conversations(spark, rows)
    plain = repair_plainly(rows)
    assert sorted(map(tuple, conversation_repair.report(df, 16).collect())) == sorted(r[:-1] for r in plain)
    kept = conversation_repair.repaired(df, 16).orderBy("conv_id", "_row_index", "place").collect()
    for conv, *_, fixed in plain:
        assert [(r.role, r.text) for r in kept if r.conv_id == conv] == list(fixed)
    ordered = conversation_repair.in_order(conversation_repair.damaged(df))
    _, passes = conversation_repair.converge(conversation_repair.blocks(conversation_repair.row_codes(ordered, 16)))
    assert 1 <= passes <= 4


def test_repair_of_odd_tables(spark):
    assert conversation_repair.report(conversations(spark, [])).count() == 0
    gone = [(c, 0, "user", "x.") for c in range(60) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    empty = hashlib.sha256(b"").hexdigest()
    assert {tuple(r)[1:] for r in conversation_repair.report(conversations(spark, gone)).collect()} == {(0, 0, 0, 0, 0, 0, "", empty)}
    assert conversation_repair.repaired(conversations(spark, gone)).count() == 0
    nulls = [(None, None, None, None)] * 5
    got = conversation_repair.report(conversations(spark, nulls)).collect()
    assert [tuple(r) for r in got] == [r[:-1] for r in repair_plainly(nulls)]
