"""Byte-pair encoding and decoding by a deterministic automaton over tokens.

The merges are compiled one by one. At first a single state accepts every byte and returns to
itself. The gadget of the merge (u, v) makes a state q that the arcs of u lead to into a copy
without the arc of v, sends the arcs of u to the copy, and adds an arc of the new token uv beside
every arc of u from which v could follow; it leads where v led. All arcs of a token lead to one
state, so a gadget is one new state (parent, token taken out, number of the merge) and a gadget
changes nothing else. After the last merge the automaton accepts exactly the token sequences that
merging produces.

An arc is missing from a state if, for a gadget on its chain of copies, the token is v or was made
from v, through first parts, by this gadget or after it. Tokens numbered in preorder of their first parts
(older ones first) make that one or two ranges, so the table of a state is a short sorted list of
forbidden ranges. Encoding walks a trie of the tokens from every byte and takes the arcs that the
table allows; the string has one path, which is followed back from its end. Decoding emits the
arcs' labels.

Texts are cut into words by the pattern of byte-level tokenizers, and around the file's added tokens.
Distinct words of a batch are encoded side by side in numpy, long ones alone; a task remembers a
bounded number of words. Every text passes through one task once; nothing is shuffled. The tables
are broadcast: they are as large as the vocabulary.

Defined cases: a null text is empty, an empty text has no ids; rows that repeat a doc_id stay, and
so does a null doc_id; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import give_back, text_column

# Fixed value: how byte-level tokenizers cut a text into words, with names for two classes.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?LETTER+| ?DIGIT+| ?[^\sLETTERDIGIT]+|\s+(?!\S)|\s+"
REMEMBERED = 400_000  # words a task keeps the ids of
SIDE_BY_SIDE = 48  # bytes of a word encoded together with others; longer ones are walked alone
TEXT_CHARS = 4_000_000  # characters of texts worked on together


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def class_changes() -> dict[str, str]:
    """Characters that the tokenizer library classes otherwise than ``regex`` does, by its class.

    The two follow different versions of Unicode, which differ in a few recent scripts.
    """
    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    ahead = ByteLevel(add_prefix_space=False, use_regex=True)
    letter, digit, space = regex.compile(r"\p{L}"), regex.compile(r"\p{N}"), regex.compile(r"\s")
    alike: dict[str, list[str]] = {"L": [], "N": [], "": []}
    for c in map(chr, chain(range(128, 0xD800), range(0xE000, 0x110000))):
        if not space.match(c):
            alike["L" if letter.match(c) else "N" if digit.match(c) else ""].append(c)
    changes = {"L": "", "N": "", "": ""}
    for kind, every in alike.items():
        for at in range(0, len(every), 4_000):
            chars = every[at : at + 4_000]
            # characters of one class are one word; the library cuts where it sees another class
            for _, (start, end) in ahead.pre_tokenize_str("".join(chars)):
                # a letter stays with the a before it, a digit with the 1 behind it, anything else with neither
                ends = {b for _, (_, b) in ahead.pre_tokenize_str(f"a{chars[start]}1")}
                found = "L" if 1 not in ends else "N" if 2 not in ends else ""
                if found != kind:
                    changes[found] += "".join(chars[start:end])
    return changes


def as_ranges(chars: str) -> str:
    """Characters as ranges of a class in a pattern."""
    codes = np.array(sorted(map(ord, chars)), np.int64)
    runs = np.split(codes, np.flatnonzero(np.diff(codes) > 1) + 1) if len(codes) else []
    return "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs)


def word_pattern(changes: dict[str, str]) -> str:
    """The pattern with the given characters moved between its classes."""

    def members(kind: str) -> str:
        others = as_ranges("".join(v for k, v in changes.items() if k != kind))
        own = as_ranges(changes.get(kind, ""))
        return f"[[\\p{{{kind}}}{own}]--[{others}]]" if others else f"[\\p{{{kind}}}{own}]"

    if not any(changes.values()):
        return WORDS.replace("[^\\sLETTERDIGIT]", r"[^\s\p{L}\p{N}]").replace("LETTER", r"\p{L}").replace("DIGIT", r"\p{N}")
    return "(?V1)" + WORDS.replace("LETTER", members("L")).replace("DIGIT", members("N"))


@dataclass(frozen=True)
class Vocabulary:
    """Token labels by place, their ids, the merges by place, and the added tokens' ids."""

    labels: list[bytes]
    ids: list[int]
    merges: list[tuple[int, int, int]]  # first part, second part, token
    added: dict[str, int]
    changes: dict[str, str]  # characters of another class than in ``regex``

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        model = json.loads(Path(path).read_text(encoding="utf-8"))
        unlike = [k for k in ("normalizer", "post_processor") if model.get(k)]
        ahead = model.get("pre_tokenizer") or {}
        if unlike or ahead.get("type") != "ByteLevel" or ahead.get("add_prefix_space") or not ahead.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level tokenizer")
        rules = model["model"]
        if rules.get("ignore_merges") or rules.get("dropout") or rules.get("continuing_subword_prefix") or rules.get("end_of_word_suffix"):
            raise ValueError(f"{path} does not encode by merges alone")
        byte = {c: b for b, c in enumerate(byte_letters())}
        vocab = rules["vocab"]
        place, labels, ids = {}, [], []

        def add(token: str) -> int:
            if token not in place:
                place[token] = len(labels)
                labels.append(bytes(byte[c] for c in token))
                ids.append(vocab[token])
            return place[token]

        for c in byte_letters():
            add(c)
        merges, made = [], set()
        for pair in rules["merges"]:
            u, v = pair if isinstance(pair, list) else pair.split(" ")
            if u + v in made:
                raise ValueError(f"token {u + v!r} is made by two merges")
            made.add(u + v)
            merges.append((add(u), add(v), add(u + v)))
        return cls(labels, ids, merges, {t["content"]: t["id"] for t in model.get("added_tokens", [])}, class_changes())


@dataclass(frozen=True)
class Automaton:
    """The compiled table. Tokens are named by preorder number."""

    state: np.ndarray  # state that a token's arcs lead to; state 0 is the start
    first: np.ndarray  # place of a state's first forbidden range
    low: np.ndarray  # ranges of tokens without an arc, sorted within a state
    high: np.ndarray
    ids: np.ndarray  # id of a token
    dead: np.ndarray  # tokens without any arc
    labels: list[bytes]
    added: dict[str, int]
    changes: dict[str, str]

    def allows(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether each state has an arc of the token beside it: a binary search in its ranges."""
        lo, end = self.first[states].astype(np.int64), self.first[states + 1].astype(np.int64)
        start, hi = lo.copy(), end.copy()
        while True:
            open_ = lo < hi
            if not open_.any():
                break
            mid = (lo + hi) >> 1
            right = open_ & (self.low[np.minimum(mid, len(self.low) - 1)] <= tokens)
            lo = np.where(right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)
        before = np.maximum(lo - 1, 0)
        return ~((lo > start) & (tokens <= self.high[before]))


def compile_merges(vocabulary: Vocabulary) -> Automaton:
    """Applies the gadget of each merge in order, then writes down each reachable state's ranges."""
    n = len(vocabulary.labels)
    target = [0] * n  # state that the arcs of a token lead to
    parent, removed, made = [-1], [-1], [-1]
    first_part, born = [-1] * n, [-1] * n
    dead = [False] * n  # tokens that no merge ever makes, so without arcs

    def lacks(state: int, token: int) -> bool:
        """Whether the state has no arc of the token, by its chain of copies."""
        spine, above = {}, n + len(vocabulary.merges)
        while token >= 0:
            spine[token] = above
            above, token = born[token], first_part[token]
        while state > 0:
            if spine.get(removed[state], -1) >= made[state]:
                return True
            state = parent[state]
        return False

    for time, (u, v, w) in enumerate(vocabulary.merges):
        q = target[u]
        first_part[w], born[w] = u, time
        target[w] = target[v]
        dead[w] = dead[u] or dead[v] or lacks(q, v)
        if not dead[w]:
            parent.append(q)
            removed.append(v)
            made.append(time)
            target[u] = len(parent) - 1

    # preorder of the tokens by first part, older children first
    children: list[list[int]] = [[] for _ in range(n)]
    roots = []
    for t in range(n):
        (children[first_part[t]] if first_part[t] >= 0 else roots).append(t)
    for c in children:
        c.sort(key=lambda t: born[t])
    order, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
    stack, number = [(t, False) for t in reversed(roots)], 0
    while stack:
        t, leaving = stack.pop()
        if leaving:
            last[t] = number - 1
            continue
        order[t] = number
        number += 1
        stack.append((t, True))
        stack.extend((c, False) for c in reversed(children[t]))

    def ranges(state: int) -> list[tuple[int, int]]:
        v, time = removed[state], made[state]
        later = [c for c in children[v] if born[c] >= time]
        out = [(order[v], order[v])]
        if later:
            out.append((order[later[0]], last[v]))
        return out

    # only states that some token leads to, and the start, are written down
    used = sorted({0, *target})
    below: dict[int, list[int]] = {}
    needed, todo = set(), list(used)
    while todo:
        s = todo.pop()
        if s in needed:
            continue
        needed.add(s)
        if s > 0:
            below.setdefault(parent[s], []).append(s)
            todo.append(parent[s])
    number_of = {s: i for i, s in enumerate(used)}
    lows: list[np.ndarray] = [np.zeros(0, np.int32)] * len(used)
    highs: list[np.ndarray] = [np.zeros(0, np.int32)] * len(used)
    taken = np.zeros(n + 2, np.int32)
    walk: list[tuple[int, bool]] = [(0, False)]
    while walk:
        s, leaving = walk.pop()
        if s > 0:
            for a, b in ranges(s):
                taken[a + 1 : b + 2] += -1 if leaving else 1
        if leaving:
            continue
        if s in number_of:
            edge = np.flatnonzero(np.diff((taken > 0).view(np.int8)))
            lows[number_of[s]], highs[number_of[s]] = edge[::2].astype(np.int32), (edge[1::2] - 1).astype(np.int32)
        walk.append((s, True))
        walk.extend((c, False) for c in below.get(s, []))
    back = np.argsort(order)
    return Automaton(
        np.array([number_of[target[t]] for t in back], np.int32),
        np.concatenate([[0], np.cumsum([len(x) for x in lows])]).astype(np.int64),
        np.concatenate([*lows, np.zeros(1, np.int32)]), np.concatenate([*highs, np.full(1, -1, np.int32)]),
        np.array(vocabulary.ids, np.int64)[back], np.array(dead)[back], [vocabulary.labels[t] for t in back], vocabulary.added,
        vocabulary.changes,
    )


class Coder:
    """Encodes and decodes by an automaton's table; remembers words."""

    def __init__(self, automaton: Automaton):
        import regex

        self.table = automaton
        self.words = regex.compile(word_pattern({}))
        changed = "".join(automaton.changes.values())
        # one range is quick to search for; a text that only falls into it is cut alike by both patterns
        self.changed = re.compile(f"[{as_ranges(min(changed))[:10]}-{as_ranges(max(changed))[:10]}]") if changed else None
        self.changed_words = regex.compile(word_pattern(automaton.changes)) if changed else self.words
        known = sorted(automaton.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, known)) + ")") if known else None
        self.label_of = dict(zip(automaton.ids.tolist(), automaton.labels, strict=True))
        self.label_of.update({i: t.encode() for t, i in automaton.added.items()})
        self._trie()
        self.known: dict[str, tuple[str, int, bytes]] = {}
        self.arcs: dict[tuple[int, int], bool] = {}

    def _trie(self) -> None:
        """Byte trie of the labels, a dense row of 256 children for each inner node."""
        nodes: dict[bytes, int] = {b"": 0}
        for label in self.table.labels:
            for k in range(1, len(label) + 1):
                nodes.setdefault(label[:k], len(nodes))
        token = np.full(len(nodes), -1, np.int32)
        for t, label in enumerate(self.table.labels):
            if not self.table.dead[t]:
                token[nodes[label]] = t
        keys = np.array([nodes[p[:-1]] * 256 + p[-1] for p in nodes if p], np.int64)
        inner = np.unique(keys // 256)
        row = np.full(len(nodes), -1, np.int32)
        row[inner] = np.arange(len(inner))
        child = np.full((len(inner) + 1, 256), -1, np.int32)  # the last row has no children
        child[row[keys // 256], keys % 256] = np.array([n for p, n in nodes.items() if p], np.int32)
        row[row < 0] = len(inner)
        self.child, self.row, self.token = child, row, token

    # -------------------------------------------------------- encoding

    def paths(self, words: list[bytes]) -> list[list[int]]:
        """Tokens (preorder numbers) of each word."""
        out: list[list[int]] = [[]] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= SIDE_BY_SIDE]
        for i, w in enumerate(words):
            if len(w) > SIDE_BY_SIDE:
                out[i] = self.walk(w)
        if short:
            for i, path in zip(short, self.side_by_side([words[i] for i in short]), strict=True):
                out[i] = path
        return out

    def walk(self, word: bytes) -> list[int]:
        """One word alone: at every byte the arcs that its state allows."""
        n, allowed, states = len(word), self.arcs, self.table.state
        state, via = [-1] * (n + 1), [-1] * (n + 1)
        state[0] = 0
        child, row, token = self.child, self.row, self.token
        for i in range(n):
            here = state[i]
            if here < 0:
                continue
            node, k = 0, i
            while k < n:
                node = int(child[row[node], word[k]])
                if node < 0:
                    break
                k += 1
                t = int(token[node])
                if t < 0 or via[k] >= 0:
                    continue
                ok = allowed.get((here, t))
                if ok is None:
                    ok = bool(self.table.allows(np.array([here]), np.array([t]))[0])
                    if len(allowed) > 1_000_000:
                        allowed.clear()
                    allowed[(here, t)] = ok
                if ok:
                    via[k], state[k] = t, int(states[t])
        path = []
        while n:
            path.append(via[n])
            n -= len(self.table.labels[via[n]])
        return path[::-1]

    def side_by_side(self, words: list[bytes]) -> list[list[int]]:
        """Short words together, longest first, so that those with a byte at a place are a prefix."""
        by_size = sorted(range(len(words)), key=lambda i: -len(words[i]))
        size = np.array([len(words[i]) for i in by_size], np.int64)
        width = int(size[0])
        filled = b"".join(words[i].ljust(width, b"\0") for i in by_size)
        text = np.frombuffer(filled, np.uint8).reshape(len(words), width)
        state = np.full((len(words), width + 1), -1, np.int32)
        via = np.full((len(words), width + 1), -1, np.int32)
        state[:, 0] = 0
        for i in range(width):
            at = np.flatnonzero((size > i) & (state[:, i] >= 0))
            node = np.zeros(len(at), np.int32)
            for k in range(i, width):
                node = self.child[self.row[node], text[at, k]]
                on = (node >= 0) & (size[at] > k)
                at, node = at[on], node[on]
                if not len(at):
                    break
                t = self.token[node]
                ends = np.flatnonzero(t >= 0)
                ends = ends[self.table.allows(state[at[ends], i], t[ends])]
                via[at[ends], k + 1] = t[ends]
                state[at[ends], k + 1] = self.table.state[t[ends]]
        out: list[list[int]] = [[]] * len(words)
        length = np.array([len(x) for x in self.table.labels], np.int64)
        place, live = size.copy(), np.arange(len(words))
        steps = []
        while len(live):
            t = via[live, place[live]]
            steps.append((live, t))
            place[live] -= length[t]
            live = live[place[live] > 0]
        owner = np.concatenate([a for a, _ in steps] or [np.zeros(0, np.int64)])
        token = np.concatenate([t for _, t in steps] or [np.zeros(0, np.int32)])
        depth = np.concatenate([np.full(len(a), d) for d, (a, _) in enumerate(steps)] or [np.zeros(0, np.int64)])
        order = np.lexsort((-depth, owner))
        cuts = np.searchsorted(owner[order], np.arange(1, len(words)))
        for j, part in enumerate(np.split(token[order], cuts)):
            out[by_size[j]] = part.tolist()
        return out

    def pieces(self, text: str) -> list[str]:
        """Words of a text; added tokens stand alone."""
        words = self.changed_words if self.changed is not None and self.changed.search(text) else self.words
        if self.cut is None or not any(a in text for a in self.table.added):
            return words.findall(text)
        parts = self.cut.split(text)
        return list(chain.from_iterable([p] if i % 2 else words.findall(p) for i, p in enumerate(parts)))

    def learn(self, pieces: set[str]) -> dict[str, tuple[str, int, bytes]]:
        """Per word: its ids joined by commas, their number, and the labels of their arcs."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = [p for p in pieces if p not in self.known]
        ids, labels = self.table.ids, self.table.labels
        found = {}
        for p, path in zip(new, self.paths([p.encode() for p in new]), strict=True):
            found[p] = (",".join([str(ids[t]) for t in path]), len(path), b"".join([labels[t] for t in path]))
        for token, i in self.table.added.items():
            if token in found:
                found[token] = (str(i), 1, token.encode())
        if len(self.known) + len(found) <= 2 * REMEMBERED:
            self.known.update(found)
            return self.known
        return self.known | found

    def coded(self, texts: list[str]) -> Iterator[tuple[str, int, bytes]]:
        """Per text: ids joined by commas, their number, and the decoded bytes."""
        cut = [self.pieces(t) for t in texts]
        words = self.learn(set(chain.from_iterable(cut)))
        for pieces in cut:
            rows = [words[p] for p in pieces]
            yield ",".join([r[0] for r in rows]), sum([r[1] for r in rows]), b"".join([r[2] for r in rows])

    def encode(self, text: str) -> list[int]:
        joined, _, _ = next(iter(self.coded([text])))
        return [int(i) for i in joined.split(",")] if joined else []

    def decode(self, ids) -> str:
        """Labels of the arcs; bytes that are no text become replacement characters."""
        return b"".join([self.label_of.get(int(i), b"") for i in ids]).decode("utf-8", "replace")


def batches(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of bounded size; a text is never cut."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= TEXT_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _coders(df: DataFrame, path: str):
    shared = df.sparkSession.sparkContext.broadcast(compile_merges(Vocabulary.read(path)))
    kept: list[Coder] = []

    def coder() -> Coder:
        if not kept:
            kept.append(Coder(shared.value))
        return kept[0]

    return coder


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and the ``ids`` of each text."""
    coder = _coders(docs, path)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, at = part.column("text").to_pylist(), 0
            for some in batches(texts):
                ids = [[int(i) for i in joined.split(",")] if joined else [] for joined, _, _ in coder().coded(some)]
                names = part.column("doc_id")[at : at + len(some)]
                at += len(some)
                yield pa.RecordBatch.from_arrays([names, pa.array(ids, pa.list_(pa.int64()))], schema=schema)
        give_back()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<long>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and the ``text`` of each array of ``ids``; a null array gives an empty text."""
    coder = _coders(rows, path)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [coder().decode([i for i in ids or [] if i is not None]) for ids in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], schema=schema)

    named = rows.select(rows["doc_id"].cast("long").alias("doc_id"), rows["ids"].cast("array<long>").alias("ids"))
    return named.mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoding and decoding in one pass."""
    coder = _coders(docs, path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            counts, ids, decoded = [], [], []
            for some in batches(part.column("text").to_pylist()):
                for joined, n, raw in coder().coded(some):
                    counts.append(n)
                    ids.append(hashlib.sha256(joined.encode()).hexdigest())
                    # bytes that are no text would be decoded with replacement characters
                    decoded.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                schema=schema,
            )
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
