"""Packing of documents into training sequences by cutting-stock column generation.

Every document becomes token ids and an end id. Whole sequences of ids are cut off its front; what
remains, shorter than a sequence, is an item. The lengths of all items form a histogram over length
classes (a few lengths each). The cutting-stock problem "fill sequences with the fewest left-over
places" is solved on the histogram alone: a linear program over patterns (how many items of each
class share a sequence), whose columns are priced by a knapsack dynamic program on the dual prices
until none pays; pattern counts are rounded down and the few items left over are packed by
decreasing size. Items are ranked within their class, and the rank decides pattern, sequence and
place. Only counts reach the driver: one per class, and one per group of rows ranked together.

Defined cases: a null or empty text is one end id; rows that repeat a doc_id are documents of their
own; a null doc_id stays null.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesync.llm.common import give_back, stored
from tablesync.session import local_frame

CACHE_PIECES = 600_000  # pieces a task keeps the ids of; the rest is encoded again, batch by batch
MARKS = ".,!?;:"
TEXTS = 2_000  # texts encoded together
LEAST_RANKED, MOST_RANKED, SALTS = 1_000, 500_000, 64  # rows of a class ranked together; ways a middling class is split


@dataclass(frozen=True)
class Layout:
    length: int = 2048  # ids of a sequence
    grain: int = 16  # lengths of a class; a sequence wastes fewer than this per item
    end_id: int = 1


# ------------------------------------------------------------ tokens


class Encoder:
    """Ids of a byte-level BPE tokenizer file, looked up piece by piece.

    The tokenizer never joins ids across a single space (which starts the next piece) or a single
    line feed (a piece of its own), so a text is cut there, each distinct piece is encoded once, and
    texts with any other white space next to white space, or with an added token of the file (such
    as ``<|endoftext|>``, which gets its own id as in the plain call), are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.adjacent = regex.compile(r"\s\s")
        self.forget()
        # an id that begins with a space begins a piece, as no piece has a space inside
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.begins = np.array([t.startswith("\u0120") for t in tokens])

    def forget(self) -> None:
        """Drops what was learned; other stages of a job need the memory."""
        self.cache: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def pieces(self, text: str) -> list[str]:
        """The text cut before single spaces and around single line feeds."""
        out: list[str] = []
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append("\n")
            head, *rest = line.split(" ")
            if head:
                out.append(head)
            out.extend([" " + x for x in rest])
        return out

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and where those of each end; pieces that start with a space are encoded joined."""
        joined = [i for i, p in enumerate(pieces) if p[0] == " " and len(p) > 1]
        rest = [i for i, p in enumerate(pieces) if p[0] != " " or len(p) == 1]
        blocks = ["".join([pieces[i] for i in joined[k : k + 2000]]) for k in range(0, len(joined), 2000)]
        together = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(blocks, add_special_tokens=False)]
        spaced = np.concatenate([np.zeros(0, np.uint32), *together])
        single = self.plain([pieces[i] for i in rest])
        sizes = np.zeros(len(pieces), np.int64)
        sizes[joined] = np.diff(np.append(np.flatnonzero(self.begins[spaced]), len(spaced)))
        sizes[rest] = [len(x) for x in single]
        order = np.argsort(np.array(joined + rest, np.int64), kind="stable")
        at = np.concatenate([[0], np.cumsum(sizes[joined + rest])])
        ids = np.concatenate([spaced, *single])
        n = sizes[np.arange(len(pieces))]
        ends = np.cumsum(n)
        return ids[np.repeat(at[order] - ends + n, n) + np.arange(len(ids))], ends

    def learn(self, pieces: set[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Numbers new pieces after the known ones; returns them, all ids and where each piece's start.

        A letter and the mark after it never share an id, so a word with a mark is encoded as two.
        """
        marked = [p for p in pieces if p[-1] in MARKS and p[1:-1].isalpha() and p[0] == " "]
        plain = list((pieces.difference(marked) | {p[:-1] for p in marked} | {p[-1] for p in marked}) - self.cache.keys())
        first = len(self.starts) - 1
        ids, ends = self.encode(plain) if plain else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        ids, starts = np.concatenate([self.ids, ids]), np.concatenate([self.starts, len(self.ids) + ends])
        self.cache.update(zip(plain, range(first, first + len(plain)), strict=True))
        if marked:
            at = np.array([[self.cache[p[:-1]], self.cache[p[-1]]] for p in marked]).ravel()
            n = starts[at + 1] - starts[at]
            ends = np.cumsum(n)
            more = ids[np.repeat(starts[at] - ends + n, n) + np.arange(ends[-1])]
            self.cache.update(zip(marked, range(len(starts) - 1, len(starts) - 1 + len(marked)), strict=True))
            ids, starts = np.concatenate([ids, more]), np.concatenate([starts, len(ids) + ends[1::2]])
        return plain + marked, ids, starts

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        whole = [self.adjacent.search(t) is not None or any(a in t for a in self.added) for t in texts]
        cut = [None if w else self.pieces(t) for t, w in zip(texts, whole, strict=True)]
        distinct: set[str] = set()
        for ps in cut:
            if ps:
                distinct.update(ps)
        new, ids, starts = self.learn(distinct - self.cache.keys())
        full = len(self.cache) > CACHE_PIECES
        if not full:
            self.ids, self.starts = ids, starts
        for t, w, ps in zip(texts, whole, cut, strict=True):
            if w:
                yield self.plain([t])[0]
                continue
            at = np.fromiter(map(self.cache.__getitem__, ps), np.int64, len(ps))
            n = starts[at + 1] - starts[at]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            yield ids[np.repeat(starts[at] - ends + n, n) + np.arange(total)]
        if full:
            for p in new:
                del self.cache[p]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenized(docs: DataFrame, tokenizer_path: str, layout: Layout) -> DataFrame:
    """Pieces of every document: full sequences from its front, then what remains."""

    def run(batches):
        encode = encoder(tokenizer_path)
        for b in batches:
            ids_of = b.column("doc_id").to_pylist()
            texts = b.column("text").to_pylist()
            for lo in range(0, len(texts), TEXTS):
                rows = []
                for doc_id, ids in zip(ids_of[lo : lo + TEXTS], encode([t or "" for t in texts[lo : lo + TEXTS]]), strict=True):
                    data = np.append(ids, layout.end_id).astype("<u4")
                    for start in range(0, len(data), layout.length):
                        piece = data[start : start + layout.length]
                        rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(data)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                )
            del b, texts
        encode.forget()
        give_back()

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, PIECES)


# ------------------------------------------------------------ cutting stock


def knapsack(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest multiset of classes (class c takes c + 1 places) within the capacity."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        value = prices[:room] + best[room - 1 :: -1][:room]
        c = int(np.argmax(value))
        best[room], choice[room] = value[c], c
        if best[room - 1] >= best[room]:
            best[room], choice[room] = best[room - 1], -1
    counts, room = np.zeros(len(prices), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= choice[room] + 1
    return float(best[capacity]), counts


def column_generation(demand: np.ndarray, gap: float = 0.001, rounds: int = 20_000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often the linear program uses them, for class c of c + 1 places.

    Minimises the number of sequences that hold ``demand[c]`` items of each class: a revised simplex
    whose entering columns come from the knapsack on the dual prices. The dearest column's price
    bounds how far the current solution is from the best one; it ends within ``gap``.
    """
    capacity = len(demand)
    classes = np.flatnonzero(demand)
    m = len(classes)
    if not m:
        return []
    basis = [np.zeros(capacity, np.int64) for _ in range(m)]
    inverse = np.zeros((m, m))
    for i, c in enumerate(classes):
        fit = capacity // (c + 1)
        basis[i][c] = fit
        inverse[i, i] = 1 / fit
    x = inverse @ demand[classes]
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        prices = np.full(capacity, -1.0)
        prices[classes] = duals
        value, pattern = knapsack(prices, capacity)
        if value <= 1 + gap:
            break
        direction = inverse @ pattern[classes]
        positive = direction > 1e-10
        if not positive.any():
            break
        ratio = np.full(m, np.inf)
        ratio[positive] = np.maximum(x[positive], 0) / direction[positive]
        out = int(np.argmin(ratio))
        step = ratio[out]
        x -= step * direction
        x[out] = step
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        basis[out] = pattern
    return [(b, float(v)) for b, v in zip(basis, x, strict=True) if v > 1e-9]


def plan(demand: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole counts that together hold exactly ``demand``."""
    capacity, left = len(demand), demand.astype(np.int64).copy()
    out = []
    for pattern, times in sorted(column_generation(demand), key=lambda p: -p[1]):
        fits = pattern > 0
        n = min(int(times + 1e-6), int((left[fits] // pattern[fits]).min()))
        if n > 0:
            out.append((pattern, n))
            left -= n * pattern
    while left.any():  # one pattern at a time, largest class first, repeated while it lasts
        pattern, room = np.zeros(capacity, np.int64), capacity
        while room > 0:
            fitting = np.flatnonzero(left[:room] - pattern[:room] > 0)
            if not len(fitting):
                break
            c = int(fitting[-1])
            take = int(min((left - pattern)[c], room // (c + 1)))
            pattern[c] += take
            room -= take * (c + 1)
        fits = pattern > 0
        n = int((left[fits] // pattern[fits]).min())
        out.append((pattern, n))
        left -= n * pattern
    return out


def assign(pieces: DataFrame, layout: Layout) -> DataFrame:
    """``pieces`` with sequence_id and offset, gapless within each sequence."""
    spark = pieces.sparkSession
    classes = layout.length // layout.grain  # class number ``classes`` is that of full sequences
    number = F.when(F.col("length") == layout.length, F.lit(classes)).otherwise(F.floor((F.col("length") - 1) / layout.grain)).cast("int")
    cut = pieces.select("*", number.alias("_class"))
    sizes = np.zeros(classes + 1, np.int64)
    for c, n in cut.groupBy("_class").count().collect():
        sizes[c] = n
    salts = np.maximum(-(-sizes // MOST_RANKED), np.minimum(SALTS, -(-sizes // LEAST_RANKED)))
    by_class = local_frame(spark, [(c, int(n)) for c, n in enumerate(salts) if n], "_class int, _salts int")
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("_salts")).cast("int")
    cut = cut.join(F.broadcast(by_class), "_class").select(*pieces.columns, "_class", salt.alias("_salt"))
    offsets, so_far = [], np.zeros(classes + 1, np.int64)
    for c, k, n in sorted(cut.groupBy("_class", "_salt").count().collect()):
        offsets.append((c, k, int(so_far[c])))
        so_far[c] += n
    patterns = plan(sizes[:classes])

    first_full = sum(n for _, n in patterns)
    used, base, slots = np.zeros(classes, np.int64), 0, []
    for pattern, n in patterns:
        place = 0
        for c in np.flatnonzero(pattern).tolist():
            slots.append((c, int(used[c]), int(used[c] + n * pattern[c]), base, int(pattern[c]), place))
            used[c] += n * pattern[c]
            place += int(pattern[c])
        base += n
    slot_frame = local_frame(spark, slots, "_slot_class int, _from long, _to long, _base long, _each int, _place int")

    # ranks within (class, salt), then the counts of earlier salts: a large class is in many tasks
    order = Window.partitionBy("_class", "_salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = cut.withColumn("_rank", F.row_number().over(order) - 1).join(
        F.broadcast(local_frame(spark, offsets, "_class int, _salt int, _before long")), ["_class", "_salt"]
    ).withColumn("_rank", F.col("_rank") + F.col("_before"))
    columns = [F.col(c) for c in pieces.columns]
    full = ranked.filter(F.col("_class") == classes).select(*columns, (F.col("_rank") + first_full).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    inside = F.col("_rank") - F.col("_from")
    placed = (
        ranked.filter(F.col("_class") < classes)
        .join(F.broadcast(slot_frame), (F.col("_class") == F.col("_slot_class")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
        .select(*columns, (F.col("_base") + F.floor(inside / F.col("_each"))).alias("sequence_id"), (F.col("_place") + inside % F.col("_each")).alias("_at"))
    )
    earlier = Window.partitionBy("sequence_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select(*columns, "sequence_id", F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"))
    return full.union(placed)


def pack(docs: DataFrame, tokenizer_path: str, layout: Layout = Layout()) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return assign(stored(tokenized(docs, tokenizer_path, layout), "packing-pieces"), layout)
