"""Repeated windows of a fixed length, found through anchors: what phrase and suffix dedup share.

A window is ``length`` consecutive units (words or bytes) of one document. Its anchor is the
smallest hash among its grams of ``gram`` units, so equal windows have equal anchors at equal
places, and consecutive windows mostly share one. A document thus falls into segments, each the run
of windows of one anchor occurrence. Only windows whose anchors agree can be equal, so all work is
grouped by anchor:

1. ``occurrences`` gives one row per segment: anchor, hash of the segment, place. Segments that a
   task saw before are settled there and sent once, so a passage in a third of all documents reaches
   its anchor's group as a row per task.
2. ``resolve`` groups by anchor. Equal segments settle each other. An anchor whose segments differ
   may still share windows; its segments become requests. A short gram recurs by chance the more the larger
   the corpus is, so a rule that is not mutual cuts these segments in halves first (see ``contexts``), and only
   halves whose context recurs are requested, in a group of their own.
3. ``pieces`` reads the requested segments from the texts. A group with very many different
   segments is split: its segments are cut into single windows, routed by the window's own hash.

Covered ranges travel along as rows with tag 0. Documents are identified by (doc_id, hash of the
text); a null doc_id counts as the smallest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import mix, signed, stored, text_column

COVERED, OPEN, SETTLED, HOT = 0, 1, 2, 4  # tags; HOT is added to the other two
CHUNK = 400_000  # segments a task keeps to compare among themselves
NULL_ID = -(1 << 63)

ROW = "key long, segment long, doc_id long, text_key long, low long, span int, at int, tag int"
NAMES = ("key", "segment", "doc_id", "text_key", "low", "span", "at", "tag")
TYPES = (np.int64, np.int64, np.int64, np.int64, np.int64, np.int32, np.int32, np.int32)
CONTEXT = "context"  # of rules that are not mutual: one more column on the way to ``resolve``


@dataclass(frozen=True)
class Windows:
    length: int
    gram: int
    mutual: bool  # True: any other occurrence covers; False: only earlier ones do
    hot: int = 4_000  # different segments of an anchor handled in one group

    @property
    def half(self) -> int:
        """Windows that start fewer units than this before their anchor are in the first half of a segment."""
        return (self.length - self.gram + 2) // 2


# ------------------------------------------------------------ hashing

FACTOR = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(FACTOR), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """FACTOR**i and its inverse for i up to n, modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(2 * len(_powers[0]), n + 1, 1 << 12)
        for i, f in enumerate((FACTOR, INVERSE)):
            factors = np.full(size, f, np.uint64)
            factors[0] = 1
            _powers[i] = np.cumprod(factors, dtype=np.uint64)
    return _powers[0][: n + 1], _powers[1][: n + 1]


class Hashed:
    """Hashes of any range of a sequence of unit codes."""

    def __init__(self, codes: np.ndarray):
        up, self.down = powers(len(codes))
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def runs(self, k: int) -> np.ndarray:
        """All ranges of k units."""
        return (self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k]


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    width, m = 1, v
    while 2 * width <= w:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < w:
        m = np.minimum(m[: len(m) - (w - width)], m[w - width :])
    return m


def segments(codes: np.ndarray, rule: Windows, step: int = 1 << 19) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (anchor hash, segment hash, first window, windows - 1, anchor - first window, contexts)."""
    places = rule.length - rule.gram + 1
    for base in range(0, max(len(codes) - rule.length + 1, 0), step):
        part = codes[base : base + step + rule.length - 1]
        h = Hashed(part)
        grams = mix(h.runs(rule.gram))
        packed = (grams & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(grams), dtype=np.uint64)
        anchor = (sliding_min(packed, places) & np.uint64(0xFFFFF)).astype(np.int64)
        low = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        high = np.append(low[1:], len(anchor)) - 1
        at = anchor[low] - low
        content = mix(h(low, high + rule.length) + mix((at * 4096 + (high - low)).astype(np.uint64)))
        around = np.zeros(len(low), np.uint64) if rule.mutual else contexts(h, anchor[low], at, high - low, rule)
        yield grams[anchor[low]], content, low + base, high - low, at, around


def contexts(h: Hashed, anchor: np.ndarray, at: np.ndarray, span: np.ndarray, rule: Windows) -> np.ndarray:
    """What all windows of either half of a segment contain, as two hashes of 32 bits; 0 for a half without windows.

    Windows that start 0 to ``half - 1`` units before the anchor all hold the same units from the anchor on,
    those that start farther before it the same units around it. Equal windows start equally far before
    their anchor, so they agree in their half and in its context.
    """
    near, far = at - span < rule.half, at >= rule.half
    first = h(np.where(near, anchor, 0), np.where(near, anchor + rule.length - rule.half + 1, 0))
    second = h(np.where(far, anchor - rule.half, 0), np.where(far, anchor + rule.gram, 0))
    return (mix(first) & np.uint64(0xFFFFFFFF00000000)) | (mix(second) >> np.uint64(32))


def halves(rows: list[np.ndarray], rule: Windows) -> list[np.ndarray]:
    """Both halves of each segment as segments whose key is the context."""
    key, segment, doc_id, text_key, low, span, at, tag, around = rows
    out = []
    for far in (False, True):
        some = at >= rule.half if far else at - span < rule.half
        hashed = around[some].view(np.uint64)
        hashed = hashed & np.uint64(0xFFFFFFFF) if far else hashed >> np.uint64(32)
        inner = mix(hashed + np.uint64(int(far) << 32))
        last = at[some] - span[some]  # units the last window starts before the anchor
        start = at[some] if far else np.minimum(at[some], rule.half - 1)
        end = np.maximum(last, rule.half) if far else last
        out.append([signed(mix(key[some].view(np.uint64) ^ inner)), segment[some], doc_id[some], text_key[some],
                    low[some] + at[some] - start, (start - end).astype(np.int32), start.astype(np.int32), tag[some]])
    return [np.concatenate(c) for c in zip(*out, strict=True)]


# ------------------------------------------------------------ settling


def batches_of(columns: list[np.ndarray], names=NAMES, step: int = 100_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), step):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + step]) for c in columns], list(names))


def covered_rows(doc_id, text_key, low, end) -> list[np.ndarray]:
    """Ranges [low, end) of documents, united, as rows."""
    order = np.lexsort((low, text_key, doc_id))
    doc_id, text_key, low, end = doc_id[order], text_key[order], low[order], end[order]
    new_doc = np.ones(len(low), bool)
    new_doc[1:] = (doc_id[1:] != doc_id[:-1]) | (text_key[1:] != text_key[:-1])
    shift = np.cumsum(new_doc).astype(np.int64) << 36
    reach = np.maximum.accumulate(end + shift)
    new = new_doc.copy()
    new[1:] |= low[1:] + shift[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first, len(low))[1:] - 1
    n = len(first)
    return [text_key[first], np.zeros(n, np.int64), doc_id[first], text_key[first], low[first],
            (reach[last] - shift[last] - low[first]).astype(np.int32), np.zeros(n, np.int32), np.full(n, COVERED, np.int32)]


def settle(rows: list[np.ndarray], rule: Windows) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Compares equal segments: rows of the first of each, their group starts by key, covered rows."""
    key, segment, doc_id, text_key, low = rows[:5]
    order = np.lexsort((low, text_key, doc_id, segment, key))
    key, segment, doc_id, text_key, low, span, at, tag, *more = (c[order] for c in rows)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (segment[1:] != segment[:-1])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    if rule.mutual:
        several = np.diff(np.append(first, len(key))) > 1
        covers = several[group] & (tag & SETTLED == 0)
        tag = tag.copy()
        tag[first] = np.where(several, SETTLED, tag[first])
        if len(first) < len(key):
            some = np.zeros(len(first), bool)
            np.logical_or.at(some, group, tag & SETTLED > 0)
            tag[first] = np.where(some, SETTLED, tag[first])
    else:  # rows that repeat a document are the same occurrence
        lead = first[group]
        covers = ~new & ((doc_id != doc_id[lead]) | (text_key != text_key[lead]) | (low != low[lead]))
    covered = covered_rows(doc_id[covers], text_key[covers], low[covers], low[covers] + span[covers] + rule.length)
    kept = [c[first] for c in (key, segment, doc_id, text_key, low, span, at, tag, *more)]
    starts = np.flatnonzero(np.concatenate([[True], kept[0][1:] != kept[0][:-1]])) if len(first) else np.zeros(0, np.int64)
    return kept, starts, covered


def identified(docs: DataFrame) -> DataFrame:
    """doc_id (smallest for null), hash of the text, text."""
    text = text_column(docs)
    return docs.select(
        F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID).cast("long")).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")
    )


def occurrences(docs: DataFrame, codes_of: Callable[[bytes], np.ndarray], rule: Windows) -> DataFrame:
    """One row per segment, equal segments of a task settled and sent once."""
    names, types = (NAMES, TYPES) if rule.mutual else ((*NAMES, CONTEXT), (*TYPES, np.int64))

    def run(batches):
        held, n = [], 0

        def flush():
            rows = [np.concatenate(c).astype(t, copy=False) for c, t in zip(zip(*held, strict=True), types, strict=True)]
            kept, _, covered = settle(rows, rule)
            yield from batches_of(kept, names)
            yield from batches_of(covered if rule.mutual else [*covered, np.zeros(len(covered[0]), np.int64)], names)

        for b in batches:
            texts = b.column("text").cast(pa.binary())
            for doc_id, text_key, text in zip(b.column("doc_id").to_pylist(), b.column("text_key").to_pylist(), texts, strict=True):
                for anchor, content, low, span, at, around in segments(codes_of(text.as_py()), rule):
                    m = len(low)
                    row = (signed(anchor), signed(content), np.full(m, doc_id), np.full(m, text_key), low, span, at, np.full(m, OPEN, np.int32))
                    held.append(row if rule.mutual else (*row, signed(around)))
                    n += m
                if n >= CHUNK:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    return identified(docs).filter(F.octet_length("text") >= rule.length).mapInArrow(run, ROW if rule.mutual else f"{ROW}, {CONTEXT} long")


def gathered(batches, more: tuple[str, ...] = ()) -> list[np.ndarray]:
    """All rows of a task, which Spark bounds by the number of partitions."""
    parts = [[b.column(n).to_numpy(zero_copy_only=False) for n in (*NAMES, *more)] for b in batches]
    types = (*TYPES, *[np.int64 for _ in more])
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate(types)]


def resolve(rows: DataFrame, rule: Windows) -> DataFrame:
    """Covered ranges, and requests for the segments of anchors that have different ones."""

    def run(batches):
        table = gathered(batches, () if rule.mutual else (CONTEXT,))
        done = table[7] == COVERED
        yield from batches_of([c[done] for c in table[: len(NAMES)]])
        kept, starts, covered = settle([c[~done] for c in table], rule)
        yield from batches_of(covered)
        if not len(starts):
            return
        sizes = np.diff(np.append(starts, len(kept[0])))
        wanted = sizes > 1
        if not rule.mutual:
            several = np.repeat(wanted, sizes)
            kept = halves([c[several] for c in kept], rule)
            _, group, many = np.unique(kept[0], return_inverse=True, return_counts=True)
            kept[7] = kept[7] + np.where(many[group] > rule.hot, HOT, 0).astype(np.int32)
            yield from batches_of([c[many[group] > 1] for c in kept])
            return
        wanted &= np.add.reduceat((kept[7] & SETTLED == 0).astype(np.int64), starts) > 0
        chosen = np.repeat(wanted, sizes)
        kept[7] = kept[7] + np.where(np.repeat(sizes > rule.hot, sizes), HOT, 0).astype(np.int32)
        yield from batches_of([c[chosen] for c in kept])

    return rows.repartition("key").mapInArrow(run, ROW)


PIECE = ROW + ", content binary"


def pieces(docs: DataFrame, resolved: DataFrame, rule: Windows, units_of: Callable, codes_of: Callable, cut: Callable) -> DataFrame:
    """The requested segments with their content; covered rows pass through with none.

    ``units_of`` splits a text, ``cut(units, a, b)`` gives the bytes of units a to b, ``codes_of``
    their hashes.
    """
    asked = resolved.filter(F.col("tag") != COVERED).groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("key", "segment", "low", "span", "at", "tag")).alias("asked")
    )
    texts = identified(docs).join(asked, ["doc_id", "text_key"])

    def run(batches):
        held: list[list] = []
        contents: list[bytes] = []

        def flush():
            rows = [np.array(c, t) for c, t in zip(zip(*held, strict=True), TYPES, strict=True)]
            hot = rows[7] & HOT > 0
            plain = np.flatnonzero(~hot)
            yield from with_content([c[plain] for c in rows], [contents[i] for i in plain])
            if hot.any():  # single windows: settle those equal within the task
                at = np.flatnonzero(hot)
                single = [c[at] for c in rows]
                single[1] = at  # remembers the content
                single[7] = single[7] & ~HOT
                order = np.lexsort((single[4], single[3], single[2], single[0]))
                single = [c[order] for c in single]
                number = single[1].copy()
                single[1] = np.zeros(len(at), np.int64)
                kept, _, covered = settle(single, rule)
                which = {(k, d, t, lo): n for k, d, t, lo, n in zip(single[0], single[2], single[3], single[4], number, strict=True)}
                yield from with_content(kept, [contents[which[x]] for x in zip(kept[0], kept[2], kept[3], kept[4], strict=True)])
                yield from with_content(covered, [None] * len(covered[0]))

        size = 0
        for b in batches:
            for doc_id, text_key, text, wishes in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text_key", "text", "asked")), strict=True):
                units = units_of(text.encode())
                h = None
                for w in wishes:
                    if w["tag"] & HOT:
                        h = h or Hashed(codes_of(text.encode()))
                        lows = np.arange(w["low"], w["low"] + w["span"] + 1)
                        for lo, k in zip(lows.tolist(), signed(mix(h(lows, lows + rule.length))).tolist(), strict=True):
                            held.append([k, 0, doc_id, text_key, lo, 0, w["low"] + w["at"] - lo, w["tag"]])
                            contents.append(cut(units, lo, lo + rule.length))
                    else:
                        held.append([w["key"], w["segment"], doc_id, text_key, w["low"], w["span"], w["at"], w["tag"]])
                        contents.append(cut(units, w["low"], w["low"] + w["span"] + rule.length))
                    size += len(contents[-1])
                if size > 1 << 23 or len(held) > 200_000:
                    yield from flush()
                    held, contents, size = [], [], 0
        if held:
            yield from flush()

    def with_content(rows, content, step: int = 20_000):
        for i in range(0, len(content), step):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[i : i + step]) for c in rows] + [pa.array(content[i : i + step], pa.binary())], [*NAMES, "content"]
            )

    return texts.select("doc_id", "text_key", "text", "asked").mapInArrow(run, PIECE)


def ranges(covered: DataFrame, rule: Windows) -> DataFrame:
    """Covered ranges of each document (or text, when occurrences are mutual) as a sorted list."""
    by = ["text_key"] if rule.mutual else ["doc_id", "text_key"]
    each = covered.groupBy(*by, "low").agg(F.max(F.col("low") + F.col("span")).alias("end"))
    return each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("low", "end"))).alias("ranges"))


def covered_mask(n: int, spans: list[dict] | None) -> np.ndarray:
    """Which of n units lie in a range."""
    mask = np.zeros(n, bool)
    for r in spans or ():
        mask[r["low"] : r["end"]] = True
    return mask


def run_stages(docs: DataFrame, rule: Windows, units_of, codes_of, cut, compare: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """Documents (doc_id, text_key, text) with the ranges that repeat; null where there are none."""
    resolved = stored(resolve(occurrences(docs, codes_of, rule), rule), f"{label}-segments")
    found = compare(pieces(docs, resolved, rule, units_of, codes_of, cut))
    covered = resolved.filter(F.col("tag") == COVERED).select("doc_id", "text_key", "low", "span").union(found.select("doc_id", "text_key", "low", "span"))
    spans = ranges(covered, rule)
    texts = identified(docs)
    return texts.join(spans, ["text_key"] if rule.mutual else ["doc_id", "text_key"], "left").select("doc_id", "text_key", "text", "ranges")
