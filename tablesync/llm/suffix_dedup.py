"""Exact substring removal over a sparse suffix array.

Every byte covered by a ``length``-byte string that also starts earlier is removed: earlier means a
smaller doc_id, or an earlier start in the same document. Strings are judged on the input, overlaps
count, and matches never cross documents.

Sorting every suffix of the corpus would shuffle many times its size. Equal strings have equal
anchors at equal places (see ``repeats``), so the suffixes that start at anchors are enough, and of
these only the ones whose anchor recurs with different surroundings of which more than half a string's
bytes agree. Spark samples splitters and range-partitions these suffixes by their leading tokens (the
anchor's bytes) and those surroundings; equal ones never straddle a boundary, so what has to be compared
across buckets is only surroundings too frequent for one bucket, and their suffixes are cut into single
strings that are routed by their whole content. A bucket sorts its suffixes by multikey quicksort, eight bytes at a time, keeping the
common prefix of neighbours. Two strings that start ``o`` bytes before their anchors are equal when
the suffixes share ``length - o`` bytes, which is a run in the sorted order, and the ``o`` bytes
before the anchors agree.

Defined cases: a null or empty text has no bytes; rows that repeat doc_id and text are one document
(none is earlier than the other); texts that share a doc_id are ordered by the hash of their text; a
null doc_id is smaller than all others.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import mix, stored
from tablesync.llm.repeats import (
    COVERED, NAMES, NULL_ID, ROW, Windows, batches_of, covered_mask, covered_rows, powers, run_stages,
)

CODES = mix(np.arange(1, 257, dtype=np.uint64))


def rule_of(length: int) -> Windows:
    return Windows(length, min(16, length), mutual=False)


def codes_of(text: bytes) -> np.ndarray:
    return CODES[np.frombuffer(text, np.uint8)]


def byte_matrix(parts: list[bytes], width: int) -> np.ndarray:
    """One row of ``width`` bytes per part, cut or filled with zeros."""
    return np.frombuffer(b"".join(p[:width].ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Sorted order of rows by their columns: ties of the columns so far are sorted by the next one."""
    order = np.argsort(words[:, 0], kind="stable")
    tied = np.flatnonzero(np.concatenate([[False], words[order][1:, 0] == words[order][:-1, 0]]))
    same = np.zeros(len(order), bool)
    same[tied] = True
    for d in range(1, words.shape[1]):
        inside = same.copy()
        inside[:-1] |= same[1:]
        at = np.flatnonzero(inside)
        if not len(at):
            break
        group = np.cumsum(~same)[at]
        order[at] = order[at][np.lexsort((words[order[at], d], group))]
        same[1:] &= words[order[1:], d] == words[order[:-1], d]
    return order


def common_prefixes(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes each row of the order shares with the one before it."""
    out = np.zeros(len(order), np.int64)
    differ = words[order[1:]] ^ words[order[:-1]]
    column = np.argmax(differ != 0, axis=1)
    first = differ[np.arange(len(differ)), column]
    byte = np.argmax(first[:, None] >= (np.uint64(1) << np.arange(56, -8, -8, dtype=np.uint64))[None, :], axis=1)
    out[1:] = np.where(first == 0, 8 * words.shape[1], 8 * column + byte)
    return out


def earlier_windows(rows: list[np.ndarray], content: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``rows`` and window starts of all windows that also start earlier."""
    _, _, doc_id, text_key, low, span, at, _ = rows
    width = -(-length // 8) * 8
    right = byte_matrix([c[a:] for c, a in zip(content, at.tolist(), strict=True)], width).view(">u8").astype(np.uint64)
    most = int(at.max())
    left = byte_matrix([c[:a][::-1] for c, a in zip(content, at.tolist(), strict=True)], max(most, 1))
    order = multikey_order(right)
    shared = common_prefixes(right, order)
    rank = np.empty(len(order), np.int64)
    place = np.lexsort((low, text_key, doc_id))
    new = np.ones(len(order), bool)
    new[1:] = (doc_id[place][1:] != doc_id[place][:-1]) | (text_key[place][1:] != text_key[place][:-1]) | (low[place][1:] != low[place][:-1])
    rank[place] = np.cumsum(new)
    before, factors = np.zeros(len(order), np.uint64), powers(most + 1)[0]
    who, where = [], []
    for o in range(most + 1):
        if o:
            before = before + CODES[left[:, o - 1]] * factors[o]
        member = (at - span <= o) & (o <= at)
        run = np.cumsum(shared < length - o)
        mine = order[member[order]]
        if len(mine) < 2:
            continue
        key = mix(run[member[order]].astype(np.uint64)) ^ mix(before[mine])
        _, code, many = np.unique(key, return_inverse=True, return_counts=True)
        some = many[code] > 1
        mine, code = mine[some], code[some]
        if not len(mine):
            continue
        least = np.full(len(many), np.iinfo(np.int64).max)
        np.minimum.at(least, code, rank[mine])
        late = mine[rank[mine] > least[code]]
        who.append(late)
        where.append(low[late] + at[late] - o)
    return (np.concatenate(who), np.concatenate(where)) if who else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def compare(pieces: DataFrame, rule: Windows) -> DataFrame:
    """Covered rows from the requested suffixes, bucket by bucket."""
    kept = stored(pieces, "suffixes")
    lead = F.substring("content", F.col("at") + 1, F.lit(rule.gram))
    buckets = kept.filter(F.col("tag") != COVERED).withColumn("_lead", lead).repartitionByRange("_lead", "key").drop("_lead")

    def run(batches):
        tables = [pa.Table.from_batches([b]) for b in batches]
        if not tables:
            return
        table = pa.concat_tables(tables)
        rows = [table.column(n).to_numpy() for n in NAMES]
        # the rows of one leading token stay together; a part of the bucket is compared at a time
        order = np.argsort(rows[0], kind="stable")
        rows = [c[order] for c in rows]
        starts = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))
        content = table.column("content").take(pa.array(order)).to_pylist()
        ends = np.append(starts[1:], len(order))
        cut = [0]
        for e in ends.tolist():
            if e - cut[-1] >= 50_000:
                cut.append(e)
        if cut[-1] < len(order):
            cut.append(len(order))
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            part = [c[a:z] for c in rows]
            who, where = earlier_windows(part, content[a:z], rule.length)
            if len(who):
                yield from batches_of(covered_rows(part[2][who], part[3][who], where, where + rule.length))

    return kept.filter(F.col("tag") == COVERED).drop("content").union(buckets.mapInArrow(run, ROW))


def removed(docs: DataFrame, length: int = 100) -> DataFrame:
    """One row per document: bytes, bytes and runs removed, digest of the rest."""
    rule = rule_of(length)
    texts = run_stages(docs, rule, lambda t: t, codes_of, lambda t, a, b: t[a:b], lambda p: compare(p, rule), "suffix")

    def run(batches):
        for b in batches:
            out = []
            for doc_id, text, spans in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("ranges").to_pylist(), strict=True):
                mask = covered_mask(len(text), spans)
                runs = int(np.count_nonzero(np.diff(mask.astype(np.int8), prepend=0) == 1))
                rest = np.frombuffer(text, np.uint8)[~mask].tobytes() if runs else text
                out.append((None if doc_id == NULL_ID else doc_id, len(text), int(mask.sum()), runs, sha256(rest).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
