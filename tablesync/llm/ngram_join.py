"""Near-duplicate join on word n-grams by parity sketches.

A document is the set of its distinct shingles, as 64-bit hashes. Two documents link when their
Jaccard similarity reaches ``num / den``.

Sizes fall into bands so narrow that linked documents are in the same or in neighbouring bands.
Within the pair of bands that ends at band ``k``, linked sets differ in at most ``D_k`` shingles. A
sketch toggles one bit per shingle, so that the Hamming distance of two sketches is at most the size
of the symmetric difference of the sets. The sketch is cut into ``D_k + 1`` parts: differing in at
most ``D_k`` bits, linked documents agree in a whole part (pigeonhole). Documents are joined on
(band, part, bits of the part), and the pairs found are verified on the shingles themselves. A part
has 2**32 bits, so that parts of a single set bit do not agree by chance, and is kept as the exclusive
or of codes of its set bits. Parts without a set bit say little; a few spare parts make it safe to
leave them out, except for a document with more empty parts than spare ones.

No pair is written for every two members of a bucket. Sets that are equal are one vertex. A bucket
becomes a group of vertices named after its smallest member, or after the smallest of the names its
members have in all their groups, where all of that name fit one task. Groups of one name are verified
together in one task (or several, beyond a stated number of shingles, and blockwise beyond a stated
number of members), which compares only vertices that it has not connected yet and returns a
spanning forest of the links. Connected components follow from the forests.

Defined cases: null and empty texts have no shingles and are linked with nothing; fewer words than
the shingle length make one shingle; rows that repeat a text are linked; a null doc_id is a row of
its own text and never the smallest id unless all ids of its component are null.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tablesync.llm.common import (
    byte_texts, connected_components, give_back, mix, sequence_hashes, signed, stored, word_hashes,
)
from tablesync.operators.chunking import fresh_names
from tablesync.session import broadcast_if_small

PART_BITS = np.uint64(0xFFFFFFFF)
NULL_ID = -(1 << 63)
BLOCK = 2048  # members of a bucket compared in one block; larger buckets are pairs of blocks
UNIT_SHINGLES = 1_000_000  # shingles verified in one task, about


@dataclass(frozen=True)
class Threshold:
    words: int = 4
    num: int = 85
    den: int = 100


def shingles(text: bytes, k: int) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    return np.unique(sequence_hashes(h, k) if len(words) >= k else sequence_hashes(h, len(words)) ^ np.uint64(len(words)))


def fingerprint(s: np.ndarray) -> int:
    """Identity of a set: a signed 64-bit hash."""
    h = xxh3_64_intdigest(s.tobytes())
    return h - (1 << 64) if h >= 1 << 63 else h


def next_bound(low: int, t: Threshold) -> int:
    return max(low + 1, low * t.den // t.num + 1)


def bounds(limit: int, t: Threshold) -> list[int]:
    out = [1]
    while out[-1] <= limit:
        out.append(next_bound(out[-1], t))
    out.append(next_bound(out[-1], t))
    return out


def parts(s: np.ndarray, count: int, salt: int) -> np.ndarray:
    """The parts of a set's sketch, each as the exclusive or of its set bits' codes (zero: none)."""
    h = mix(s ^ np.uint64(salt))
    where = ((h >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    out = np.zeros(count, np.uint64)
    np.bitwise_xor.at(out, where.astype(np.int64), mix((h & PART_BITS) + np.uint64(1)))
    return out


@lru_cache(maxsize=None)
def layout(band: int, low: int, top: int, t: Threshold) -> tuple[int, int]:
    """Parts of the sketches of a pair of bands, and how many of them may be empty without notice.

    Sets of at most ``top`` shingles link only if they differ in at most
    (1 - t) / (1 + t) * 2 * top of them. With ``spare`` parts more than pigeonhole needs, linked
    documents agree in more than ``spare`` parts: in one with a set bit, if either has at most
    ``spare`` empty ones.
    """
    need = (t.den - t.num) * 2 * top // (t.den + t.num) + 1
    empty = need * math.exp(-low / need)
    spare = 0 if empty < 0.02 else math.ceil(empty + 3 * math.sqrt(empty))
    return need + spare, spare


def bucket_keys(s: np.ndarray, t: Threshold, edges: list[int]) -> np.ndarray:
    """Hashed (band, part, bits) keys of a set, in its own band and as the smaller side of the next."""
    n = len(s)
    own = bisect_right(edges, n) - 1
    out = []
    for band in (own, own + 1):
        count, spare = layout(band, edges[max(band - 1, 0)], edges[band + 1] - 1, t)
        bits = parts(s, count, 2 * band + 1)
        index = np.arange(count, dtype=np.uint64) + np.uint64(band << 40)
        full = bits != 0
        if count - np.count_nonzero(full) > spare:
            full[:] = True
        out.append(mix(mix(index[full]) ^ bits[full]))
    return signed(np.concatenate(out))


def describe(docs: DataFrame, t: Threshold) -> DataFrame:
    """doc_id, hash of the text, number of shingles and the set's identity (null when there are none)."""

    def run(batches):
        for b in batches:
            sets = [shingles(x, t.words) for x in byte_texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([fingerprint(s) if len(s) else None for s in sets], pa.int64())],
                ["doc_id", "text_key", "n_shingles", "vertex"],
            )

    return docs.select(docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string")).alias("text_key"), docs["text"].cast("string")).mapInArrow(
        run, "doc_id long, text_key long, n_shingles long, vertex long"
    )


def key_mask(rows: int) -> int:
    """Bits of a key that are sent: enough that chance brings together one pair in some hundred rows.

    A key only proposes candidates, so shorter keys cost a little checking and no result.
    """
    return (1 << min(63, math.ceil(math.log2(max(rows, 1) * 256)) + 14)) - 1


def bucketed(docs: DataFrame, t: Threshold, mask: int = (1 << 63) - 1) -> DataFrame:
    """(key, vertex) of every distinct set; copies within a task give their keys once."""

    def run(batches):
        seen: set[int] = set()
        edges = bounds(1 << 10, t)
        for b in batches:
            for text in byte_texts(b.column("text")):
                s = shingles(text, t.words)
                if not len(s):
                    continue
                vertex = fingerprint(s)
                if vertex in seen:
                    continue
                seen.add(vertex)
                if len(s) >= edges[-2]:
                    edges = bounds(2 * len(s), t)
                keys = bucket_keys(s, t, edges) & mask
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), vertex))], ["key", "vertex"])
        give_back()

    return docs.select(docs["text"].cast("string")).filter("text is not null").mapInArrow(run, "key long, vertex long")


def groups(keys: DataFrame) -> DataFrame:
    """Buckets of at least two vertices as rows (name, part, vertex): the smallest vertex names a group.

    Equal groups of a task are written once. A bucket over BLOCK members becomes one group for each
    pair of blocks, so that no group has more than twice that number.
    """

    def run(batches):
        key, vertex = [], []
        for b in batches:
            key.append(b.column("key").to_numpy())
            vertex.append(b.column("vertex").to_numpy())
        if not key:
            return
        key, vertex = np.concatenate(key), np.concatenate(vertex)
        order = np.lexsort((vertex, key))
        key, vertex = key[order], vertex[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (vertex[1:] != vertex[:-1])
        key, vertex = key[new], vertex[new]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(starts[1:], len(key))
        written: set[int] = set()
        out: list[np.ndarray] = []
        size = 0
        for a, z in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            members = vertex[a:z]
            if z - a <= BLOCK:
                chunks = [members]
            else:
                blocks = [members[i : i + BLOCK] for i in range(0, z - a, BLOCK)]
                chunks = [np.concatenate([x, y]) for i, x in enumerate(blocks) for y in blocks[i + 1 :]]
            for chunk in chunks:
                part = fingerprint(chunk)
                if part not in written:
                    written.add(part)
                    out.append(np.stack([np.full(len(chunk), chunk[0]), np.full(len(chunk), part), chunk]))
                    size += len(chunk)
            if size > 100_000:
                yield from rows(out)
                out, size = [], 0
        yield from rows(out)
        del key, vertex, order, out
        give_back()

    def rows(out):
        if out:
            table = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in table], ["name", "part", "vertex"])

    return keys.repartition("key").mapInArrow(run, "name long, part long, vertex long")


def forest(sizes: np.ndarray, sets: list[np.ndarray], members: list[np.ndarray], t: Threshold) -> list[tuple[int, int]]:
    """Links that connect whatever the groups' links connect; vertices are positions in ``sets``."""
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    values = np.concatenate(sets)
    _, code = np.unique(values, return_inverse=True)
    start = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.zeros(int(code.max()) + 1, bool)
    compared: dict[int, set[int]] = {}
    out = []
    for group in sorted(members, key=len):
        for at, x in enumerate(group[:-1]):
            done = compared.setdefault(int(x), set())
            rx = root(int(x))
            rest = [y for y in group[at + 1 :].tolist() if y not in done and root(y) != rx]
            rest = [y for y in rest if t.num * max(sizes[x], sizes[y]) <= t.den * min(sizes[x], sizes[y])]
            if not rest:
                continue
            done.update(rest)
            mine = code[start[x] : start[x + 1]]
            marked[mine] = True
            index = np.concatenate([code[start[y] : start[y + 1]] for y in rest])
            cut = np.concatenate([[0], np.cumsum(sizes[rest])[:-1]])
            common = np.add.reduceat(marked[index].astype(np.int64), cut)
            marked[mine] = False
            union = sizes[x] + sizes[rest] - common
            for y in np.array(rest)[t.den * common >= t.num * union].tolist():
                a, b = root(int(x)), root(y)
                if a != b:
                    parent[b] = a
                    out.append((int(x), y))
    return out


def weights(grouped: DataFrame, holders: DataFrame) -> DataFrame:
    """Shingles of all vertices of each name."""
    return grouped.select("name", "vertex").distinct().join(holders.select("vertex", "n"), "vertex").groupBy("name").agg(F.sum("n").alias("n"))


def gathered(grouped: DataFrame, holders: DataFrame) -> DataFrame:
    """Distinct groups, those that overlap under one name as far as a unit holds them.

    A vertex is in many groups of different smallest members, and its text is sent once for each
    name. A group takes the smallest name that any of its members has, unless the groups of that
    name have more than UNIT_SHINGLES together: they keep their own.
    """
    least = grouped.groupBy("vertex").agg(F.min("name").alias("least"))
    near = grouped.select("part", "vertex").join(least, "vertex").groupBy("part").agg(F.min("least").alias("near"))
    moved = stored(grouped.distinct().join(near, "part"), "ngram-near")
    fits = weights(moved.select(F.col("near").alias("name"), "vertex"), holders).filter(F.col("n") <= UNIT_SHINGLES)
    return moved.join(fits.select(F.col("name").alias("fit")), F.col("near") == F.col("fit"), "left").select(
        F.coalesce("fit", "name").alias("name"), "part", "vertex")


def links(docs: DataFrame, grouped: DataFrame, described: DataFrame, t: Threshold) -> DataFrame:
    """Verified links (a, b) between vertices that connect all linked vertices."""
    spark = docs.sparkSession
    place = F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id"), "text_key")
    holders = described.filter("vertex is not null").groupBy("vertex").agg(F.min(place).alias("place"), F.max("n_shingles").alias("n"))
    grouped = stored(gathered(grouped, holders), "ngram-gathered")
    names = stored(weights(grouped, holders), "ngram-names")
    total = names.agg(F.sum("n")).first()[0] or 0
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / UNIT_SHINGLES))
    part = F.pmod("part", F.ceil(F.col("n") / UNIT_SHINGLES))
    units = stored(
        grouped.join(names, "name")
        .select(F.pmod(F.xxhash64("name", part), F.lit(bins)).cast("int").alias("unit"), "part", "vertex").distinct(),
        "ngram-units",
    )
    homes = units.groupBy("vertex").agg(F.collect_set("unit").alias("units"))  # so a text is shuffled to its units alone
    wanted = homes.join(holders, "vertex").select("vertex", "units", "place._id", "place.text_key")
    text = docs["text"].cast("string")
    texts = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    found = texts.join(broadcast_if_small(wanted), ["_id", "text_key"])
    sent = found.select(F.explode("units").alias("unit"), "vertex", "text")

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        vertex, first = np.unique(left.column("vertex").to_numpy(), return_index=True)
        content = [shingles(x, t.words) for x in byte_texts(left.column("text").take(pa.array(first)).combine_chunks())]
        sizes = np.array([len(s) for s in content], np.int64)
        part, who = right.column("of_part").to_numpy(), right.column("member").to_numpy()
        where = np.searchsorted(vertex, who)
        order = np.lexsort((where, part))
        part, where = part[order], where[order]
        groups = np.split(where, np.flatnonzero(part[1:] != part[:-1]) + 1)
        pairs = forest(sizes, content, groups, t) if len(content) > 1 else []
        a, b = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
        del content, groups
        give_back()
        return pa.table({"a": vertex[a], "b": vertex[b]})

    named = units.select(F.col("unit").alias("of_unit"), F.col("part").alias("of_part"), F.col("vertex").alias("member"))
    return sent.groupBy("unit").cogroup(named.groupBy("of_unit")).applyInArrow(verify, "a long, b long")


def components(docs: DataFrame, t: Threshold = Threshold()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (its own id when linked with nothing)."""
    return classified(docs, t).select("doc_id", "n_shingles", "component_id")


def classified(docs: DataFrame, t: Threshold) -> DataFrame:
    """``components`` with the hash of the text, and that of the text that stands for the component."""
    described = stored(describe(docs, t), "ngram-sets")
    grouped = stored(groups(bucketed(docs, t, key_mask(described.count()))), "ngram-groups")
    edges = links(docs, grouped, described, t)
    linked = connected_components(edges)
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))).alias("least")
    sets = described.filter("vertex is not null").groupBy("vertex").agg(first)
    joined = sets.join(linked, sets["vertex"] == linked["node"], "left").select(
        "vertex", "least", F.coalesce("component", "vertex").alias("class")
    )
    classes = joined.groupBy("class").agg(F.min("least").alias("first"))
    of_vertex = joined.join(classes, "class").select("vertex", F.col("first.doc_id").alias("component_id"), F.col("first.text_key").alias("first_text"))
    with_set = described.filter("vertex is not null").join(of_vertex, "vertex").select("doc_id", "n_shingles", "component_id", "text_key", "first_text")
    return with_set.union(described.filter("vertex is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_key", F.col("text_key").alias("first_text")))


# Rows to drop, of 16 bytes each, that are broadcast; more of them meet the documents by a shuffle.
GONE_ROWS = 2_000_000


def keep_one(docs: DataFrame, t: Threshold = Threshold()) -> DataFrame:
    """One document of each component, that of the smallest id and then text hash, with all its columns.

    A row goes by its id and its text, so another text under the same id is judged by itself. Rows
    without an id stay; rows that repeat the id and the text that stay are that document and stay
    with it.
    """
    other = (F.col("doc_id") != F.col("component_id")) | (F.col("text_key") != F.col("first_text"))
    of, key = fresh_names(docs, "_gone", "_text_key")
    gone = classified(docs, t).filter(F.col("doc_id").isNotNull() & other).select(F.col("doc_id").alias(of), F.col("text_key").alias(key)).distinct()
    gone = broadcast_if_small(stored(gone, "ngram-gone"), GONE_ROWS)
    same = (docs["doc_id"].cast("long") == F.col(of)) & (F.xxhash64(docs["text"].cast("string")) == F.col(key))
    return docs.join(gone, same, "left_anti")
