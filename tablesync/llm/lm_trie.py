"""Scores of texts under an n-gram language model kept as an Elias-Fano trie.

The model is interpolated absolute discounting. Words are known by 64-bit hashes. Level 1 holds all
words of the training documents, sorted by hash, with exact counts; a word's position is its rank.
Level k holds the n-grams of k words, all of them unless ``min_count`` is raised, sorted by context (the
position of the first k - 1 words in level k - 1) and rank of the last word. Words are stored
relative to their context, added to the last value of the context before, which makes the sequence
monotone; it and the contexts' pointers are Elias-Fano coded. Probabilities and back-off weights are
one byte each, an index into the 256 values of a codebook. A query finds a context's range through
the pointers and searches the successor of the word within it.

Two passes over the documents count: one the words, the other each pair of words with the word after
it. Tasks count a few million words at a time, and send sorted counts to shards (ranges of hashes, then
of first words), which add them up, prune, and write files to the shared folder. A pair's count is the
sum of its triples' counts, one of them for the pairs that end a text, which no word follows; so both
levels come from one shuffle, and a triple that is kept never lacks its pairs. Probabilities of triples
need pairs of other shards; they are worked out when all pairs are written. Counts and vocabulary cover
all training documents; nothing but one row per shard reaches the driver. Scoring tasks memory-map the files, so ``spark.checkpoint.dir`` must lie on a file system
that executors mount.

The unigram model adds one to each count, unknown words included; a longer context's kept n-grams
give up ``discount`` each, and what they and the pruned ones leave goes to the shorter context.

Defined cases: a null or empty text is one end token; a null doc_id counts as the empty text, so it
is a training document; rows that repeat are counted as often.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tablesync.llm.common import shuffles_dropped, text_column, word_hashes
from tablesync.llm.elias_fano import EliasFano, map_arrays, write_arrays
from tablesync.session import scratch_path

NONE = np.uint64(0xFFFFFFFF)  # in place of a word's rank: no word follows
COUNT_WORDS = 2_000_000  # words counted together in a task
SCORE_WORDS = 800_000  # words scored together in a task


@dataclass(frozen=True)
class Settings:
    order: int = 3
    min_count: int = 1  # of n-grams of two and more words: 1 keeps them all
    discount: float = 0.75
    folds: int = 7
    held_out: int = 2


LOWER = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\v\f\r", bytes(range(97, 123)) + b" " * 5)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the different tokens, each token's place among them, and where each text begins (one more at the end)."""
    data = b" \n".join([*(t.translate(LOWER) for t in texts), b""])
    flat = np.frombuffer(data, np.uint8)
    ends = np.concatenate([[0], np.flatnonzero((flat == 32) | (flat == 10)) + 1])
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
    different, of = pieces.dictionary, pieces.indices.to_numpy()
    words = b"".join(different.to_numpy(zero_copy_only=False)).replace(b"\n", b"\n ").split(b" ")[:-1]  # without what separates them
    if b"" in words:  # nothing between two separators
        of = of[of != words.index(b"")]
    hashes = word_hashes(words)
    starts = np.concatenate([[0], np.flatnonzero(of == words.index(b"\n")) + 1]) if texts else np.zeros(1, np.int64)
    order = np.argsort(hashes)
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    return hashes[order], place[of], starts


def is_held_out(doc_id: int | None, s: Settings) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % s.folds == s.held_out


def local_path(path: str) -> str:
    if path.startswith("file:"):
        return "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        raise ValueError("spark.checkpoint.dir must be on a file system that executors mount: the model is memory-mapped")
    return path


def quantised(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and codebook: 255 evenly spaced values from the least to the greatest, and zero exactly."""
    book = np.zeros(256)
    some = logs[logs < 0]
    if len(some):
        book[:255] = np.linspace(some.min(), some.max(), 255)
    codes = np.searchsorted((book[1:] + book[:-1]) / 2, logs, side="left").astype(np.uint8)
    codes[logs >= 0] = 255
    return codes, book


# ------------------------------------------------------------ the model, mapped


class Model:
    """Levels in ``path``; ``sizes[k]`` has the entries of each shard of level k + 1."""

    def __init__(self, path: str, sizes: list[list[int]], total: int, shards: int):
        self.path, self.total, self.shards = path, total, shards
        self.bounds = [np.concatenate([[0], np.cumsum(s)]) for s in sizes]
        self.vocabulary = int(self.bounds[0][-1]) if sizes else 0
        self.files: dict[tuple[int, int], dict] = {}

    def shard(self, level: int, s: int) -> dict:
        if (level, s) not in self.files:
            a = map_arrays(f"{self.path}/level{level}-{s}")
            if level > 1:
                a |= {"pointers": EliasFano.of(a, "pointers")} | map_arrays(f"{self.path}/log{level}-{s}")
            self.files[level, s] = a | {"words": EliasFano.of(a, "words")}
        return self.files[level, s]

    def context_bounds(self, level: int) -> np.ndarray:
        """First context of each shard of a level; level 2's contexts are ranks, dealt evenly."""
        if level == 2:
            return np.array([s * self.vocabulary // self.shards for s in range(self.shards + 1)])
        return self.bounds[level - 2]

    def parts(self, owner: np.ndarray):
        """(shard, slice) of sorted shard numbers."""
        cut = np.flatnonzero(np.diff(owner)) + 1
        for a, z in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(owner)]]), strict=True):
            if z > a:
                yield int(owner[a]), slice(int(a), int(z))

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of each hash (sorted), -1 when it is not in the training documents."""
        out = np.full(len(hashes), -1)
        for s, part in self.parts(shard_of_hash(hashes, self.shards)):
            if self.bounds[0][s + 1] > self.bounds[0][s]:
                at = self.shard(1, s)["words"].find(hashes[part])
                out[part] = np.where(at >= 0, at + self.bounds[0][s], -1)
        return out

    def column(self, level: int, name: str, entry: np.ndarray) -> np.ndarray:
        """An array of a level's entries (or contexts, for back-off weights) by global position, in rising order."""
        bounds = self.context_bounds(level) if name == "weight" else self.bounds[level - 1]
        owner = np.searchsorted(bounds, entry, side="right") - 1
        out = np.zeros(len(entry), np.float64 if name in ("log", "weight") else np.int64)
        for s, part in self.parts(owner):
            if self.bounds[level - 1][s + 1] == self.bounds[level - 1][s]:  # no file, and contexts of weight 1
                continue
            local = entry[part] - bounds[s]
            a = self.shard(level, s)
            if name in ("log", "weight"):
                out[part] = a[f"{name}_book"][a[name][local]] if len(a[name]) else 0.0
            elif name == "word":
                context = a["pointers"].all().astype(np.int64)
                at = np.searchsorted(context, local, side="right") - 1
                out[part] = (a["words"].access(local) - base_of(a["words"], context[at])).astype(np.int64)
            else:
                out[part] = a[name][local]
        return out

    def find(self, level: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Global position of (context, word) in a level, -1 when absent; sorted by context."""
        bounds = self.context_bounds(level)
        out = np.full(len(context), -1)
        for s, part in self.parts(np.searchsorted(bounds, context, side="right") - 1):
            if self.bounds[level - 1][s + 1] == self.bounds[level - 1][s]:
                continue
            a = self.shard(level, s)
            first = np.flatnonzero(np.diff(context[part], prepend=-1))  # one look-up for each context
            local = context[part][first] - bounds[s]
            lo, hi = (a["pointers"].access(local + i).astype(np.int64) for i in (0, 1))
            base = base_of(a["words"], lo)
            times = np.diff(np.append(first, part.stop - part.start))
            some = np.flatnonzero(np.repeat(hi > lo, times))
            lo, hi, base = (np.repeat(x, times)[some] for x in (lo, hi, base))
            at = a["words"].find(base + word[part][some].astype(np.uint64), lo, hi)
            found = np.full(part.stop - part.start, -1)
            found[some] = np.where(at >= 0, at + self.bounds[level - 1][s], -1)
            out[part] = found
        return out

    def unigram(self, rank: np.ndarray) -> np.ndarray:
        """log10 of the add-one probability by rank, in rising order but for -1, an unknown word."""
        count = np.zeros(len(rank), np.int64)
        known = rank >= 0
        count[known] = self.column(1, "count", rank[known])
        return np.log10((count + 1) / (self.total + self.vocabulary + 1)), count


def base_of(words: EliasFano, first: np.ndarray) -> np.ndarray:
    """What a context that begins at position ``first`` adds to its words."""
    out = np.zeros(len(first), np.uint64)
    later = first > 0
    out[later] = words.access(first[later] - 1) + np.uint64(1)
    return out


def shard_of_hash(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


_models: dict[str, Model] = {}


def model_of(path: str, sizes: list[list[int]], total: int, shards: int) -> Model:
    """One mapping per worker process, model and number of levels."""
    key = f"{path}/{len(sizes)}"
    if key not in _models:
        _models.clear()
        _models[key] = Model(path, sizes, total, shards)
    return _models[key]


# ------------------------------------------------------------ positions of a batch's tokens in the levels


def entries(model: Model, hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray, levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For levels 1 to ``levels``, the different entries, rising but for -1, and each token's place among them:
    the entry of the n-gram that ends there. Beyond level 1 the last one is -1, for tokens too near to a text's beginning."""
    ranks = model.ranks(hashes)
    out = [(ranks, codes)]
    n = len(codes)
    word = ranks[codes]
    place = np.arange(n) - np.repeat(starts[:-1], np.diff(starts))
    for k in range(2, levels + 1):
        found, of = out[-1]
        context = np.full(n, -1)
        context[1:] = found[of[:-1]]
        here = np.flatnonzero((place >= k - 1) & (context >= 0) & (word >= 0))
        pair, at = np.unique((context[here].astype(np.uint64) << np.uint64(32)) | word[here].astype(np.uint64), return_inverse=True)
        found = model.find(k, (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64))
        of = np.full(n, len(pair))
        of[here] = at
        out.append((np.append(found, -1), of))
    return out


def by_entry(model: Model, level: int, name: str, entry: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A column for each token, 0 without an entry, and whether there is one."""
    has = entry >= 0
    value = np.zeros(len(entry))
    value[has] = model.column(level, name, entry[has])
    return value[of], has[of]


def grouped_texts(batches, words: int):
    """(doc_ids, texts) with about ``words`` words together."""
    ids, texts, size = [], [], 0
    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if size >= 6 * words:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


# ------------------------------------------------------------ counting and building

BLOCK = "shard int, context binary, word binary, n binary"
BUILT = "shard int, entries long, more long"


def blocks(owner: np.ndarray, context: np.ndarray, word: np.ndarray, n: np.ndarray):
    """A row per shard, of counts sorted by context and word; contexts as differences."""
    cut = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]])
    for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if z > a:
            steps = np.diff(context[a:z], prepend=context.dtype.type(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(owner[a])], pa.int32()), *[pa.array([planes(x)], pa.binary()) for x in (steps, word[a:z], n[a:z])]],
                ["shard", "context", "word", "n"],
            )


def planes(x: np.ndarray) -> bytes:
    """The values' first bytes, then their second ones and so on: bytes that are mostly zero lie together, and
    what Spark compresses a shuffle with makes nothing of them."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, words and counts of all blocks, added up and sorted."""
    column = lambda name, t: [from_planes(x, t) for x in table.column(name).to_pylist()]
    context = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in column("context", np.uint64)])
    word, n = np.concatenate(column("word", np.uint32)), np.concatenate(column("n", np.uint32)).astype(np.int64)
    if not word.any():  # level 1 has hashes and no words
        key = context
    elif context.max() < 1 << 32:
        key = (context << np.uint64(32)) | word
    else:
        of = np.unique(context, return_inverse=True)[1]
        key = (of.astype(np.uint64) << np.uint64(32)) | word
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    at = order[first]
    return context[at], word[at], np.add.reduceat(n[order], first)


def built(rows: DataFrame, build, shards: int) -> tuple[list[int], list[int]]:
    """Entries of each shard, and the other number it tells."""
    sizes, more = [0] * shards, [0] * shards
    with shuffles_dropped(rows.sparkSession):  # blocks go before the next step
        found = rows.groupBy("shard").applyInArrow(build, BUILT).collect()
    for s, n, m in found:
        sizes[s], more[s] = n, m
    return sizes, more


def told(shard: int, entries: int, more: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([entries]), pa.array([more])], ["shard", "entries", "more"])


def least(n: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as hold them."""
    return n.astype(np.min_scalar_type(n.max(initial=0)))


def first_level(docs: DataFrame, path: str, shards: int, s: Settings) -> tuple[list[int], int]:
    """Entries of each shard of the words' level, and the number of training tokens."""

    def count(batches):
        for ids, texts in grouped_texts(batches, COUNT_WORDS):
            words, codes, _ = tokens([t for d, t in zip(ids, texts, strict=True) if not is_held_out(d, s)])
            n = np.bincount(codes, minlength=len(words))
            words, n = words[n > 0], n[n > 0]
            yield from blocks(shard_of_hash(words, shards), words, np.zeros(len(words), np.uint32), n.astype(np.uint32))

    def build(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        words, _, n = merged(table)
        coded = {f"words.{k}": v for k, v in EliasFano.arrays(words, (1 << 64) - 1).items()}
        write_arrays(f"{path}/level1-{shard}", coded | {"count": least(n)})
        return pa.Table.from_batches([told(shard, len(words), int(n.sum()))])

    sizes, counts = built(docs.mapInArrow(count, BLOCK), build, shards)
    return sizes, sum(counts)


def longer_levels(docs: DataFrame, path: str, first: list[int], total: int, shards: int, s: Settings) -> tuple[list[int], list[int]]:
    """Entries of each shard of the pairs' level and of the triples' one, of which the probabilities are still missing."""

    def count(batches):
        model = model_of(path, [first], total, shards)
        bounds = model.context_bounds(2)
        for ids, texts in grouped_texts(batches, COUNT_WORDS):
            words, codes, starts = tokens([t for d, t in zip(ids, texts, strict=True) if not is_held_out(d, s)])
            rank = model.ranks(words)[codes].astype(np.uint64)
            after = np.full(len(rank), NONE)
            if s.order > 2:
                after[:-1] = rank[1:]
                after[starts[1:] - 1] = NONE
            inner = np.ones(len(rank), bool)
            inner[starts[:-1]] = False
            here = np.flatnonzero(inner)
            pair, of = np.unique((rank[here - 1] << np.uint64(32)) | rank[here], return_inverse=True)
            key, n = np.unique((of.astype(np.uint64) << np.uint64(32)) | after[here], return_counts=True)
            context = pair[(key >> np.uint64(32)).astype(np.int64)]
            owner = np.searchsorted(bounds, (context >> np.uint64(32)).astype(np.int64), side="right") - 1
            yield from blocks(owner, context, (key & NONE).astype(np.uint32), n.astype(np.uint32))

    def build(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        model = model_of(path, [first], total, shards)
        begin, end = (int(x) for x in model.context_bounds(2)[shard : shard + 2])
        pair, after, n = merged(table)
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        pairs, times = pair[new], np.add.reduceat(n, np.flatnonzero(new))
        kept = times >= s.min_count
        place = (np.cumsum(kept) - 1)[np.cumsum(new) - 1]  # of each triple's pair among those that are kept
        pairs, times = pairs[kept], times[kept]
        context, word = (pairs >> np.uint64(32)).astype(np.int64), (pairs & NONE).astype(np.int64)
        write_arrays(f"{path}/level2-{shard}", trie(context - begin, end - begin, word, times))
        write_arrays(f"{path}/log2-{shard}", logs(model, 2, begin, end, context, word, times, s))
        triple = (after != NONE) & (n >= s.min_count)
        if s.order > 2:
            write_arrays(f"{path}/level3-{shard}", trie(place[triple], len(pairs), after[triple].astype(np.int64), n[triple]))
        return pa.Table.from_batches([told(shard, len(pairs), int(triple.sum()))])

    return built(docs.mapInArrow(count, BLOCK), build, shards)


def triples_weighed(spark: SparkSession, path: str, sizes: list[list[int]], triples: list[int], total: int, shards: int, s: Settings) -> None:
    """Writes the probabilities and weights of each shard of triples."""

    def weigh(batches):
        for shard in (x for b in batches for x in b.column("id").to_pylist()):
            if not triples[shard]:
                continue
            model = model_of(path, sizes, total, shards)
            begin, end = (int(x) for x in model.context_bounds(3)[shard : shard + 2])
            a = map_arrays(f"{path}/level3-{shard}")
            values, pointers = (EliasFano.of(a, name).all().astype(np.int64) for name in ("words", "pointers"))
            base = np.where(pointers[:-1] > 0, values[pointers[:-1] - 1] + 1, 0)
            times = np.diff(pointers)
            write_arrays(f"{path}/log3-{shard}", logs(model, 3, begin, end, np.repeat(np.arange(begin, end), times),
                                                      values - np.repeat(base, times), a["count"].astype(np.int64), s))
            yield told(shard, len(values), 0)

    spark.range(0, shards, 1, shards).mapInArrow(weigh, BUILT).collect()


def trie(local: np.ndarray, contexts: int, word: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """A shard's n-grams, sorted by context (its place in the shard) and word."""
    pointers = np.searchsorted(local, np.arange(contexts + 1), side="left")
    begins = np.flatnonzero(np.concatenate([[True], local[1:] != local[:-1]])) if len(local) else np.zeros(0, np.int64)
    last = np.append(begins[1:], len(local)) - 1 if len(local) else begins
    base = np.concatenate([[0], np.cumsum(word[last] + 1)[:-1]]) if len(local) else np.zeros(0, np.int64)
    values = word + np.repeat(base, np.diff(np.append(begins, len(local)))) if len(local) else word
    out = {f"words.{k}": v for k, v in EliasFano.arrays(values, int(values[-1]) + 1 if len(values) else 1).items()}
    out |= {f"pointers.{k}": v for k, v in EliasFano.arrays(pointers, len(word) + 1).items()}
    return out | {"count": least(n)}


def logs(model: Model, level: int, begin: int, end: int, context: np.ndarray, word: np.ndarray, n: np.ndarray, s: Settings) -> dict[str, np.ndarray]:
    """Probabilities of a shard's n-grams, and back-off weights of its contexts, ``begin`` to ``end``; the level below is in the model."""
    used, of = np.unique(context, return_inverse=True)
    whole = model.column(level - 1, "count", used)
    share = (n - s.discount) / whole[of]
    left = 1 - np.bincount(of, share, len(used))
    if level == 2:
        last, which = np.unique(word, return_inverse=True)
        lower = model.unigram(last)[0][which]
    else:
        shorter = model.column(level - 1, "word", used)[of]
        pair, which = np.unique((shorter.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64), return_inverse=True)
        lower = shorter_log(model, level - 1, (pair >> np.uint64(32)).astype(np.int64), (pair & NONE).astype(np.int64))[which]
    log = np.log10(share + left[of] * 10**lower)
    weight = np.zeros(end - begin)
    weight[used - begin] = np.log10(np.maximum(left, 1e-12))
    out = {}
    out["log"], out["log_book"] = quantised(log)
    out["weight"], out["weight_book"] = quantised(weight)
    return out


def shorter_log(model: Model, level: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """log10 probability of words after contexts of level 2, in rising order of both: stored, or by the unigram model."""
    found = model.find(level, context, word)
    out, has, none = np.zeros(len(word)), np.flatnonzero(found >= 0), np.flatnonzero(found < 0)
    out[has] = model.column(level, "log", found[has])
    if len(none):
        last, of = np.unique(word[none], return_inverse=True)
        out[none] = model.column(level, "weight", context[none]) + model.unigram(last)[0][of]
    return out


def fit(docs: DataFrame, s: Settings = Settings()) -> tuple[str, list[list[int]], int, int]:
    """Writes the model of the training documents; returns its folder, sizes, words and shards."""
    if s.order not in (1, 2, 3):
        raise ValueError("order must be 1, 2 or 3")
    spark = docs.sparkSession
    path = local_path(scratch_path(spark, "lm"))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = readable(docs)
    first, total = first_level(rows, path, shards, s)
    sizes = [first]
    if s.order > 1:
        refused(first, 1)
        second, third = longer_levels(rows, path, first, total, shards, s)
        sizes.append(second)
        if s.order > 2:
            refused(second, 2)
            triples_weighed(spark, path, sizes, third, total, shards, s)
            sizes = [*sizes, third]
    return path, sizes, total, shards


def refused(sizes: list[int], words: int) -> None:
    if sum(sizes) >= 1 << 32:  # an entry's place takes half of a 64-bit key in the next level
        raise ValueError(f"more than 2**32 n-grams of {words} words below a longer one")


def readable(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_column(docs).alias("text"))


def scored(docs: DataFrame, fitted: tuple[str, list[list[int]], int, int], s: Settings = Settings()) -> DataFrame:
    """One row per document: fold, tokens, known tokens, unigram and model log10 probability."""

    def run(batches):
        model = model_of(*fitted)
        for ids, texts in grouped_texts(batches, SCORE_WORDS):
            words, codes, starts = tokens(texts)
            at = entries(model, words, codes, starts, s.order)
            base, counts = model.unigram(at[0][0])
            base, known = base[codes], (counts > 0)[codes]
            log = base.copy()
            for k in range(2, s.order + 1):
                # a context's place in level k - 1 is its entry there, and its weight is stored with level k
                weight, _ = by_entry(model, k, "weight", *at[k - 2])
                weight[starts[1:] - 1] = 0  # what ends a text is no context of the next
                log[1:] += weight[:-1]
                stored, has = by_entry(model, k, "log", *at[k - 1])
                log = np.where(has, stored, log)
            sums = lambda x: np.add.reduceat(x, starts[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([is_held_out(d, s) for d in ids]), pa.array(np.diff(starts)),
                 pa.array(sums(known.astype(np.int64))), pa.array(np.full(len(ids), model.total, np.int64)),
                 pa.array(sums(base)), pa.array(sums(log))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return readable(docs).mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def score(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Fits on the training fold and scores every document."""
    return scored(docs, fit(docs, s), s)

