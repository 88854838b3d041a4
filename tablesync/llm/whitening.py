"""Whitening of embeddings by spectral divide and conquer on their covariance.

The vectors are rounded to whole numbers and their distinct values form the fit list, written once
to the shared folder. Two passes over it give the sums, exact, and the centred covariance: every task
adds up one matrix, and matrices are added in rounds of ever fewer tasks, so that no task and not the
driver holds more than a few of them, however many rows or tasks there are. The eigenvectors come
from dynamically weighted Halley iterations in QR form: the polar factor of the covariance less a
shift is +1 on the eigenspace above the shift and -1 below it, half of its sum with the identity
projects on the upper one, and both invariant subspaces are split again, the upper first, until the
components wanted stand alone. What is broadcast is the mean and those components: its size is
the number of dimensions times the number of components, whatever the number of rows.

Defined cases: null vectors and vectors with null or non-finite entries are dropped; a vector shorter
than the longest is continued with zeros, an empty one is all zeros; rows that repeat a vec_id, and
rows without one, stay rows; components without variance (rounding of the trace) are left out, so
a table of one distinct vector has no rows, nor has an empty one; a deviation beyond 64 bits is null;
other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import give_back, stored

SCALE = 256
MOST_DIMENSIONS = 8_192  # a task holds matrices of this many rows and columns
ADDED_TOGETHER = 16  # matrices a task adds up


# ------------------------------------------------------------ polar decomposition


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Unitary polar factor of a symmetric matrix by dynamically weighted Halley iterations."""
    d = len(a)
    size = np.linalg.norm(a, 2)
    if size == 0:
        return np.eye(d)
    x = a / size
    low = max(1 / (np.sqrt(d) * np.linalg.norm(np.linalg.pinv(x), 1)), 1e-16) * 0.9
    for _ in range(60):
        c2 = low * low
        e = (4 * (1 - c2) / (c2 * c2)) ** (1 / 3)
        root = np.sqrt(1 + e)
        f = root + 0.5 * np.sqrt(max(8 - 4 * e + 8 * (2 - c2) / (c2 * root), 0.0))
        g = (f - 1) ** 2 / 4
        h = f + g - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(h) * x, np.eye(d)]))
        new = (g / h) * x + (1 / np.sqrt(h)) * (f - g / h) * (q[:d] @ q[d:].T)
        new = (new + new.T) / 2
        low = min(low * (f + g * c2) / (1 + h * c2), 1.0)
        moved = np.linalg.norm(new - x)
        x = new
        if moved < 1e-15 * d and 1 - low < 1e-12:
            break
        if low >= 1 - 1e-15:
            low = 1 - 1e-15
    return x


def halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below a shift; None where nothing can be split."""
    d = len(a)
    size = np.linalg.norm(a)
    spread = np.linalg.norm(a - np.trace(a) / d * np.eye(d))
    if d == 1 or spread <= 4 * np.finfo(float).eps * d * size:
        return None
    values = np.sort(np.diag(a))
    rng = np.random.default_rng(0)
    shifts = [np.median(values), np.trace(a) / d, values[0] + 0.75 * np.ptp(values), values[0] + 0.25 * np.ptp(values)]
    shifts += [np.trace(a) / d + s * spread / np.sqrt(d) for s in (0.5, -0.5, 0.9, -0.9, 0.1, -0.1, 0.01, -0.01)]
    best = None
    for shift in shifts:
        upper = (polar_factor(a - shift * np.eye(d)) + np.eye(d)) / 2
        rank = int(round(np.trace(upper)))
        if not 0 < rank < d:
            continue
        # a basis of the projector's range, and what is orthogonal to it; a second turn sharpens it
        sample = upper @ rng.standard_normal((d, rank))
        sample = upper @ np.linalg.qr(sample)[0]
        q, _ = np.linalg.qr(sample, mode="complete")
        rest = np.linalg.norm(q[:, :rank].T @ a @ q[:, rank:])
        if best is None or rest < best[0]:
            best = (rest, q[:, :rank], q[:, rank:])
        if rest <= 32 * np.finfo(float).eps * d * size:
            break
    return None if best is None or best[0] > 1e-8 * size else (best[1], best[2])


def components(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of the first ``wanted`` components."""
    d = len(v)
    found: list[tuple[float, np.ndarray]] = []
    todo = [np.eye(d)]  # bases of invariant subspaces, the lowest first
    while todo and len(found) < wanted:
        basis = todo.pop()
        a = basis.T @ v @ basis
        split = halves((a + a.T) / 2)
        if split is None:
            # a space on which the covariance is a multiple of the identity: any basis will do
            for column in basis.T:
                column = column / np.linalg.norm(column)
                found.append((float(column @ v @ column), column))
            continue
        todo += [basis @ split[1], basis @ split[0]]
    found.sort(key=lambda f: -f[0])
    found = found[:wanted]
    return np.array([e for e, _ in found]), np.array([c for _, c in found]).reshape(len(found), d).T


# ------------------------------------------------------------ the fit list


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in the least number of bytes each, trailing zeros left out; equal vectors pack alike."""
    x = np.trim_zeros(x, "b")
    for kind in (np.int8, np.int16, np.int32):
        if not len(x) or (np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max):
            return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()
    return bytes([8]) + x.tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<i{b[0]}", offset=1).astype(np.int64)


def matrix(keys: list[bytes], d: int) -> np.ndarray:
    out = np.zeros((len(keys), d), np.int64)
    for i, k in enumerate(keys):
        x = unpacked(k)
        out[i, : len(x)] = x
    return out


def whole_vectors(column: pa.Array) -> list[bytes | None]:
    """The packed vector of each row; None where it is dropped."""
    out: list[bytes | None] = []
    for vector in column:
        values = vector.values
        if values is None or values.null_count:
            out.append(None)
            continue
        c = values.to_numpy(zero_copy_only=False).astype(np.float64)
        if not np.isfinite(c).all():
            out.append(None)
            continue
        with np.errstate(over="ignore"):
            scaled = np.floor(SCALE * c)
        out.append(packed(np.clip(scaled, -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64)))
    return out


def keyed(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and the packed vector ``key`` of the rows that remain."""
    schema = pa.schema([("vec_id", pa.int64()), ("key", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys = pa.array(whole_vectors(part.column("embedding")), pa.binary())
            rows = pa.RecordBatch.from_arrays([part.column("vec_id"), keys], schema=schema)
            yield rows.filter(keys.is_valid())

    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, key binary")


def _added(partial: DataFrame, d: int) -> np.ndarray | None:
    """Sum of the matrices of a frame, one row each, in rounds of ever fewer tasks."""
    spark = partial.sparkSession
    schema = pa.schema([("slot", pa.int64()), ("m", pa.binary())])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, slot = None, 0
        for part in parts:
            for slot, m in zip(part.column("slot").to_pylist(), part.column("m"), strict=True):
                m = np.frombuffer(m.as_buffer(), np.float64)
                total = m.copy() if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([slot // ADDED_TOGETHER]), pa.array([total.tobytes()], pa.binary())], schema=schema)

    current = stored(partial, "matrices")
    while True:
        n = current.count()
        if n <= ADDED_TOGETHER:
            total = None
            for row in current.orderBy("slot").toLocalIterator():
                m = np.frombuffer(row["m"], np.float64)
                total = m.copy() if total is None else total + m
            return total
        tasks = -(-n // ADDED_TOGETHER)
        numbered = current.repartitionByRange(tasks, "slot")
        current = stored(numbered.mapInArrow(add, "slot long, m binary"), "matrices")


def _sums_of(fit: DataFrame, d: int, task) -> np.ndarray | None:
    """One flat matrix per task, by ``task`` from blocks of the fit list, added up."""
    schema = pa.schema([("slot", pa.int64()), ("m", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for part in parts:
            keys = part.column("key").to_pylist()
            for at in range(0, len(keys), 4096):
                m = task(matrix(keys[at : at + 4096], d))
                total = m if total is None else total + m
        give_back()
        if total is not None:
            slot = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([slot]), pa.array([total.astype(np.float64).tobytes()], pa.binary())], schema=schema)

    return _added(fit.mapInArrow(run, "slot long, m binary"), d)


@dataclass(frozen=True)
class Model:
    """Whitening of the vectors of ``d`` dimensions."""

    n: int
    sums: tuple[int, ...]
    basis: np.ndarray  # d x components
    variance: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.basis / np.sqrt(self.variance)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2 per row, exact; None beyond 64 bits."""
        most = max([abs(s) for s in self.sums] + [self.n * int(v) for v in (abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))])
        if len(self.sums) * (2 * most) ** 2 < 1 << 63:
            away = self.n * x - np.array(self.sums, np.int64)
            return (away * away).sum(axis=1).tolist()
        out = []
        for row in x.tolist():
            total = sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True))
            out.append(total if total < 1 << 63 else None)
        return out


def exact_sums(fit: DataFrame, d: int) -> tuple[int, ...]:
    """Sum of each dimension; tasks add in Python's whole numbers, Spark adds the tasks' sums in decimals."""
    schema = pa.schema([("i", pa.int32()), ("s", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for part in parts:
            keys = part.column("key").to_pylist()
            for at in range(0, len(keys), 4096):
                x = matrix(keys[at : at + 4096], d)
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                total = [t + (int(h) << 32) + int(w) for t, h, w in zip(total, high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([str(t) for t in total])], schema=schema)

    rows = fit.mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    found = {r["i"]: int(r["s"]) for r in rows}
    return tuple(found.get(i, 0) for i in range(d))


def fit(keys: DataFrame, wanted: int = 4) -> Model | None:
    """The model of packed vectors (column ``key``); None without a component of any variance."""
    distinct = stored(keys.select("key").distinct(), "fit-list")
    size = F.octet_length("key") - 1
    width = F.ascii(F.substring(F.hex(F.substring("key", 1, 1)), 2, 1)) - F.lit(ord("0"))
    facts = distinct.agg(F.count("*").alias("n"), F.max((size / width).cast("long")).alias("d")).first()
    n, d = facts["n"], facts["d"] or 0
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions, more than {MOST_DIMENSIONS}")
    if not n or not d:
        return None
    sums = exact_sums(distinct, d)
    mean = np.array([s / n for s in sums])

    def scatter(x: np.ndarray) -> np.ndarray:
        away = x - mean
        return (away.T @ away).ravel()

    v = _sums_of(distinct, d, scatter).reshape(d, d) / n
    v = (v + v.T) / 2
    variance, basis = components(v, wanted)
    some = variance > 64 * d * np.finfo(float).eps * max(np.trace(v), 0)
    if not some.any():
        return None
    model = Model(n, sums, basis[:, some], variance[some], float(np.trace(v)))
    k = int(some.sum())

    def moments(x: np.ndarray) -> np.ndarray:
        w = model.whitened(x)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    m = _sums_of(distinct, d, moments) / n
    covariance = m[k:].reshape(k, k) - np.outer(m[:k], m[:k])
    return Model(n, sums, model.basis, model.variance, model.trace, float(np.abs(covariance - np.eye(k)).max()))


WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, wanted: int = 4) -> DataFrame:
    """One row per remaining row and component: see ``WHITE``."""
    spark = vectors.sparkSession
    rows = keyed(vectors)
    model = fit(rows, wanted)
    if model is None:
        return spark.createDataFrame([], WHITE)
    shared = spark.sparkContext.broadcast(model)
    schema = pa.schema([
        ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()),
    ])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        d, k = len(m.sums), len(m.variance)
        for part in parts:
            keys = part.column("key").to_pylist()
            for at in range(0, len(keys), 4096):
                x = matrix(keys[at : at + 4096], d)
                names = part.column("vec_id")[at : at + 4096]
                rows = len(x)
                deviation = pa.array(m.deviation(x), pa.int64())
                repeated = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays([
                    names.take(repeated), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, m.n, np.int64)), deviation.take(repeated),
                    pa.array(m.whitened(x).ravel()), pa.array(np.tile(m.variance / m.trace, rows)),
                    pa.array(np.full(rows * k, m.identity_error)),
                ], schema=schema)

    return rows.mapInArrow(run, WHITE)
