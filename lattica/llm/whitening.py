"""Embedding whitening by QDWH spectral divide and conquer.

Vectors become whole numbers first (entry c is floor(64 c) + 1,000,000), so that counts, sums and deviations are exact and equal vectors are equal
bytes. The fit list has every distinct vector once. Its covariance, a d x d matrix however long the table, is taken apart on the driver: the polar
factor of a shifted covariance, by dynamically weighted Halley steps, tells the eigenvalues above the shift from those below it; the two
projectors split the space into two invariant subspaces, and each is split in turn until it has one component. The d x k matrix of components
is broadcast, and every row is projected on it where it lies.

Rows whose vector is null, empty or holds null or non-finite entries have no result, nor have those of another length than the most frequent one
(the longest of equally frequent ones) or with |64 c| of 2**40 and more. Repeated rows each have their own result; a null id is kept. Components
without variance beyond rounding cannot be whitened and are left out: a table of equal vectors, or an empty one, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, written

STEPS, SHIFT = 64, 1_000_000
#: Components that are kept, and the size from which an entry counts as not finite.
COMPONENTS, LARGEST = 16, float(1 << 40)
EPS = np.finfo(float).eps
OUT = "vec_id long, n long, deviation decimal(38,0), whitened array<double>"
#: Rows worked on at a time.
SLAB = 4096


# Polar factors and projectors


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix. The weights of each Halley step follow from a bound `low` on the least singular value,
    which grows to 1 in six steps at most from the smallest number that a double can tell from 0; steps with large weights go by QR, which needs
    no inverse."""
    n, eye = len(a), np.eye(len(a))
    x = a / np.linalg.norm(a)
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(1.0, max(low, EPS / n))
    for _ in range(40):
        root = np.cbrt(4 * max(0.0, 1 - low * low) / low**4)
        wa = np.sqrt(1 + root) + np.sqrt(8 - 4 * root + 8 * (2 - low * low) / (low * low * np.sqrt(1 + root))) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(eye + wc * (x.T @ x), x.T).T
        new = (new + new.T) / 2
        moved, x, low = np.linalg.norm(new - x), new, min(1.0, low * (wa + wb * low * low) / (1 + wc * low * low))
        if 1 - low < 10 * EPS and moved < EPS ** (1 / 3):
            break
    return x


def _range(p: np.ndarray, k: int) -> np.ndarray:
    """An orthogonal matrix whose first k columns span the range of the projector p: two steps of subspace iteration from a fixed start."""
    q = np.random.default_rng(len(p)).standard_normal((len(p), k))
    for _ in range(2):
        full, _ = np.linalg.qr(p @ q, mode="complete")
        q = full[:, :k]
    return full


def components_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix."""
    size = np.linalg.norm(v)

    def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, diagonal = len(a), np.diag(a)
        if n == 1 or np.linalg.norm(a - np.diag(diagonal)) <= EPS * size:
            return diagonal.copy(), np.eye(n)
        best = None
        middle, mean, spread = np.median(diagonal), diagonal.mean(), np.linalg.norm(a - diagonal.mean() * np.eye(n)) / np.sqrt(n)
        # the mean lies strictly between the least and the greatest eigenvalue; the others serve where it is an eigenvalue itself
        for shift in (middle, mean, *(mean + f * spread for f in (0.1, -0.1, 0.03, -0.03, 0.3, -0.3))):
            u = polar(a - shift * np.eye(n))
            k = int(round((np.trace(u) + n) / 2))
            if not 0 < k < n:
                continue
            q = _range((u + np.eye(n)) / 2, k)
            b = q.T @ a @ q
            left = np.linalg.norm(b[k:, :k])
            if best is None or left < best[0]:
                best = left, k, q, b
            if left <= 4 * n * EPS * size:
                break
        left, k, q, b = best
        parts = [split((s + s.T) / 2) for s in (b[:k, :k], b[k:, k:])]
        return np.concatenate([e for e, _ in parts]), np.hstack([q[:, :k] @ parts[0][1], q[:, k:] @ parts[1][1]])

    e, w = split((v + v.T) / 2)
    order = np.argsort(-e, kind="stable")
    return e[order], w[:, order]


# Rows as whole numbers


def _rows(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, whole numbers less SHIFT), a matrix for each length of the usable vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # a null entry becomes nan
    start = np.cumsum(size) - size
    for d in np.unique(size[size > 0]):
        at = np.flatnonzero(size == d)
        for some in np.split(at, range(SLAB, len(at), SLAB)):
            with np.errstate(invalid="ignore"):
                y = STEPS * flat[start[some][:, None] + np.arange(d)]
                fine = (np.abs(y) < LARGEST).all(1)
            yield some[fine], np.floor(y[fine]).astype(np.int64)


def keys(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(d, key): every usable vector as bytes of the least width that holds it, so that equal vectors, and only they, have equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, y in _rows(batch.column(0)):
                low, high = y.min(1, initial=0), y.max(1, initial=0)
                width = np.select([(low >= -(1 << (8 * w - 1))) & (high < 1 << (8 * w - 1)) for w in (1, 2, 4)], [1, 2, 4], 8)
                out = [bytes([w]) + r.tobytes() for w in (1, 2, 4, 8) for r in y[width == w].astype(f"<i{w}")]
                yield pa.RecordBatch.from_arrays([pa.array([y.shape[1]] * len(out), pa.int32()), pa.array(out, pa.binary())], ["d", "key"])

    return vectors.select(column).mapInArrow(tidy(run), "d int, key binary")


def _unpacked(column: pa.BinaryArray) -> Iterator[np.ndarray]:
    """The matrices of keys of one length of vectors."""
    held = column.to_pylist()
    for w in (1, 2, 4, 8):
        some = [k[1:] for k in held if k[0] == w]
        for i in range(0, len(some), SLAB):
            part = some[i : i + SLAB]
            yield np.frombuffer(b"".join(part), f"<i{w}").astype(np.int64).reshape(len(part), -1)


def sums(fit: DataFrame) -> list[int]:
    """The exact sum of each dimension, less SHIFT for each vector; a row for each dimension reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y in _unpacked(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(y.shape[1], dtype=np.int32)), pa.array(y.sum(0))], ["i", "s"])

    parts = fit.select("key").mapInArrow(tidy(run), "i int, s long")
    return [int(r.s) for r in parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()]


def scatter(fit: DataFrame, n: int, total: list[int], onto: np.ndarray | None = None) -> np.ndarray:
    """The covariance of the fit list, or of its projection on the columns of `onto`: entries are centred, then multiplied. Every task adds up
    its own matrix; its lines meet line by line, and the matrix alone reaches the driver."""
    near = np.array([(s + n // 2) // n for s in total])
    rest = np.array([float(s - n * int(m)) / n for s, m in zip(total, near)])
    sent = fit.sparkSession.sparkContext.broadcast((near, rest, onto))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, rest, onto = sent.value
        found = None
        for batch in batches:
            for y in _unpacked(batch.column(0)):
                c = (y - near) - rest
                c = c if onto is None else c @ onto
                found = c.T @ c if found is None else found + c.T @ c
        if found is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found), dtype=np.int32)), pa.array([part] * len(found), pa.int32()), pa.array(list(found), pa.list_(pa.float64()))], ["i", "part", "line"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        lines = np.stack(pdf.sort_values("part")["line"].to_numpy())
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "line": [lines.sum(0)]})

    lines = fit.select("key").mapInArrow(tidy(run), "i int, part int, line array<double>").groupBy("i").applyInPandas(add, "i int, line array<double>")
    return np.array([r.line for r in lines.orderBy("i").collect()]) / n


# The operator


class Whitening:
    """What the fit list gives: n, sums (less SHIFT), eigenvalues and components, and the largest error of the whitened covariance."""

    def __init__(self, d: int, n: int, total: list[int], values: np.ndarray, vectors: np.ndarray, trace: float, error: float):
        self.d, self.n, self.total, self.values, self.vectors, self.trace, self.error = d, n, total, values, vectors, trace, error

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.values]


def fit(vectors: DataFrame, column: str = "embedding", most: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table's distinct vectors with up to `most` components; None where no component has any variance."""
    table = written(keys(vectors, column).distinct(), "vectors")
    top = table.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if top is None:
        return None
    some = table.where(F.col("d") == top.d)
    total = sums(some)
    v = scatter(some, top.n, total)
    trace = float(np.trace(v))
    if not trace > 0:
        return None
    e, w = components_of(v)
    k = int((e > top.d * EPS * e[0]).sum())
    e, w = e[: min(k, most)], w[:, : min(k, most)]
    error = np.abs(scatter(some, top.n, total, w / np.sqrt(e)) - np.eye(len(e))).max()
    return Whitening(top.d, top.n, total, e, w, trace, float(error))


def project(vectors: DataFrame, model: Whitening, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, n, deviation, whitened) of every usable row: the exact sum of (n x - S)^2 and an array of its whitened components. A deviation
    beyond 38 digits is null."""
    n, total = model.n, model.total
    near = [(s + n // 2) // n for s in total]
    left = [s - n * m for s, m in zip(total, near)]
    sent = vectors.sparkSession.sparkContext.broadcast((model.d, n, np.array(near), left, model.vectors / np.sqrt(model.values)))
    schema = pa.schema([("vec_id", pa.int64()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, n, near, left, onto = sent.value
        rest, most = np.array([x / n for x in left]), max(map(abs, left))
        for batch in batches:
            for at, y in _rows(batch.column(1)):
                if y.shape[1] != d or not len(y):
                    continue
                y = y - near
                # within these bounds a sum of squares stays a whole 64-bit number
                whole = d * (n * int(np.abs(y).max()) + most) ** 2 < 1 << 63
                off = n * y - np.array(left) if whole else n * y.astype(object) - np.array(left, object)
                away = (off * off).sum(1)
                white = (y - rest) @ onto
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array([n] * len(at), pa.int64()), pa.array([Decimal(int(a)) if a < 10**38 else None for a in away], pa.decimal128(38, 0)), pa.array(list(white), pa.list_(pa.float64()))], schema=schema
                )

    return vectors.select(F.col(key).cast("long"), column).mapInArrow(tidy(run), OUT)


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row for each usable row and component: (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    model = fit(vectors, column, most)
    if model is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    rows = project(vectors, model, key, column).select("vec_id", "n", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, model.explained)), F.col("i") + 1)
    return rows.select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", "whitened", explained.alias("explained"), F.lit(model.error).alias("identity_error"))
