"""Whitened leading components of vectors by Chebyshev-filtered subspace iteration.

Components x = floor(``scale`` * c) of the distinct vectors form the fit list; V is its covariance.
A block of orthonormal columns Q, a few more than are wanted, is filtered again and again by a
Chebyshev polynomial of V that is small between 0 and the block's own least Ritz value, which
holds the unwanted spectrum (V is positive semidefinite), and grows above. Each degree of the
recurrence is one distributed pass: tasks add up (x - mean)(x - mean)'Q over their vectors, the
sums per cell are added by a grouped aggregate, and the driver holds a matrix of dimensions x
columns, whatever the number of vectors. Then QR and Rayleigh-Ritz: the leading pairs are certified
when no residual |V u - e u| exceeds ``TOLERANCE`` times the largest e; sums in doubles reach that
within a few passes, and a run that does not is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcohort.llm.top_k import LONG, usable, whole
from seqcohort.session import release, settle

SCALE, COMPONENTS = 256, 4
GUARD, DEGREE, ROUNDS = 24, 8, 60
TOLERANCE = 2e-13
BLOCK = 4096


class Whitening(NamedTuple):
    """``n`` and the exact sums of the fit list; eigenvalues, unit eigenvectors (columns), trace, and
    the largest entry of the whitened fit list's covariance minus the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dim)


def packed(fit: DataFrame) -> DataFrame:
    """The vectors of the fit list, ``BLOCK`` at a time as one binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                x = batch.column(0).slice(start, BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), pa.array([np.asarray(x.flatten()).tobytes()])], ["size", "x"])

    return fit.select("x").mapInArrow(run, "size int, x binary")


def added(blocks: DataFrame, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of ``part(x)``, a matrix of ``shape``: one matrix per task, one row per
    cell of it in the exchange."""
    rows, columns = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(shape), False
        for batch in batches:
            for size, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                total += part(np.frombuffer(raw.as_buffer(), np.int64).reshape(size, -1).astype(np.float64))
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows * columns)), pa.array(total.ravel())], ["cell", "v"])

    out = np.zeros(rows * columns)
    for cell, v in blocks.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v")).collect():
        out[cell] = v
    return out.reshape(shape)


def exact_sums(blocks: DataFrame, dim: int) -> list[int]:
    """Sums per dimension: high and low halves of the numbers are summed apart, so that none overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(raw.as_buffer(), np.int64).reshape(size, dim)
                high = x >> 32
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(dim)), pa.array(high.sum(axis=0)), pa.array((x - (high << 32)).sum(axis=0))], ["i", "high", "low"]
                )

    wide = [F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("high", "low")]
    out = [0] * dim
    for i, high, low in blocks.mapInArrow(run, "i long, high long, low long").groupBy("i").agg(*wide).collect():
        out[i] = (int(high) << 32) + int(low)
    return out


def fit(rows: DataFrame, components: int = COMPONENTS, seed: int = 7) -> Whitening | None:
    """The leading eigenvectors of the fit list ``rows`` (``x``: arrays of longs of one length); those
    of no variance are left out. None if there are no rows."""
    blocks = settle(packed(rows.select("x").distinct()))
    first = blocks.filter("size > 0").select("size", F.length("x").alias("bytes")).first()
    if first is None:
        return None
    dim = first["bytes"] // 8 // first["size"]
    n = blocks.agg(F.sum("size")).first()[0]
    sums = exact_sums(blocks, dim)
    mean = np.array([s / n for s in sums])
    trace = float(added(blocks, (1, dim), lambda x: ((x - mean) ** 2).sum(axis=0)[None]).sum() / n)
    none = np.zeros((dim, 0))
    if not dim or trace == 0:
        release(blocks)
        return Whitening(n, sums, np.zeros(0), none, trace, 0.0)
    columns = min(dim, components + GUARD)
    wanted = min(components, dim)

    def times(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            x = x - mean
            return x.T @ (x @ q)

        return added(blocks, q.shape, part) / n

    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, columns)))[0]
    for _ in range(ROUNDS):
        vq = times(q)
        values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        residuals = np.linalg.norm(vq - q * values, axis=0)[:wanted]
        if residuals.max() <= TOLERANCE * values[0] or columns == dim and residuals.max() <= 100 * TOLERANCE * values[0]:
            break
        # The recurrence, scaled so that the leading direction keeps its length; ``vq`` is its first pass.
        upper = max(values[-1], 1e-12 * values[0])
        half = centre = upper / 2
        sigma = first_sigma = half / (values[0] - centre)
        before, filtered = q, (vq - centre * q) * (sigma / half)
        for _ in range(DEGREE - 1):
            next_sigma = 1 / (2 / first_sigma - sigma)
            before, filtered = filtered, 2 * next_sigma / half * (times(filtered) - centre * filtered) - sigma * next_sigma * before
            sigma = next_sigma
        q = np.linalg.qr(filtered)[0]
    else:
        raise RuntimeError(f"eigenvectors not certified: residuals {residuals}")
    some = values[:wanted] > 1e-12 * values[0]
    values, vectors = values[:wanted][some], q[:, :wanted][:, some]
    to = vectors / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ to
        return np.vstack([z.sum(axis=0), z.T @ z])

    m = added(blocks, (len(values) + 1, len(values)), moments) / n
    error = float(np.abs(m[1:] - np.outer(m[0], m[0]) - np.eye(len(values))).max())
    release(blocks)
    return Whitening(n, sums, values, vectors, trace, error)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sums over dimensions of (n*x - S)^2; null where a long cannot hold it."""
    most = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, sums), default=0)
    if most * most * max(1, x.shape[1]) <= LONG:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = (sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist())
    return [d if d <= LONG else None for d in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding",
           scale: int = SCALE) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` of every row that takes part
    and every component, from 1 by falling eigenvalue.

    Vectors that are null or hold null or non-finite components take no part; neither do vectors of
    other lengths than the commonest one of the rows (the longer at a tie). Repeated rows and null
    ids are rows like others, and equal vectors enter the fit once, however many they are.
    Components beyond a long are held at its ends, a ``deviation`` beyond it is null. Components
    without variance are left out, so a table of one distinct vector, or an empty one, gives no rows.
    Equal eigenvalues leave their eigenvectors to chance. Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec")).filter(usable("vec"))
    lengths = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = lengths["dim"] if lengths else 0
    rows = rows.filter(F.size("vec") == dim).select("id", whole("vec", scale).alias("x"))
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    mean = np.array([s / model.n for s in model.sums])
    to, explained, many = model.vectors / np.sqrt(model.values), model.values / model.trace if model.trace else model.values, len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dim)
            z = (x.astype(np.float64) - mean) @ to
            each = np.repeat(np.arange(len(x)), many)
            component = np.tile(np.arange(many, dtype=np.int32), len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(each)), pa.array(component + 1, pa.int32()), pa.array(np.full(len(each), model.n, np.int64)),
                 pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(each)), pa.array(z.ravel()),
                 pa.array(explained[component]), pa.array(np.full(len(each), model.identity_error))],
                [f.split()[0] for f in schema.split(", ")],
            )

    return rows.mapInArrow(run, schema)
