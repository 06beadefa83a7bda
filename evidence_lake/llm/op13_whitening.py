"""Embedding whitening by a matrix-free block Lanczos iteration.

Entries become integers floor(64 c); each distinct integer vector counts once. The covariance V is never
formed: a pass over the distinct vectors, which lie in matrix blocks on shared storage, gives V Q for a few
directions Q as the sum of X'(X Q) over centred blocks X; the driver holds Q and V Q of the basis only. Each
new block of directions is orthogonalised twice against the whole basis; directions that break down are
replaced by random ones; a full basis restarts from its best Ritz vectors. The iteration ends when the
residuals of all wanted pairs are at rounding level and random directions change none of them. The trace comes from the exact squared deviations.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_lake.llm.common import in_arrow, staged

SCALE = 64.0
#: The integers of the contract are larger by this; it cancels in all centred values.
SHIFT = 1_000_000
COMPONENTS = 16
#: Directions that a pass multiplies.
WIDTH = 16
#: The basis restarts beyond so many directions.
BASIS = 256
#: Residuals of at most this share of the largest eigenvalue end the iteration.
TOLERANCE = 1e-13
PASSES = 400
#: Eigenvalues of at most this share of the largest are zero: such components have no variance to whiten.
NO_VARIANCE = 1e-11
BLOCK_ROWS = 8192
#: Integers are cut to this size, beyond which doubles don't hold them.
MOST = 2**52
LONG = 2**63 - 1
_LOW = 26

KEYED = "dim int, key binary"
BLOCKS = "dim int, n int, kind string, cells binary"


@dataclass
class Whitening:
    """A fit of vectors of one length: n, the means as integer part and rest, eigenvalues, components (columns), trace, identity_error."""

    n: int
    sums: list[int]
    floor: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    def whitened(self, cells: np.ndarray) -> np.ndarray:
        """Rows of integer cells, centred, projected on the components, over the roots of the eigenvalues."""
        return ((cells - self.floor).astype(np.float64) - self.rest) @ self.components / np.sqrt(self.values)


def integers(batch: pa.RecordBatch):
    """(dim, row numbers, integer cells) of the usable vectors, each length by itself."""
    vectors = batch.column("vector")
    size = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    for dim in np.unique(size[size > 0]).tolist():
        pick = np.flatnonzero(size == dim)
        flat = vectors.take(pa.array(pick)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(pick), dim)
        good = np.isfinite(flat).all(axis=1)
        with np.errstate(over="ignore"):
            cells = np.clip(np.floor(flat[good] * SCALE), -MOST, MOST).astype(np.int64)
        yield dim, pick[good], cells


def _kind(cells: np.ndarray) -> str:
    most = np.abs(cells).max(initial=0)
    return "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8"


def _keyed(batches):
    """Each vector as the bytes of its integers, as narrow as they allow: equal vectors have equal bytes."""
    for batch in batches:
        for dim, _, cells in integers(batch):
            most = np.abs(cells).max(axis=1)
            for kind, low, high in (("<i2", 0, 2**15), ("<i4", 2**15, 2**31), ("<i8", 2**31, LONG)):
                own = cells[(most >= low) & (most < high)].astype(kind)
                if len(own):
                    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(own.shape[1] * own.itemsize), len(own), [None, pa.py_buffer(own.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), dim, np.int32)), raw.cast(pa.binary())], names=["dim", "key"])


def _blocks(batches):
    """Matrix blocks of keys of one length."""
    held: dict[int, list[np.ndarray]] = {}

    def block(dim: int):
        cells = np.concatenate(held.pop(dim))
        kind = _kind(cells)
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(cells)], pa.int32()), pa.array([kind]), pa.array([cells.astype(kind).tobytes()], pa.binary())], names=["dim", "n", "kind", "cells"])

    for batch in batches:
        dims = batch.column("dim").to_numpy()
        size = batch.column("key").cast(pa.large_binary()).to_numpy(zero_copy_only=False)
        widths = np.array([len(x) for x in size]) // dims
        for dim, width in np.unique(np.stack([dims, widths], 1), axis=0).tolist():
            raw = b"".join(size[(dims == dim) & (widths == width)])
            held.setdefault(dim, []).append(np.frombuffer(raw, f"<i{width}").reshape(-1, dim).astype(np.int64))
            if sum(map(len, held[dim])) >= BLOCK_ROWS:
                yield block(dim)
    for dim in list(held):
        yield block(dim)


def _cells(batch: pa.RecordBatch):
    """(dim, integers) of each block."""
    for i in range(batch.num_rows):
        dim = batch.column("dim")[i].as_py()
        yield dim, np.frombuffer(batch.column("cells")[i].as_buffer(), batch.column("kind")[i].as_py()).reshape(-1, dim).astype(np.int64)


_SUMS = "part int, dim int, n long, total binary"


def _totals(found: dict[int, tuple[int, np.ndarray]]):
    part = TaskContext.get().partitionId()
    names = ["part", "dim", "n", "total"]
    for dim, (n, total) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([dim], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=names)


def summed(blocks: DataFrame, of: Callable[[int, np.ndarray], np.ndarray], kind: str) -> dict[int, tuple[int, np.ndarray]]:
    """{dim: (rows, sum of `of` over its blocks)}: each task adds up its blocks, then some tasks add up what these found, in order, and the driver the rest."""

    def first(batches):
        found: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for dim, cells in _cells(batch):
                n, total = found.get(dim, (0, 0))
                found[dim] = (n + len(cells), total + of(dim, cells))
        yield from _totals(found)

    def then(batches):
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["dim"], r["part"]))  # one for each task at most
        found: dict[int, tuple[int, np.ndarray]] = {}
        for r in rows:
            n, total = found.get(r["dim"], (0, 0))
            found[r["dim"]] = (n + r["n"], total + np.frombuffer(r["total"], kind))
        yield from _totals(found)

    parts = blocks.transform(in_arrow, first, _SUMS)
    fewer = parts.repartition(max(1, math.isqrt(blocks.rdd.getNumPartitions()))).transform(in_arrow, then, _SUMS)
    out: dict[int, tuple[int, np.ndarray]] = {}
    for r in sorted(fewer.collect(), key=lambda r: r["part"]):  # some tens of sums
        n, total = out.get(r["dim"], (0, 0))
        out[r["dim"]] = (n + r["n"], total + np.frombuffer(bytes(r["total"]), kind))
    return out


def _exact(total: np.ndarray) -> list[int]:
    """Sums whose high and low halves were added apart."""
    high, low = total.reshape(2, -1).tolist()
    return [(h << _LOW) + w for h, w in zip(high, low)]


def _halves(x: np.ndarray) -> np.ndarray:
    return np.stack([(x >> _LOW).sum(axis=0), (x & ((1 << _LOW) - 1)).sum(axis=0)]).ravel()


def deviations(cells: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sum over dimensions of (n x - S)^2, exact; beyond 64 bits cut to them."""
    floor = [s // n for s in sums]
    rest = [s - n * f for s, f in zip(sums, floor)]
    away = cells - np.array(floor)
    if (n * (int(np.abs(away).max(initial=0)) + 1)) ** 2 * len(sums) <= LONG:
        return ((n * away - np.array(rest)) ** 2).sum(axis=1)
    return np.array([min(LONG, sum((n * x - r) ** 2 for x, r in zip(row, rest))) for row in away.tolist()], np.int64)


def _new_directions(new: np.ndarray, basis: np.ndarray, least: float, rng: np.random.Generator) -> np.ndarray:
    """An orthonormal block, orthogonal to the basis, of the directions of `new`; random ones replace those that break down (norm of at most `least`)."""
    d, wanted = len(basis), min(new.shape[1], len(basis) - basis.shape[1])
    out = np.zeros((d, 0))
    while out.shape[1] < wanted:
        for _ in range(2):
            both = np.hstack([basis, out])
            new = new - both @ (both.T @ new)
        left, size, _ = np.linalg.svd(new, full_matrices=False)
        out = np.hstack([out, left[:, size > least][:, : wanted - out.shape[1]]])
        new, least = rng.standard_normal((d, max(1, wanted - out.shape[1]))), 1e-6
    both = out - basis @ (basis.T @ out)
    return np.linalg.qr(both)[0]


def eigenpairs(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, width: int = WIDTH, basis: int = BASIS, tolerance: float = TOLERANCE, passes: int = PASSES, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the k largest eigenpairs of a symmetric operator of size d that `times` multiplies blocks by."""
    rng = np.random.default_rng(seed)
    k, width = min(k, d), min(width, d)
    basis = max(basis, k + 2 * width)
    q, vq, new, least = np.zeros((d, 0)), np.zeros((d, 0)), rng.standard_normal((d, width)), 1e-6
    before = None
    for _ in range(passes):
        block = _new_directions(new, q, least, rng)
        z = times(block)
        q, vq = np.hstack([q, block]), np.hstack([vq, z])
        t = q.T @ vq
        values, ritz = np.linalg.eigh((t + t.T) / 2)
        values, ritz = values[::-1], ritz[:, ::-1]
        left = np.linalg.norm(vq @ ritz[:, :k] - (q @ ritz[:, :k]) * values[:k], axis=0).max(initial=0.0)
        small = q.shape[1] >= k and left <= tolerance * abs(values[0])
        if q.shape[1] >= d or small and before is not None and np.abs(values[:k] - before).max(initial=0.0) <= 8 * tolerance * abs(values[0]):
            vectors = np.linalg.qr(q @ ritz[:, :k])[0]
            return values[:k], vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), range(k)] < 0, -1.0, 1.0)
        # small residuals may belong to a subspace that lacks a direction: random ones must leave the values as they are
        before = values[:k] if small else None
        new, least = (rng.standard_normal((d, width)), 1e-6) if small else (z - q @ (q.T @ z), 1e-12 * abs(values[0]))
        if q.shape[1] + width > basis:
            q, vq = q @ ritz[:, : k + width], vq @ ritz[:, : k + width]
    raise ArithmeticError(f"no convergence in {passes} passes")


def fitted(vectors: DataFrame, components: int = COMPONENTS, vector_col: str = "embedding") -> dict[int, Whitening]:
    """{length: Whitening} of the vectors of each length; lengths without variance have no components."""
    own = vectors.select(F.col(vector_col).cast("array<double>").alias("vector"))
    keys = own.transform(in_arrow, _keyed, KEYED).distinct().sortWithinPartitions("dim", "key")
    blocks = staged(keys.transform(in_arrow, _blocks, BLOCKS), "whitening-blocks")
    out: dict[int, Whitening] = {}
    for dim, (n, total) in summed(blocks, lambda _, x: _halves(x), "<i8").items():
        sums = _exact(total)
        floor = np.array([s // n for s in sums])
        rest = np.array([(s - n * (s // n)) / n for s in sums])
        own = blocks.where(F.col("dim") == dim)
        (high, low) = summed(own, lambda _, x, n=n, sums=sums: _halves(deviations(x, n, sums)), "<i8")[dim][1].tolist()
        trace = ((high << _LOW) + low) / n**3

        def times(q: np.ndarray, own=own, dim=dim, n=n, floor=floor, rest=rest) -> np.ndarray:
            def product(_, cells: np.ndarray) -> np.ndarray:
                x = (cells - floor).astype(np.float64) - rest
                return x.T @ (x @ q)

            return summed(own, product, "<f8")[dim][1].reshape(q.shape) / n

        values, vectors_ = eigenpairs(times, dim, components)
        some = values > NO_VARIANCE * max(values[0], 0.0)
        fit = Whitening(n, sums, floor, rest, values[some], vectors_[:, some], trace)
        k = int(some.sum())
        if k:

            def moments(_, cells: np.ndarray, fit=fit) -> np.ndarray:
                w = fit.whitened(cells)
                return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

            total = summed(own, moments, "<f8")[dim][1] / n
            mean = total[:k]
            fit.identity_error = float(np.abs(total[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())
        out[dim] = fit
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row and component.

    Rows whose vector is null or empty, or holds null or non-finite entries, are left out; a null or repeated
    id stays as it is. Vectors of each length are a fit of their own. Components without variance aren't
    given: with fewer distinct vectors than dimensions there are fewer, and equal vectors alone give no rows.
    Integers are cut to 52 bits, deviations to 64. Empty table: no rows. Extra columns are ignored.
    """
    fits = fitted(vectors, components, vector_col)
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))

    def run(batches):
        for batch in batches:
            for dim, at, cells in integers(batch):
                fit = fits[dim]
                k = len(fit.values)
                for a in range(0, len(at) if k else 0, BLOCK_ROWS):
                    rows, part = at[a : a + BLOCK_ROWS], cells[a : a + BLOCK_ROWS]
                    many = len(rows)
                    columns = [
                        batch.column("vec_id").take(pa.array(np.repeat(rows, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)),
                        pa.array(np.full(many * k, fit.n)),
                        pa.array(np.repeat(deviations(part, fit.n, fit.sums), k)),
                        pa.array(fit.whitened(part).ravel()),
                        pa.array(np.tile(fit.values / fit.trace, many)),
                        pa.array(np.full(many * k, fit.identity_error)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return own.transform(in_arrow, run, f"vec_id {dict(own.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
