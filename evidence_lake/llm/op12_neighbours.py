"""Nearest neighbours by inner product, as a join of matrix blocks.

Vectors lie in blocks, each also as int8 cells with a scale and the length of what rounding took away. A
query block and a candidate block meet as tiles of int8 products; with the lengths of the errors these give
bounds on every inner product, so that a pair is left out only if it can't be among the k best. What
survives is recomputed in doubles, always in the same order of dimensions, and goes onto a heap for each query;
a full heap's least score is the cutoff of the blocks that follow. The best of all tasks' heaps are the result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidence_lake.llm.common import in_arrow, staged

BLOCK_ROWS = 8192
QUERY_ROWS = 2048
#: Queries whose products with a block are in memory at a time.
TILE = 256
#: Pairs that are recomputed at a time.
PAIRS = 1 << 16
#: Query blocks of at most so many bytes, measured, are broadcast; more are dealt into groups of this size.
GROUP_BYTES = 32 << 20
#: Candidate blocks of a lane, where query blocks are dealt.
LANE_BYTES = 64 << 20
#: What sums of doubles may be off by, as a share of the product of the lengths.
ROUNDING = 1e-12

_PART = "n int, ids binary, cells binary, scales binary, errors binary, lengths binary, kind string, vectors binary"
BLOCKS = f"block long, dim int, {_PART}, q_at binary, q_cut binary"
QUERIES = f"q_block long, dim int, {_PART}, home binary, at binary, cut binary"


class Quantised:
    """Vectors with int8 cells: row i is scales[i] * cells[i] but for a rest of length errors[i]."""

    def __init__(self, vectors: np.ndarray, cells=None, scales=None, errors=None, lengths=None):
        self.vectors = vectors
        if cells is None:
            with np.errstate(all="ignore"):
                lengths = np.sqrt((vectors**2).sum(axis=1))
                scales = np.abs(vectors).max(axis=1, initial=0.0) / 127.0
                usable = (scales > 1e-290) & np.isfinite(lengths)
                scales = np.where(usable, scales, 0.0)
                cells = np.where(usable[:, None], np.rint(vectors / np.where(usable, scales, 1.0)[:, None]), 0.0).astype(np.int8)
                errors = np.sqrt(((vectors - scales[:, None] * cells) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-300
        self.cells, self.scales, self.errors, self.lengths = cells, scales, errors, lengths

    @classmethod
    def read(cls, r: dict) -> Quantised:
        side = lambda name, kind: np.frombuffer(r[name], kind)
        return cls(side("vectors", r["kind"]).reshape(r["n"], -1).astype(np.float64), side("cells", "i1").reshape(r["n"], -1), side("scales", "<f8"), side("errors", "<f8"), side("lengths", "<f8"))

    def fields(self, ids: np.ndarray, pick=slice(None)) -> dict:
        vectors = self.vectors[pick]
        with np.errstate(over="ignore"):
            kind = "<f4" if np.array_equal(vectors.astype("<f4").astype(np.float64), vectors) else "<f8"
        return {"n": len(vectors), "ids": ids[pick].astype("<i8").tobytes(), "cells": self.cells[pick].tobytes(), "scales": self.scales[pick].tobytes(), "errors": self.errors[pick].tobytes(), "lengths": self.lengths[pick].tobytes(), "kind": kind, "vectors": vectors.astype(kind).tobytes()}


def bounded(q: Quantised, rows, c: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, errors): each inner product of the rows of q and all of c lies within its error of its estimate.

    int8 products are whole numbers; single precision holds their sums up to 1040 dimensions, double beyond.
    """
    kind = np.float32 if q.cells.shape[1] * 127 * 127 < 2**24 else np.float64
    with np.errstate(all="ignore"):
        whole = q.cells[rows].astype(kind) @ c.cells.astype(kind).T
        estimate = whole * q.scales[rows][:, None] * c.scales
        # <q,c> - <q',c'> = <q-q',c> + <q',c-c'>, and a rounded vector is no longer than its own and its error's length
        error = q.errors[rows][:, None] * c.lengths + (q.lengths + q.errors)[rows][:, None] * c.errors
        return estimate, error + ROUNDING * (q.lengths[rows][:, None] * c.lengths) + 1e-300


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, added up from the first dimension to the last: the same bits in any batch. What isn't a number comes last."""
    out = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for j in range(a.shape[1]):
            out += a[:, j] * b[:, j]
    return np.where(np.isnan(out), -np.inf, out)


def best_rows(who: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores of each query of `who` (ascending), of equals the first."""
    order = np.lexsort((np.arange(len(who)), -score, who))
    start = np.searchsorted(who, who)
    return order[np.arange(len(who)) - start < k]


def survivors(q: Quantised, rows: np.ndarray, c: Quantised, cut: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the pairs that may be among the k best: their upper bound reaches the query's cutoff, and the k-th best lower bound of the tile. own: the query's own column or -1."""
    estimate, error = bounded(q, rows, c)
    mine = np.flatnonzero(own >= 0)
    low = estimate - error
    low[mine, own[mine]] = -np.inf
    low[np.isnan(low)] = -np.inf
    passing = ~(estimate + error < cut[:, None])
    passing[mine, own[mine]] = False
    many = np.flatnonzero(passing.sum(axis=1) > 2 * k)
    if len(many) and low.shape[1] > k:
        kth = np.partition(low[many], -k, axis=1)[:, -k]
        passing[many] &= ~((estimate + error)[many] < kth[:, None])
    return np.nonzero(passing)


def cutoffs(c: Quantised, at: np.ndarray, k: int) -> np.ndarray:
    """For the rows `at` of a block a score that k other rows of it reach: the k-th best lower bound; -inf if there are too few."""
    out = np.full(len(at), -np.inf)
    if len(c.cells) <= k:
        return out
    for a in range(0, len(at), TILE):
        rows = at[a : a + TILE]
        estimate, error = bounded(c, rows, c)
        low = estimate - error
        low[np.arange(len(rows)), rows] = -np.inf
        low[np.isnan(low)] = -np.inf
        out[a : a + TILE] = np.partition(low, -k, axis=1)[:, -k]
    return out


def usable(batch: pa.RecordBatch):
    """(dim, ids, vectors) of the rows that take part, each length by itself."""
    ids, vectors = batch.column("vec_id"), batch.column("vector")
    size = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    size = np.where(ids.is_valid().to_numpy(zero_copy_only=False), size, -1)
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for dim in np.unique(size[size > 0]).tolist():
        pick = np.flatnonzero(size == dim)
        flat = vectors.take(pa.array(pick)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(pick), dim)
        good = np.isfinite(flat).all(axis=1) & flat.any(axis=1)
        yield dim, ids[pick][good], flat[good]


def _packed(batches, every: int, k: int, rows: int):
    """Blocks in the order of ids, with the block's queries and their first cutoffs."""
    held: dict[int, list] = {}
    part, made = TaskContext.get().partitionId(), 0

    def block(dim: int):
        nonlocal made
        ids, vectors = (np.concatenate(x) for x in zip(*held.pop(dim)))
        order = np.argsort(ids, kind="stable")
        ids, own = ids[order], Quantised(vectors[order])
        made += 1
        at = np.flatnonzero(ids % every == 0)
        out = own.fields(ids) | {"block": (part << 32) + made, "dim": dim, "q_at": at.astype("<i8").tobytes(), "q_cut": cutoffs(own, at, k).tobytes()}
        return pa.RecordBatch.from_pylist([out], schema=_BLOCK_SCHEMA)

    for batch in batches:
        for dim, ids, vectors in usable(batch):
            for a in range(0, len(ids), rows):
                held.setdefault(dim, []).append((ids[a : a + rows], vectors[a : a + rows]))
                if sum(len(x) for x, _ in held[dim]) >= rows:
                    yield block(dim)
    for dim in list(held):
        yield block(dim)


_FIELDS = [("n", pa.int32()), ("ids", pa.binary()), ("cells", pa.binary()), ("scales", pa.binary()), ("errors", pa.binary()), ("lengths", pa.binary()), ("kind", pa.string()), ("vectors", pa.binary())]
_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("dim", pa.int32()), *_FIELDS, ("q_at", pa.binary()), ("q_cut", pa.binary())])
_QUERY_SCHEMA = pa.schema([("q_block", pa.int64()), ("dim", pa.int32()), *_FIELDS, ("home", pa.binary()), ("at", pa.binary()), ("cut", pa.binary())])


def _asked(batches, rows: int):
    """Query rows of several blocks in blocks of their own, each with the place it comes from."""
    held: dict[int, list] = {}
    part, made = TaskContext.get().partitionId(), 0

    def out(dim: int):
        nonlocal made
        ids, vectors, home, at, cut = (np.concatenate(x) for x in zip(*held.pop(dim)))
        made += 1
        row = Quantised(vectors).fields(ids) | {"q_block": (part << 32) + made, "dim": dim, "home": home.astype("<i8").tobytes(), "at": at.astype("<i8").tobytes(), "cut": cut.tobytes()}
        return pa.RecordBatch.from_pylist([row], schema=_QUERY_SCHEMA)

    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            at, cut = np.frombuffer(r["q_at"], "<i8"), np.frombuffer(r["q_cut"], "<f8")
            ids, own = np.frombuffer(r["ids"], "<i8"), Quantised.read(r)
            for a in range(0, len(at), rows):
                pick = at[a : a + rows]
                held.setdefault(r["dim"], []).append((ids[pick], own.vectors[pick], np.full(len(pick), r["block"], np.int64), pick, cut[a : a + rows]))
                if sum(len(x[0]) for x in held[r["dim"]]) >= rows:
                    yield out(r["dim"])
    for dim in list(held):
        yield out(dim)


def met(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """Each query block with each block of its dimension: query blocks of checked size go to every task; more are dealt into groups, and a group meets the blocks in lanes."""
    size = lambda df: df.agg(F.sum(F.length("vectors") + F.length("cells"))).first()[0] or 0
    named = queries.select("q_block", "dim", F.struct(*[c for c in queries.columns if c not in ("q_block", "dim")]).alias("q"))
    laid = blocks.select("block", "dim", F.struct("n", "ids", "cells", "scales", "errors", "lengths", "kind", "vectors").alias("c"))
    groups = math.ceil(size(queries) / GROUP_BYTES)
    if groups <= 1:
        return laid.join(F.broadcast(named), "dim")
    lanes = max(blocks.sparkSession.sparkContext.defaultParallelism, math.ceil(size(blocks) / LANE_BYTES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = named.withColumn("group", F.pmod(F.xxhash64("q_block"), F.lit(groups)).cast("int")).withColumn("lane", each(lanes))
    return laid.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int")).withColumn("group", each(groups)).join(dealt, ["dim", "group", "lane"])


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest candidates of each row whose id is divisible by `every`.

    The bounds are exact, so the result is that of all pairs. Ties go to the smaller vec_id. A row is no
    candidate of itself; rows that repeat its id are, and each has neighbours of its own. Rows with a null id,
    or a vector that is null, empty, zero or holds a null or non-finite component, take no part; vectors of
    different lengths aren't compared. Sums that overflow are infinite; what isn't a number is minus infinity.
    Empty table: no rows. Extra columns are ignored.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    block_rows, query_rows, tile = BLOCK_ROWS, QUERY_ROWS, TILE
    blocks = staged(own.transform(in_arrow, lambda b: _packed(b, every, k, block_rows), BLOCKS), "neighbour-blocks", codec="none")
    asking = blocks.where(F.length("q_at") > 0)
    n = asking.agg(F.sum(F.length("q_at") / 8)).first()[0] or 0
    queries = staged(asking.repartition(max(1, math.ceil(n / (4 * query_rows)))).transform(in_arrow, lambda b: _asked(b, query_rows), QUERIES), "neighbour-queries", codec="none")

    def run(batches):
        heaps: dict[int, list[list]] = {}
        names: dict[int, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                block, q_block, qr, cr = (batch.column(c)[i].as_py() for c in ("block", "q_block", "q", "c"))
                q, c = Quantised.read(qr), Quantised.read(cr)
                ids, cut = np.frombuffer(cr["ids"], "<i8"), np.frombuffer(qr["cut"], "<f8").copy()
                own = np.where(np.frombuffer(qr["home"], "<i8") == block, np.frombuffer(qr["at"], "<i8"), -1)
                best = heaps.setdefault(q_block, [[] for _ in range(qr["n"])])
                names.setdefault(q_block, np.frombuffer(qr["ids"], "<i8").tolist())
                for j, heap in enumerate(best):
                    if len(heap) == k:
                        cut[j] = max(cut[j], heap[0][0])
                for a in range(0, qr["n"], tile):
                    rows = np.arange(a, min(a + tile, qr["n"]))
                    at_q, at_c = survivors(q, rows, c, cut[rows], own[rows], k)
                    for p in range(0, len(at_q), PAIRS):
                        who, col = rows[at_q[p : p + PAIRS]], at_c[p : p + PAIRS]
                        score = exact(q.vectors[who], c.vectors[col])
                        keep = best_rows(who, score, k)
                        for j, score, other in zip(who[keep].tolist(), score[keep].tolist(), ids[col[keep]].tolist()):
                            heap, item = best[j], (score, -other)
                            if len(heap) < k:
                                heapq.heappush(heap, item)
                            elif item > heap[0]:
                                heapq.heapreplace(heap, item)
        for q_block, best in heaps.items():
            found = [(q_block, j, names[q_block][j], -other, score) for j, heap in enumerate(best) for score, other in heap]
            if found:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), kinds)], names=["q_block", "q_row", "query_id", "vec_id", "score"])

    found = met(blocks, queries).transform(in_arrow, run, "q_block long, q_row int, query_id long, vec_id long, score double")
    order = Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row_no, vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), s AS (
  SELECT a.row_no AS query_row, a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.x, b.x) AS score
  FROM v a JOIN v b ON a.row_no <> b.row_no WHERE a.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
