"""Exact top-k search by inner product, with a uniform threshold in three phases.

Components become floor(64 x). Rows lie in blocks, in the order of their ids; a vector's dimensions are
cut into LISTS segments, each giving a list of partial scores.
1. Each block looks at its own queries: the k best entries of each list are gathered and added up, and
   the k-th best total of a query is a safe cutoff: k entries reach it.
2. Queries take their cutoffs along. An entry of at least the cutoff has a segment of at least the
   uniform threshold, cutoff / LISTS; so a query visits only blocks where a segment's bound (by the
   segment's centre and radius) reaches that and the bounds' sum reaches the cutoff.
3. In visited blocks totals are resolved exactly, once; a block sends on a query's k best of at least
   the cutoff.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidence_lake.llm.common import in_arrow, staged

SCALE = 64.0
LISTS = 4
BLOCK_ROWS = 16384
QUERY_ROWS = 2048
#: Queries whose scores with a block are in memory at a time.
TILE = 512
#: Blocks' bounds that lie in one row.
BOUNDS = 256
LONG = 2**63 - 1

BLOCKS = "block long, dim int, n int, ids binary, kind string, cells binary, centre binary, radius binary"
QUERIES = "q_block long, dim int, q_n int, q_ids binary, q_home binary, q_at binary, q_cut binary, q_cells binary"


def _matrix(raw: bytes, n: int, kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(n, -1).astype(np.float64)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact: in floats or doubles where no sum can leave their integers, else in Python integers cut to 64 bits."""
    most = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * max(1, a.shape[1])
    if most < 2**24:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if most < 2**53:
        return a @ b.T
    exact = np.array([[int(x) for x in row] for row in a], object).reshape(a.shape) @ np.array([[int(x) for x in row] for row in b], object).reshape(b.shape).T
    return np.vectorize(lambda v: max(-LONG - 1, min(LONG, v)), otypes=[np.int64])(exact)


def _segments(dim: int) -> list[slice]:
    edge = np.linspace(0, dim, LISTS + 1).astype(int)
    return [slice(a, b) for a, b in zip(edge, edge[1:])]


def _as_long(totals: np.ndarray) -> np.ndarray:
    return totals if totals.dtype == np.int64 else totals.astype(np.int64)


def cutoffs(cells: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Phase 1 for a block's queries (its rows `at`): the k-th best total of the entries that lead the block's lists; -LONG if the block has too few."""
    n, out = len(cells), np.full(len(at), -LONG, np.int64)
    if n <= k:
        return out
    for a in range(0, len(at), TILE):
        own = at[a : a + TILE]
        lists = [_times(cells[own, s], cells[:, s]) for s in _segments(cells.shape[1])]
        many = min(k + 1, n)
        seen = np.concatenate([np.argpartition(-p, many - 1, axis=1)[:, :many] for p in lists], axis=1)
        seen.sort(axis=1)
        total = _as_long(_times(cells[own], cells))
        total = np.take_along_axis(total, seen, axis=1)
        total[seen == own[:, None]] = -LONG
        total[:, 1:][seen[:, 1:] == seen[:, :-1]] = -LONG
        out[a : a + TILE] = np.partition(total, -k, axis=1)[:, -k]
    return out


def bounds(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centre, each segment's largest distance from it) of a block."""
    centre = cells.mean(axis=0)
    return centre, np.array([np.sqrt(((cells[:, s] - centre[s]) ** 2).sum(axis=1)).max(initial=0.0) for s in _segments(len(centre))])


def visits(q: np.ndarray, cut: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Phase 2: whether each query (row) visits each block (column)."""
    total = np.zeros((len(q), len(centres)))
    some = np.zeros(total.shape, bool)
    slack = 1.0 + np.abs(q).max(initial=0.0) * (np.abs(centres).max(initial=0.0) + radii.max(initial=0.0)) * max(1, q.shape[1]) * 1e-9  # rounding
    with np.errstate(over="ignore", invalid="ignore"):
        share = cut[:, None] / LISTS
        for i, s in enumerate(_segments(q.shape[1])):
            most = q[:, s] @ centres[:, s].T + np.sqrt((q[:, s] ** 2).sum(axis=1))[:, None] * radii[:, i] + slack
            some |= ~(most < share)
            total += most
        return some & ~(total < cut[:, None]) | (cut == -LONG)[:, None]


def best_of(total: np.ndarray, cut: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase 3: (rows, columns) of each query's k best totals of at least its cutoff, ties to the first column; own: its own column or -1."""
    passing = total >= cut[:, None]
    mine = np.flatnonzero(own >= 0)
    passing[mine, own[mine]] = False
    for i in np.flatnonzero(passing.sum(axis=1) > k).tolist():
        at = np.flatnonzero(passing[i])
        got = total[i, at]
        kth = np.partition(got, -k)[-k]
        above = at[got > kth]
        keep = np.concatenate([above, at[got == kth][: k - len(above)]])
        passing[i] = False
        passing[i, keep] = True
    return np.nonzero(passing)


def _quantised(batches, every: int, k: int, rows: int):
    """Blocks of usable rows, one dimension each, and the blocks' queries: a row has the one or the other."""
    held: dict[int, list] = {}
    part, made = TaskContext.get().partitionId(), 0

    def block(dim: int):
        nonlocal made
        ids, cells = (np.concatenate(x) for x in zip(*held.pop(dim)))
        order = np.argsort(ids, kind="stable")
        ids, cells = ids[order], cells[order]
        made += 1
        name = (part << 32) + made
        kind = "<i2" if np.abs(cells).max(initial=0.0) < 2**15 else "<f8"
        centre, radius = bounds(cells)
        out = {"block": name, "dim": dim, "n": len(ids), "ids": ids.astype("<i8").tobytes(), "kind": kind, "cells": cells.astype(kind).tobytes(), "centre": centre.tobytes(), "radius": radius.tobytes(), "q_n": None, "q_at": None, "q_cut": None}
        at = np.flatnonzero(ids % every == 0)
        if len(at):
            out |= {"q_n": len(at), "q_at": at.astype("<i8").tobytes(), "q_cut": cutoffs(cells, at, k).astype("<i8").tobytes()}
        return pa.RecordBatch.from_pylist([out], schema=_BLOCK_SCHEMA)

    for batch in batches:
        ids, vectors = batch.column("vec_id"), batch.column("vector")
        size = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        size = np.where(ids.is_valid().to_numpy(zero_copy_only=False), size, -1)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        for dim in np.unique(size[size >= 0]).tolist():
            pick = np.flatnonzero(size == dim)
            flat = vectors.take(pa.array(pick)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                cells = np.floor(flat.reshape(len(pick), dim) * SCALE)
            good = np.isfinite(cells).all(axis=1)
            names, cells = ids[pick][good], cells[good]
            for a in range(0, len(names), rows):
                held.setdefault(dim, []).append((names[a : a + rows], cells[a : a + rows]))
                if sum(len(x) for x, _ in held[dim]) >= rows:
                    yield block(dim)
    for dim in list(held):
        yield block(dim)


_BLOCK_SCHEMA = pa.schema(
    [("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("kind", pa.string()), ("cells", pa.binary()), ("centre", pa.binary()), ("radius", pa.binary()), ("q_n", pa.int32()), ("q_at", pa.binary()), ("q_cut", pa.binary())]
)


def _queries(batches, rows: int):
    """The query rows of blocks, in blocks of their own, each with the place it comes from and its cutoff."""
    held: dict[int, list] = {}
    part, made = TaskContext.get().partitionId(), 0

    def out(dim: int):
        nonlocal made
        ids, home, at, cut, cells = (np.concatenate(x) for x in zip(*held.pop(dim)))
        made += 1
        fields = [pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((ids, "<i8"), (home, "<i8"), (at, "<i8"), (cut, "<i8"), (cells, "<f8"))]
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + made], pa.int64()), pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), *fields], names=["q_block", "dim", "q_n", "q_ids", "q_home", "q_at", "q_cut", "q_cells"])

    for batch in batches:
        for r in batch.to_pylist():
            at, cut = np.frombuffer(r["q_at"], "<i8"), np.frombuffer(r["q_cut"], "<i8")
            ids, cells = np.frombuffer(r["ids"], "<i8")[at], _matrix(r["cells"], r["n"], r["kind"])[at]
            for a in range(0, len(at), rows):
                own = held.setdefault(r["dim"], [])
                own.append((ids[a : a + rows], np.full(len(at[a : a + rows]), r["block"], np.int64), at[a : a + rows], cut[a : a + rows], cells[a : a + rows]))
                if sum(len(x[0]) for x in own) >= rows:
                    yield out(r["dim"])
    for dim in list(held):
        yield out(dim)


def _bounds_rows(batches):
    """BOUNDS blocks' bounds in a row."""
    held: dict[int, list] = {}

    def out(dim: int):
        names, centres, radii = zip(*held.pop(dim))
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.array(names, "<i8").tobytes()], pa.binary()), pa.array([b"".join(centres)], pa.binary()), pa.array([b"".join(radii)], pa.binary())], names=["dim", "blocks", "centres", "radii"])

    for batch in batches:
        for r in batch.to_pylist():
            own = held.setdefault(r["dim"], [])
            own.append((r["block"], r["centre"], r["radius"]))
            if len(own) >= BOUNDS:
                yield out(r["dim"])
    for dim in list(held):
        yield out(dim)


def _visits(batches):
    """q_block, block, rows: the queries of a block that visit another."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            blocks = np.frombuffer(r["blocks"], "<i8")
            q, cut = _matrix(r["q_cells"], r["q_n"]), np.frombuffer(r["q_cut"], "<i8")
            seen = visits(q, cut, _matrix(r["centres"], len(blocks)), _matrix(r["radii"], len(blocks)))
            go = np.flatnonzero(seen.any(axis=0))
            rows = [np.flatnonzero(seen[:, j]).astype("<i4").tobytes() for j in go.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(go), r["q_block"])), pa.array(blocks[go]), pa.array(rows, pa.binary())], names=["q_block", "block", "rows"])


def visiting(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, query blocks, which query rows visit which block): staged tables, the first two phases."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    blocks = staged(own.transform(in_arrow, lambda b: _quantised(b, every, k, BLOCK_ROWS), f"{BLOCKS}, q_n int, q_at binary, q_cut binary"), "vector-blocks")
    n_queries = blocks.agg(F.sum("q_n")).first()[0] or 0
    asked = blocks.where("q_n > 0").select("block", "dim", "n", "ids", "kind", "cells", "q_at", "q_cut").repartition(max(1, -(-n_queries // (4 * QUERY_ROWS))))
    q_blocks = staged(asked.transform(in_arrow, lambda b: _queries(b, QUERY_ROWS), QUERIES), "query-blocks")
    summaries = staged(blocks.select("block", "dim", "centre", "radius").transform(in_arrow, _bounds_rows, "dim int, blocks binary, centres binary, radii binary"), "block-bounds")
    # each query block meets each row of bounds of its dimension: never a pair of vectors, and no block's rows. A
    # dimension may be that of the whole table, so query blocks are dealt into groups and bounds into lanes
    lanes, groups = (max(1, min(vectors.sparkSession.sparkContext.defaultParallelism, x.count())) for x in (summaries, q_blocks))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = q_blocks.select("q_block", "dim", "q_n", "q_cut", "q_cells").withColumn("group", F.pmod("q_block", F.lit(groups)).cast("int")).withColumn("lane", each(lanes))
    bounds = summaries.withColumn("lane", F.pmod(F.xxhash64("blocks"), F.lit(lanes)).cast("int")).withColumn("group", each(groups))
    met = asked.join(bounds, ["dim", "group", "lane"])
    return blocks, q_blocks, staged(met.transform(in_arrow, _visits, "q_block long, block long, rows binary"), "visits")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose id is divisible by `every`.

    Ties go to the smaller vec_id. A row is no candidate of itself; rows that repeat its id are.
    Rows with a null id, a null vector, or a null or non-finite component (also after scaling) take no
    part; vectors of different dimensions aren't compared. Scores beyond 64 bits are cut to them. Empty
    table: no rows. Extra columns are ignored.
    """
    blocks, q_blocks, visited = visiting(vectors, k, every, id_col, vector_col)

    def resolve(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                rows = np.frombuffer(r["rows"], "<i4")
                take = lambda name, rows=rows, r=r: np.frombuffer(r[name], "<i8")[rows]
                q, c = _matrix(r["q_cells"], r["q_n"])[rows], _matrix(r["cells"], r["n"], r["kind"])
                q_ids, cut, ids = take("q_ids"), take("q_cut"), np.frombuffer(r["ids"], "<i8")
                own = np.where(take("q_home") == r["block"], take("q_at"), -1)
                for a in range(0, len(rows), TILE):
                    tile = slice(a, a + TILE)
                    total = _times(q[tile], c)
                    at_q, at_c = best_of(total, cut[tile], own[tile], k)
                    names = [pa.array(np.full(len(at_q), r["q_block"])), pa.array(rows[tile][at_q]), pa.array(q_ids[tile][at_q]), pa.array(ids[at_c]), pa.array(_as_long(total[at_q, at_c]))]
                    yield pa.RecordBatch.from_arrays(names, names=["q_block", "q_row", "query_id", "vec_id", "score"])

    paired = visited.join(q_blocks.drop("dim"), "q_block").join(blocks.select("block", "n", "ids", "kind", "cells"), "block")
    found = paired.transform(in_arrow, resolve, "q_block long, q_row int, query_id long, vec_id long, score long")
    best = Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.row_no AS query_row, a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.row_no <> b.row_no WHERE a.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
