"""Inner-product search in blocks: one matrix product for each pair of a block of points and a block of queries."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Arrow batches for Python workers hold about so many bytes at most (and a row at least).
BATCH_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Queries of a block that are multiplied with a block of points at once.
TILE_ROWS = 128
POINT_ROWS = 4096
QUERY_ROWS = 1024
#: Query blocks of at most so many bytes go to every task; more are dealt into groups of this size.
BROADCAST_BYTES = 32 << 20
#: Tables below this size for each core are dealt out anew, as their files make too few tasks.
SPLIT_BYTES = 64 << 20


def rounded(x: np.ndarray) -> np.ndarray:
    """To six digits, halves away from zero."""
    return np.sign(x) * np.floor(np.abs(x) * 1e6 + 0.5) / 1e6 + 0.0


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Mask of each row's k best cells, of equals the first."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    kth = np.partition(scores, -k, axis=1)[:, -k][:, None]
    out = scores >= kth
    for i in np.flatnonzero(out.sum(axis=1) > k).tolist():
        equal = np.flatnonzero(scores[i] == kth[i])
        out[i, equal[k - int((scores[i] > kth[i]).sum()) :]] = False
    return out


def small_batches(spark) -> None:
    """From now on Arrow batches hold BATCH_BYTES at most: blocks are large rows, of which the usual number would be a whole partition."""
    if int(spark.conf.get(BATCH_CONF).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def _tidied(batches, f: Callable):
    """f's batches; after a task memory that nothing uses goes back to the system, as workers stay for later stages."""
    try:
        yield from f(batches)
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


def in_arrow(df: DataFrame, f: Callable, schema) -> DataFrame:
    """df.mapInArrow(f, schema) with batches bounded by bytes."""
    small_batches(df.sparkSession)
    return df.mapInArrow(lambda batches: _tidied(batches, f), schema)


def packed(df: DataFrame, name: str, vector: str, dims: int, rows: int, scope: str | None) -> DataFrame:
    """Blocks of df (name, vector, scope): ids in ascending order and their vectors as one matrix. Vectors that are null, of other dimensions or with null components take no part."""
    kind = dict(df.dtypes)[name]
    schema = f"ids array<{kind}>, n int, cells binary" + (f", scope {dict(df.dtypes)[scope]}" if scope else "")

    def block(key, parts):
        ids = pa.concat_arrays([x for x, _ in parts])
        cells = np.concatenate([x for _, x in parts])
        order = pc.sort_indices(ids)
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(order))
        columns = [lists, pa.array([len(ids)], pa.int32()), pa.array([cells[order.to_numpy()].tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, *([pa.array([key[0]], key[1])] if scope else [])], names=["ids", "n", "cells", *(["scope"] if scope else [])])

    def run(batches):
        held, many = {}, 0
        for batch in batches:
            v = batch.column("v")
            good = np.flatnonzero(v.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dims)
            flat = v.take(pa.array(good)).flatten()
            cells = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(good), dims)
            whole = flat.is_valid().to_numpy(zero_copy_only=False).reshape(len(good), dims).all(axis=1)
            good, cells = good[whole], cells[whole]
            if scope:
                coded = batch.column("scope").take(pa.array(good)).dictionary_encode()
                kind, code = coded.dictionary.type, coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                groups = [((x, kind), np.flatnonzero(code == i)) for i, x in enumerate(coded.dictionary.to_pylist())]
            else:
                groups = [((None, None), np.arange(len(good)))]
            for key, at in groups:
                for a in range(0, len(at), rows):
                    pick = at[a : a + rows]
                    held.setdefault(key, []).append((batch.column("id").take(pa.array(good[pick])), cells[pick]))
                    many += len(pick)
                    if sum(len(x) for x, _ in held[key]) >= rows:
                        parts = held.pop(key)
                        many -= sum(len(x) for x, _ in parts)
                        yield block(key, parts)
            if many > 16 * rows:  # many scopes: what is there goes on
                yield from (block(key, parts) for key, parts in held.items())
                held, many = {}, 0
        yield from (block(key, parts) for key, parts in held.items())

    cols = [F.col(name).alias("id"), F.col(vector).alias("v"), *([F.col(scope).alias("scope")] if scope else [])]
    return in_arrow(df.select(*cols), run, schema)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out over all cores if it is so small that its files make fewer tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df


def met(points: DataFrame, queries: DataFrame, scope: bool = False, size: int | None = None) -> DataFrame:
    """Pairs of a block of points and a block of queries, with `scope` of equal scope only.

    Query blocks of a checked size go to every task. More are dealt into groups, each of which meets the points in
    as many lanes as there are cores; a scope that many blocks have is dealt like the whole table. size: of the
    queries' cells in bytes, measured if it isn't given.
    """
    if size is None:
        size = queries.agg(F.sum(F.length("q_cells"))).first()[0] or 0
    groups, key = -(-size // BROADCAST_BYTES), ["scope"] if scope else []
    if groups <= 1:
        return points.join(F.broadcast(queries), key or F.lit(True)).drop(*key)
    lanes = points.sparkSession.sparkContext.defaultParallelism
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    p = points.withColumn("lane", F.pmod(F.xxhash64("cells"), F.lit(lanes)).cast("int")).withColumn("group", each(groups))
    q = queries.withColumn("group", F.pmod(F.xxhash64("q_cells"), F.lit(groups)).cast("int")).withColumn("lane", each(lanes))
    return p.join(q, [*key, "group", "lane"]).drop(*key)


def products(vectors: list[list[float]], dims: int):
    """A vectorised function of a vector column: its inner products with each of a few vectors, to six digits; null for vectors that are null or of other dimensions."""
    sides = np.asarray(vectors, np.float64).reshape(-1, dims)

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            good = np.array([x is not None and len(x) == dims for x in rows], bool)
            out = np.full(len(rows), None, object)
            if good.any():
                found = rounded(np.stack([np.asarray(x, np.float64) for x in rows[good]]) @ sides.T)
                out[good] = pd.Series(list(found)).to_numpy()
            yield pd.Series(out)

    return score


def nearest(queries: DataFrame, points: DataFrame, k: int, dims: int, scope: str | None = None) -> DataFrame:
    """query_id, id, score: for each pair of blocks the k points of the best inner products (to six digits; ties to the smaller id) of every query.

    queries (query_id, q), points (id, v), with `scope` of equal scope only.
    """
    kinds = dict(queries.dtypes) | {"id": dict(points.dtypes)["id"]}
    p = packed(spread(points), "id", "v", dims, POINT_ROWS, scope)
    q = packed(queries, "query_id", "q", dims, QUERY_ROWS, scope)
    q = q.select(F.col("ids").alias("q_ids"), F.col("n").alias("q_n"), F.col("cells").alias("q_cells"), *(["scope"] if scope else []))
    pairs = met(p, q, bool(scope), queries.count() * dims * 8)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[i].as_buffer(), np.float64).reshape(-1, dims) for c in ("q_cells", "cells"))
                for at in range(0, len(a), TILE_ROWS):
                    scores = rounded(a[at : at + TILE_ROWS] @ b.T)
                    row, col = np.nonzero(best(scores, k))
                    yield pa.RecordBatch.from_arrays([batch.column("q_ids")[i].values.take(pa.array(row + at)), batch.column("ids")[i].values.take(pa.array(col)), pa.array(scores[row, col])], names=["query_id", "id", "score"])

    return in_arrow(pairs.select("q_ids", "q_cells", "ids", "cells"), run, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
