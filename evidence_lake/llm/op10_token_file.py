"""Token-id files by Simple-8b word-aligned coding.

A record holds whole documents, about BLOCK ids: their doc_ids and lengths, then the ids in
mini-blocks of MINI values. A 64-bit word has a 4-bit selector above 60 bits that hold as many
values as fit at one width; a mini-block's first word is found by a table of offsets, so that
mini-blocks decode independently and each selector's words unpack at once. Values of 60 bits or
more are escapes: an all-ones word marks one and its value is listed at the record's end.
Records are rows of a Parquet file each, in order (`shard`, `record`).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_lake.llm import tokens
from evidence_lake.llm.common import documents, in_arrow, staged

MAGIC = b"ELS8"
MINI = 1024
BLOCK = 1 << 18
#: selector -> (values in a word, bits of each)
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNT = np.array([c for c, _ in SELECTORS])
ESCAPE = (1 << 60) - 1
HEADER = struct.Struct("<4sIQQII")


def bit_widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value takes, 0 for 0."""
    if values.max(initial=0) < 2**53:  # a double's exponent
        return np.maximum((values.astype(np.float64).view(np.int64) >> 52) - 1022, 0).astype(np.uint8)
    high = values >> np.uint64(32)
    return np.where(high > 0, bit_widths(high) + np.uint8(32), bit_widths(values & np.uint64(0xFFFFFFFF)))


def pack_words(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each mini-block, escaped values) of an array of uint64."""
    n = len(values)
    minis = -(-n // MINI)
    big = values >= ESCAPE
    escapes = values[big]
    body = np.zeros(minis * MINI, np.uint64)
    body[:n] = np.where(big, np.uint64(ESCAPE), values) if len(escapes) else values
    grid = np.zeros((minis, MINI + 240), np.uint64)
    grid[:, :MINI] = body.reshape(minis, MINI)
    width = np.zeros(grid.shape, np.uint8)
    width[:, :MINI] = bit_widths(body).reshape(minis, MINI)
    # widest value among the next c, for each count c, from windows of a power of two
    power, windows = 1, {1: width}
    while power < 128:
        w = windows[power].copy()
        np.maximum(w[:, :-power], windows[power][:, power:], out=w[:, :-power])
        windows[2 * power] = w
        power *= 2
    choice = np.full((minis, MINI), 15, np.uint8)
    for s in range(14, -1, -1):
        c, bits = SELECTORS[s]
        p = 1 << (c.bit_length() - 1)
        most = windows[p][:, :MINI]
        if c > p:
            most = np.maximum(most, windows[p][:, c - p : c - p + MINI])
        choice[most <= bits] = s
    # all mini-blocks walk their words in step
    sizes = np.minimum(MINI, n - MINI * np.arange(minis))
    at, live = np.zeros(minis, np.int64), np.arange(minis)
    rows, starts = [], []
    while len(live):
        here = at[live]
        rows.append(live)
        starts.append(here)
        at[live] = here + COUNT[choice[live, here]]
        live = live[at[live] < sizes[live]]
    row, start = (np.concatenate(rows), np.concatenate(starts)) if rows else (np.zeros(0, np.int64),) * 2
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    selector = choice[row, start] if len(row) else np.zeros(0, np.uint8)
    words = selector.astype(np.uint64) << np.uint64(60)
    for s, (c, bits) in enumerate(SELECTORS):
        if bits and len(pick := np.flatnonzero(selector == s)):
            got = grid[row[pick][:, None], start[pick][:, None] + np.arange(c)]
            got <<= (np.arange(c) * bits).astype(np.uint64)
            words[pick] |= np.bitwise_or.reduce(got, axis=1)
    offsets = np.searchsorted(row, np.arange(minis)).astype(np.uint32)
    return words, offsets, escapes


def unpack_words(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n values, decoding all words of a selector at once."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNT[selector]
    minis = len(offsets)
    ends = np.cumsum(count)
    before = ends - count
    of = np.searchsorted(offsets, np.arange(len(words)), side="right") - 1 if minis else np.zeros(0, np.int64)
    inside = before - before[offsets.astype(np.int64)][of] if len(words) else before
    grid = np.zeros((minis, MINI + 240), np.uint64)
    for s, (c, bits) in enumerate(SELECTORS):
        if bits and len(pick := np.flatnonzero(selector == s)):
            got = words[pick][:, None] >> (np.arange(c) * bits).astype(np.uint64)
            grid[of[pick][:, None], inside[pick][:, None] + np.arange(c)] = got & np.uint64((1 << bits) - 1)
    out = grid[:, :MINI].reshape(-1)[:n]
    if len(escapes):
        out[out == np.uint64(ESCAPE)] = escapes
    return out


def write_record(doc_ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets, escapes = pack_words(ids.astype(np.uint64))
    head = HEADER.pack(MAGIC, len(sizes), len(ids), len(words), len(offsets), len(escapes))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), known.astype("u1").tobytes(), sizes.astype("<i8").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()])


def read_record(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, whether each is known, sizes, ids) of a record."""
    magic, docs, n, n_words, n_offsets, n_escapes = HEADER.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token record")
    at = HEADER.size

    def take(kind: str, many: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(raw, kind, many, at)
        at += got.nbytes
        return got

    doc_ids, known, sizes, offsets = take("<i8", docs), take("u1", docs), take("<i8", docs), take("<u4", n_offsets)
    words, escapes = take("<u8", n_words), take("<u8", n_escapes)
    return doc_ids, known.astype(bool), sizes, unpack_words(words, offsets, escapes, n)


def written(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """shard, record, before (ids before it in its shard), n_ids, body: the file, in ascending doc_id order.

    Documents are dealt out by ranges of doc_id (null first; among equal ids by text), so shard s
    holds smaller ids than shard s + 1; a hot id is split by its texts' hash.
    """

    def run(batches):
        shard, record, before = TaskContext.get().partitionId(), 0, 0
        held, many = [], 0

        def flush():
            nonlocal record, before, held, many
            names, known, sizes, ids = (np.concatenate(x) for x in zip(*held))
            out = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([record], pa.int64()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([write_record(names, known, sizes, ids)], pa.binary())],
                names=["shard", "record", "before", "n_ids", "body"],
            )
            record, before, held, many = record + 1, before + len(ids), [], 0
            return out

        for rows, ids, size in tokens.encoded(batches, path):
            col = rows.column("doc_id")
            known = col.is_valid().to_numpy(zero_copy_only=False)
            names = col.fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(size)
            a = 0
            while a < len(size):  # whole documents up to `block` ids, at least one
                done = ends[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(ends, done + block - many, side="right")))
                held.append((names[a:b], known[a:b], size[a:b], ids[done : ends[b - 1]]))
                many += int(ends[b - 1] - done)
                a = b
                if many >= block or a < len(size):
                    yield flush()
        if held:
            yield flush()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    return staged(dealt.transform(in_arrow, run, "shard long, record long, before long, n_ids long, body binary", encodes=True), "token-file")


def read_back(file: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the file, decoded from its records."""
    totals = file.groupBy("shard").agg(F.sum("n_ids").alias("total")).orderBy("shard").toPandas()  # a row for each shard
    totals["base"] = totals["total"].cumsum() - totals["total"]
    base = file.sparkSession.createDataFrame([(int(s), int(b)) for s, b in zip(totals["shard"], totals["base"])], "shard long, base long")

    def run(batches):
        for batch in batches:
            for first, body in zip(batch.column("first").to_pylist(), batch.column("body")):
                names, known, sizes, ids = read_record(body.as_buffer().to_pybytes())
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, mask=~known), pa.array(first + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    rows = file.join(F.broadcast(base), "shard").select((F.col("base") + F.col("before")).alias("first"), "body")
    return rows.transform(in_arrow, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and digest, read back from the file written in ascending doc_id order.

    Null or empty text: the end id alone. Null doc_id comes first; rows that repeat a doc_id are
    documents of their own. Empty table: an empty file and no rows. Extra columns are ignored.
    """
    return read_back(written(documents(spark, sf_dir), tokens.default_path()))
