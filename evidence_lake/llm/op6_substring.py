"""Substring dedup by content-defined chunking with a gear rolling hash.

A text's bytes are cut where the gear hash of the last WINDOW bytes is the least within REACH places
on either side. A cut depends on the bytes around it alone, so an insertion shifts no later chunk,
and a passage is cut the same in every document. Chunks are deduplicated by digest: one that occurs
earlier is a repeat, and runs of repeats of at least LEAST_BYTES are reported.

Documents keep their chunks' digests and lengths in arrays. Digests that occur again are found by
counting digests alone; only occurrences of those are ordered. The joins have exchanges of their own
on both sides, so that Spark can split a very common chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_lake.llm.common import documents, in_arrow, released, staged
from evidence_lake.llm.tokens import slices

WINDOW = 16
REACH = 20
#: Chunks are cut at this size at the latest, for bytes that repeat themselves.
LONGEST = 4096
#: A run of repeated chunks is reported from so many bytes on; a passage of 50 words holds one.
LEAST_BYTES = 100

_GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 77) for b in range(256)], np.uint64)


def gear(data: np.ndarray) -> np.ndarray:
    """The hash of the WINDOW bytes up to each place: sum of gear[b] << age."""
    h = _GEAR[data]
    step = 1
    while step < WINDOW:
        older = np.zeros_like(h)
        older[step:] = h[:-step] << np.uint64(step) if len(h) > step else older[step:]
        h = h + older
        step *= 2
    return (h ^ (h >> np.uint64(23))) * np.uint64(0x9E3779B97F4A7C15)


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of a text."""
    n = len(data)
    ends = []
    if n > 2 * REACH:
        h = gear(data)
        # least of the 2 * REACH + 1 places around each, from windows of a power of two
        width, power, low = 2 * REACH + 1, 1, h
        while 2 * power <= width:
            low = np.minimum(low[:-power], low[power:])
            power *= 2
        low = np.minimum(low[: n - width + 1], low[width - power : n - power + 1])
        ends = (np.flatnonzero(h[REACH : n - REACH] == low) + REACH + 1).tolist()
    out, last = [], 0
    for e in [*ends, n]:
        while e - last > LONGEST:
            last += LONGEST
            out.append(last)
        if e > last:
            out.append(e)
            last = e
    return out


def _chunks(batches):
    for batch in batches:
        for rows in slices(batch, "text", 4 << 20):
            size, digests, many = [], [], []
            for text in rows.column("text").to_pylist():
                raw = (text or "").encode()
                ends = cuts(np.frombuffer(raw, np.uint8)) if raw else []
                begins = [0, *ends[:-1]]
                digests.extend(xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(begins, ends))
                size.extend(b - a for a, b in zip(begins, ends))
                many.append(len(ends))
            edge = pa.array(np.concatenate(([0], np.cumsum(many))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("row_key"), pa.ListArray.from_arrays(edge, pa.array(size, pa.int32())), pa.ListArray.from_arrays(edge, pa.array(np.array(digests, np.uint64).view(np.int64)))],
                names=["doc_id", "row_key", "sizes", "digests"],
            )


CHUNKS = "doc_id long, row_key long, sizes array<int>, digests array<long>"


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_BYTES, inside: bool = True) -> DataFrame:
    """doc_id, row_key, start, length, n_chunks, first_doc_id of every run of chunks that occur earlier.

    start and length count UTF-8 bytes; documents come in the order of doc_id (null last) and of the
    input, a document's chunks in that of the text; first_doc_id holds the run's first chunk first (its
    own doc_id where a document repeats itself; with inside=False chunks that only occur earlier in the
    same document don't count). Null or empty texts have no chunks. Rows that repeat a doc_id are
    documents of their own. Empty table: no rows. Extra columns are ignored. docs must be a stable table
    (files). Digests have 64 bits: of 10^12 chunks about one in 20 million is taken for another's repeat.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_key"), F.col(text_col).cast("string").alias("text"))
    chunks = staged(own.transform(in_arrow, _chunks, CHUNKS), "chunks")
    each = chunks.select(F.explode("digests").alias("digest"))
    repeated = staged(each.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "repeated-chunks")
    at = chunks.select("doc_id", "row_key", F.posexplode("digests").alias("place", "digest"))
    again = staged(at.join(repeated, "digest", "left_semi"), "chunk-places")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row_key", "place")
    first = staged(again.groupBy("digest").agg(F.min(order).alias("first")), "first-chunks")
    later = F.col("first.row_key") != F.col("row_key")
    if inside:
        later = later | (F.col("first.place") != F.col("place"))
    repeats = again.join(first.select("digest", "first"), "digest").where(later)
    # a document's repeats meet its chunks' sizes
    marked = repeats.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("place", F.col("first.doc_id").alias("d")))).alias("marks"))  # a document's own chunks
    joined = marked.join(chunks.select("doc_id", "row_key", "sizes"), "row_key")
    spans = joined.transform(in_arrow, lambda batches: _runs(batches, least), "doc_id long, row_key long, start long, length long, n_chunks long, first_doc_id long")
    released(repeated)
    return spans


def _runs(batches, least: int):
    """Runs of neighbouring marks of each document, of `least` bytes and more."""
    for batch in batches:
        out = [[], [], [], [], [], []]
        for doc, key, marks, size in zip(*(batch.column(c) for c in ("doc_id", "row_key", "marks", "sizes"))):
            sizes = size.values.to_numpy()
            ends = np.cumsum(sizes, dtype=np.int64)
            place, origin = (marks.values.field(i) for i in range(2))
            place = place.to_numpy()
            begins = np.flatnonzero(np.diff(place, prepend=-2) != 1)
            lasts = np.concatenate((begins[1:], [len(place)])) - 1
            start = ends[place[begins]] - sizes[place[begins]]
            length = ends[place[lasts]] - start
            for i in np.flatnonzero(length >= least).tolist():
                for column, value in zip(out, (doc.as_py(), key.as_py(), int(start[i]), int(length[i]), int(lasts[i] - begins[i] + 1), origin[int(begins[i])].as_py())):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "row_key", "start", "length", "n_chunks", "first_doc_id"])


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that other documents have before; `substring_repeats_inside` has those of a document itself, too."""
    return repeated_spans(documents(spark, sf_dir), inside=False).drop("row_key")


def substring_repeats_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(documents(spark, sf_dir)).drop("row_key")
