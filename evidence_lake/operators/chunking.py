"""Chunkers: column expressions from a text to the array of its pieces, and the explode around them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_lake.functions.text import nonblank, py_strip, uuid5
from evidence_lake.functions.vectors import dot, norm
from evidence_lake.operators.blocks import in_arrow

Chunker = Callable[[Column], Column]


def none() -> Chunker:
    return lambda text: F.array(text)


def sentence() -> Chunker:
    return lambda text: nonblank(F.split(py_strip(text), r"(?<=[.!?])\s+"))


def paragraph(least_chars: int = 50, least_words: int = 6) -> Chunker:
    """Paragraphs between blank lines that are long enough."""
    return lambda text: F.filter(nonblank(F.split(text, r"\n\s*\n")), lambda p: (F.length(p) >= least_chars) & (F.size(F.split(p, r"\s+")) >= least_words))


def _windows(text: Column, size: int, step: int) -> Column:
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return nonblank(F.transform(starts, lambda i: text.substr(i + 1, F.lit(size))))


def fixed_size(size: int = 600, overlap: int = 100) -> Chunker:
    """Windows of `size` characters that overlap; also those inside the last full one."""
    if size <= 0 or overlap < 0:
        raise ValueError("size must be positive and overlap not negative")
    step = size - min(overlap, size - 1)
    return lambda text: _windows(text, size, step)


def recursive(most: int = 1024, inner: Chunker | None = None) -> Chunker:
    """The inner chunker's pieces, longer ones cut into slices of `most` characters."""
    inner = inner or paragraph()
    return lambda text: F.flatten(F.transform(inner(text), lambda c: F.when(F.length(c) <= most, F.array(c)).otherwise(_windows(c, most, most))))


#: Names as a workspace setting has them.
CHUNKERS: dict[str, Callable[..., Chunker]] = {"none": none, "sentence": sentence, "paragraph": paragraph, "fixed_size": fixed_size, "recursive": recursive}


def chunker(strategy: str, **params) -> Chunker:
    if strategy not in CHUNKERS:
        raise ValueError(f"unknown chunker {strategy!r}; one of {sorted(CHUNKERS)}")
    return CHUNKERS[strategy](**params)


def config(strategy: str, **params) -> dict:
    return {"strategy": strategy, **params}


def chunk(df: DataFrame, pieces: Column, keep: list[str]) -> DataFrame:
    """One row a piece: keep, chunk_ord (from 0), text."""
    # outer, as else Spark computes the pieces once more to see whether there are any
    return df.select(*keep, F.posexplode_outer(pieces).alias("chunk_ord", "text")).where("chunk_ord IS NOT NULL").withColumn("chunk_ord", F.col("chunk_ord").cast("long"))


def chunk_papers(papers: DataFrame, sections: DataFrame, how: Chunker, scope: str = "text") -> DataFrame:
    """Chunk rows of papers(paper_id, abstract) and sections(paper_id, section_ord, title, section_type, content).

    A non-empty abstract comes first, whole, as metadata; then the sections' chunks. Ids depend on the
    text alone, or on paper and text with scope="paper+text".
    """
    head = papers.where(F.coalesce("abstract", F.lit("")) != "").select(
        "paper_id", F.lit(-1).cast("long").alias("section_ord"), F.lit(0).cast("long").alias("chunk_ord"), F.col("abstract").alias("text"), F.lit("Abstract").alias("section_title"), F.lit("Abstract").alias("section_type"), F.lit(True).alias("is_metadata")
    )
    body = chunk(sections, how(F.col("content")), ["paper_id", "section_ord", F.col("title").alias("section_title"), "section_type"])
    body = body.select("paper_id", "section_ord", "chunk_ord", "text", "section_title", "section_type", F.lit(False).alias("is_metadata"))
    name = F.col("text") if scope == "text" else F.concat_ws("\x1f", "paper_id", "text")
    return head.unionByName(body).withColumn("id", uuid5(name))


def semantic_last(sentences: DataFrame, key: str, order: str, text: str, vector: str, threshold: float = 0.5) -> DataFrame:
    """key, chunk_ord, text: a sentence starts a new chunk when its cosine with the one before is below the threshold."""
    w = Window.partitionBy(key).orderBy(order)
    paired = sentences.withColumn("_before", F.lag(vector).over(w))
    cosine = F.round(dot(F.col(vector), F.col("_before")) / (norm(F.col(vector)) * norm(F.col("_before")) + 1e-9), 6)
    marked = paired.withColumn("_new", F.when(F.coalesce(cosine, F.lit(-2.0)) < threshold, 1).otherwise(0))
    grouped = marked.withColumn("_chunk", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    parts = grouped.groupBy(key, "_chunk").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("p"))
    return parts.select(key, F.col("_chunk").cast("long").alias("chunk_ord"), F.array_join(F.col("p.t"), " ").alias("text"))


def means_begin(vectors: list[np.ndarray], threshold: float) -> list[np.ndarray]:
    """For each text (a matrix of its sentences' vectors) where a chunk begins: at a sentence whose cosine with the mean of the chunk so far is below the threshold.

    All texts are folded side by side, the longest first, so that a step is one operation on those that go on.
    """
    sizes = np.array([len(v) for v in vectors], np.int64)
    order = np.argsort(-sizes, kind="stable")
    flat = np.concatenate(vectors)
    flat = flat / (np.sqrt((flat * flat).sum(axis=1)) + 1e-9)[:, None]
    starts = (np.cumsum(sizes) - sizes)[order]
    alive = np.searchsorted(-sizes[order], -np.arange(sizes.max()), side="left")  # texts with more sentences than that
    new = np.ones(len(flat), bool)
    total, n = flat[starts[: alive[0]]], np.ones(alive[0])
    for i, m in enumerate(alive.tolist()[1:], 1):
        v, total, n = flat[starts[:m] + i], total[:m], n[:m]
        mean = total / n[:, None]
        same = (v * mean).sum(axis=1) / (np.sqrt((mean * mean).sum(axis=1)) + 1e-9) >= threshold
        new[starts[:m] + i] = ~same
        total, n = np.where(same[:, None], total + v, v), np.where(same, n + 1, 1.0)
    return np.split(new, np.cumsum(sizes)[:-1])


def semantic_mean(sentences: DataFrame, key: str, order: str, text: str, vector: str, threshold: float = 0.5) -> DataFrame:
    """As semantic_last, against the normalised mean of the chunk so far; an order-dependent fold in each key. Vectors have one length."""
    parts = sentences.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"), F.col(vector).cast("array<double>").alias("v")))).alias("p"))  # a text's sentences

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("v")
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            rows = lists.flatten()
            cells = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            new = means_begin(np.split(cells, np.cumsum(size)[:-1]), threshold)
            flags = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.concatenate(new)))
            yield pa.RecordBatch.from_arrays([batch.column("p"), batch.column(key), flags], names=["p", key, "begins"])

    kinds = dict(parts.dtypes)
    texts = parts.select(F.col("p.t").alias("p"), key, F.col("p.v").alias("v"))
    marked = in_arrow(texts, run, f"p array<string>, {key} {kinds[key]}, begins array<boolean>")
    at = F.filter(F.transform("begins", lambda b, i: F.when(b, i)), lambda i: i.isNotNull())
    cuts = marked.select(key, "p", at.alias("at"))
    pieces = F.transform("at", lambda i, j: F.array_join(F.slice("p", i + 1, F.coalesce(F.try_element_at("at", j + 2), F.size("p")) - i), " "))
    return cuts.select(key, F.posexplode(pieces).alias("chunk_ord", "text")).withColumn("chunk_ord", F.col("chunk_ord").cast("long"))
