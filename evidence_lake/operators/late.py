"""Late interaction over token matrices: texts as ragged matrices of token vectors, scored by sums of maxima.

An encoder gives vectors for lists of tokens, for queries and for documents; each distinct token of a task's
batch is encoded once. A text's matrix is one binary cell. Candidate pairs of one query are scored by a single product
of the query's matrix and all its documents' matrices laid end to end, with a maximum over each document's part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_lake.functions.text import word_tokens
from evidence_lake.operators import blocks, retrieval

#: Query matrices of at most so many bytes, measured, are broadcast.
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class TokenEncoder:
    """Two loaders, called once a task: each gives a function of tokens to a matrix with a row of `dims` for each."""

    dims: int
    query: Callable[[], Callable[[list[str]], np.ndarray]]
    document: Callable[[], Callable[[list[str]], np.ndarray]]


def hashed_encoder(dims: int = 8) -> TokenEncoder:
    """Unit vectors from a token's md5, four hexadecimal digits an entry: a stand-in for a model, alike on both sides. dims: 8 at most."""

    def load():
        def encode(tokens: list[str]) -> np.ndarray:
            raw = b"".join(hashlib.md5(t.encode()).digest()[: 2 * dims] for t in tokens)
            cells = np.frombuffer(raw, ">u2").reshape(len(tokens), dims) / 32768.0 - 1.0
            return cells / np.sqrt((cells**2).sum(axis=1))[:, None]

        return encode

    return TokenEncoder(dims, load, load)


def matrices(texts: DataFrame, key: str, encoder: TokenEncoder, side: str = "document", text: str = "text") -> DataFrame:
    """key, cells: a row of the matrix for each distinct token, in order of first use; texts without tokens have no cells."""
    load, dims = getattr(encoder, side), encoder.dims

    def run(batches):
        encode = load()
        for batch in batches:
            tokens = batch.column("tokens")
            coded = tokens.flatten().dictionary_encode()
            known = np.asarray(encode(coded.dictionary.to_pylist()), "<f8").reshape(-1, dims) if len(coded.dictionary) else np.zeros((0, dims))
            rows = known[coded.indices.to_numpy(zero_copy_only=False)]
            ends = np.concatenate([[0], np.cumsum(tokens.value_lengths().to_numpy(zero_copy_only=False))])
            cells = [rows[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(cells, pa.binary())], names=[key, "cells"])

    own = texts.select(F.col(key).alias("key"), F.array_distinct(F.coalesce(word_tokens(F.col(text)), F.array().cast("array<string>"))).alias("tokens"))
    return blocks.in_arrow(own, run, f"{key} {dict(texts.dtypes)[key]}, cells binary")


def max_sims(query: np.ndarray, documents: list[np.ndarray]) -> np.ndarray:
    """For each document the sum over the query's rows of the largest inner product with one of its rows; 0 if either is empty."""
    sizes = np.array([len(d) for d in documents], np.int64)
    out, some = np.zeros(len(documents)), np.flatnonzero(sizes)
    if len(some) and len(query):
        product = query @ np.concatenate([documents[i] for i in some]).T
        out[some] = np.maximum.reduceat(product, np.concatenate([[0], np.cumsum(sizes[some])[:-1]]), axis=1).sum(axis=0)
    return out


def scored(candidates: DataFrame, query_cells: DataFrame, document_cells: DataFrame, dims: int) -> DataFrame:
    """query_id, id, score (six digits) of candidates (query_id, id). A pair whose query or document has no matrix is left out."""
    size = query_cells.agg(F.sum(F.length("cells"))).first()[0] or 0
    q = query_cells.select("query_id", F.col("cells").alias("q_cells"))
    pairs = candidates.select("query_id", "id").join(document_cells.select("id", "cells"), "id").join(F.broadcast(q) if size <= BROADCAST_BYTES else q, "query_id")
    kinds = dict(candidates.dtypes)

    def run(batches):
        for batch in batches:
            mine = batch.column("q_cells").dictionary_encode()
            code = mine.indices.to_numpy(zero_copy_only=False)
            scores = np.zeros(batch.num_rows)
            matrix = lambda raw: np.frombuffer(raw.as_buffer(), "<f8").reshape(-1, dims)
            for j in range(len(mine.dictionary)):
                at = np.flatnonzero(code == j)
                scores[at] = max_sims(matrix(mine.dictionary[j]), [matrix(batch.column("cells")[i]) for i in at.tolist()])
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("id"), pa.array(blocks.rounded(scores))], names=["query_id", "id", "score"])

    return blocks.in_arrow(pairs.select("query_id", "id", "q_cells", "cells"), run, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")


def rerank(candidates: DataFrame, queries: DataFrame, points: DataFrame, k: int, encoder: TokenEncoder | None = None) -> DataFrame:
    """query_id, id, score, rank: candidates (query_id, id) by late interaction of queries (query_id, text) and points (id, text); only candidates' texts are encoded."""
    encoder = encoder or hashed_encoder()
    texts = points.select("id", "text").join(candidates.select("id").distinct(), "id", "left_semi")
    found = scored(candidates, matrices(queries, "query_id", encoder, "query"), matrices(texts, "id", encoder), encoder.dims)
    return retrieval.top(found, k, ["query_id"])
