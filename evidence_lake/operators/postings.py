"""Sparse search over texts: postings in blocks of documents, with the best weight of each term as a bound.

A block of documents and a block of queries meet once. A query's bound on a block is the sum of its weights
times the block's best weights; a block whose bound is below the query's k-th best score so far is passed over.
In a visited block terms go by falling bound; when those left can't lift a new document to that score, only
documents that may still reach it are looked up. Weights have six digits and are held as whole numbers, so
scores are exact in any order, and so is the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_lake.functions.text import word_tokens
from evidence_lake.operators import blocks

BLOCK_DOCS = 1024
QUERY_DOCS = 256
#: Weights are log(1 + occurrences), to six digits.
UNIT = 1_000_000


@dataclass
class Postings:
    """Terms of some texts: term t stands in the texts at[starts[t]:starts[t + 1]], ascending, with these weights."""

    terms: list[bytes]
    starts: np.ndarray
    at: np.ndarray
    weights: np.ndarray
    n: int

    @classmethod
    def of(cls, tokens: pa.ListArray) -> Postings:
        n = len(tokens)
        flat = tokens.flatten()
        text = np.repeat(np.arange(n), tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        coded = flat.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        keys, many = np.unique(code * max(1, n) + text, return_counts=True)
        term = keys // max(1, n)
        starts = np.searchsorted(term, np.arange(len(coded.dictionary) + 1))
        weights = np.rint(np.log1p(many) * UNIT).astype(np.int64)
        return cls([x.encode() for x in coded.dictionary.to_pylist()], starts, keys % max(1, n), weights, n)

    def fields(self) -> list[bytes]:
        return [b" ".join(self.terms), self.starts.astype("<i4").tobytes() + self.at.astype("<i4").tobytes() + self.weights.astype("<i4").tobytes()]

    @classmethod
    def read(cls, terms: bytes, cells: bytes, n: int) -> Postings:
        names = terms.split()
        all_ = np.frombuffer(cells, "<i4")
        starts = all_[: len(names) + 1]
        at, weights = all_[len(names) + 1 :].reshape(2, -1)
        return cls(names, starts, at, weights.astype(np.int64), n)

    def of_term(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[t], self.starts[t + 1])
        return self.at[part], self.weights[part]

    def bests(self) -> np.ndarray:
        """The best weight of each term."""
        return np.maximum.reduceat(self.weights, self.starts[:-1]) if self.terms else np.zeros(0, np.int64)


def asked(block: Postings, queries: Postings) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query (the block's terms, the query's weights, bounds of the products), by falling bound."""
    place = {t: i for i, t in enumerate(block.terms)}
    both = [(t, place[x]) for t, x in enumerate(queries.terms) if x in place]
    bests = block.bests()
    spans = [queries.of_term(t) for t, _ in both]
    query = np.concatenate([a for a, _ in spans]) if spans else np.zeros(0, np.int64)
    weight = np.concatenate([w for _, w in spans]) if spans else np.zeros(0, np.int64)
    term = np.repeat(np.array([i for _, i in both], np.int64), [len(a) for a, _ in spans])
    bound = weight * bests[term]
    order = np.lexsort((-bound, query))
    ends = np.searchsorted(query[order], np.arange(queries.n + 1))
    return [tuple(x[order[a:b]] for x in (term, weight, bound)) for a, b in zip(ends, ends[1:])]


def scored(block: Postings, terms: np.ndarray, weights: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a query with a score above 0 and of at least `least`; the others may be left out."""
    left = int(bounds.sum())
    if not left or left < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.zeros(block.n, np.int64)
    alive = None
    for t, w, b in zip(terms.tolist(), weights.tolist(), bounds.tolist()):
        at, own = block.of_term(t)
        if alive is None:
            total[at] += w * own
        else:
            place = np.minimum(np.searchsorted(at, alive), len(at) - 1)
            hit = at[place] == alive
            total[alive[hit]] += w * own[place[hit]]
        left -= b
        if left < least:  # no other document can get there
            alive = np.flatnonzero(total + left >= least) if alive is None else alive[total[alive] + left >= least]
            if not len(alive):
                break
    found = np.flatnonzero(total > 0) if alive is None else alive[total[alive] > 0]
    return found, total[found]


def first(ids: list, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, of equal scores the smaller ids (which ascend)."""
    return np.lexsort((np.arange(len(ids)), -scores))[:k]


def rounded(scores: np.ndarray) -> np.ndarray:
    """Products of two weights to six digits, halves up."""
    return (scores + UNIT // 2) // UNIT


def _packed(df: DataFrame, name: str, text: Column, rows: int, prefix: str) -> DataFrame:
    kind = dict(df.dtypes)[name]

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                part = batch.slice(a, rows)
                order = pc.sort_indices(part.column("id"))
                part = part.take(order)
                ids, n = part.column("id"), part.num_rows
                terms, cells = Postings.of(part.column("tokens")).fields()
                lists = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([lists, pa.array([terms], pa.binary()), pa.array([cells], pa.binary())], names=[f"{prefix}ids", f"{prefix}terms", f"{prefix}cells"])

    own = df.select(F.col(name).alias("id"), F.coalesce(word_tokens(text), F.array().cast("array<string>")).alias("tokens"))
    return blocks.in_arrow(own, run, f"{prefix}ids array<{kind}>, {prefix}terms binary, {prefix}cells binary")


def sparse(queries: DataFrame, points: DataFrame, k: int, text: str = "text") -> DataFrame:
    """query_id, id, score: for each query (query_id, text) the k points (id, text) of the largest sums of products of weights, k of each task; ties to the smaller id. Only scores above 0 count.

    Texts that are null or without tokens match nothing. Cut the rows with retrieval.top.
    """
    kinds = {"query_id": dict(queries.dtypes)["query_id"], "id": dict(points.dtypes)["id"]}
    p = _packed(blocks.spread(points), "id", F.col(text), BLOCK_DOCS, "")
    q = _packed(queries, "query_id", F.col(text), QUERY_DOCS, "q_")

    def run(batches):
        best: dict[tuple, list[list]] = {}
        names: dict[tuple, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in ("q_ids", "q_terms", "q_cells", "ids", "terms", "cells")}
                key = (r["q_terms"], r["q_cells"], tuple(r["q_ids"]))
                held = best.setdefault(key, [[] for _ in r["q_ids"]])
                names.setdefault(key, r["q_ids"])
                block = Postings.read(r["terms"], r["cells"], len(r["ids"]))
                queries_ = Postings.read(r["q_terms"], r["q_cells"], len(r["q_ids"]))
                for j, how in enumerate(asked(block, queries_)):
                    # scores that round to the k-th best may be as much as half a unit below it
                    least = -held[j][-1][0] * UNIT - UNIT // 2 if len(held[j]) == k else 1
                    at, scores = scored(block, *how, least)
                    if len(at):
                        scores = rounded(scores)
                        keep = first(at, scores, k)
                        held[j] = sorted([*held[j], *((-s, r["ids"][d]) for s, d in zip(scores[keep].tolist(), at[keep].tolist()))])[:k]
        for key, held in best.items():
            out = [(names[key][j], d, -s / UNIT) for j, hits in enumerate(held) for s, d in hits]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["query_id", "id", "score"])

    types = [_arrow(queries, "query_id"), _arrow(points, "id"), pa.float64()]
    return blocks.in_arrow(blocks.met(p, q).select("q_ids", "q_terms", "q_cells", "ids", "terms", "cells"), run, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)
