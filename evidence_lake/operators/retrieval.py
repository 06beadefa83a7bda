"""Retrieval: filters, dense, sparse, keyword and hybrid search, fusion, thresholds, late interaction.

Query tables are the small side: a checked size is broadcast, a larger one is joined on its scope.
Every ranking has a total order: score descending, then id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_lake.functions.vectors import dot, max_sim, norm, unit
from evidence_lake.operators import blocks, postings

#: Query tables of at most so many rows are broadcast.
BROADCAST_QUERIES = 10_000
DEFAULTS = {"top_k": 5, "prefetch_k": 50, "rerank_top_k": 20, "rrf_k": 60}


def split_filter(filters: dict | None, allowed: list[str]) -> tuple[str | None, dict]:
    """(namespace, other filters): paper_id, else namespace, scopes the search; unknown keys raise unless nothing is known."""
    rest = dict(filters or {})
    scope = rest.pop("paper_id", None) or rest.pop("namespace", None)
    if allowed and (unknown := set(rest) - set(allowed)):
        raise ValueError(f"unknown filter keys: {sorted(unknown)}")
    return scope, rest


def matching(points: DataFrame, filters: dict, scope: str | None = None, scope_col: str = "paper_id") -> DataFrame:
    """Rows whose columns equal the filters, null-safe; the scope overrides a filter on its column."""
    wanted = filters | ({scope_col: scope} if scope is not None else {})
    return points.where(reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.lit(v)) for k, v in wanted.items()), F.lit(True)))


def small(queries: DataFrame, most: int = BROADCAST_QUERIES) -> DataFrame:
    """queries with a broadcast hint if their number allows it."""
    return F.broadcast(queries) if queries.limit(most + 1).count() <= most else queries


def top(scored: DataFrame, k: int, query: list[str], score: str = "score", tie: str = "id") -> DataFrame:
    """The k best rows of each query with `rank` from 1; partial limits run before the shuffle."""
    order = Window.partitionBy(*query).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def met(points: DataFrame, queries: DataFrame, most: int = BROADCAST_QUERIES) -> DataFrame:
    """Every point with every query: a query table of checked size is broadcast and the points stay where they are; a larger one is dealt into blocks that each point visits, in as many lanes as there are cores."""
    n = queries.count()
    if n <= most:
        return points.join(F.broadcast(queries), F.lit(True))
    groups, lanes = -(-n // most), points.sparkSession.sparkContext.defaultParallelism
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).withColumn("_lane", each(lanes))
    laid = points.withColumn("_lane", F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("int")).withColumn("_block", each(groups))
    return laid.join(dealt, ["_block", "_lane"]).drop("_block", "_lane")


def dense(queries: DataFrame, points: DataFrame, k: int, scope: str | None = None, dims: int | None = None) -> DataFrame:
    """query_id, id, score, rank by inner product of q (queries) and v (points), to six digits.

    With `scope`, queries meet the points of equal scope only (an equi-join). Vectors of known `dims` are
    multiplied in blocks, others pair by pair.
    """
    if dims:
        return top(blocks.nearest(queries, points, k, dims, scope), k, ["query_id"])
    pairs = points.join(small(queries), scope) if scope else met(points, queries)
    return top(pairs.select("query_id", "id", F.round(dot(F.col("q"), F.col("v")), 6).alias("score")), k, ["query_id"])


#: Lengths within this of 1 count as normalised.
UNIT_SLACK = 1e-6


def vector_facts(points: DataFrame, v: str = "v") -> dict:
    """What holds for a table's vectors: n, dims (null if they differ), least and largest length, whether they are normalised; null vectors don't count."""
    length = norm(F.col(v))
    row = points.where(F.col(v).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.min(F.size(v)).alias("low"), F.max(F.size(v)).alias("high"), F.min(length).alias("least"), F.max(length).alias("most")).first()
    return {"n": row.n, "dims": row.low if row.low == row.high else None, "least_norm": row.least, "most_norm": row.most, "normalised": bool(row.n) and abs(row.least - 1) <= UNIT_SLACK and abs(row.most - 1) <= UNIT_SLACK}


def cosine(queries: DataFrame, points: DataFrame, k: int, facts: dict | None = None) -> DataFrame:
    """query_id, id, score, rank by the cosine of q and v, to six digits; a zero vector's is 0.

    facts: the points' vector_facts, as kept beside an index; normalised points go as they are.
    """
    facts = facts or vector_facts(points)
    if facts["n"] and not facts["dims"]:
        raise ValueError("vectors of different dimensions have no cosine")
    own = points if facts["normalised"] else points.withColumn("v", unit(F.col("v").cast("array<double>")))
    return dense(queries.withColumn("q", unit(F.col("q").cast("array<double>"))), own, k, dims=facts["dims"] or 1)


def transformed(queries: DataFrame, chain: list, text: str = "text") -> DataFrame:
    """queries with `text` put through a chain of column transforms, in order; the text as asked stays as original_text. An empty result falls back to the text before it."""
    out = queries.withColumn("original_text", F.col(text))
    for step in chain:
        new = step(F.col(text))
        out = out.withColumn(text, F.when(F.coalesce(F.trim(new), F.lit("")) != "", new).otherwise(F.col(text)))
    return out


def sparse(query_terms: DataFrame, point_terms: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank by an inverted-index join on terms: sums of products of weights."""
    pairs = point_terms.join(small(query_terms.select("query_id", "term", F.col("weight").alias("qw"))), "term")
    return top(pairs.groupBy("query_id", "id").agg(F.round(F.sum(F.col("qw") * F.col("weight")), 6).alias("score")), k, ["query_id"])


def sparse_texts(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank as by `sparse` over the terms of queries (query_id, text) and points (id, text): blocks with bounds in place of a join of terms."""
    return top(postings.sparse(queries, points, k), k, ["query_id"])


def keyword_hits(text: Column, words: list[str]) -> Column:
    """Sum over the words (repeated ones count again) of their occurrences as substrings."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, ((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w) for w in words), F.lit(0.0)).cast("long")


def keyword(points: DataFrame, query: str, k: int, text: str = "text") -> DataFrame:
    """id, hits, rank of the best keyword matches; similarity plays no part."""
    hits = points.withColumn("hits", keyword_hits(F.col(text), query.lower().split())).where("hits > 0")
    best = hits.select("id", "hits").orderBy(F.desc("hits"), F.asc("id")).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("hits"), F.asc("id"))).cast("long"))


def fuse(lists: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """query_id, id, score, rank by reciprocal-rank fusion of lists (query_id, list_no, rank0, id, ...).

    Rows with a null id take a rank and score nothing; ties go to the row seen first.
    """
    score = F.round(F.sum(1.0 / (rrf_k + F.col("rank0") + 1)), 9).alias("score")
    seen = F.min(F.struct("list_no", "rank0")).alias("seen")
    fused = lists.where(F.col("id").isNotNull()).groupBy("query_id", "id").agg(score, seen)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("seen"), F.asc("id"))
    return fused.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).drop("seen")


def hybrid(dense_hits: DataFrame, sparse_hits: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """Fusion of two candidate lists already cut to prefetch_k."""
    one = lambda df, n: df.select("query_id", F.lit(n).alias("list_no"), (F.col("rank") - 1).alias("rank0"), "id")
    return fuse(one(dense_hits, 0).unionByName(one(sparse_hits, 1)), k, rrf_k)


def threshold(hits: DataFrame, least: float | None, score: str = "score") -> DataFrame:
    """Cut first, then the threshold: the result may have fewer than k rows."""
    return hits if least is None else hits.where(F.col(score) >= least)


def late_rerank(candidates: DataFrame, query_vectors: DataFrame, doc_vectors: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank of candidates (query_id, id) by late interaction of ql and dl."""
    rows = candidates.select("query_id", "id").join(doc_vectors.select("id", "dl"), "id").join(small(query_vectors.select("query_id", "ql")), "query_id")
    return top(rows.select("query_id", "id", F.round(max_sim(F.col("ql"), F.col("dl")), 6).alias("score")), k, ["query_id"])


def results(hits: DataFrame, points: DataFrame, source: str) -> DataFrame:
    """Hits as search results: id as text, defaults filled in, the section type `other` when unknown."""
    cols = points.columns
    pick = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in cols else F.lit(default)
    return hits.join(points, "id").select(
        "query_id",
        F.col("id").cast("string").alias("id"),
        pick("paper_id", "").alias("paper_id"),
        pick("text", "").alias("text"),
        pick("section_type", "other").alias("section_type"),
        F.col("score").alias("similarity_score"),
        F.col("score").alias("rank_score"),
        "rank",
        F.lit(source).alias("source"),
    )


MODES = ("dense_only", "sparse_only", "hybrid_candidates_only", "hybrid")


def clamp_mode(mode: str, has: set[str], explicit: bool) -> str:
    """The mode the index supports: an implicit one falls back to dense, an explicit one raises."""
    if mode not in MODES:
        raise ValueError(f"unknown retrieval mode {mode!r}")
    need = {"dense_only": {"dense"}, "sparse_only": {"sparse"}}.get(mode, {"dense", "sparse"})
    if need <= has:
        return mode
    if explicit or "dense" not in has:
        raise ValueError(f"{mode} needs {sorted(need - has)}")
    return "dense_only"


#: Quality presets: chunker, least paragraph, window, overlap, mode (fixed values).
PRESETS = {
    "fast": ("paragraph", 20, 800, 80, "dense"),
    "balanced": ("paragraph", 20, 600, 100, "hybrid"),
    "accurate": ("paragraph", 20, 500, 120, "hybrid"),
}


def setting(explicit, preset, workspace, default):
    """Explicit beats preset, preset beats workspace, workspace beats default; 0 is a value."""
    return next((x for x in (explicit, preset, workspace) if x is not None), default)


def expand_query(query: str, generated: list[str]) -> str:
    """The query with hypothetical documents after it; failed and empty ones don't count."""
    good = [d for d in generated if d.strip() and "failed" not in d.lower()]
    return "\n\n".join([query, *good])


def with_hypothetical(queries: DataFrame, made: DataFrame) -> DataFrame:
    """queries (query_id, text) with retrieval_text: the text and the generated documents (query_id, n, text) in order, failed and empty ones left out; the text alone without any.

    Candidates are searched by retrieval_text, rerankers read text.
    """
    good = made.where((F.trim("text") != "") & ~F.lower("text").contains("failed")).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("n", F.trim("text").alias("t")))).alias("made"))  # a few a query
    more = F.array_join(F.col("made.t"), "\n\n")
    return queries.join(good, "query_id", "left").select(*queries.columns, F.when(F.col("made").isNull(), F.col("text")).otherwise(F.concat("text", F.lit("\n\n"), more)).alias("retrieval_text"))
