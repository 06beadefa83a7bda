"""Rerankers: a score for (query, text), cascades, and the evidence pools of categories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_lake.functions.text import overlap_score, py_strip
from evidence_lake.operators.retrieval import small

Scorer = Callable[[Column, Column], Column]


def rerank(rows: DataFrame, scorer: Scorer, k: int, by: list[str], tie: str = "id") -> DataFrame:
    """rows (by, query, text, id) with rank_score and rank; models plug in as scorers over vectorised functions."""
    scored = rows.withColumn("rank_score", scorer(F.col("query"), F.col("text")))
    order = Window.partitionBy(*by).orderBy(F.desc("rank_score"), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def cascade(rows: DataFrame, steps: list[tuple[Scorer, int | None]], k: int, by: list[str], tie: str = "id") -> DataFrame:
    """Scorers one after the other; each but the last cuts to its own k (none: keeps all)."""
    if not steps:
        raise ValueError("a cascade needs a step")
    for i, (scorer, most) in enumerate(steps):
        last = i == len(steps) - 1
        rows = rerank(rows, scorer, k if last else most or 2**31 - 1, by, tie)
    return rows


def best_by_text(rows: DataFrame, by: list[str], score: str, ties: list[str]) -> DataFrame:
    """One row for each text (stripped, not blank): the best score, the first of equals."""
    keyed = rows.withColumn("_text", py_strip(F.col("text"))).where(F.col("_text") != "")
    order = Window.partitionBy(*by, "_text").orderBy(F.desc(score), *[F.asc(t) for t in ties])
    return keyed.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_text")


def within_label(evidence: DataFrame, category_queries: DataFrame, k: int, scorer: Scorer = overlap_score) -> DataFrame:
    """Each category's k best rows (paper_id, category, text, id, score) rescored with the category's query."""
    order = Window.partitionBy("paper_id", "category").orderBy(F.desc("score"), F.asc("id"))
    cut = evidence.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
    return rerank(cut.join(small(category_queries), "category"), scorer, k, ["paper_id", "category"])


def global_pool(evidence: DataFrame, category_queries: DataFrame, k: int, scorer: Scorer = overlap_score) -> DataFrame:
    """A paper's k best distinct texts, each rescored for every category."""
    pool = best_by_text(evidence, ["paper_id"], "score", ["category", "id"])
    order = Window.partitionBy("paper_id").orderBy(F.desc("score"), F.asc("id"))
    pool = pool.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n", "category")
    return rerank(pool.join(small(category_queries), F.lit(True)), scorer, k, ["paper_id", "category"])


def category_query(categories: DataFrame) -> DataFrame:
    """category, query: the first condensed sentence, else the first template (both arrays); a category without either raises when it is read."""
    first = F.coalesce(F.try_element_at("condensed", F.lit(1)), F.try_element_at("templates", F.lit(1)))
    return categories.select("category", F.coalesce(first, F.raise_error(F.concat(F.lit("no query for category "), "category")).cast("string")).alias("query"))


def by_text(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row for each text that isn't blank: the last of equal texts, as a later one takes the earlier one's place."""
    keyed = rows.withColumn("_text", py_strip(F.col("text"))).where("_text <> ''")
    last = Window.partitionBy(*by, "_text").orderBy(*[F.desc(c) for c in order])
    return keyed.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_text")


def select_evidence(hits: DataFrame, k: int) -> DataFrame:
    """paper_id, id, category, text, score, rank: the best category of each text, then the paper's k best.

    hits: (paper_id, category, category_ord, template_ord, rank0, id, text, score); equal scores go to
    the category, template and rank that come first.
    """
    ties = ["category_ord", "template_ord", "rank0"]
    winners = best_by_text(hits, ["paper_id"], "score", ties)
    order = Window.partitionBy("paper_id").orderBy(F.desc("score"), *[F.asc(t) for t in ties], F.asc("id"))
    ranked = winners.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    return ranked.select("paper_id", "id", "category", "text", "score", "rank")


def mine_evidence(hits: DataFrame, k: int = 15, sections: list[str] | None = None) -> DataFrame:
    """As select_evidence with one category, of the sections named (any case; none: all)."""
    rows = section_filter(hits, sections)
    return select_evidence(rows.withColumn("category", F.lit("evidence")).withColumn("category_ord", F.lit(0)), k)


def section_filter(rows: DataFrame, sections: list[str] | None, col: str = "section_type") -> DataFrame:
    return rows.where(F.lower(F.coalesce(F.col(col), F.lit(""))).isin([s.lower() for s in sections])) if sections else rows
