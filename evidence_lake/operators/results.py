"""Results in the shapes that readers take: search results with their leftovers, and a report of each paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a chunk that a search result has fields for (fixed values); any other becomes an artifact.
KNOWN = ("id", "paper_id", "text", "section_type", "section_title", "title", "is_metadata", "score", "rrf_score", "rank_score")
#: The report's head: label and column (fixed values).
HEAD = [
    ("Title", "title"),
    ("First Author", "first_author"),
    ("Publication Year", "publication_year"),
    ("DOI", "doi"),
    ("Journal", "journal"),
    ("Analysis Type", "analysis_type"),
    ("PDF Path", "path"),
]
#: A data source's lines: label and field (fixed values).
SOURCE = [("- **Source Name:**", "source_name"), ("  - **URL:**", "url"), ("  - **Explanation:**", "explanation"), ("  - **Section Found:**", "section_found")]
NONE = "N/A"


def search_results(chunks: DataFrame, source: str, threshold: float = 0.0) -> DataFrame:
    """Chunks of a score from the threshold on as results: id, paper_id, text, section_type, section_title, title,
    is_metadata, similarity_score, rank_score, source, artifacts.

    rank_score is the fused score, else the chunk's own rank score, else its score. The titles stand in for each
    other. Columns that chunks don't have and nulls take the field's default ("", "other", false, 0). artifacts is
    a JSON object of all further columns with their nulls.
    """
    has = set(chunks.columns)

    def first(*names: str, default):
        return F.coalesce(*[F.col(c) for c in names if c in has], F.lit(default))

    score = first("score", default=0.0).cast("double")
    text = lambda *names: first(*names, default="").cast("string")
    more = [F.col(f"`{c}`") for c in chunks.columns if c not in KNOWN]
    return chunks.where(score >= threshold).select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id") if "id" in has else F.lit("").alias("id"),
        text("paper_id").alias("paper_id"),
        text("text").alias("text"),
        first("section_type", default="other").alias("section_type"),
        text("section_title", "title").alias("section_title"),
        text("title", "section_title").alias("title"),
        first("is_metadata", default=False).cast("boolean").alias("is_metadata"),
        score.alias("similarity_score"),
        F.coalesce(*[F.col(c).cast("double") for c in ("rrf_score", "rank_score") if c in has], score).alias("rank_score"),
        F.lit(source).alias("source"),
        (F.to_json(F.struct(*more), {"ignoreNullFields": "false"}) if more else F.lit("{}")).alias("artifacts"),
    )


def result_score(rank_score: Column, similarity_score: Column) -> Column:
    """The score a result is compared by."""
    return F.coalesce(rank_score.cast("double"), similarity_score.cast("double"), F.lit(0.0))


def _said(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull() | (text == ""), NONE).otherwise(text)


def _line(label: str, value: Column, end: str = "\n") -> Column:
    return F.concat(F.lit(f"{label} "), _said(value), F.lit(end))


def reports(papers: DataFrame) -> DataFrame:
    """paper_id, report: a markdown report of each row.

    papers has paper_id, the head's columns, abstract, keywords (array), and what was extracted: sources (array of
    structs source_name, url, explanation, section_found; null: nothing extracted), description, scores (array of
    structs name, score), dois (array; null: no such part). Missing and empty values read N/A. A row is one paper's
    whole result, so the report is an expression of it and nothing is shuffled.
    """
    rule, fixed = "\n---\n", lambda *lines: F.array(*[F.lit(x) for x in lines])
    nothing = F.array().cast("array<string>")
    head = F.array(F.concat(F.lit("# Paper ID: "), _said(F.col("paper_id")), F.lit("\n")), *[_line(f"**{label}:**", F.col(c)) for label, c in HEAD])
    keywords = F.array_join(F.coalesce("keywords", nothing), ", ")
    body = F.array(F.lit(rule), F.lit("## Abstract\n"), F.concat(_said(F.col("abstract")), F.lit("\n")), F.lit("## Keywords\n"), F.concat(_said(keywords), F.lit("\n")), F.lit("## Extracted Data Sources\n"))
    found = F.flatten(F.transform("sources", lambda s: F.array(*[_line(label, s[field], "\n\n" if field == SOURCE[-1][1] else "\n") for label, field in SOURCE])))
    found = F.coalesce(found, fixed("No data sources extracted.\n"))
    about = F.array(F.lit(rule), F.lit("## Data Sources Description\n"), F.concat(_said(F.col("description")), F.lit("\n")))
    scores = F.when(F.size("scores") > 0, F.concat(fixed(rule, "## Confidence Scores\n"), F.transform("scores", lambda s: F.concat(F.lit("- **"), _said(s["name"]), F.lit(":** "), _said(s["score"]), F.lit("\n\n")))))
    dois = F.when(F.col("dois").isNotNull(), F.concat(fixed(rule, "## DOIs\n"), F.transform("dois", lambda x: F.concat(F.lit("- https://doi.org/"), _said(x), F.lit("\n")))))
    lines = F.concat(head, body, found, about, F.coalesce(scores, nothing), F.coalesce(dois, nothing))
    return papers.select("paper_id", F.array_join(lines, "\n").alias("report"))
