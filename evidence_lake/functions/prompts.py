"""Prompt blocks and answers made of retrieved passages."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOINER = "\n\n---\n\n"


def check_template(name: str, template: str, allowed: set[str]) -> None:
    """Raises for a broken brace or a placeholder that isn't allowed, naming both."""
    try:
        used = {f for _, f, _, _ in string.Formatter().parse(template) if f is not None}
    except ValueError as bad:
        raise ValueError(f"template {name!r}: {bad}") from bad
    if used - allowed:
        raise ValueError(f"template {name!r} has {sorted(used - allowed)}; supported: {sorted(allowed)}")


def filled(template: str, **values: Column) -> Column:
    """The template with columns in its placeholders."""
    parts = []
    for text, field, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(text))
        if field is not None:
            parts.append(F.coalesce(values[field].cast("string"), F.lit("")))
    return F.concat(*parts)


def header(rank: Column, paper: Column, section: Column) -> Column:
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f" | {label}="), c)).otherwise("")
    return F.concat(F.lit("[Context "), rank.cast("string"), part("paper_id", paper), part("section", section), F.lit("]"))


def contexts(rows: DataFrame, key: str, order: str = "rank", joiner: str = JOINER) -> DataFrame:
    """key, context: the passages (paper_id, section_type, text) in order, each under its header."""
    block = F.concat(header(F.col(order), F.col("paper_id").cast("string"), F.col("section_type")), F.lit("\n"), F.col("text"))
    parts = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b")))).alias("p"))
    return parts.select(key, F.array_join(F.col("p.b"), joiner).alias("context"))


def concatenated(rows: DataFrame, key: str, order: str = "rank") -> DataFrame:
    """key, answer, evidences: the texts in order, each with its provenance."""
    evidence = F.struct(F.col(order).alias("o"), "paper_id", F.col("text").alias("snippet"), F.col("section_type").alias("section"), F.lit("simple-generator").alias("model_id"), F.lit("concatenate").alias("prompt_id"))
    parts = rows.groupBy(key).agg(F.sort_array(F.collect_list(evidence)).alias("evidences"))
    return parts.select(key, F.array_join(F.col("evidences.snippet"), "\n\n").alias("answer"), "evidences")


def three_digits(c: Column, plain: Column) -> Column:
    """A decimal to three digits, halves up; numbers that no decimal holds as they print."""
    return F.coalesce(F.round(c, 3).cast("string"), F.format_string("%.3f", plain))


def by_category(rows: DataFrame, key: str) -> DataFrame:
    """key, block: for each category in the order of its first rank its mean score and its scored texts.

    Means are of decimals, so they are the same in any order of the rows, and halves are exactly halves.
    """
    exact = F.col("score").try_cast("decimal(28,12)")
    line = F.concat(F.lit("  • "), three_digits(exact, F.col("score")), F.lit(": "), F.col("text"))
    mean = F.when(F.count(exact) == F.count("score"), F.avg(exact))
    groups = rows.groupBy(key, "category").agg(F.min("rank").alias("first"), mean.alias("mean"), F.avg("score").alias("plain"), F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))).alias("p"))
    block = F.concat(F.lit("\n"), F.upper("category"), F.lit(" (avg "), three_digits(F.col("mean"), F.col("plain")), F.lit("):\n"), F.array_join(F.col("p.l"), "\n"))
    parts = groups.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("first", block.alias("b")))).alias("q"))
    return parts.select(key, F.array_join(F.col("q.b"), "\n").alias("block"))


def classification(papers: DataFrame, blocks: DataFrame, template: str, categories: dict[str, str], schema: str, extra: dict[str, str] | None = None) -> DataFrame:
    """paper_id, prompt of papers (paper_id, title, abstract, keywords) with their evidence blocks (paper_id, block).

    A paper without evidence has no extracts heading, nor the blank lines after it.
    """
    extra = extra or {}
    check_template("user prompt", template, {"categories", "title", "abstract", "keywords", "chunks_info", "schema", *extra})
    lines = F.lit("\n".join(f"{k} – {v}" for k, v in categories.items()))
    values = {"categories": lines, "title": F.col("title"), "abstract": F.coalesce("abstract", F.lit("N/A")), "keywords": F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), ", "), "chunks_info": F.col("block"), "schema": F.lit(schema)}
    whole = filled(template, **values, **{k: F.lit(v) for k, v in extra.items()})
    bare = F.regexp_replace(whole, r"(?i)\*\*Relevant Extracts[^\n]*\*\*[ \t]*\n(?:[ \t]*\n)*", "")  # fixed value: the heading that templates have
    joined = papers.join(blocks.select("paper_id", "block"), "paper_id", "left")
    return joined.select("paper_id", F.when(F.col("block").isNull(), bare).otherwise(whole).alias("prompt"))
