"""Section types by title, and line streams into sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Buckets in the order they are tried, with the words that put a title there.
SECTION_WORDS = {
    "introduction": ["introduction", "background", "overview", "abstract", "summary"],
    "methods": ["methods?", "materials?", "approach", "experiment(?:al)?", "procedure", "design", "methodology"],
    "results": ["results?", "findings?", "observations?"],
    "discussion": ["discussion", "conclusions?", "limitations?", "future work", "implications?"],
    "declarations": ["acknowledg(?:ement|ments)", "funding", "ethic(?:s|al)", "competing interest", "conflict of interest"],
    "references": ["references?", "bibliography", "works cited"],
    "appendices": ["appendix", "annex", "supplementary", "supplemental"],
    "data": ["data", "dataset", "survey", "census"],
    "code": ["code", "software"],
    "untitled": ["untitled"],
}
OTHER = "other"


def section_pattern(bucket: str) -> str:
    return rf"\b(?:{'|'.join(SECTION_WORDS[bucket])})\b"


def section_type(title: Column) -> Column:
    """The first bucket with a word in the title."""
    low = F.lower(F.trim(title))
    out = F.when(F.lit(False), "")
    for bucket in SECTION_WORDS:
        out = out.when(low.rlike(section_pattern(bucket)), bucket)
    return out.otherwise(OTHER)


def text_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, section_ord, title, section_type, content: one section for each paragraph between blank lines."""
    parts = F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")
    return docs.select(key, F.posexplode_outer(parts).alias("section_ord", "content")).where("content IS NOT NULL").select(key, F.col("section_ord").cast("long").alias("section_ord"), F.lit("").alias("title"), F.lit("Other").alias("section_type"), "content")


def body_size(lines: DataFrame) -> DataFrame:
    """doc_id, body: the most frequent font size, to one digit; the smaller of equals."""
    counts = lines.groupBy("doc_id", F.round("size", 1).alias("body")).count()
    order = Window.partitionBy("doc_id").orderBy(F.desc("count"), F.asc("body"))
    return counts.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("doc_id", "body")


def repeated_noise(lines: DataFrame, pages: int = 3, share: float = 0.5, most: int = 100) -> DataFrame:
    """doc_id, text of running headers and footers: short texts on many pages."""
    total = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    seen = lines.groupBy("doc_id", "text").agg(F.countDistinct("page").alias("on"))
    return seen.join(total, "doc_id").where((F.col("on") >= pages) & (F.col("on") >= share * F.col("pages")) & (F.length("text") < most)).select("doc_id", "text")


def is_heading(text: Column, size: Column, bold: Column, body: Column) -> Column:
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.length(text).between(3, 90) & (words <= 14) & text.rlike(r"\p{L}") & (bold | (size > 1.05 * body))


def line_sections(lines: DataFrame) -> DataFrame:
    """doc_id, section_ord, title, content from lines (doc_id, page, line_ord, text, size, bold).

    Noise lines go; a heading opens a section; of headings in a row the last names it; a heading
    without text opens none.
    """
    clean = lines.join(repeated_noise(lines), ["doc_id", "text"], "left_anti").join(body_size(lines), "doc_id")
    order = Window.partitionBy("doc_id").orderBy("page", "line_ord")
    marked = clean.withColumn("heading", is_heading(F.col("text"), F.col("size"), F.col("bold"), F.col("body")))
    marked = marked.withColumn("island", F.sum(F.col("heading").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct("page", "line_ord", "text")
    parts = marked.groupBy("doc_id", "island").agg(F.max(F.when(F.col("heading"), F.col("text"))).alias("title"), F.sort_array(F.collect_list(F.when(~F.col("heading"), place))).alias("l"))
    full = parts.where(F.size("l") > 0)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("island")) - 1
    return full.select("doc_id", number.cast("long").alias("section_ord"), F.coalesce("title", F.lit("")).alias("title"), F.array_join(F.col("l.text"), "\n").alias("content"))


def html_sections(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, section_ord, title, content: paragraphs under the nearest heading before them, from simple markup.

    What stands before the first heading is section 0, without a title, if it has text; the headings'
    sections count from 1. The document's head is no text.
    """
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(html), r"(?s)<!--.*?-->", ""), r"(?s)<(script|style)\b.*?</\1>", ""), r"(?s)<head\b.*?</head>", "")
    rows = pages.select(key, F.posexplode_outer(F.split(body, r"<h[1-6][^>]*>")).alias("section_ord", "piece")).where("piece IS NOT NULL")
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    lead = F.col("section_ord") == 0
    title = F.when(lead, "").otherwise(clean(F.regexp_extract("piece", r"(?s)^(.*?)</h[1-6]>", 1)))
    rest = F.when(lead, F.col("piece")).otherwise(F.regexp_replace("piece", r"(?s)^.*?</h[1-6]>", ""))
    out = rows.select(key, F.col("section_ord").cast("long").alias("section_ord"), title.alias("title"), clean(rest).alias("content"))
    return out.where("section_ord > 0 OR content <> ''")
