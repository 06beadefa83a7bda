"""File scans and loaders: which files count, how they become sections, errors as rows."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable

import pandas as pd
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidence_lake.functions.text import stem
from evidence_lake.operators.blocks import small_batches
from evidence_lake.sources.sections import section_type, text_sections

#: Parsed documents go on when they stand for so many characters.
PARSED_CHARS = 1 << 19
SUFFIXES = (".pdf", ".txt", ".md", ".text")


def supported(path) -> F.col:
    return F.lower(path).rlike(r"\.(pdf|txt|md|text)$")


def scan(spark: SparkSession, path: str, unique_stems: bool = False) -> DataFrame:
    """path, stem, content of the supported files under a folder, or of one file (ValueError, if it isn't supported); with unique_stems the last path of each stem."""
    whole = path if ":/" in path else Path(path).absolute().as_posix()
    one = F.endswith("path", F.lit("/" + whole.split(":", 1)[-1].strip("/")))
    if spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(one & ~supported(F.col("path"))).select("path").limit(1).count():
        raise ValueError(f"{path} isn't one of {', '.join(SUFFIXES)}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    files = files.where(supported(F.col("path"))).withColumn("stem", stem(F.col("path")))
    if unique_stems:
        last = Window.partitionBy("stem").orderBy(F.desc("path"))
        files = files.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return files


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path of the supported files under a folder, in order; contents aren't read."""
    return scan(spark, path).select("path").orderBy("path")


def readable(content) -> F.col:
    """Bytes as UTF-8 text; bytes that aren't are left out (with U+FFFD, where there are any)."""
    text = content.cast("string")
    return F.coalesce(F.try_validate_utf8(text), F.replace(F.make_valid_utf8(text), F.lit("\uFFFD"), F.lit("")))


def text_papers(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(papers, sections) of text and markdown files: a section for each paragraph."""
    docs = files.select(F.col("stem").alias("paper_id"), readable(F.col("content")).alias("text"))
    papers = docs.select("paper_id", F.col("paper_id").alias("title"), F.lit(None).cast("string").alias("abstract"))
    return papers, text_sections(docs, "paper_id", "text")


PARSED = "paper_id string, title string, abstract string, year int, doi string, journal string, authors array<string>, keywords array<string>, sections array<struct<title:string,content:string,references_cited:array<string>>>, refs array<struct<raw_text:string,title:string,year:int,doi:string,journal:string,authors:array<string>>>, error string"


def _local(e) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _flat(e) -> str:
    """An element's text, with the targets of references after it, blanks collapsed."""

    def walk(x) -> str:
        inner = (x.text or "") + "".join(walk(c) + (c.tail or "") for c in x)
        return f"{inner} ({x.get('target')})" if _local(x) in ("ref", "ptr") and x.get("target") else inner

    return " ".join(walk(e).split())


def _all(e, name: str) -> list:
    return [x for x in e.iter() if _local(x) == name]


def _year(e) -> int | None:
    for d in _all(e, "date"):
        if (when := (d.get("when") or "")[:4]).isdigit():
            return int(when)
    return None


def _people(e) -> list[str]:
    names = [" ".join(_flat(n) for n in _all(p, "forename") + _all(p, "surname")) for p in _all(e, "persName")]
    return [n for n in names if n]


def _id(e, kind: str) -> str | None:
    return next((_flat(x) for x in _all(e, "idno") if (x.get("type") or "").lower() == kind), None)


def parse_tei(key: str, xml: str) -> dict:
    """Metadata, sections and references of a TEI document."""
    root = ET.fromstring(xml)
    header = next(iter(_all(root, "teiHeader")), root)
    titles = _all(header, "title")
    main = next((t for t in titles if t.get("level") == "a" and _flat(t)), None)
    title = _flat(main) if main is not None else next((_flat(t) for t in titles if _flat(t)), key)
    abstract = next((a for x in _all(root, "abstract") if len(a := _flat(x)) >= 50), None)
    seen, sections = set(), []
    bodies = [x for n in ("body", "back") for x in _all(root, n)] or [root]
    for top in bodies:
        for div in _all(top, "div"):
            if div.get("type") == "references":
                continue
            paragraphs = [p for p in (_flat(x) for x in div if _local(x) == "p") if p]
            content = "\n\n".join(paragraphs)
            if content and (mark := " ".join(content.split())) not in seen:
                seen.add(mark)
                head = next((_flat(x) for x in div if _local(x) == "head"), "")
                cited = [x.get("target") for x in _all(div, "ref") if x.get("type") == "bibr" and x.get("target")]
                sections.append({"title": head or "Untitled Section", "content": content, "references_cited": cited})
    refs = []
    for b in _all(root, "biblStruct"):
        if b in _all(header, "biblStruct"):
            continue
        names, t = _people(b), next((_flat(x) for x in _all(b, "title") if _flat(x)), "")
        journal = next((_flat(x) for x in _all(b, "title") if x.get("level") == "j"), None)
        parts = [", ".join(names), t, journal or "", str(_year(b) or "")]
        refs.append({"raw_text": ". ".join(x for x in parts if x), "title": t or None, "year": _year(b), "doi": _id(b, "doi"), "journal": journal, "authors": names})
    keywords = [k for x in _all(header, "keywords") for k in (_flat(t) for t in _all(x, "term")) if k]
    journal = next((_flat(t) for t in titles if t.get("level") == "j"), None)
    return {"title": title, "abstract": abstract, "year": _year(header), "doi": _id(header, "doi"), "journal": journal, "authors": _people(header), "keywords": keywords, "sections": sections, "refs": refs}


def tei_papers(files: DataFrame) -> DataFrame:
    """One parsed row for each (paper_id, xml); a document that can't be parsed keeps its id as title and says why."""

    names = ["paper_id", "title", "abstract", "year", "doi", "journal", "authors", "keywords", "sections", "refs", "error"]

    def run(batches):
        for pdf in batches:
            out, held = [], 0
            for key, xml in zip(pdf["paper_id"], pdf["xml"]):
                row = {"paper_id": key, "title": key, "abstract": None, "year": None, "doi": None, "journal": None, "authors": [], "keywords": [], "sections": [], "refs": [], "error": None}
                try:
                    row |= parse_tei(key, xml or "")
                except ET.ParseError as bad:
                    row["error"] = str(bad)
                out.append(row)
                held += len(xml or "")
                if held >= PARSED_CHARS:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)

    small_batches(files.sparkSession)
    return files.select("paper_id", "xml").mapInPandas(run, PARSED)


def tei_sections(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("paper_id", F.posexplode("sections").alias("section_ord", "s"))
    return rows.select("paper_id", F.col("section_ord").cast("long").alias("section_ord"), "s.title", section_type(F.col("s.title")).alias("section_type"), "s.content", "s.references_cited")


def tei_metadata(parsed: DataFrame) -> DataFrame:
    """A row for each document: title, authors, year, DOI, journal, abstract, keywords, and the error of one that can't be parsed."""
    return parsed.select("paper_id", "title", "authors", "year", "doi", "journal", "abstract", "keywords", "error")


def tei_references(parsed: DataFrame) -> DataFrame:
    """A row for each entry of the documents' bibliographies, in order; entries that stand twice are two."""
    rows = parsed.select("paper_id", F.posexplode("refs").alias("ref_ord", "r"))
    return rows.select("paper_id", F.col("ref_ord").cast("long").alias("ref_ord"), "r.raw_text", "r.title", "r.authors", "r.year", "r.doi", "r.journal")


LOADERS: dict[str, Callable] = {"text": text_papers, "tei": tei_papers}


def loader(name: str) -> Callable:
    if name not in LOADERS:
        raise ValueError(f"unknown loader {name!r}; one of {sorted(LOADERS)}")
    return LOADERS[name]
