"""Result mapping, reports, strict schemas, settings files, miners' templates, scans of one file."""

import json

import pytest
from pyspark.sql import functions as F

from evidence_lake.functions import schemas
from evidence_lake.operators import results
from evidence_lake.plans.tasks import Registry, Settings
from evidence_lake.sources import files


def test_search_results(spark):
    cols = "id long, paper_id string, text string, title string, score double, rrf_score double, rank_score double, page int, `a.b` string"
    rows = [(1, "p", "t", "T", 0.5, None, 0.7, 3, "x"), (2, None, None, None, None, 0.2, 0.9, None, None), (3, "p", "", "T", 0.5, None, None, 1, "y"), (4, "p", "t", "T", -0.1, 0.9, None, 1, "z")]
    got = {r.id: r for r in results.search_results(spark.createDataFrame(rows, cols), "dense").collect()}
    assert set(got) == {"1", "2", "3"}
    assert (got["1"].rank_score, got["2"].rank_score, got["3"].rank_score) == (0.7, 0.2, 0.5)
    assert (got["1"].section_title, got["2"].section_title, got["2"].section_type, got["2"].is_metadata, got["2"].text) == ("T", "", "other", False, "")
    assert json.loads(got["2"].artifacts) == {"page": None, "a.b": None} and json.loads(got["1"].artifacts) == {"page": 3, "a.b": "x"}
    bare = spark.createDataFrame([("k",)], "text string")
    assert results.search_results(bare, "s").first().asDict() == {"id": "", "paper_id": "", "text": "k", "section_type": "other", "section_title": "", "title": "", "is_metadata": False, "similarity_score": 0.0, "rank_score": 0.0, "source": "s", "artifacts": "{}"}
    assert results.search_results(bare, "s", 0.1).count() == 0
    scored = spark.createDataFrame([(None, 0.3), (0.0, 0.3), (None, None)], "r double, s double").select(results.result_score(F.col("r"), F.col("s")).alias("x"))
    assert [r.x for r in scored.collect()] == [0.3, 0.0, 0.0]


PAPER = "paper_id string, title string, first_author string, publication_year int, doi string, journal string, analysis_type string, path string, abstract string, keywords array<string>, sources array<struct<source_name:string,url:string,explanation:string,section_found:string>>, description string, scores array<struct<name:string,score:double>>, dois array<string>"


def test_reports(spark):
    rows = [
        ("p", "A", "B", 2001, "10/x", "J", "k", "f.pdf", "abs", ["m", "n"], [("S", None, "E", "M")], "D", [("c", 0.5)], ["10/y"]),
        ("q",) + (None,) * 13,
        ("r",) + (None,) * 8 + ([], [], "", [], []),
    ]
    got = {r.paper_id: r.report for r in results.reports(spark.createDataFrame(rows, PAPER)).collect()}
    want = """# Paper ID: p
|
**Title:** A
|
**First Author:** B
|
**Publication Year:** 2001
|
**DOI:** 10/x
|
**Journal:** J
|
**Analysis Type:** k
|
**PDF Path:** f.pdf
|
|
---
|
## Abstract
|
abs
|
## Keywords
|
m, n
|
## Extracted Data Sources
|
- **Source Name:** S
|
  - **URL:** N/A
|
  - **Explanation:** E
|
  - **Section Found:** M
|
|
|
---
|
## Data Sources Description
|
D
|
|
---
|
## Confidence Scores
|
- **c:** 0.5
|
|
|
---
|
## DOIs
|
- https://doi.org/10/y
"""
    assert got["p"] == want.replace("|", "")
    assert "No data sources extracted.\n" in got["q"] and "DOIs" not in got["q"] and "Scores" not in got["q"] and "**Title:** N/A\n" in got["q"]
    assert "No data sources" not in got["r"] and got["r"].endswith("## DOIs\n") and "## Keywords\n\nN/A\n" in got["r"]


def test_strict_schemas():
    schema = {
        "title": "An answer!", "type": "object",
        "properties": {
            "title": {"type": "string", "minLength": 2, "title": "Title"},
            "share": {"anyOf": [{"type": "object", "additionalProperties": {"type": "number"}}, {"type": "null"}]},
            "items": {"type": "array", "maxItems": 3, "items": {"$ref": "#/$defs/Item"}},
        },
        "required": [], "$defs": {"Item": {"type": "object", "properties": {"x": {"type": "integer", "default": 0}}}, "Empty": {"type": "object"}},
    }
    before = json.dumps(schema)
    item = {"type": "object", "properties": {"x": {"type": "integer"}}, "additionalProperties": False, "required": ["x"]}
    assert schemas.strict(schema) == {
        "type": "object", "additionalProperties": False, "required": ["title", "items"],
        "properties": {"title": {"type": "string"}, "items": {"type": "array", "items": {"$ref": "#/$defs/Item"}}},
        "$defs": {"Item": item, "Empty": {"type": "object", "properties": {}, "additionalProperties": False, "required": []}},
    }
    assert json.dumps(schema) == before
    assert schemas.schema_name(schema) == "An_answer_" and schemas.schema_name({}) == "response" and len(schemas.schema_name({"title": "x" * 99})) == 64


def test_settings_file(tmp_path):
    file = tmp_path / "workspace.toml"
    own = Settings("file:///w", chunker="fixed_size", chunk_size=300, threshold=0.25, mode='a "b"', extra={"llm.model": "m", "server.on": True})
    own.write(str(file))
    assert Settings.read(str(file), "file:///w") == own
    file.write_text('[indexing]\nchunk_size = 0\nchunker = ""\n[llm]\nworkflow_top_k = 7\n')
    got = Settings.read(str(file))
    assert (got.chunk_size, got.chunker, got.top_k, got.path) == (600, "paragraph", 7, tmp_path.resolve().as_uri())
    with pytest.raises(FileNotFoundError):
        Settings.read(str(tmp_path / "none.toml"))


def test_miners_have_eight_templates():
    tasks = Registry()
    for key in ("find_data_sources", "find_supplementary_links", "identify_key_references"):
        assert len(set(tasks.get(key).templates)) == 8 and len(tasks.get(key).queries()) == 8


def test_scan_of_files(spark, tmp_path):
    for name in ("b.txt", "a.md", "c.bin", "d/e.TXT"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    assert [r.path.rsplit("/", 1)[1] for r in files.listed(spark, str(tmp_path)).collect()] == ["a.md", "b.txt", "e.TXT"]
    assert [r.stem for r in files.scan(spark, str(tmp_path / "b.txt")).collect()] == ["b"]
    with pytest.raises(ValueError):
        files.scan(spark, f"file://{tmp_path}/c.bin")
