"""Stores that survive crashes, loaders of broken bytes, blocks of vectors, runs, prompts."""

import random

import pytest
from pyspark.sql import functions as F

from evidence_lake.functions import prompts
from evidence_lake.operators import blocks, index, rerank, retrieval, runs
from evidence_lake.sources import files, sections


def test_a_crash_between_the_writes_leaves_the_live_version(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/s"
    rows = lambda *r: spark.createDataFrame(list(r), "id string, seq long")
    store = index.Store(spark, path)
    store.write(rows(("a", 1)), {"model": "m"})
    with monkeypatch.context() as m:
        m.setattr(index.Store, "_point", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.upsert(rows(("b", 1)))
    (tmp_path / "s" / "pointers" / "_unfinished").write_text("{")
    again = index.Store(spark, path)
    assert [r.id for r in again.read().collect()] == ["a"] and again.settings() == {"model": "m"}
    again.upsert(rows(("b", 1)))
    assert {r.id for r in store.read().collect()} == {"a", "b"}


def test_of_two_writers_one_is_told(spark, tmp_path):
    store = index.Store(spark, f"file://{tmp_path}/s")
    store._point(1, {"version": "x"})
    with pytest.raises(RuntimeError):
        store._point(1, {"version": "y"})
    assert store._pointer() == {"version": "x"}


def test_metadata_store(spark, tmp_path):
    store = index.MetadataStore(spark, f"file://{tmp_path}/m")
    assert store.retrieve("d", "t", "s") is None and store.delete_doc("d") == 0
    rows = spark.createDataFrame([("d", "t", "s", "one"), ("d", "t", "s", "two"), ("d", "u", "s", ""), ("e", "t", "z", "three"), ("d", "t", "z", "four")], "doc_id string, type string, strategy string, content string")
    store.insert(rows)
    store.insert(rows.withColumn("content", F.lit("later")))
    assert store.retrieve("d", "t", "s") == "one" and store.retrieve("d", "u", "s") is None
    assert [r.doc_id for r in store.list_docs().collect()] == ["d", "e"]
    assert store.delete_by_strategy("z") == 2 and store.delete_by_strategy("z") == 0
    assert store.delete_doc("d") == 2 and store.list_docs().count() == 0


def test_run_store(spark, tmp_path):
    store = runs.RunStore(spark, f"file://{tmp_path}/r")
    for i in range(3):
        store.save(f"r{i}", "mine", "completed", f"2024-01-0{i + 1}", spark.createDataFrame([(i,)], "x long"))
    assert [r.run_id for r in store.runs(2).collect()] == ["r2", "r1"]
    assert store.results("r1").first().x == 1


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xc3\xa9\n\n\xfftwo\x80 words\xe2\x82")
    (tmp_path / "b.txt").write_bytes("genuine � stays".encode())
    _, parts = files.text_papers(files.scan(spark, str(tmp_path)))
    got = {(r.paper_id, r.section_ord): r.content for r in parts.collect()}
    assert got == {("a", 0): "café", ("a", 1): "two words", ("b", 0): "genuine � stays"}


def test_page_without_headings_and_lead(spark):
    rows = [(1, "<head><title>t</title></head><p>Only text</p>"), (2, "<p>Lead</p><h2>One</h2>in one"), (3, None), (4, "<h1>Bare</h1>")]
    got = [(r.page_id, r.section_ord, r.title, r.content) for r in sections.html_sections(spark.createDataFrame(rows, "page_id long, html string")).orderBy("page_id", "section_ord").collect()]
    assert got == [(1, 0, "", "Only text"), (2, 0, "", "Lead"), (2, 1, "One", "in one"), (4, 1, "Bare", "")]


@pytest.mark.parametrize("scope", [None, "label"])
@pytest.mark.parametrize("most", [32 << 20, 600])
def test_blocks_against_brute_force(spark, monkeypatch, scope, most):
    monkeypatch.setattr(blocks, "POINT_ROWS", 7)
    monkeypatch.setattr(blocks, "QUERY_ROWS", 4)
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", most)
    rng = random.Random(5)
    vector = lambda: [round(rng.uniform(-1, 1), 1) for _ in range(4)]
    points = [(f"p{i:02d}", vector(), i % 3) for i in range(50)] + [("same1", [1.0] * 4, 1), ("same0", [1.0] * 4, 1), ("none", None, 1), ("short", [1.0], 1), ("holes", [1.0, None, 1.0, 1.0], 1)]
    queries = [(i, vector(), i % 3) for i in range(20)]
    want = set()
    for q, a, lq in queries:
        scored = sorted((-round(sum(x * y for x, y in zip(a, b)), 6), p) for p, b, lp in points if b and len(b) == 4 and None not in b and (scope is None or lp == lq))
        want |= {(q, r + 1, p, -s) for r, (s, p) in enumerate(scored[:5])}
    p = spark.createDataFrame(points, "id string, v array<double>, label int")
    q = spark.createDataFrame(queries, "query_id long, q array<double>, label int")
    p, q = (p, q) if scope else (p.drop("label"), q.drop("label"))
    got = {(r.query_id, r["rank"], r.id, r.score + 0.0) for r in retrieval.dense(q, p, 5, scope=scope, dims=4).collect()}
    assert {(a, b, c, round(d, 6)) for a, b, c, d in got} == {(a, b, c, round(d, 6) + 0.0) for a, b, c, d in want}


def test_lanes_equal_broadcast(spark):
    points = spark.createDataFrame([(f"p{i}",) for i in range(9)], "id string")
    queries = spark.createDataFrame([(i,) for i in range(7)], "query_id long")
    rows = lambda df: sorted((r.id, r.query_id) for r in df.collect())
    assert rows(retrieval.met(points, queries, 3)) == rows(retrieval.met(points, queries)) and len(rows(retrieval.met(points, queries, 3))) == 63


def test_category_queries_and_texts(spark):
    df = spark.createDataFrame([("a", ["x"], ["y"]), ("b", [], ["y", "z"])], "category string, condensed array<string>, templates array<string>")
    assert {r.category: r["query"] for r in rerank.category_query(df).collect()} == {"a": "x", "b": "y"}
    with pytest.raises(Exception, match="no query for category c"):
        rerank.category_query(spark.createDataFrame([("c", [], [])], df.schema)).collect()
    rows = spark.createDataFrame([("s", 1, " t"), ("s", 2, "t "), ("s", 3, "  ")], "source string, doc_id long, text string")
    assert [r.doc_id for r in rerank.by_text(rows, ["source"], ["doc_id"]).collect()] == [2]


def test_prompt_and_expanded_queries(spark):
    papers = spark.createDataFrame([("p", "T", None, ["k", "l"]), ("q", "U", "A", None)], "paper_id string, title string, abstract string, keywords array<string>")
    made = prompts.classification(papers, spark.createDataFrame([("p", "E")], "paper_id string, block string"), "{title}|{abstract}|{keywords}\n**Relevant extracts:** \n \n{chunks_info}!{schema}{more}", {"A": "x"}, "{}", {"more": "+"})
    assert {r.paper_id: r.prompt for r in made.collect()} == {"p": "T|N/A|k, l\n**Relevant extracts:** \n \nE!{}+", "q": "U|A|\n!{}+"}
    with pytest.raises(ValueError):
        prompts.classification(papers, papers, "{nothing}", {}, "")
    queries = spark.createDataFrame([(1, "one"), (2, "two")], "query_id long, text string")
    docs = spark.createDataFrame([(1, 1, " d1 "), (1, 0, "d0"), (1, 2, "Generation FAILED"), (2, 0, "  ")], "query_id long, n int, text string")
    assert {r.query_id: r.retrieval_text for r in retrieval.with_hypothetical(queries, docs).collect()} == {1: "one\n\nd0\n\nd1", 2: "two"}
