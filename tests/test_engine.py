import json

import pytest
from pyspark.sql import functions as F

from evidence_lake.operators.index import Store
from evidence_lake.plans.engine import Engine
from evidence_lake.plans.tasks import Registry, Settings, parse
from evidence_lake.streaming.incremental import file_stream, index_stream


def papers(spark, *keys):
    p = spark.createDataFrame([(k, f"abstract of {k} about water and data") for k in keys], "paper_id string, abstract string")
    s = spark.createDataFrame([(k, i, "Methods", "methods", f"the paper {k} has data set number {i} from a survey of open houses") for k in keys for i in range(3)], "paper_id string, section_ord long, title string, section_type string, content string")
    return p, s


def test_index_explore_classify(spark, tmp_path):
    e = Engine(spark, Settings(f"file://{tmp_path}/w", dims=16))
    with pytest.raises(ValueError):
        e.points()
    assert e.index(*papers(spark, "p", "q")).count() == 0
    assert {(r.paper_id, r.n_chunks) for r in e.papers().collect()} == {("p", 4), ("q", 4)}
    with pytest.raises(ValueError):
        e.index(*papers(spark, "p"))
    e.index(*papers(spark, "p", "r"), replace=True)
    assert e.papers().count() == 3
    q = spark.createDataFrame([(1, "data set number 2 of paper q")], "query_id long, text string")
    for mode in (None, "dense_only", "sparse_only"):
        hits = e.explore(q, {"paper_id": "q"}, 2, mode).orderBy("rank").collect()
        assert len(hits) == 2 and {h.paper_id for h in hits} == {"q"}
    assert "number 2" in e.ask(q, filters={"paper_id": "q"}, top_k=1, mode="sparse_only").first().answer
    answers = spark.createDataFrame([("p", 1, "junk"), ("p", 2, json.dumps({"classification": ["B"]})), ("q", 1, "junk")], "paper_id string, attempt int, raw string")
    got = {r.paper_id: (r.codes, r.parsed_ok) for r in e.classify("data_accessibility", answers).collect()}
    assert got == {"p": (["B"], True), "q": (["F"], False), "r": (["F"], False)}
    assert e.evidence(e.registry.get("find_data_sources")).count() > 0
    assert e.prompt("data_accessibility").count() == 3


def test_whole_classification_with_corrections(spark, tmp_path):
    e = Engine(spark, Settings(f"file://{tmp_path}/w", dims=16))
    e.index(*papers(spark, "p", "q", "r"))

    def generate(open_, attempt):
        """p reads at once, q after one correction, r never."""
        good, told = F.lit('{"classification": ["B"], "confidence": 0.5}'), F.size("messages") > 2
        return open_.select("paper_id", F.when((F.col("paper_id") == "p") | (F.col("paper_id") == "q") & told, good).otherwise("so it is").alias("raw"))

    meta = spark.createDataFrame([(k, f"Title {k}", None, ["water"]) for k in "pqr"], "paper_id string, title string, abstract string, keywords array<string>")
    got = {r.paper_id: r for r in e.run_classifier("data_accessibility", meta, generate).collect()}
    assert {k: (r.attempt, r.codes, len(r.messages), [x.parsed_ok for x in r.samples]) for k, r in got.items()} == {
        "p": (1, ["B"], 2, [True]),
        "q": (2, ["B"], 4, [False, True]),
        "r": (None, ["F"], 6, [False] * 3),
    }
    prompt = got["q"].messages[1].content
    assert "Title q" in prompt and "Relevant Extracts" in prompt and "data set number" in prompt and "Abstract: N/A" in prompt


def test_task_rules(tmp_path):
    good = {"key": "my_task", "labels": [{"code": "a", "name": "A"}, {"code": "b"}], "default_label": "a"}
    t = parse(good)
    assert (t.label, t.default, t.top_k, t.table) == ("My Task", "a", 10, {"a": "A", "b": "b"})
    for change in ({"key": "Bad Key"}, {"labels": []}, {"labels": [{"code": "a"}, {"code": "a"}]}, {"default_label": "z"}, {"kind": "odd"}, {"kind": "miner"}):
        with pytest.raises(ValueError):
            parse(good | change)
    (tmp_path / "t.json").write_text(json.dumps(good))
    r = Registry()
    assert r.load(str(tmp_path)) == ["my_task"] and "my_task" in r.keys()
    with pytest.raises(ValueError):
        r.add(parse(good | {"key": "geo"}))
    with pytest.raises(ValueError):
        r.get("unknown")


def test_stream_equals_batch(spark, tmp_path):
    schema = "id string, seq long, text string"
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], schema).coalesce(1).write.mode("append").parquet(src)
    store = Store(spark, f"file://{tmp_path}/s")
    run = lambda: index_stream(file_stream(spark, src, schema), store, lambda b: b, str(tmp_path / "ck")).awaitTermination()
    run()
    spark.createDataFrame([("a", 1, "z")], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    assert {(r.id, r.text) for r in store.read().collect()} == {("a", "z"), ("b", "y")}
