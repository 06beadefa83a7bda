"""The index of deltas: merge on read, whole documents, isolation, writers, compaction, streams."""

import pytest
from pyspark.sql import functions as F

from evidence_lake.operators import deltas
from evidence_lake.streaming.incremental import delta_stream, file_stream

SCHEMA = "paper_id string, id string, text string, dense array<double>"


def rows(spark, *docs):
    return spark.createDataFrame([(d, f"{d}{i}", t, [1.0, float(i)]) for d, texts in docs for i, t in enumerate(texts)], SCHEMA)


def live(index, **how):
    return sorted((r.paper_id, r.text) for r in index.read(**how).collect())


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_last_write_of_a_document_wins_and_only_its_delta_is_written(spark, tmp_path):
    index = deltas.DeltaIndex(spark, f"file://{tmp_path}/i", buckets=4)
    assert index.read() is None
    index.upsert(rows(spark, *[(f"d{i}", ["x", "y"]) for i in range(40)]))
    before = files(tmp_path)
    index.upsert(rows(spark, ("d1", ["new"]), ("e", ["z"])))
    after = files(tmp_path)
    assert {k: after[k] for k in before} == before and 1 <= len(after) - len(before) <= 2
    index.delete(spark.createDataFrame([("d2",), (None,), ("unknown",)], "paper_id string"))
    got = live(index)
    assert ("d1", "new") in got and ("d1", "x") not in got and ("e", "z") in got and not [x for x in got if x[0] == "d2"] and len(got) == 38 * 2 + 2
    assert live(index, documents=["d1", "d2", "d3"]) == [("d1", "new"), ("d3", "x"), ("d3", "y")]
    index.upsert(rows(spark, ("d2", ["back"])))
    assert ("d2", "back") in live(index)


def test_compaction_and_vacuum_keep_the_rows(spark, tmp_path):
    index = deltas.DeltaIndex(spark, f"file://{tmp_path}/i", buckets=3)
    for i in range(4):
        index.upsert(rows(spark, ("a", [f"a{i}"]), (f"d{i}", ["x"])))
    index.delete(spark.createDataFrame([("d0",)], "paper_id string"))
    want = live(index)
    assert index.compact() >= 1 and live(index) == want
    index.upsert(rows(spark, ("a", ["last"])))
    assert index.compact() == 1  # the bucket of `a`
    assert index.compact() == 0
    want = [("a", "last"), ("d1", "x"), ("d2", "x"), ("d3", "x")]
    assert live(index) == want
    assert index.vacuum(keep=1) >= 4 and live(index) == want
    assert live(deltas.DeltaIndex(spark, f"file://{tmp_path}/i", buckets=99)) == want  # the number of buckets is the index's


def test_of_two_writers_one_is_told_and_nothing_changes(spark, tmp_path, monkeypatch):
    index = deltas.DeltaIndex(spark, f"file://{tmp_path}/i")
    index.upsert(rows(spark, ("a", ["one"])), settings={"model": "m"})
    old = index.manifest()
    index.upsert(rows(spark, ("a", ["two"])))
    monkeypatch.setattr(index, "manifest", lambda: old)
    with pytest.raises(RuntimeError, match="first"):
        index.upsert(rows(spark, ("a", ["three"])))
    monkeypatch.undo()
    assert live(index) == [("a", "two")]
    with pytest.raises(ValueError, match="model"):
        index.upsert(rows(spark, ("b", ["x"])), settings={"model": "other"})


def test_a_bad_row_rejects_its_document_only(spark):
    data = [("a", "1", "t", [1.0, 2.0]), ("a", "2", "t", None), ("b", "3", "t", [1.0, 2.0]), ("c", None, "t", [1.0, 2.0]), ("d", "4", "t", [1.0]), ("e", "5", "t", [1.0, float("nan")]), ("f", "6", "t", [1.0, None]), (None, "7", "t", [1.0, 2.0])]
    df = spark.createDataFrame(data, SCHEMA)
    papers = spark.createDataFrame([(x,) for x in "abcdefg"], "paper_id string")
    good, errors = deltas.checked(df, papers, dims=2)
    assert [r.id for r in good.collect()] == ["3"]
    assert {r.paper_id for r in errors.collect()} == {"a", "c", "d", "e", "f", "g", None} and errors.count() == 7
    assert deltas.checked(df.limit(0), dims=2)[0].count() == 0


def test_a_stream_adds_each_batch_once(spark, tmp_path):
    index = deltas.DeltaIndex(spark, f"file://{tmp_path}/i")
    source = tmp_path / "in"
    rows(spark, ("a", ["x"]), ("b", ["y"])).coalesce(1).write.parquet(str(source))
    build = lambda df: df.withColumn("text", F.upper("text"))
    run = lambda check: delta_stream(file_stream(spark, str(source), SCHEMA), index, build, f"{tmp_path}/{check}", dims=2).awaitTermination()
    run("c1")
    number = index.manifest()["number"]
    run("c2")  # a lost checkpoint: batch 0 comes again
    assert index.manifest()["number"] == number == 1
    rows(spark, ("b", ["new"])).coalesce(1).write.mode("append").parquet(str(source))
    run("c1")
    assert live(index) == [("a", "X"), ("b", "NEW")]
