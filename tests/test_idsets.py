"""Candidate ids, vector facts, cosine and transforms."""

import math

import pytest
from pyspark.sql import functions as F

from evidence_lake.operators import blocks, idsets, retrieval


@pytest.mark.parametrize("most", [1 << 23, 1 << 15])
def test_filters_hold_every_id_and_errors_never_show(spark, monkeypatch, most):
    monkeypatch.setattr(idsets, "MOST_BITS", most)
    ids = spark.range(0, 60_000, 3).select(F.concat(F.lit("p"), "id").alias("id")).union(spark.createDataFrame([(None,)], "id string"))
    points = spark.range(40_000).select(F.concat(F.lit("p"), "id").alias("id"), F.lit(1).alias("x"))
    passed = points.where(idsets.IdFilter(ids).may_hold(F.col("id"))).count()
    right = len(range(0, 40_000, 3))
    assert right <= passed <= (right * 1.1 if most > 1 << 15 else 40_000)
    got = idsets.among(points.union(points.limit(1)), ids)
    assert got.columns == ["id", "x"] and got.select("id").distinct().count() == right and got.count() == right + 1
    assert idsets.among(points, ids.limit(0)).count() == 0


def test_cosine_and_facts(spark):
    points = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0]), (4, None)], "id long, v array<double>")
    queries = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, q array<double>")
    facts = retrieval.vector_facts(points)
    assert facts == {"n": 3, "dims": 2, "least_norm": 0.0, "most_norm": 5.0, "normalised": False}
    assert [(r.id, r.score) for r in retrieval.cosine(queries, points, 3).orderBy("rank").collect()] == [(1, 0.6), (2, 0.0), (3, -1.0)]
    one = points.where("id IN (3)")
    assert retrieval.vector_facts(one)["normalised"] and retrieval.cosine(queries, one, 3).first().score == -1.0
    with pytest.raises(ValueError, match="dimensions"):
        retrieval.cosine(queries, points.union(spark.createDataFrame([(5, [1.0])], points.schema)), 3)


def test_chains_keep_the_text_asked(spark):
    q = spark.createDataFrame([(1, "A B"), (2, "xx"), (3, None)], "query_id long, text string")
    rows = retrieval.transformed(q, [F.lower, lambda c: F.replace(c, F.lit("x"), F.lit(""))]).orderBy("query_id").collect()
    assert [(r.text, r.original_text) for r in rows] == [("a b", "A B"), ("xx", "xx"), (None, None)]


def test_scoped_blocks_are_dealt(spark, monkeypatch):
    points = spark.range(300).select("id", (F.col("id") % 2).alias("s"), F.array(F.sin("id"), F.cos("id")).alias("v"))
    queries = spark.range(200).select(F.col("id").alias("query_id"), (F.col("id") % 2).alias("s"), F.array(F.cos("id"), F.sin(F.col("id") * 3)).alias("q"))
    want = sorted(map(tuple, retrieval.dense(queries, points, 4, scope="s", dims=2).collect()))
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 700)
    assert sorted(map(tuple, retrieval.dense(queries, points, 4, scope="s", dims=2).collect())) == want and len(want) == 800


def test_products_of_a_column_with_a_few_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,), ([1.0],)], "v array<double>")
    got = [r.s for r in df.select(blocks.products([[1.0, 0.0], [0.5, 1 / 3]], 2)("v").alias("s")).collect()]
    assert got == [[1.0, round(0.5 + 2 / 3, 6)], None, None] and math.isclose(got[0][1], 1.166667)
