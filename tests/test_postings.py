"""Sparse search in blocks: equal to the join of terms; blocks and documents that bounds leave out."""

import numpy as np
import pyarrow as pa

from evidence_lake.operators import embedding, postings, retrieval


def texts(rng, n, topics=5):
    return [" ".join(rng.choice([f"t{i % topics}w{j}" for j in range(15)] + ["the", "of"], 12)) for i in range(n)]


def test_equals_the_join_of_terms(spark, monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(postings, "BLOCK_DOCS", 16)
    monkeypatch.setattr(postings, "QUERY_DOCS", 3)
    rows = [(i, t) for i, t in enumerate(texts(rng, 120))] + [(200 + i, "the of same text") for i in range(30)] + [(300, None), (301, ""), (302, "Ünïcode 文字 the"), (303, "the " * 5000)]
    asked = [(i, t) for i, t in enumerate(texts(rng, 7))] + [(8, "the of same"), (9, None), (10, "nowhere"), (11, "文字")]
    points = spark.createDataFrame(rows, "id long, text string").repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, text string")
    got = sorted(map(tuple, retrieval.sparse_texts(queries, points, 6).collect()))
    want = retrieval.sparse(embedding.sparse_terms(queries, "query_id", "text"), embedding.sparse_terms(points, "id", "text"), 6)
    assert got == sorted(map(tuple, want.select("query_id", "id", "score", "rank").collect()))
    assert retrieval.sparse_texts(queries.limit(0), points, 6).count() == 0 and retrieval.sparse_texts(queries, points.limit(0), 6).count() == 0
    named = retrieval.sparse_texts(queries.selectExpr("concat('q', query_id) query_id", "text"), points.selectExpr("concat('d', id) id", "text"), 6)
    assert named.count() == len(got)


def test_bounds_leave_out_blocks_and_documents():
    rng = np.random.default_rng(2)
    make = lambda rows: postings.Postings.of(pa.array([r.split() for r in rows]))
    blocks = [make([x for i, x in enumerate(texts(rng, 200)) if i % 5 == t]) for t in range(5)]  # a topic a block
    queries = make(["t0w1 t0w2 t0w3 the", "t3w1 t3w5 of the"])
    for j, topic in ((0, 0), (1, 3)):
        _, found = postings.scored(blocks[topic], *postings.asked(blocks[topic], queries)[j], 1)
        least = int(np.sort(found)[-5])
        passed = [t for t in range(5) if not len(postings.scored(blocks[t], *postings.asked(blocks[t], queries)[j], least)[0])]
        assert passed == [t for t in range(5) if t != topic]
        full = dict(zip(*map(np.ndarray.tolist, postings.scored(blocks[topic], *postings.asked(blocks[topic], queries)[j], 1))))
        cut = dict(zip(*map(np.ndarray.tolist, postings.scored(blocks[topic], *postings.asked(blocks[topic], queries)[j], least))))
        assert len(cut) < len(full) and {d: s for d, s in full.items() if s >= least}.items() <= cut.items()


def test_arrow_batches_are_bounded_by_bytes(spark, tmp_path):
    """Blocks are rows of some MB: a task's blocks don't come as one batch; parsed documents go on in parts."""
    from pyspark.sql import functions as F

    from evidence_lake.operators import blocks
    from evidence_lake.sources import files

    kept = spark.conf.get(blocks.BATCH_CONF)
    try:
        spark.conf.set(blocks.BATCH_CONF, str(256 << 20))
        rows = spark.range(12).coalesce(1).select(F.repeat(F.lit("x"), 1 << 20).alias("cells"))

        def sizes(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

        assert max(r.n for r in blocks.in_arrow(rows, sizes, "n long").collect()) <= 2 * blocks.BATCH_BYTES
        spark.conf.set(blocks.BATCH_CONF, str(256 << 20))
        files.tei_papers(spark.createDataFrame([("a", "<TEI/>")], "paper_id string, xml string"))
        assert int(spark.conf.get(blocks.BATCH_CONF).rstrip("b")) <= blocks.BATCH_BYTES
    finally:
        spark.conf.set(blocks.BATCH_CONF, kept)
