"""Late interaction over ragged token matrices."""

import numpy as np

from evidence_lake.operators import late


def test_sums_of_maxima():
    rng = np.random.default_rng(0)
    q, docs = rng.normal(size=(4, 6)), [rng.normal(size=(n, 6)) for n in (3, 0, 1, 7)]
    want = [(q @ d.T).max(axis=1).sum() if len(d) else 0.0 for d in docs]
    assert np.allclose(late.max_sims(q, docs), want)
    assert late.max_sims(q[:0], docs).tolist() == [0.0] * 4 and late.max_sims(q, []).tolist() == []


def test_rerank_with_sides_of_their_own(spark):
    def side(sign):
        return lambda: lambda tokens: np.array([[sign * len(t), 1.0] for t in tokens])

    encoder = late.TokenEncoder(2, side(-1.0), side(1.0))
    points = spark.createDataFrame([(1, "a bb a"), (2, "cccc"), (3, None), (4, "")], "id long, text string")
    queries = spark.createDataFrame([(7, "x yy"), (8, None)], "query_id long, text string")
    pairs = spark.createDataFrame([(q, i) for q in (7, 8) for i in (1, 2, 3, 4)], "query_id long, id long")
    got = {(r.query_id, r.id): (r.score, r["rank"]) for r in late.rerank(pairs, queries, points, 4, encoder).collect()}
    # x: max(-1, -2) + 1, yy: max(-2, -4) + 1
    assert got[7, 1] == (-1.0, 3) and got[7, 2] == (-10.0, 4) and got[7, 3] == (0.0, 1) and got[8, 1][0] == 0.0 and len(got) == 8
    assert late.rerank(pairs.limit(0), queries, points, 4).count() == 0
