"""Evidence of documents: one shuffle, and the same lines as a plain loop finds."""

import re

from evidence_lake.plans import search_queries, workflow_queries


def test_evidence_shuffles_the_texts_once(spark, tmp_path):
    rows = [(1, "the thing and\n  of that \nund die\n\nlas del"), (1, "the thing"), (2, None), (None, "die und\nder"), (3, "\n".join(f"the {i} on was" for i in range(40)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, run in [("evidence_select", search_queries.evidence_select), ("prompt_contexts", workflow_queries.prompt_contexts), ("answer", workflow_queries.answer_concat_with_provenance), ("within", search_queries.evidence_within_label), ("pool", search_queries.rerank_global_pool)]:
        plan = run(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1, name

    def tokens(s):
        return set(re.findall(r"[a-z0-9]+", s.lower()))

    want = set()
    for key in (1, None, 3):
        lines = [(i, line.strip(" ")) for k, t in rows if k == key and t is not None for i, line in enumerate(t.split("\n"))]
        for category, _, template, query in search_queries.TEMPLATES:
            x = tokens(query)
            score = lambda line, x=x: round(len(x & tokens(line)) / len(x | tokens(line)), 6)
            best = sorted((-score(line), i) for i, line in lines)[:6]
            want |= {(key, category, template, r, i, -s) for r, (s, i) in enumerate(best)}
    got = {(r.paper_id, r.category, r.template_ord, r.rank0, r.id, r.score) for r in search_queries.hits(spark, str(tmp_path)).collect()}
    assert got == want
