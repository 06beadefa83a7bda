"""Queries on retrieval, fusion, reranking and evidence, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_lake.functions.text import set_similarity, word_tokens
from evidence_lake.functions.vectors import let
from evidence_lake.operators import embedding, idsets, late, rerank, retrieval
from evidence_lake.plans.chunk_queries import TOKENS, docs, table
from evidence_lake.session import stored

QUERIES: dict = {}
SQL: dict[str, str] = {}
DIMS = 64


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def points(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))


def vector_queries(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q"))


DENSE = "SELECT a.vec_id AS query_id, b.vec_id AS id, a.label AS ql, b.label AS bl, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b"
RANKED = "SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {0} QUALIFY rank <= {1}"


@query(f"WITH s AS ({DENSE}) {RANKED.format('s', 10)}")
def search_dense_topk(spark, d):
    return retrieval.dense(vector_queries(spark, d).drop("label"), points(spark, d), 10, dims=DIMS)


@query(f"WITH s AS ({DENSE} WHERE a.label = b.label) {RANKED.format('s', 5)}")
def search_dense_scoped(spark, d):
    return retrieval.dense(vector_queries(spark, d), points(spark, d), 5, scope="label", dims=DIMS)


@query(f"WITH s AS ({DENSE}), r AS ({RANKED.format('s', 5)}) SELECT * FROM r WHERE score >= 0.3")
def search_threshold_after_cut(spark, d):
    return retrieval.threshold(search_dense_topk(spark, d).where("rank <= 5"), 0.3)


@query("SELECT vec_id AS id, label FROM embeddings WHERE label IS NOT DISTINCT FROM 3")
def filter_equality_nullsafe(spark, d):
    scope, rest = retrieval.split_filter({"label": 3}, ["label"])
    return retrieval.matching(points(spark, d).select("id", "label"), rest, scope)


TERMS = f"""
dt AS (SELECT doc_id AS id, term, round(ln(1 + count(*)), 6) AS w FROM (SELECT doc_id, unnest({TOKENS.format("text")}) AS term FROM documents) GROUP BY ALL),
qt AS (SELECT item_id AS query_id, term, round(ln(1 + count(*)), 6) AS qw FROM (SELECT item_id, unnest({TOKENS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
ss AS (SELECT query_id, id, round(sum(qw * w), 6) AS score FROM dt JOIN qt USING (term) GROUP BY ALL)"""


def sparse(spark, d, k):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.sparse_texts(q, docs(spark, d).select(F.col("doc_id").alias("id"), "text"), k)


@query(f"WITH {TERMS} {RANKED.format('ss', 10)}")
def search_sparse(spark, d):
    return sparse(spark, d, 10)


@query(f"WITH c AS (SELECT doc_id FROM documents WHERE length(text) % 3 = 0), s AS ({DENSE} WHERE b.vec_id IN (SELECT doc_id FROM c)) {RANKED.format('s', 10)}")
def search_among_ids(spark, d):
    """Dense search among the ids that another table names: documents of certain lengths."""
    ids = docs(spark, d).where(F.length("text") % 3 == 0).select(F.col("doc_id").alias("id"))
    return retrieval.dense(vector_queries(spark, d).drop("label"), idsets.among(points(spark, d).drop("label"), ids), 10, dims=DIMS)


@query(
    f"""
WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, CASE WHEN b.vec_id % 97 = 5 THEN 0.0 ELSE round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) END AS score FROM embeddings a, embeddings b)
{RANKED.format("s", 10)}
"""
)
def search_cosine(spark, d):
    """Cosine over vectors of other lengths than 1 (the length differs with the id, some are zero)."""
    longer = F.transform("v", lambda x: x.cast("double") * F.when(F.col("id") % 97 == 5, 0.0).otherwise(1.0 + F.col("id") % 5))
    return retrieval.cosine(vector_queries(spark, d).drop("label"), points(spark, d).select("id", longer.alias("v")), 10)


CHAIN_TOKENS = TOKENS.format("regexp_replace(lower(text), '[aeiou]', '', 'g')")


@query(
    f"""
WITH {TERMS.replace(TOKENS.format("text"), CHAIN_TOKENS).replace("doc_id, unnest(" + CHAIN_TOKENS, "doc_id, unnest(" + TOKENS.format("text"))} {RANKED.format("ss", 10)}
"""
)
def search_transformed(spark, d):
    """Items asked through a chain of transforms: lower case, then without vowels."""
    chain = [F.lower, lambda c: F.regexp_replace(c, "[aeiou]", "")]
    q = retrieval.transformed(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), chain)
    return retrieval.sparse_texts(q, docs(spark, d).select(F.col("doc_id").alias("id"), "text"), 10)


KEYWORDS = "the of was the"
HITS = " + ".join(f"(len(string_split(lower(text), '{w}')) - 1)" for w in KEYWORDS.split())


@query(f"SELECT doc_id AS id, CAST({HITS} AS BIGINT) AS hits, row_number() OVER (ORDER BY hits DESC, doc_id) AS rank FROM documents WHERE {HITS} > 0 QUALIFY rank <= 25")
def search_keyword(spark, d):
    return retrieval.keyword(docs(spark, d).select(F.col("doc_id").alias("id"), "text"), KEYWORDS, 25)


HASHED = """
{p}b AS (SELECT {key} AS k, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 32 AS b, count(*) AS n FROM (SELECT {key}, unnest({tokens}) AS tok FROM {table}) GROUP BY ALL),
{p}u AS (SELECT k, b, n / sqrt(sum(n * n) OVER (PARTITION BY k)) AS x FROM {p}b)"""
DENSE_TEXT = (
    HASHED.format(p="d", key="doc_id", table="documents", tokens=TOKENS.format("text"))
    + ","
    + HASHED.format(p="q", key="item_id", table="benchmark", tokens=TOKENS.format("text"))
    + ", ds AS (SELECT q.k AS query_id, d.k AS id, round(sum(q.x * d.x), 6) AS score FROM qu q JOIN du d USING (b) GROUP BY ALL)"
)


def text_dense(spark, d, k):
    embed = embedding.hashed(32)
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), embed(F.col("text")).alias("q"))
    v = docs(spark, d).select(F.col("doc_id").alias("id"), embed(F.col("text")).alias("v"))
    return retrieval.dense(q, v, k, dims=32)


RRF = "round(sum(1.0::DOUBLE / (60 + rank)), 9)"


@query(
    f"""
WITH {TERMS}, {DENSE_TEXT},
a AS ({RANKED.format("ds", 50)}), b AS ({RANKED.format("ss", 50)}),
u AS (SELECT 0 AS l, * FROM a UNION ALL SELECT 1, * FROM b),
f AS (SELECT query_id, id, {RRF} AS score, min({{'l': l, 'r': rank}}) AS seen FROM u GROUP BY ALL)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, id) AS rank FROM f QUALIFY rank <= 10
"""
)
def search_hybrid_rrf(spark, d):
    return retrieval.hybrid(text_dense(spark, d, 50), sparse(spark, d, 50), 10)


@query(
    """
WITH l AS (
  SELECT source AS query_id, 0 AS l, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS r, CASE WHEN doc_id % 7 <> 0 THEN doc_id END AS id FROM documents
  UNION ALL
  SELECT source, 1, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1, doc_id FROM documents
), f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + r + 1)), 9) AS score, min({'l': l, 'r': r}) AS seen FROM l WHERE id IS NOT NULL GROUP BY ALL)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, id) AS rank FROM f QUALIFY rank <= 20
"""
)
def fuse_rrf_full_outer(spark, d):
    from pyspark.sql import Window

    rows = docs(spark, d)
    one = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    two = Window.partitionBy("source").orderBy("doc_id")
    a = rows.select(F.col("source").alias("query_id"), F.lit(0).alias("list_no"), (F.row_number().over(one) - 1).alias("rank0"), F.when(F.col("doc_id") % 7 != 0, F.col("doc_id")).alias("id"))
    b = rows.select(F.col("source").alias("query_id"), F.lit(1).alias("list_no"), (F.row_number().over(two) - 1).alias("rank0"), F.col("doc_id").alias("id"))
    return retrieval.fuse(a.unionByName(b), 20)


@query(
    f"""
WITH {TERMS}, c AS ({RANKED.format("ss", 20)}),
dtok AS (SELECT doc_id AS id, tok, min(i) AS i FROM (SELECT doc_id, unnest(t) AS tok, unnest(range(len(t))) AS i FROM (SELECT doc_id, {TOKENS.format("text")} AS t FROM documents)) GROUP BY ALL),
dl AS (SELECT id, list(DISTINCT ('0x' || substr(md5(tok), 1, 8))::BIGINT % 8) AS bs FROM dtok GROUP BY id),
qtok AS (SELECT item_id, tok, min(i) AS i FROM (SELECT item_id, unnest(t) AS tok, unnest(range(len(t))) AS i FROM (SELECT item_id, {TOKENS.format("text")} AS t FROM benchmark)) GROUP BY ALL),
ql AS (SELECT item_id AS query_id, list(('0x' || substr(md5(tok), 1, 8))::BIGINT % 8) AS bs FROM qtok GROUP BY item_id),
s AS (SELECT query_id, id, len(list_filter(ql.bs, lambda b: list_contains(dl.bs, b)))::DOUBLE AS score FROM c JOIN dl USING (id) JOIN ql USING (query_id))
{RANKED.format("s", 5)}
"""
)
def late_maxsim(spark, d):
    embed = embedding.late_tokens(8)
    candidates = stored(sparse(spark, d, 20), "candidates")  # read twice
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), embed(F.col("text")).alias("ql"))
    texts = docs(spark, d).select(F.col("doc_id").alias("id"), "text").join(candidates.select("id").distinct(), "id", "left_semi")
    v = texts.select("id", F.array_distinct(embed(F.col("text"))).alias("dl"))  # equal vectors have one maximum
    return retrieval.late_rerank(candidates, q, v, 5)


VECTOR = "list_transform(range(8), lambda i: ('0x' || substr(md5(tok), 4 * i + 1, 4))::BIGINT / 32768 - 1)"


@query(
    f"""
WITH {TERMS}, c AS ({RANKED.format("ss", 20)}),
dv AS (SELECT id, list_transform(x, lambda y: y / sqrt(list_inner_product(x, x))) AS v FROM (SELECT id, {VECTOR} AS x FROM (SELECT doc_id AS id, unnest(list_distinct({TOKENS.format("text")})) AS tok FROM documents) WHERE id IN (SELECT id FROM c))),
qv AS (SELECT query_id, tok, list_transform(x, lambda y: y / sqrt(list_inner_product(x, x))) AS v FROM (SELECT query_id, tok, {VECTOR} AS x FROM (SELECT item_id AS query_id, unnest(list_distinct({TOKENS.format("text")})) AS tok FROM benchmark))),
m AS (SELECT c.query_id, c.id, tok, max(list_inner_product(qv.v, dv.v)) AS best FROM c JOIN qv USING (query_id) JOIN dv USING (id) GROUP BY ALL),
s AS (SELECT query_id, id, round(sum(best), 6) AS score FROM m GROUP BY ALL)
{RANKED.format("s", 5)}
"""
)
def late_token_matrices(spark, d):
    """Candidates of the sparse search by late interaction of real-valued token vectors of whole texts."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    candidates = stored(sparse(spark, d, 20).select("query_id", "id"), "candidates")  # read twice
    return late.rerank(candidates, q, docs(spark, d).select(F.col("doc_id").alias("id"), "text"), 5)


JACCARD = "round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6)"
SETS = f"dset AS (SELECT doc_id AS id, list_distinct({TOKENS.format('text')}) AS x FROM documents), qset AS (SELECT item_id AS query_id, list_distinct({TOKENS.format('text')}) AS y FROM benchmark)"


def pairs_with_sets(spark, d, k):
    """Candidates with the word sets of both texts, made once a text."""
    c = stored(sparse(spark, d, k).select("query_id", "id", "score"), "candidates")  # read twice
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(word_tokens(F.col("text"))).alias("query"))
    texts = docs(spark, d).select(F.col("doc_id").alias("id"), "text").join(c.select("id").distinct(), "id", "left_semi")
    v = texts.select("id", F.array_distinct(word_tokens(F.col("text"))).alias("text"))
    return c.join(v, "id").join(retrieval.small(q), "query_id")


@query(f"WITH {TERMS}, {SETS}, c AS ({RANKED.format('ss', 20)}), s AS (SELECT query_id, id, {JACCARD} AS score FROM c JOIN dset USING (id) JOIN qset USING (query_id)), r AS ({RANKED.format('s', 5)}) SELECT query_id, id, score AS rank_score, rank FROM r")
def rerank_cross_lexical(spark, d):
    return rerank.rerank(pairs_with_sets(spark, d, 20), set_similarity, 5, ["query_id"]).select("query_id", "id", "rank_score", "rank")


def containment(q, t):
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(q, t)), F.size(q)), F.lit(0.0)), 6)


@query(
    f"""
WITH {TERMS}, {SETS}, c AS ({RANKED.format("ss", 20)}),
one AS (SELECT query_id, id, {JACCARD} AS j, x, y FROM c JOIN dset USING (id) JOIN qset USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY j DESC, id) <= 10),
two AS (SELECT query_id, id, round(len(list_intersect(x, y)) / len(y), 6) AS score FROM one), r AS ({RANKED.format("two", 4)})
SELECT query_id, id, score AS rank_score, rank FROM r
"""
)
def rerank_cascade(spark, d):
    rows = pairs_with_sets(spark, d, 20).drop("score")
    return rerank.cascade(rows, [(set_similarity, 10), (containment, None)], 4, ["query_id"]).select("query_id", "id", "rank_score", "rank")


#: Categories and their templates, in order, for the evidence queries.
TEMPLATES = [("open", 0, 0, "the thing and of that"), ("open", 0, 1, "was for with on"), ("closed", 1, 0, "les des une dans que"), ("closed", 1, 1, "der die und ein"), ("other", 2, 0, "los las del que")]
TEMPLATE_SQL = "t AS (SELECT * FROM (VALUES " + ", ".join(str(x) for x in TEMPLATES) + ") AS v(category, category_ord, template_ord, query))"
HIT_SQL = f"""
{TEMPLATE_SQL},
l AS (SELECT doc_id, unnest(range(len(p))) AS ord, trim(unnest(p), ' ') AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
ls AS (SELECT *, list_distinct({TOKENS.format("text")}) AS x FROM l),
ts AS (SELECT *, list_distinct({TOKENS.format("query")}) AS y FROM t),
h AS (SELECT doc_id AS paper_id, ord AS id, text, category, category_ord, template_ord, {JACCARD} AS score, CASE WHEN ord = 0 THEN 'Introduction' ELSE 'Other' END AS section_type FROM ls, ts),
hits AS (SELECT *, row_number() OVER (PARTITION BY paper_id, category_ord, template_ord ORDER BY score DESC, id) - 1 AS rank0 FROM h QUALIFY rank0 < 6)"""


def best_lines(papers, k: int):
    """papers (paper_id, text) with each text's k best lines for every template, taken from the text as one row."""
    sides = [F.array_distinct(word_tokens(F.lit(q))) for *_, q in TEMPLATES]

    def scored(line, i):
        scores = lambda x: F.array(*[set_similarity(x, y) for y in sides])
        return let(F.trim(line), lambda t: F.struct(i.cast("long").alias("id"), t.alias("text"), let(F.array_distinct(word_tokens(t)), scores).alias("scores")))

    def best(lines, j, category, category_ord, template_ord):
        order = F.array_sort(F.transform(lines, lambda s: F.struct((-s["scores"][j]).alias("down"), s["id"].alias("id"), s["text"].alias("text"), s["scores"][j].alias("score"))))
        return F.transform(F.slice(order, 1, k), lambda s: F.struct(s["id"].alias("id"), s["text"].alias("text"), F.lit(category).alias("category"), F.lit(category_ord).alias("category_ord"), F.lit(template_ord).alias("template_ord"), s["score"].alias("score")))

    found = let(F.transform(F.split("text", "\n"), scored), lambda lines: F.flatten(F.array(*[best(lines, j, *t[:3]) for j, t in enumerate(TEMPLATES)])))
    return papers.select("paper_id", F.explode(found).alias("h")).select("paper_id", "h.*")


def hits(spark, d, k: int = 6):
    """The k best lines of each document for each template: one table of (document, template) searches.

    Texts are dealt out once, by document, and all that follows for a document stays in its partition.
    """
    from pyspark.sql import Window

    papers = table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), "text").repartition("paper_id")
    w = Window.partitionBy("paper_id", "category_ord", "template_ord").orderBy(F.desc("score"), "id")  # rows of equal ids, too
    kind = F.when(F.col("id") == 0, "Introduction").otherwise("Other")
    return best_lines(papers, k).withColumn("rank0", F.row_number().over(w) - 1).where(F.col("rank0") < k).withColumn("section_type", kind)


BEST = "SELECT * FROM {0} WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY paper_id, text ORDER BY score DESC, category_ord, template_ord, rank0) = 1"
SELECTED = f"best AS ({BEST.format('hits')}), sel AS (SELECT paper_id, id, category, text, score, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, category_ord, template_ord, rank0, id) AS rank FROM best QUALIFY rank <= 5)"


@query(f"WITH {HIT_SQL}, {SELECTED} SELECT * FROM sel")
def evidence_select(spark, d):
    return rerank.select_evidence(hits(spark, d), 5)


@query(
    f"""
WITH {HIT_SQL}, f AS (SELECT * FROM hits WHERE lower(section_type) IN ('introduction', 'methods')),
best AS (SELECT * FROM f WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY paper_id, text ORDER BY score DESC, 0, template_ord, rank0, category_ord) = 1)
SELECT paper_id, text, max(score) AS score FROM best GROUP BY ALL
"""
)
def miner_retrieve_dedup(spark, d):
    return rerank.mine_evidence(hits(spark, d), 15, ["Introduction", "METHODS"]).select("paper_id", "text", "score")


@query(f"WITH {HIT_SQL} SELECT paper_id, id, category, template_ord, score FROM hits WHERE lower(section_type) = 'introduction'")
def filter_section(spark, d):
    return rerank.section_filter(hits(spark, d), ["INTRODUCTION"]).select("paper_id", "id", "category", "template_ord", "score")


CATEGORY_QUERIES = [("open", "that and the for"), ("closed", "une des und der"), ("other", "los que las")]
CATEGORY_SQL = "cq AS (SELECT category, query, list_distinct(" + TOKENS.format("query") + ") AS y FROM (VALUES " + ", ".join(str(x) for x in CATEGORY_QUERIES) + ") AS v(category, query))"


def category_queries(spark):
    return spark.createDataFrame(CATEGORY_QUERIES, "category string, query string")


WITHIN = f"""
best AS (SELECT * FROM hits WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY paper_id, category, text ORDER BY score DESC, category_ord, template_ord, rank0) = 1),
cut AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY paper_id, category ORDER BY score DESC, id) <= 4),
s AS (SELECT cut.paper_id, cut.category, cut.id, list_distinct({TOKENS.format("text")}) AS x, y FROM cut JOIN cq USING (category))"""


@query(f"WITH {HIT_SQL}, {CATEGORY_SQL}, {WITHIN} SELECT paper_id, category, id, {JACCARD} AS rank_score, row_number() OVER (PARTITION BY paper_id, category ORDER BY rank_score DESC, id) AS rank FROM s")
def evidence_within_label(spark, d):
    best = rerank.best_by_text(hits(spark, d), ["paper_id", "category"], "score", ["category_ord", "template_ord", "rank0"])
    return rerank.within_label(best, category_queries(spark), 4).select("paper_id", "category", "id", "rank_score", "rank")


@query(
    f"""
WITH {HIT_SQL}, {CATEGORY_SQL},
pool AS (SELECT * FROM (SELECT * FROM hits WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY paper_id, text ORDER BY score DESC, category, id) = 1) QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, id) <= 4),
s AS (SELECT paper_id, cq.category, id, list_distinct({TOKENS.format("text")}) AS x, y FROM pool, cq)
SELECT paper_id, category, id, {JACCARD} AS rank_score, row_number() OVER (PARTITION BY paper_id, category ORDER BY rank_score DESC, id) AS rank FROM s
"""
)
def rerank_global_pool(spark, d):
    return rerank.global_pool(hits(spark, d), category_queries(spark), 4).select("paper_id", "category", "id", "rank_score", "rank")


@query("SELECT b.item_id, count(*) AS n FROM benchmark b JOIN documents d ON contains(d.text, left(b.text, 40)) GROUP BY b.item_id")
def coverage_theta_join(spark, d):
    """Texts that hold an item's first 40 characters: the items, of checked size, are broadcast."""
    items = table(spark, d, "benchmark").select("item_id", F.substring("text", 1, 40).alias("quote"))
    rows = retrieval.met(docs(spark, d).select("doc_id", "text"), items.withColumnRenamed("item_id", "query_id"))
    return rows.where(F.contains("text", "quote")).groupBy(F.col("query_id").alias("item_id")).agg(F.count(F.lit(1)).alias("n"))
