"""Queries on the workspace's services with their SQL: loaders' bytes, metadata deletes, category queries, prompts, expanded queries, listings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evidence_lake.functions import prompts
from evidence_lake.operators import deltas, index, jobs, rerank, results, retrieval, runs, titles, turns
from evidence_lake.plans.chunk_queries import TOKENS, docs, table
from evidence_lake.plans.search_queries import HIT_SQL, SELECTED, hits
from evidence_lake.session import shared_dir
from evidence_lake.sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query("SELECT CAST(doc_id AS VARCHAR) AS paper_id, text AS loaded FROM documents")
def text_bad_bytes(spark, d):
    """Texts with bytes that are no UTF-8 between them load without these bytes."""
    text = F.col("text")
    half = F.floor(F.length(text) / 2).cast("int")
    raw = F.concat(F.unhex(F.lit("FF")), F.encode(F.substring(text, F.lit(1), half), "UTF-8"), F.unhex(F.lit("FEFF")), F.encode(text.substr(half + 1, F.length(text)), "UTF-8"))
    return docs(spark, d).select(F.col("doc_id").cast("string").alias("paper_id"), files.readable(raw).alias("loaded"))


META = "SELECT doc_id, lang AS type, source AS strategy FROM documents"


def metadata(spark, d):
    return docs(spark, d).select("doc_id", F.col("lang").alias("type"), F.col("source").alias("strategy"))


@query(f"WITH m AS ({META}), r AS (SELECT count(*) FILTER (doc_id = 7) AS removed FROM m) SELECT doc_id, type, strategy, removed FROM m, r WHERE NOT coalesce(doc_id = 7, false)")
def meta_delete_doc(spark, d):
    kept, removed = index.delete_counted(metadata(spark, d), F.col("doc_id") == 7)
    return kept.join(F.broadcast(removed), F.lit(True))  # one row


FIRST_SOURCE = "(SELECT min(source) FROM documents)"


@query(f"WITH m AS ({META}), r AS (SELECT count(*) FILTER (strategy = {FIRST_SOURCE}) AS removed FROM m) SELECT strategy, count(*) AS n, any_value(removed) AS removed FROM m, r WHERE NOT coalesce(strategy = {FIRST_SOURCE}, false) GROUP BY strategy")
def meta_delete_strategy(spark, d):
    rows = metadata(spark, d)
    first = F.broadcast(rows.agg(F.min("strategy").alias("gone")))  # one row
    kept, removed = index.delete_counted(rows.join(first, F.lit(True)), F.col("strategy") == F.col("gone"))
    return kept.groupBy("strategy").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(removed), F.lit(True))


@query("SELECT doc_id AS category, CASE WHEN doc_id % 3 <> 0 THEN 'condensed ' || lang ELSE 'template ' || source END AS query FROM documents")
def category_query_choice(spark, d):
    none = F.array().cast("array<string>")
    both = F.array(F.concat(F.lit("template "), "source"), F.lit("another"))
    rows = docs(spark, d).select(F.col("doc_id").alias("category"), F.when(F.col("doc_id") % 3 != 0, F.array(F.concat(F.lit("condensed "), "lang"))).otherwise(none).alias("condensed"), both.alias("templates"))
    return rerank.category_query(rows)


@query("SELECT source, doc_id, text FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS text FROM documents) WHERE trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY source, regexp_replace(text, '^\\s+|\\s+$', '', 'g') ORDER BY doc_id DESC, text DESC) = 1")
def reindex_by_text(spark, d):
    """Of a source's equal passages (lines) the last."""
    rows = docs(spark, d).select("source", "doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return rerank.by_text(rows, ["source"], ["doc_id", "text"])


def delta_rows(rows):
    """Documents' rows for the index: an id, the text, and a vector of the text's characters and lines."""
    return rows.select(F.col("doc_id").alias("paper_id"), F.concat(F.lit("c"), "doc_id").alias("id"), "lang", "text", F.array(F.length("text"), F.size(F.split("text", "\n"))).cast("array<double>").alias("dense"))


@query(
    """
WITH a AS (SELECT doc_id, lang, text, 1 AS step FROM documents
  UNION ALL SELECT doc_id, lang, text || ' again', 2 FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, lang, NULL, 3 FROM documents WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, 'again', text, 4 FROM documents WHERE doc_id % 10 = 0)
SELECT doc_id AS paper_id, lang, CAST(length(text) AS INTEGER) AS n, md5(text) AS digest FROM a QUALIFY step = max(step) OVER (PARTITION BY doc_id) AND step <> 3
"""
)
def index_delta_merge(spark, d):
    """All documents, then a third written again, a fifth deleted and a tenth written once more, each as a delta; buckets are compacted in between."""
    rows, store = docs(spark, d), deltas.DeltaIndex(spark, f"{shared_dir(spark)}/delta-index-{uuid.uuid4().hex}", buckets=8)
    store.upsert(delta_rows(rows))
    store.upsert(delta_rows(rows.where("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" again")))))
    store.compact()
    store.delete(rows.where("doc_id % 5 = 0").select(F.col("doc_id").alias("paper_id")))
    store.upsert(delta_rows(rows.where("doc_id % 10 = 0").withColumn("lang", F.lit("again"))))
    return store.read().select("paper_id", "lang", F.length("text").alias("n"), F.md5("text").alias("digest"))


@query(
    """
WITH r AS (SELECT doc_id, CASE WHEN i % 7 = 3 AND doc_id % 4 = 1 THEN 'vector with entries that are no numbers' WHEN doc_id % 9 = 2 AND i = 1 THEN 'a required field is null' END AS error
  FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE doc_id % 11 <> 5)),
s AS (SELECT doc_id, min(error) AS error, count(*) AS n FROM r GROUP BY doc_id)
SELECT documents.doc_id AS paper_id, CASE WHEN s.doc_id IS NULL THEN 'no rows to index' ELSE error END AS error, CASE WHEN error IS NULL THEN coalesce(n, 0) ELSE 0 END AS live FROM documents LEFT JOIN s USING (doc_id)
"""
)
def index_bad_document_isolated(spark, d):
    """Lines of all documents, some with a bad vector or without an id: a document with one is an error, the others go live."""
    rows = docs(spark, d).where("doc_id % 11 <> 5").select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    broken = (F.col("i") % 7 == 3) & (F.col("paper_id") % 4 == 1)
    vector = F.array(F.length("line").cast("double"), F.when(~broken, F.lit(1.0)))
    rows = rows.select("paper_id", F.when(~((F.col("paper_id") % 9 == 2) & (F.col("i") == 1)), F.concat_ws("-", "paper_id", "i")).alias("id"), vector.alias("dense"))
    papers = docs(spark, d).select(F.col("doc_id").alias("paper_id"))
    good, errors = deltas.checked(rows, papers, dims=2)
    store = deltas.DeltaIndex(spark, f"{shared_dir(spark)}/delta-index-{uuid.uuid4().hex}", buckets=8)
    store.upsert(good)
    live = store.read().groupBy("paper_id").agg(F.count(F.lit(1)).alias("live"))
    return papers.join(errors, "paper_id", "left").join(live, "paper_id", "left").select("paper_id", "error", F.coalesce("live", F.lit(0)).alias("live"))


@query(
    f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
t AS (SELECT doc_id, line, list_distinct({TOKENS.format("line")}) AS x FROM l),
r AS (SELECT '10.5555/' || item_id AS doi, list_distinct({TOKENS.format("line")}) AS y FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark)),
s AS (SELECT DISTINCT x FROM (SELECT list_sort(x) AS x FROM t) WHERE len(x) > 0),
p AS (SELECT x, doi, len(list_intersect(x, y)) AS c, len(x) AS a, len(y) AS b FROM s, r WHERE len(y) > 0),
k AS (SELECT x, doi, CASE WHEN c = least(a, b) THEN 1.0::DOUBLE ELSE round(2.0::DOUBLE * c / (a + b), 6) END AS score FROM p WHERE c > 0),
m AS (SELECT x, doi, score FROM k WHERE score >= 0.9 QUALIFY row_number() OVER (PARTITION BY x ORDER BY score DESC, doi) = 1)
SELECT doc_id, md5(line) AS line, doi, score FROM t JOIN m ON list_sort(t.x) = m.x
"""
)
def doi_by_title(spark, d):
    """Every line of the documents against the lines of benchmark items as titles with a DOI."""
    lines = docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("title"))
    references = table(spark, d, "benchmark").select(F.concat(F.lit("10.5555/"), "item_id").alias("doi"), F.explode(F.split("text", "\n")).alias("title"))
    found = titles.matched(lines.select(F.struct("doc_id", F.md5("title").alias("line")).alias("title_id"), "title"), references)
    return found.select("title_id.*", "doi", "score")


def tei_documents(spark, d):
    """Documents as TEI: a header, a division for each line, and two entries of a bibliography; every 50th isn't well-formed."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    parts = F.transform(F.split("text", "\n"), lambda line, i: F.concat(F.lit("<div><head>Part "), i.cast("string"), F.lit('</head><p>'), escaped(line), F.lit('<ref type="bibr" target="#b0"/></p></div>')))
    head = F.concat(F.lit('<title level="m">Volume</title><title level="a">On '), "source", F.lit(" "), "doc_id", F.lit("</title><persName><forename>Ann</forename><surname>"), "lang", F.lit('</surname></persName><date when="'), (1990 + F.col("doc_id") % 30).cast("string"), F.lit('-05-01"/><idno type="DOI">10.5555/'), "doc_id", F.lit("</idno><keywords><term>"), "lang", F.lit("</term><term> </term></keywords>"))
    entry = lambda n: F.concat(F.lit(f'<biblStruct><title level="a">Work {n} of '), "source", F.lit('</title><title level="j">Journal</title><persName><surname>Bee</surname></persName><date when="2001"/></biblStruct>'))
    xml = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader>'), head, F.lit("</teiHeader><text><body>"), F.array_join(parts, ""), F.lit('</body><back><div type="references"><listBibl>'), entry(1), entry(2), F.lit("</listBibl></div></back></text></TEI>"))
    return files.tei_papers(docs(spark, d).where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("paper_id"), F.when(F.col("doc_id") % 50 == 7, F.concat(xml, F.lit("<"))).otherwise(xml).alias("xml")))


@query(
    """
SELECT CAST(doc_id AS VARCHAR) AS paper_id, CASE WHEN bad THEN CAST(doc_id AS VARCHAR) ELSE 'On ' || source || ' ' || doc_id END AS title, CASE WHEN bad THEN '' ELSE 'Ann ' || lang END AS authors, CASE WHEN NOT bad THEN CAST(1990 + doc_id % 30 AS INTEGER) END AS year,
  CASE WHEN NOT bad THEN '10.5555/' || doc_id END AS doi, CASE WHEN bad THEN '' ELSE lang END AS keywords, bad AS failed
FROM (SELECT *, doc_id % 50 = 7 AS bad FROM documents WHERE text IS NOT NULL)
"""
)
def tei_metadata(spark, d):
    rows = files.tei_metadata(tei_documents(spark, d))
    return rows.select("paper_id", "title", F.array_join("authors", "; ").alias("authors"), "year", "doi", F.array_join("keywords", "; ").alias("keywords"), F.col("error").isNotNull().alias("failed"))


@query(
    """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL AND doc_id % 50 <> 7),
c AS (SELECT doc_id, i, trim(regexp_replace(line || ' (#b0)', '\\s+', ' ', 'g')) AS content FROM l),
u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, content ORDER BY i) = 1)
SELECT CAST(doc_id AS VARCHAR) AS paper_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS section_ord, 'Part ' || i AS title, md5(replace(content, ' ', '')) AS content, '#b0' AS cited FROM u
"""
)
def tei_sections(spark, d):
    rows = files.tei_sections(tei_documents(spark, d))
    return rows.select("paper_id", "section_ord", "title", F.md5(F.replace("content", F.lit(" "), F.lit(""))).alias("content"), F.array_join("references_cited", "; ").alias("cited"))


@query(
    """
SELECT CAST(doc_id AS VARCHAR) AS paper_id, n - 1 AS ref_ord, 'Bee. Work ' || n || ' of ' || source || '. Journal. 2001' AS raw_text, 'Work ' || n || ' of ' || source AS title, CAST(2001 AS INTEGER) AS year, 'Journal' AS journal
FROM documents, (SELECT unnest([1, 2])::BIGINT AS n) WHERE text IS NOT NULL AND doc_id % 50 <> 7
"""
)
def tei_references(spark, d):
    return files.tei_references(tei_documents(spark, d)).select("paper_id", "ref_ord", "raw_text", "title", "year", "journal")


#: What events ask of a job.
ASKED = {"signup": "queued", "view": "running", "purchase": "completed_with_errors", "click": "cancel_requested", "error": "failed"}
LEGAL_SQL = " OR ".join(f"(split_part(acc, '|', 1) = '{s}' AND x IN ({', '.join(repr(t) for t in ts)}))" for s, ts in jobs.MOVES.items() if ts)


def moves(spark, d):
    to = F.create_map(*[F.lit(x) for both in ASKED.items() for x in both])[F.col("event_type")]
    return table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), F.col("event_id").alias("n"), to.alias("to"))


@query(
    f"""
WITH m AS (SELECT user_id AS job_id, ts, event_id, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ASKED.items())} ELSE '' END AS x FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
r AS (SELECT job_id, count(*) AS n, list_reduce(list(x ORDER BY ts, event_id), lambda acc, x: CASE WHEN {LEGAL_SQL} THEN x || '|' || (CAST(split_part(acc, '|', 2) AS BIGINT) + 1) ELSE acc END, '{jobs.START}|0') AS e FROM m GROUP BY job_id)
SELECT job_id, split_part(e, '|', 1) AS state, CAST(split_part(e, '|', 2) AS BIGINT) AS accepted, n - CAST(split_part(e, '|', 2) AS BIGINT) AS rejected FROM r
"""
)
def job_states(spark, d):
    """Users as jobs: their events ask for moves; which state they end in, and how many moves were legal."""
    return jobs.folded(moves(spark, d))


USAGE = "length(text) + 4 * (turn + 1)"


@query(
    f"""
WITH u AS (SELECT conv_id, turn, role, coalesce({USAGE}, 0) AS used FROM conversations)
SELECT conv_id, turn, role, CAST(used AS BIGINT) AS used, CAST(sum(used) OVER (PARTITION BY conv_id ORDER BY turn, role) AS BIGINT) AS so_far, CAST(sum(used) OVER (PARTITION BY conv_id, role ORDER BY turn) AS BIGINT) AS by_role,
  CAST(sum(used) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS last_3 FROM u
"""
)
def usage_running(spark, d):
    """What each call of a conversation uses, with running sums by conversation and role and over the last three calls."""
    used = table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce(F.expr(USAGE), F.lit(0)).cast("long").alias("used"))
    return runs.usage_so_far(used, ["conv_id"], ["turn", "role"], "used", "role", 3)


RETRY_SQL = f"""
WITH p AS (SELECT DISTINCT conv_id FROM conversations),
r AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS attempt, CASE WHEN turn % 4 = 3 THEN '{{"classification": ["A"]}}' WHEN turn % 5 <> 2 THEN text END AS raw FROM conversations),
a AS (SELECT * FROM r WHERE attempt <= 3 AND raw IS NOT NULL),
v AS (SELECT conv_id, min(attempt) AS ok FROM a WHERE starts_with(raw, '{{"classification"') GROUP BY conv_id),
s AS (SELECT a.*, ok, coalesce(attempt < ok, true) AS bad FROM a LEFT JOIN v USING (conv_id) WHERE attempt <= coalesce(ok, 3)),
g AS (SELECT conv_id, count(*) AS n_samples, arg_max(raw, attempt) AS raw, coalesce(string_agg(chr(10) || 'assistant: ' || raw || chr(10) || 'user: {turns.CORRECTION}', '' ORDER BY attempt) FILTER (bad AND attempt < 3), '') AS more FROM s GROUP BY conv_id)
SELECT p.conv_id, ok AS attempt, md5(raw) AS raw, md5('system: classify' || chr(10) || 'user: paper ' || p.conv_id || coalesce(more, '')) AS history, coalesce(n_samples, 0) AS n_samples
FROM p LEFT JOIN v USING (conv_id) LEFT JOIN g USING (conv_id)
"""


@query(RETRY_SQL)
def retry_with_corrections(spark, d):
    """Each conversation's turns as answers to one prompt, some of them null (failed generations) and some that read; histories and samples of three rounds."""
    from pyspark.sql import Window

    rows = table(spark, d, "conversations")
    attempt = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    raw = F.when(F.col("turn") % 4 == 3, '{"classification": ["A"]}').when(F.col("turn") % 5 != 2, F.col("text"))
    responses = rows.select(F.col("conv_id").alias("paper_id"), attempt.alias("attempt"), raw.alias("raw"))
    prompt = F.array(turns.message("system", F.lit("classify")), turns.message("user", F.concat(F.lit("paper "), "conv_id")))
    papers = rows.select("conv_id").distinct().select(F.col("conv_id").alias("paper_id"), prompt.alias("messages"))
    out = turns.retried(papers, turns.canned(responses))
    history = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return out.select(F.col("paper_id").alias("conv_id"), "attempt", F.md5("raw").alias("raw"), F.md5(history).alias("history"), F.size("samples").cast("long").alias("n_samples"))


TEMPLATE = "Categories:\n{categories}\nTitle: {title}\nAbstract: {abstract}\nKeywords: {keywords}\n**Relevant Extracts:**\n\n{chunks_info}\nAnswer as {schema}."
CATEGORIES = {"A": "open", "B": "closed"}
SCHEMA = '{"type": "object"}'
BLOCK_SQL = """c AS (SELECT paper_id, category, min(rank) AS first, upper(category) || ' (avg ' || CAST(round(CAST(avg(score) AS DECIMAL(18, 12)), 3) AS VARCHAR) || '):' || chr(10) || string_agg('  • ' || CAST(round(CAST(score AS DECIMAL(18, 12)), 3) AS VARCHAR) || ': ' || text, chr(10) ORDER BY rank) AS b FROM sel GROUP BY paper_id, category),
blocks AS (SELECT paper_id, string_agg(chr(10) || b, chr(10) ORDER BY first) AS block FROM c GROUP BY paper_id)"""


@query(
    f"""
WITH {HIT_SQL}, {SELECTED}, {BLOCK_SQL}
SELECT doc_id AS paper_id, 'Categories:' || chr(10) || 'A – open' || chr(10) || 'B – closed' || chr(10) || 'Title: ' || source || chr(10) || 'Abstract: ' || CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'N/A' END || chr(10) || 'Keywords: ' || lang || ', ' || source || chr(10)
  || CASE WHEN block IS NULL THEN '' ELSE '**Relevant Extracts:**' || chr(10) || chr(10) || block END || chr(10) || 'Answer as {SCHEMA}.' AS prompt
FROM documents LEFT JOIN blocks ON paper_id = doc_id
"""
)
def prompt_classification(spark, d):
    blocks = prompts.by_category(rerank.select_evidence(hits(spark, d), 5), "paper_id")
    abstract = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    papers = docs(spark, d).select(F.col("doc_id").alias("paper_id"), F.col("source").alias("title"), abstract.alias("abstract"), F.array("lang", "source").alias("keywords"))
    return prompts.classification(papers, blocks, TEMPLATE, CATEGORIES, SCHEMA)


@query(
    """
WITH g AS (SELECT conv_id, string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) AS made FROM conversations WHERE role = 'assistant' AND trim(text) <> '' AND NOT contains(lower(text), 'failed') GROUP BY conv_id)
SELECT item_id AS query_id, text, CASE WHEN made IS NULL THEN text ELSE text || chr(10) || chr(10) || made END AS retrieval_text FROM benchmark LEFT JOIN g ON conv_id = item_id
"""
)
def hyde_queries(spark, d):
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    made = table(spark, d, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("n"), "text")
    return retrieval.with_hypothetical(queries, made)


@query("SELECT event_id AS job_id, user_id, event_type, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place FROM events QUALIFY place <= 50")
def job_listing(spark, d):
    return runs.recent(table(spark, d, "events").select(F.col("event_id").alias("job_id"), "user_id", "event_type", F.col("ts").alias("created_at")), 50, "job_id").drop("created_at")


@query("SELECT (SELECT count(*) FROM documents) AS document_count, (SELECT count(DISTINCT source) FROM documents) AS paper_count, (SELECT count(DISTINCT event_type) FROM events) AS task_count")
def workspace_counts(spark, d):
    return runs.workspace_counts(docs(spark, d), docs(spark, d).select(F.col("source").alias("paper_id")), table(spark, d, "events").select(F.col("event_type").alias("task_key")))


@query(
    """
WITH r AS (SELECT doc_id, count(*) AS n, count(*) FILTER (quality = 1) AS s FROM labels GROUP BY doc_id)
SELECT doc_id AS paper_id, source AS paper_title, '["' || lang || '"]' AS keywords, len(string_split(text, chr(10))) AS num_sections, coalesce(n, 0) AS num_references, coalesce(s, 0) AS data_source_references
FROM documents LEFT JOIN r USING (doc_id)
"""
)
def result_records(spark, d):
    papers = docs(spark, d).select(F.col("doc_id").alias("paper_id"), F.col("source").alias("paper_title"), F.array("lang").alias("keywords"))
    sections = docs(spark, d).select(F.col("doc_id").alias("paper_id"), F.explode_outer(F.split("text", "\n")).alias("content"))
    refs = table(spark, d, "labels").select(F.col("doc_id").alias("paper_id"), (F.col("quality") == 1).alias("is_data_source"))
    return runs.result_records(papers, sections, refs)


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS id, COALESCE(source, '') AS paper_id, COALESCE(text, '') AS text, 'other' AS section_type,
              COALESCE(lang, source, '') AS section_title, COALESCE(source, lang, '') AS title, FALSE AS is_metadata,
              n_chars / 1000.0::DOUBLE AS similarity_score, COALESCE(r.quality::DOUBLE, n_chars / 1000.0::DOUBLE) AS rank_score,
              'dense' AS source_kind, CAST(to_json({'toxic': r.toxic}) AS VARCHAR) AS artifacts
       FROM documents LEFT JOIN labels r USING (doc_id) WHERE COALESCE(n_chars, 0) >= 500"""
)
def search_result_mapping(spark, d):
    """Documents as chunks of a search, ranked by their quality where there is one."""
    marks = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("rank_score"), "toxic")
    chunks = docs(spark, d).select(F.col("doc_id").alias("id"), F.col("source").alias("paper_id"), "text", F.col("lang").alias("section_title"), F.col("source").alias("title"), (F.col("n_chars") / 1000.0).alias("score"))
    return results.search_results(chunks.join(marks, "id", "left"), "dense", 0.5).withColumnRenamed("source", "source_kind")


REPORT_SQL = """
WITH r AS (
  SELECT doc_id, list_sort(coalesce(list(quality) FILTER (quality IS NOT NULL), [])) AS q, list_sort(coalesce(list(toxic) FILTER (toxic IS NOT NULL), [])) AS t
  FROM labels GROUP BY doc_id
), l AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS paper_id, list_concat(
    ['# Paper ID: ' || d.doc_id || chr(10), '**Title:** ' || coalesce(nullif(source, ''), 'N/A') || chr(10), '**First Author:** N/A' || chr(10),
     '**Publication Year:** N/A' || chr(10), '**DOI:** N/A' || chr(10), '**Journal:** N/A' || chr(10), '**Analysis Type:** quality' || chr(10),
     '**PDF Path:** N/A' || chr(10), chr(10) || '---' || chr(10), '## Abstract' || chr(10), coalesce(nullif(text, ''), 'N/A') || chr(10),
     '## Keywords' || chr(10), coalesce(nullif(lang, ''), 'N/A') || chr(10), '## Extracted Data Sources' || chr(10)],
    CASE WHEN r.q IS NULL THEN ['No data sources extracted.' || chr(10)] ELSE flatten(list_transform(r.q, lambda x:
      ['- **Source Name:** quality' || chr(10), '  - **URL:** N/A' || chr(10), '  - **Explanation:** ' || x || chr(10), '  - **Section Found:** labels' || chr(10) || chr(10)])) END,
    [chr(10) || '---' || chr(10), '## Data Sources Description' || chr(10), coalesce(CAST(n_chars AS VARCHAR), 'N/A') || chr(10)],
    CASE WHEN len(r.t) > 0 THEN list_concat([chr(10) || '---' || chr(10), '## Confidence Scores' || chr(10)], list_transform(r.t, lambda x: '- **toxic:** ' || x || chr(10) || chr(10))) ELSE [] END
  ) AS lines FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id
)
SELECT paper_id, array_to_string(lines, chr(10)) AS report FROM l
"""


@query(REPORT_SQL)
def paper_reports(spark, d):
    """A report of each document with its labels as what was extracted."""
    marks = table(spark, d, "labels").groupBy("doc_id").agg(F.sort_array(F.collect_list("quality")).alias("q"), F.sort_array(F.collect_list("toxic")).alias("t"))
    none = F.lit(None).cast("string")
    source = lambda x: F.struct(F.lit("quality").alias("source_name"), none.alias("url"), x.alias("explanation"), F.lit("labels").alias("section_found"))
    papers = docs(spark, d).join(marks, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("paper_id"), F.col("source").alias("title"), *[none.alias(c) for c in ("first_author", "publication_year", "doi", "journal", "path")],
        F.lit("quality").alias("analysis_type"), F.col("text").alias("abstract"), F.array("lang").alias("keywords"), F.transform("q", source).alias("sources"),
        F.col("n_chars").alias("description"), F.transform("t", lambda x: F.struct(F.lit("toxic").alias("name"), x.alias("score"))).alias("scores"), F.lit(None).cast("array<string>").alias("dois"),
    )
    return results.reports(papers)
