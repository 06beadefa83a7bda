"""Queries on sources, chunking, embedding and index maintenance, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_lake.functions.text import stem, title_from_key, truncate, uuid5
from evidence_lake.operators import chunking, embedding, index
from evidence_lake.operators.blocks import spread
from evidence_lake.sources import sections

QUERIES: dict = {}
SQL: dict[str, str] = {}
TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
VOCABULARY = ["the", "and", "der", "und", "les", "des", "los", "que"]
DIMS = 16


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark, d) -> DataFrame:
    """The documents; a table of a few small files is dealt out over the cores."""
    return spread(table(spark, d, "documents"))


def paragraphs(spark, d) -> DataFrame:
    """doc_id, text with blank lines between paragraphs."""
    return docs(spark, d).select("doc_id", "source", "lang", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


NONBLANK = "list_filter(list_transform({0}, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
EXPLODED = "SELECT {keep}, unnest(range(len(p))) AS chunk_ord, unnest(p) AS text FROM (SELECT *, {pieces} AS p FROM documents)"


def exploded(pieces: str, keep: str = "doc_id") -> str:
    return EXPLODED.format(keep=keep, pieces=pieces)


SENTENCES = NONBLANK.format("string_split(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))")
PARAGRAPHS = NONBLANK.format("string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n')")
LONG_PARAGRAPHS = f"list_filter({PARAGRAPHS}, lambda q: length(q) >= 20 AND len(string_split_regex(q, '\\s+')) >= 6)"


def windows(text: str, size: int, step: int) -> str:
    return NONBLANK.format(f"list_transform(range(0, length({text}), {step}), lambda i: substring({text}, CAST(i + 1 AS BIGINT), {size}))")


@query("SELECT doc_id, 0::BIGINT AS chunk_ord, text FROM documents")
def chunk_none(spark, d):
    return chunking.chunk(docs(spark, d), chunking.none()(F.col("text")), ["doc_id"])


@query(exploded(SENTENCES))
def chunk_sentence(spark, d):
    return chunking.chunk(docs(spark, d), chunking.sentence()(F.col("text")), ["doc_id"])


@query(exploded(LONG_PARAGRAPHS))
def chunk_paragraph(spark, d):
    return chunking.chunk(paragraphs(spark, d), chunking.paragraph(20)(F.col("text")), ["doc_id"])


@query(exploded(windows("text", 600, 500)))
def chunk_fixed(spark, d):
    return chunking.chunk(docs(spark, d), chunking.fixed_size(600, 100)(F.col("text")), ["doc_id"])


@query(exploded(f"flatten(list_transform({LONG_PARAGRAPHS}, lambda c: CASE WHEN length(c) <= 200 THEN [c] ELSE {windows('c', 200, 200)} END))"))
def chunk_recursive(spark, d):
    return chunking.chunk(paragraphs(spark, d), chunking.recursive(200, chunking.paragraph(20))(F.col("text")), ["doc_id"])


def paper_parts(spark, d):
    """Papers whose abstract is the first line; sections from the other lines."""
    rows = docs(spark, d).select(F.concat(F.lit("p"), "doc_id").alias("paper_id"), F.split("text", "\n").alias("l"))
    papers = rows.select("paper_id", F.trim(F.col("l")[0]).alias("abstract"))
    body = F.replace(F.array_join(F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0))), "\n"), F.lit("\n"), F.lit("\n\n"))
    return papers, sections.text_sections(rows.select("paper_id", body.alias("t")), "paper_id", "t")


UUID5 = "lower(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', 1 + CAST(('0x' || substr({h}, 17, 1))::BIGINT % 4 AS INTEGER), 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"
IDS = UUID5.format(h="sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(text))")
PAPER_CHUNKS = f"""
WITH l AS (SELECT 'p' || doc_id AS paper_id, string_split(text, chr(10)) AS l FROM documents),
s AS (
  SELECT paper_id, unnest(range(len(p))) AS section_ord, unnest(p) AS content
  FROM (SELECT paper_id, {NONBLANK.format("l[2:]")} AS p FROM l)
), c AS (
  SELECT paper_id, -1::BIGINT AS section_ord, 0::BIGINT AS chunk_ord, trim(l[1], ' ') AS text, true AS is_metadata, 'Abstract' AS section_type FROM l WHERE trim(l[1], ' ') <> ''
  UNION ALL
  SELECT paper_id, section_ord, unnest(range(len(q))), unnest(q), false, 'Other' FROM (SELECT paper_id, section_ord, {SENTENCES.replace("text", "content")} AS q FROM s)
)"""


@query(PAPER_CHUNKS + f"SELECT *, {IDS} AS id FROM c")
def chunk_abstract_plus_sections(spark, d):
    papers, parts = paper_parts(spark, d)
    return chunking.chunk_papers(papers, parts, chunking.sentence()).drop("section_title")


@query(f"SELECT doc_id, {IDS} AS id FROM documents")
def chunk_ids_uuid5(spark, d):
    return docs(spark, d).select("doc_id", uuid5(F.col("text")).alias("id"))


def sentence_vectors(spark, d):
    rows = chunking.chunk(docs(spark, d), chunking.sentence()(F.col("text")), ["doc_id"])
    return rows.withColumn("vec", embedding.hashed(8)(F.col("text")))


@query(
    f"""
WITH s AS ({exploded(SENTENCES)}),
t AS (SELECT doc_id, chunk_ord, unnest({TOKENS.format("text")}) AS tok FROM s),
b AS (SELECT doc_id, chunk_ord, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 8 AS b, count(*) AS n FROM t GROUP BY ALL),
u AS (SELECT doc_id, chunk_ord, b, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id, chunk_ord)) AS x FROM b),
c AS (SELECT y.doc_id, y.chunk_ord, sum(x.x * y.x) AS dot FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.b = y.b AND x.chunk_ord + 1 = y.chunk_ord GROUP BY ALL),
m AS (SELECT s.*, CASE WHEN s.chunk_ord = 0 OR round(coalesce(dot, 0) / (1 + 1e-9), 6) < 0.5 THEN 1 ELSE 0 END AS new FROM s LEFT JOIN c USING (doc_id, chunk_ord)),
g AS (SELECT doc_id, chunk_ord AS o, text, sum(new) OVER (PARTITION BY doc_id ORDER BY chunk_ord) - 1 AS g FROM m)
SELECT doc_id, CAST(g AS BIGINT) AS chunk_ord, string_agg(text, ' ' ORDER BY o) AS text FROM g GROUP BY doc_id, g
"""
)
def chunk_semantic_last(spark, d):
    return chunking.semantic_last(sentence_vectors(spark, d), "doc_id", "chunk_ord", "text", "vec", 0.5)


@query()
def chunk_semantic_mean(spark, d):
    """An order-dependent fold, which SQL can't express; tested against a plain loop."""
    return chunking.semantic_mean(sentence_vectors(spark, d), "doc_id", "chunk_ord", "text", "vec", 0.5)


@query(
    f"""
WITH p AS (SELECT {IDS} AS id, doc_id AS seq, source AS paper_id FROM documents)
SELECT id, max(seq) AS seq, max_by(paper_id, seq) AS paper_id FROM p GROUP BY id
"""
)
def index_upsert_last_write_wins(spark, d):
    points = docs(spark, d).select(uuid5(F.col("text")).alias("id"), F.col("doc_id").alias("seq"), F.col("source").alias("paper_id"))
    return index.upsert(points.where("paper_id = 'src0'"), points.where("paper_id <> 'src0'"))


@query("SELECT doc_id, source FROM documents WHERE source IS DISTINCT FROM 'src0'")
def index_delete_namespace(spark, d):
    return index.delete_namespace(docs(spark, d).select("doc_id", "source"), "src0", "source")


@query("SELECT DISTINCT unnest(json_keys(props)) AS key FROM events")
def index_payload_keys(spark, d):
    payload = table(spark, d, "events").select(F.from_json("props", "map<string,string>").alias("payload"))
    return index.payload_keys(payload)


@query(
    f"SELECT doc_id, 'no chunks' AS error FROM documents WHERE len({LONG_PARAGRAPHS}) = 0"
)
def index_zero_chunk_guard(spark, d):
    papers = paragraphs(spark, d)
    return index.without_chunks(papers, chunking.chunk(papers, chunking.paragraph(20)(F.col("text")), ["doc_id"]), "doc_id")


@query("SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY source, lang")
def meta_insert_first_write_wins(spark, d):
    rows = docs(spark, d).select("source", "lang", "doc_id")
    first = rows.groupBy("source", "lang").agg(F.min("doc_id").alias("doc_id")).where("lang = 'en'")
    return index.insert_absent(first, rows, ["source", "lang"], "doc_id")


@query("SELECT DISTINCT source AS doc FROM documents")
def meta_list_docs(spark, d):
    return docs(spark, d).select(F.col("source").alias("doc")).distinct().orderBy("doc")


@query(
    """
SELECT doc_id AS seq, sha256(text) AS sha256, row_number() OVER w > 1 AS duplicate, first_value(doc_id) OVER w AS first_seq
FROM documents WINDOW w AS (PARTITION BY sha256(text) ORDER BY doc_id)
"""
)
def upload_sha256_dedup(spark, d):
    return index.upload_status(docs(spark, d).select(F.col("doc_id").alias("seq"), F.encode("text", "UTF-8").alias("content"))).select("seq", "sha256", "duplicate", "first_seq")


@query(
    """
WITH u AS (SELECT source || '_' || doc_id || (CASE WHEN lang = 'en' THEN '.txt' WHEN lang = 'fr' THEN '.MD' WHEN lang = 'de' THEN '.exe' ELSE '/x.pdf' END) AS filename, text FROM documents)
SELECT filename, CASE WHEN filename LIKE '%/%' THEN 'path in name' WHEN lower(filename) LIKE '%.exe' THEN 'unsupported type' WHEN strlen(text) = 0 THEN 'empty' ELSE 'too large' END AS reason
FROM u WHERE filename LIKE '%/%' OR lower(filename) LIKE '%.exe' OR strlen(text) = 0 OR strlen(text) > 4000
"""
)
def upload_validation(spark, d):
    suffix = F.when(F.col("lang") == "en", ".txt").when(F.col("lang") == "fr", ".MD").when(F.col("lang") == "de", ".exe").otherwise("/x.pdf")
    return index.upload_errors(docs(spark, d).select(F.concat("source", F.lit("_"), "doc_id", suffix).alias("filename"), F.encode("text", "UTF-8").alias("content")), 4000)


@query(
    f"""
WITH t AS (SELECT doc_id, unnest({TOKENS.format("text")}) AS tok FROM documents),
b AS (SELECT doc_id, CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % {DIMS} AS INTEGER) AS dim, count(*) AS n FROM t GROUP BY ALL)
SELECT doc_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS x FROM b
"""
)
def embed_hash_dense(spark, d):
    vectors = docs(spark, d).select("doc_id", embedding.hashed(DIMS)(F.col("text")).alias("v"))
    return vectors.select("doc_id", F.posexplode_outer("v").alias("dim", "x")).where("x <> 0").withColumn("x", F.round("x", 6))


KEYWORD_COUNTS = ", ".join(f"len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ('{t}', '{t}s')))::DOUBLE" for t in VOCABULARY)


@query(
    f"""
WITH c AS (SELECT doc_id, [{KEYWORD_COUNTS}] AS c FROM documents)
SELECT doc_id, unnest(range({len(VOCABULARY)}))::INTEGER AS dim, unnest(list_transform(c, lambda x: CASE WHEN list_inner_product(c, c) > 0 THEN round(x / sqrt(list_inner_product(c, c)), 6) ELSE 0 END)) AS x FROM c
"""
)
def embed_keyword(spark, d):
    vectors = docs(spark, d).select("doc_id", embedding.keywords(VOCABULARY)(F.col("text")).alias("v"))
    return vectors.select("doc_id", F.posexplode_outer("v").alias("dim", "x")).where("dim IS NOT NULL").withColumn("x", F.round("x", 6))


@query(f"SELECT doc_id, term, round(ln(1 + count(*)), 6) AS weight FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY ALL")
def embed_sparse_terms(spark, d):
    return embedding.sparse_terms(docs(spark, d), "doc_id", "text")


@query(f"SELECT doc_id, unnest(range(len(p))) AS section_ord, unnest(p) AS content, '' AS title, 'Other' AS section_type FROM (SELECT doc_id, {NONBLANK.format('string_split(text, chr(10))')} AS p FROM documents)")
def text_sections(spark, d):
    return sections.text_sections(paragraphs(spark, d), "doc_id", "text")


LINES = """
l AS (
  SELECT doc_id, unnest(range(len(x))) AS line_ord, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)
), lines AS (
  SELECT doc_id, line_ord // 3 AS page, line_ord, text, CASE WHEN length(text) < 40 THEN 14.04 ELSE 10.02 + (length(text) % 2) / 100.0 END::DOUBLE AS size, length(text) % 7 = 0 AS bold FROM l
)"""


def pdf_lines(spark, d):
    """A stand-in for a parser's line stream: three lines a page, short lines in a larger size."""
    l = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_ord", "text"))  # noqa: E741
    n = F.length("text")
    size = F.when(n < 40, F.lit(14.04)).otherwise(F.lit(10.02) + (n % 2) / 100.0)
    return l.select("doc_id", F.floor(F.col("line_ord") / 3).alias("page"), F.col("line_ord").cast("long").alias("line_ord"), "text", size.alias("size"), (n % 7 == 0).alias("bold"))


BODY = "SELECT doc_id, body FROM (SELECT doc_id, round(size, 1) AS body, count(*) AS n FROM lines GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, body) = 1"
NOISE = "SELECT s.doc_id, s.text FROM (SELECT doc_id, text, count(DISTINCT page) AS n FROM lines GROUP BY ALL) s JOIN (SELECT doc_id, count(DISTINCT page) AS pages FROM lines GROUP BY ALL) p USING (doc_id) WHERE n >= 3 AND n >= 0.5 * pages AND length(s.text) < 100"


@query(f"WITH {LINES} {BODY}")
def lines_body_font_mode(spark, d):
    return sections.body_size(pdf_lines(spark, d))


@query(f"WITH {LINES} {NOISE}")
def lines_repeated_noise(spark, d):
    return sections.repeated_noise(pdf_lines(spark, d))


@query(
    f"""
WITH {LINES}, body AS ({BODY}), noise AS ({NOISE}),
m AS (
  SELECT x.*, length(text) BETWEEN 3 AND 90 AND len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) <= 14 AND regexp_matches(text, '\\p{{L}}') AND (bold OR size > 1.05 * body) AS h
  FROM lines x JOIN body USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM noise n WHERE n.doc_id = x.doc_id AND n.text = x.text)
), g AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY page, line_ord) AS island FROM m),
s AS (SELECT doc_id, island, max(text) FILTER (h) AS title, string_agg(text, chr(10) ORDER BY page, line_ord) FILTER (NOT h) AS content FROM g GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS section_ord, coalesce(title, '') AS title, content FROM s WHERE content IS NOT NULL
"""
)
def lines_to_sections(spark, d):
    return sections.line_sections(pdf_lines(spark, d))


TITLE_CASES = "CASE " + " ".join(f"WHEN regexp_matches(lower(trim(t)), '{sections.section_pattern(b)}') THEN '{b}'" for b in sections.SECTION_WORDS) + " ELSE 'other' END"
TITLES = "Introduction and Data|Materials and Methods|Key Findings|Future Work|Funding|Works cited|Annex B|Survey frame|Software|Untitled|Databases|Preamble"


@query(f"SELECT doc_id, t AS title, {TITLE_CASES} AS section_type FROM (SELECT doc_id, string_split('{TITLES}', '|')[1 + doc_id % 12] AS t FROM documents)")
def section_type_classify(spark, d):
    title = F.element_at(F.split(F.lit(TITLES), r"\|"), (F.col("doc_id") % 12 + 1).cast("int"))
    return docs(spark, d).select("doc_id", title.alias("title"), sections.section_type(title).alias("section_type"))


CLEAN = "trim(regexp_replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(
    f"""
WITH b AS (SELECT page_id, string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<script\\b.*?</script>', '', 'g'), '(?s)<style\\b.*?</style>', '', 'g'), '(?s)<head\\b.*?</head>', '', 'g'), '<h[1-6][^>]*>') AS p FROM pages),
s AS (SELECT page_id, unnest(range(len(p))) AS section_ord, unnest(p) AS piece FROM b),
c AS (SELECT page_id, section_ord, CASE WHEN section_ord = 0 THEN '' ELSE {CLEAN.format("regexp_extract(piece, '(?s)^(.*?)</h[1-6]>', 1)")} END AS title, CASE WHEN section_ord = 0 THEN {CLEAN.format("piece")} ELSE {CLEAN.format("regexp_replace(piece, '(?s)^.*?</h[1-6]>', '')")} END AS content FROM s)
SELECT * FROM c WHERE section_ord > 0 OR content <> ''
"""
)
def html_to_sections(spark, d):
    return sections.html_sections(table(spark, d, "pages"))


@query("SELECT page_id, regexp_replace(list_last(string_split(url, '/')), '(.)\\.[^.]*$', '\\1') AS stem, array_to_string(list_transform(string_split(replace('p_' || page_id, '_', ' '), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS title FROM pages")
def file_names(spark, d):
    return table(spark, d, "pages").select("page_id", stem(F.col("url")).alias("stem"), title_from_key(F.concat(F.lit("p_"), "page_id")).alias("title"))


@query("SELECT doc_id, CASE WHEN length(c) <= 60 THEN c ELSE rtrim(substr(c, 1, 57)) || '...' END AS line FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM documents)")
def text_preview(spark, d):
    return docs(spark, d).select("doc_id", truncate(F.col("text"), 60).alias("line"))
