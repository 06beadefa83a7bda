"""Queries on prompts, answers, label rules, runs and listings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_lake.functions import answers, codes, prompts
from evidence_lake.operators import rerank, runs
from evidence_lake.plans.chunk_queries import docs, table
from evidence_lake.plans.search_queries import HIT_SQL, SELECTED, hits

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def selected(spark, d):
    return rerank.select_evidence(hits(spark, d), 5).withColumn("section_type", F.col("category"))


@query(
    f"""
WITH {HIT_SQL}, {SELECTED},
c AS (SELECT paper_id, category, min(rank) AS first, upper(category) || ' (avg ' || CAST(round(CAST(avg(score) AS DECIMAL(18, 12)), 3) AS VARCHAR) || '):' || chr(10) || string_agg('  • ' || CAST(round(CAST(score AS DECIMAL(18, 12)), 3) AS VARCHAR) || ': ' || text, chr(10) ORDER BY rank) AS b FROM sel GROUP BY paper_id, category)
SELECT paper_id, string_agg(chr(10) || b, chr(10) ORDER BY first) AS block FROM c GROUP BY paper_id
"""
)
def prompt_chunks_block(spark, d):
    return prompts.by_category(selected(spark, d), "paper_id")


CONTEXT = "'[Context ' || rank || ' | paper_id=' || paper_id || ' | section=' || category || ']' || chr(10) || text"


@query(f"WITH {HIT_SQL}, {SELECTED} SELECT paper_id, string_agg({CONTEXT}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM sel GROUP BY paper_id")
def prompt_contexts(spark, d):
    rows = selected(spark, d).withColumn("key", F.col("paper_id"))
    return prompts.contexts(rows, "key").withColumnRenamed("key", "paper_id")


@query(f"WITH {HIT_SQL}, {SELECTED} SELECT paper_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS answer, count(*) AS n_evidences FROM sel GROUP BY paper_id")
def answer_concat_with_provenance(spark, d):
    rows = selected(spark, d).withColumn("key", F.col("paper_id"))
    return prompts.concatenated(rows, "key").select(F.col("key").alias("paper_id"), "answer", F.size("evidences").cast("long").alias("n_evidences"))


def letters(*steps: int):
    """Codes of a document, from its id; Z is no code of any table."""
    return F.array(*[F.substring(F.lit("ABCDEFGHZ"), (F.floor(F.col("doc_id") / s) % 9 + 1).cast("int"), F.lit(1)) for s in steps])


LETTERS = "[" + ", ".join(f"substr('ABCDEFGHZ', CAST(doc_id // {s} % 9 + 1 AS BIGINT), 1)" for s in (1, 5, 40)) + "]"
CODED = f"WITH c AS (SELECT doc_id, {LETTERS} AS c, substr('ABCDEFGHZ', CAST(doc_id // 3 % 9 + 1 AS BIGINT), 1) AS p FROM documents)"


def coded(spark, d):
    return docs(spark, d).select("doc_id", letters(1, 5, 40).alias("c"), letters(3)[0].alias("p"))


def sql_map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


@query(f"{CODED}, k AS (SELECT doc_id, list_filter(c, lambda x: x IN ('A', 'B', 'C', 'D', 'E', 'F')) AS k FROM c), v AS (SELECT doc_id, CASE WHEN len(k) > 0 THEN k ELSE ['F'] END AS codes FROM k) SELECT doc_id, array_to_string(codes, ',') AS codes, array_to_string(list_transform(codes, lambda x: {sql_map(codes.ACCESS_LABELS)}[x]), ',') AS labels FROM v")
def parse_codes_with_default(spark, d):
    rows = coded(spark, d).withColumn("k", codes.known_codes(F.col("c"), codes.ACCESS_LABELS, "F"))
    return rows.select("doc_id", F.array_join("k", ",").alias("codes"), F.array_join(codes.labels_of(F.col("k"), codes.ACCESS_LABELS), ",").alias("labels"))


PRIMARY = "CASE WHEN list_contains(codes, p) THEN p WHEN len(codes) = 1 THEN codes[1] END"


def normalised(name: str, rule, order: str, regional: bool):
    letters_sql = "[" + ", ".join(f"'{x}'" for x in order) + "]"
    kept = f"list_filter({letters_sql}, lambda x: list_contains(c, x))"
    rule_sql = f"CASE WHEN list_contains(k, 'G') THEN ['G'] WHEN len(list_filter(k, lambda x: x <> 'H')) > 0 THEN list_filter(k, lambda x: x <> 'H') ELSE ['H'] END" if regional else "k"  # noqa: F541

    def run(spark, d):
        rows = coded(spark, d).withColumn("codes", rule(F.col("c")))
        return rows.select("doc_id", F.array_join("codes", ",").alias("codes"), codes.primary_of(F.col("codes"), F.col("p")).alias("primary_label"))

    run.__name__ = name
    query(f"{CODED}, k AS (SELECT doc_id, p, {kept} AS k FROM c), n AS (SELECT doc_id, p, {rule_sql} AS codes FROM k) SELECT doc_id, array_to_string(codes, ',') AS codes, {PRIMARY} AS primary_label FROM n")(run)


normalised("normalise_davail", codes.access_codes, "ABCDEF", False)
normalised("normalise_geo", codes.region_codes, "ABCDEFGH", True)
normalised("normalise_dtype", codes.type_codes, "ABCDEFGH", True)

KINDS = ["META", "MODEL", "UNCLEAR", "OTHER", "TRIAL"]


@query(
    """
WITH k AS (SELECT doc_id, ['META', 'MODEL', 'UNCLEAR', 'OTHER', 'TRIAL'] AS k FROM documents),
s AS (SELECT doc_id, k[1 + doc_id % 5] AS p, [k[1 + doc_id // 2 % 5], k[1 + doc_id // 7 % 5], k[1 + doc_id // 2 % 5]] AS s FROM k)
SELECT doc_id, p AS primary_label, CASE WHEN p IN ('OTHER', 'UNCLEAR') THEN '' ELSE array_to_string(CASE WHEN s[1] = s[2] THEN list_filter(s[1:1], lambda x: x NOT IN (p, 'UNCLEAR', 'OTHER')) ELSE list_filter(s[1:2], lambda x: x NOT IN (p, 'UNCLEAR', 'OTHER')) END, ',') END AS secondary FROM s
"""
)
def normalise_paper_type(spark, d):
    kinds = F.array(*[F.lit(k) for k in KINDS])
    pick = lambda c: F.element_at(kinds, (c % 5 + 1).cast("int"))
    two = pick(F.floor(F.col("doc_id") / 2))
    rows = docs(spark, d).select("doc_id", pick(F.col("doc_id")).alias("p"), F.array(two, pick(F.floor(F.col("doc_id") / 7)), two).alias("s"))
    return rows.select("doc_id", F.col("p").alias("primary_label"), F.array_join(codes.secondary_labels(F.col("p"), F.col("s")), ",").alias("secondary"))


@query("SELECT doc_id, quality, CASE WHEN quality IS NOT NULL THEN CASE WHEN (n_chars % 2) = quality THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS reward FROM documents LEFT JOIN labels USING (doc_id)")
def reward_accuracy(spark, d):
    rows = docs(spark, d).select("doc_id", (F.col("n_chars") % 2).alias("predicted")).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    gold = F.when(F.col("quality").isNotNull(), F.array(F.col("quality").cast("long")))
    return rows.select("doc_id", "quality", answers.reward(F.array("predicted"), gold).alias("reward"))


@query("SELECT count(*) AS n, count(reward) AS n_gold, round(avg(reward), 6) AS accuracy FROM (SELECT CASE WHEN quality IS NOT NULL THEN CASE WHEN (n_chars % 2) = quality THEN 1.0 ELSE 0.0 END END AS reward FROM documents LEFT JOIN labels USING (doc_id))")
def reward_mean(spark, d):
    return reward_accuracy(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count("reward").alias("n_gold"), F.round(F.avg("reward"), 6).alias("accuracy"))


@query(
    """
WITH a AS (SELECT conv_id, turn AS attempt, text AS raw FROM conversations WHERE turn <= 3)
SELECT conv_id, min(attempt) FILTER (length(raw) > 60) AS attempt, arg_min(raw, attempt) FILTER (length(raw) > 60) AS raw, count(*) AS tried FROM a GROUP BY conv_id
"""
)
def retry_first_valid(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("attempt"), F.col("text").alias("raw"))
    return runs.first_valid(rows, "conv_id", F.length("raw") > 60, 3)


@query(
    """
WITH s AS (SELECT user_id, count(*) FILTER (event_type <> 'error' AND value <= 400) AS n_ok, count(*) FILTER (NOT (event_type <> 'error' AND value <= 400)) AS n_errors FROM events GROUP BY user_id)
SELECT *, CASE WHEN n_errors > 0 AND n_ok > 0 THEN 'completed_with_errors' WHEN n_errors > 0 THEN 'failed' ELSE 'completed' END AS status FROM s
"""
)
def run_status_rollup(spark, d):
    error = F.when((F.col("event_type") == "error") | (F.col("value") > 400), F.lit("bad"))
    return runs.rollup(table(spark, d, "events").select("user_id", error.alias("error")), "user_id")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def job_latest_state(spark, d):
    return runs.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


@query(
    """
SELECT source AS paper_id, count(DISTINCT lang) AS n_langs, (SELECT count(*) FROM documents s WHERE s.source = d.source AND s.n_chars > 1000) AS n_sections, (SELECT count(*) FROM labels JOIN documents s USING (doc_id) WHERE s.source = d.source AND quality = 0) AS n_refs
FROM documents d GROUP BY source
"""
)
def corpus_listing(spark, d):
    rows = docs(spark, d).select("doc_id", F.col("source").alias("paper_id"), "lang", "n_chars")
    papers = rows.groupBy("paper_id").agg(F.countDistinct("lang").alias("n_langs"))
    refs = rows.join(table(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id")
    return runs.listing(papers, rows.where("n_chars > 1000"), refs)


@query(
    """
SELECT CAST(doc_id AS VARCHAR) AS paper_id, CASE WHEN n_chars > 20 THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN n_chars > 20 THEN '{"lang":"' || lang || '","n_chars":' || n_chars || '}' ELSE 'too short' END AS result
FROM documents
"""
)
def export_ok_and_errors(spark, d):
    rows = docs(spark, d).select(F.col("doc_id").cast("string").alias("paper_id"), "lang", "n_chars")
    ok = rows.where("n_chars > 20").select("paper_id", F.struct("lang", "n_chars").alias("result"))
    return runs.export_rows(ok, rows.where("NOT n_chars > 20").select("paper_id", F.lit("too short").alias("error")))


@query("SELECT role, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS chars, round(avg(length(text)), 6) AS mean_chars FROM conversations GROUP BY role")
def token_usage(spark, d):
    n = F.length("text")
    return table(spark, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("calls"), F.sum(n).alias("chars"), F.round(F.avg(n), 6).alias("mean_chars"))


PIECES_SQL = """'"(?:[^"\\\\]|\\\\.)*"?|[{}]|[^"{}]+'"""


@query(
    f"""
WITH b AS (SELECT conv_id, turn, text, '{{"reasoning": ' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ', "classification": ["' || left(role, 1) || '", "B"], "confidence": 0.5, "secondary_labels": ["' || role || '"], "extras": {{"turn":' || turn || '}}}}' AS body FROM conversations),
r AS (SELECT *, CASE turn % 4 WHEN 0 THEN body WHEN 1 THEN 'Sure:' || chr(10) || '```json' || chr(10) || body || chr(10) || '```' WHEN 2 THEN 'so ' || body || ' then }}' ELSE text END AS raw FROM b),
p AS (SELECT *, string_split(raw, '```') AS parts, regexp_extract_all(substr(raw, strpos(raw, '{{')), {PIECES_SQL}, 0, 's') AS pieces FROM r),
n AS (SELECT *, list_transform(pieces, lambda x: CASE x WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) AS steps FROM p),
e AS (SELECT *, CASE WHEN contains(raw, '{{') THEN list_filter(range(1, len(steps) + 1), lambda i: steps[i] = -1 AND list_sum(steps[1:i]) = 0)[1] END AS stop FROM n),
c AS (SELECT *, CASE WHEN json_valid(raw) THEN raw WHEN len(parts) > 2 AND starts_with(parts[2], 'json') THEN substr(parts[2], 5) ELSE list_aggregate(pieces[1:stop], 'string_agg', '') END AS found FROM e),
j AS (SELECT conv_id, turn, CASE WHEN json_valid(found) AND found ->> '$.classification' IS NOT NULL THEN found END AS a FROM c)
SELECT conv_id, turn, CASE WHEN a IS NULL THEN 'F' WHEN a ->> '$.classification[0]' IN ({", ".join(f"'{x}'" for x in codes.ACCESS_LABELS)}) THEN (a ->> '$.classification[0]') || ',B' ELSE 'B' END AS codes,
  CASE WHEN a IS NULL THEN 0.0 ELSE CAST(a ->> '$.confidence' AS DOUBLE) END AS confidence, CAST(length(a ->> '$.reasoning') AS INTEGER) AS n_reasoning, a ->> '$.secondary_labels[0]' AS secondary, a ->> '$.extras' AS extras, a IS NOT NULL AS parsed_ok
FROM j
"""
)
def answer_parse(spark, d):
    """Answers with the turn's text as reasoning, bare, in a fence or in prose, and plain texts, read into decisions, secondary labels and extras."""
    kind, role = F.col("turn") % 4, F.col("role")
    reasoning = F.regexp_replace(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("t"))), r'(?s)^\{"t":(.*)\}$', "$1")
    body = F.concat(F.lit('{"reasoning": '), reasoning, F.lit(', "classification": ["'), F.substring(role, 1, 1), F.lit('", "B"], "confidence": 0.5, "secondary_labels": ["'), role, F.lit('"], "extras": {"turn":'), F.col("turn").cast("string"), F.lit("}}"))
    raw = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("so "), body, F.lit(" then }"))).otherwise(F.col("text"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", answers.parsed(raw).alias("a"))
    out = rows.withColumn("dec", answers.decision(F.col("a"), codes.ACCESS_LABELS, "F"))
    return out.select("conv_id", "turn", F.array_join("dec.codes", ",").alias("codes"), "dec.confidence", F.length("a.reasoning").alias("n_reasoning"), F.element_at("dec.secondary_labels", 1).alias("secondary"), "dec.extras", "dec.parsed_ok")
