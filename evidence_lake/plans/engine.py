"""The engine's verbs over tables: index, papers, explore, ask, classify, mine, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidence_lake.functions import answers, prompts
from evidence_lake.functions.text import overlap_score
from evidence_lake.operators import blocks, chunking, embedding, index, late, rerank, retrieval, runs, turns
from evidence_lake.plans.tasks import MOST_ATTEMPTS, Registry, Settings, Task
from evidence_lake.session import stored

SYSTEM = "You classify scientific papers by the evidence given, and answer with one JSON object."
TEMPLATE = "Categories:\n{categories}\n\nTitle: {title}\nAbstract: {abstract}\nKeywords: {keywords}\n\n**Relevant Extracts:**\n\n{chunks_info}\n\nAnswer with an object of this schema: {schema}"
SCHEMA = '{"reasoning": "text", "confidence": "0 to 1", "classification": ["codes"]}'


class Engine:
    """One workspace: settings, a store of points, and the verbs; every verb takes all papers or queries at once."""

    def __init__(self, spark: SparkSession, settings: Settings, registry: Registry | None = None):
        self.spark, self.settings, self.registry = spark, settings, registry or Registry()
        self.store = index.Store(spark, f"{settings.path.rstrip('/')}/points")
        self.embed = embedding.hashed(settings.dims)

    def build(self, papers: DataFrame, sections: DataFrame) -> DataFrame:
        """Points of papers: chunks, each distinct text embedded once."""
        how = chunking.chunker(self.settings.chunker, **self.settings.chunker_params())
        chunks = chunking.chunk_papers(papers, sections, how)
        vectors = chunks.select("id", "text").dropDuplicates(["id"]).select("id", self.embed(F.col("text")).alias("dense"))
        order = F.struct("paper_id", "section_ord", "chunk_ord")
        seq = F.row_number().over(Window.partitionBy("id").orderBy(order)).cast("long")
        return chunks.join(vectors, "id").withColumn("seq", seq)

    def index(self, papers: DataFrame, sections: DataFrame, replace: bool = False) -> DataFrame:
        """Indexes papers; returns (paper_id, error) of those without a chunk. Indexed papers raise unless replaced."""
        points = self.build(papers, sections)
        now = self.store.read()
        if now is not None:
            known = now.select("paper_id").distinct().join(papers.select("paper_id"), "paper_id", "left_semi")
            if not replace and not known.isEmpty():
                raise ValueError("papers are indexed already; replace them")
            kept = now.join(papers.select("paper_id").distinct(), "paper_id", "left_anti").select(now.columns)
            points = index.upsert(kept, points.select(now.columns).withColumn("seq", F.col("seq") + 1))
        else:
            points = index.upsert(points.limit(0), points)
        self.store.write(points, self.settings.index_settings(), self.settings.dims)
        return index.without_chunks(papers, self.points())

    def points(self) -> DataFrame:
        found = self.store.read()
        if found is None:
            raise ValueError("nothing is indexed")
        return found

    def papers(self) -> DataFrame:
        return self.points().groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_chunks"))

    def explore(self, queries: DataFrame, filters: dict | None = None, top_k: int | None = None, mode: str | None = None, generated: DataFrame | None = None, scorer=None, late_encoder: late.TokenEncoder | None = None) -> DataFrame:
        """Search results of queries (query_id, text): cut, then the threshold.

        With generated documents (query_id, n, text) candidates are searched by the text and these. With a
        scorer, or an encoder of tokens for late interaction, rerank_top_k candidates are reranked with the
        original queries and cut to top_k.
        """
        asked = queries.select("query_id", "text")
        if late_encoder is not None:
            n = max(top_k or self.settings.top_k, retrieval.DEFAULTS["rerank_top_k"])
            found = self.explore(asked, filters, n, mode, generated).drop("rank", "rank_score")
            texts = found.select("id", "text").dropDuplicates(["id"])
            best = late.rerank(found.select("query_id", "id"), asked, texts, top_k or self.settings.top_k, late_encoder)
            return found.join(best.withColumnRenamed("score", "rank_score"), ["query_id", "id"])
        if scorer is not None:
            n = max(top_k or self.settings.top_k, retrieval.DEFAULTS["rerank_top_k"])
            return self.rescored(self.explore(asked, filters, n, mode, generated), asked, top_k or self.settings.top_k, scorer)
        if generated is not None:
            queries = retrieval.with_hypothetical(asked, generated).select("query_id", F.col("retrieval_text").alias("text"))
        s, k = self.settings, top_k or self.settings.top_k
        scope, rest = retrieval.split_filter(filters, self.points().columns)
        rows = retrieval.matching(self.points(), rest, scope)
        how = retrieval.clamp_mode(mode or s.mode, {"dense", "sparse"}, mode is not None)
        near = lambda n: retrieval.dense(queries.select("query_id", self.embed(F.col("text")).alias("q")), rows.select("id", F.col("dense").alias("v")), n, dims=s.dims)
        by_terms = lambda n: retrieval.sparse_texts(queries.select("query_id", "text"), rows.select("id", "text"), n)
        if how == "dense_only":
            hits = near(k)
        elif how == "sparse_only":
            hits = by_terms(k)
        else:
            hits = retrieval.hybrid(near(s.prefetch_k), by_terms(s.prefetch_k), k, s.rrf_k)
        return retrieval.results(retrieval.threshold(hits, s.threshold), rows, how)

    def ask(self, queries: DataFrame, **how) -> DataFrame:
        """query_id, answer, evidences by the generator that joins passages."""
        return prompts.concatenated(self.explore(queries, **how), "query_id")

    def evidence(self, task: Task) -> DataFrame:
        """Every paper's evidence for a task: all (paper, template) searches in one job."""
        rows = task.queries()
        t = self.spark.createDataFrame(rows, "category string, category_ord int, template_ord int, query string").withColumn("q", self.embed(F.col("query")))
        asked = t.orderBy("category_ord", "template_ord").collect()  # a task's templates
        names = F.array(*[F.struct(F.lit(r.category).alias("category"), F.lit(r.category_ord).alias("category_ord"), F.lit(r.template_ord).alias("template_ord")) for r in asked])
        scores = blocks.products([r.q for r in asked], self.settings.dims)(F.col("dense"))
        both = self.points().withColumn("hit", F.explode(F.arrays_zip(names.alias("of"), scores.alias("score")))).drop("dense")
        scored = both.select("*", "hit.of.*", "hit.score").drop("hit").where("score IS NOT NULL")
        w = Window.partitionBy("paper_id", "category_ord", "template_ord").orderBy(F.desc("score"), "id")
        hits = scored.withColumn("rank0", F.row_number().over(w) - 1).where(F.col("rank0") < task.top_k)
        return rerank.mine_evidence(hits, task.top_k, list(task.sections)) if task.kind == "miner" else rerank.select_evidence(hits, task.top_k)

    def classify(self, key: str, responses: DataFrame) -> DataFrame:
        """paper_id, codes, confidence, probabilities, parsed_ok, attempt from answers (paper_id, attempt, raw): the first that reads, else the fallback."""
        task = self.registry.get(key)
        read = responses.withColumn("answer", answers.parsed(F.col("raw")))
        best = runs.first_valid(read, "paper_id", F.col("answer").isNotNull(), MOST_ATTEMPTS)
        papers = self.papers().select("paper_id")
        chosen = answers.decision(answers.parsed(F.col("raw")), task.table, task.default, task.multi_label)
        return papers.join(best, "paper_id", "left").select("paper_id", "attempt", chosen.alias("d")).select("paper_id", "attempt", "d.*")

    def run_classifier(self, key: str, papers: DataFrame, generate: turns.Generator, template: str = TEMPLATE, schema: str = SCHEMA, system: str = SYSTEM) -> DataFrame:
        """paper_id, attempt, codes, confidence, probabilities, secondary_labels, extras, parsed_ok, messages, samples: the whole classification of papers (paper_id, title, abstract, keywords).

        Evidence by category makes each paper's prompt; `generate` answers the open papers in rounds, with the
        history of their unreadable answers; a paper without a readable one gets the fallback. Each round is stored.
        """
        task = self.registry.get(key)
        prompt = prompts.classification(papers, self.prompt(key), template, task.table, schema)
        asked = prompt.select("paper_id", F.array(turns.message("system", F.lit(system)), turns.message("user", F.col("prompt"))).alias("messages"))
        out = turns.retried(asked, generate, MOST_ATTEMPTS, keep=stored)
        chosen = answers.decision(F.when(F.col("attempt").isNotNull(), answers.parsed(F.col("raw"))), task.table, task.default, task.multi_label)
        return out.select("paper_id", "attempt", "raw", "messages", "samples", chosen.alias("d")).select("paper_id", "attempt", "d.*", "raw", "messages", "samples")

    def mine(self, key: str, responses: DataFrame) -> DataFrame:
        """paper_id, description, items, evidences (id, text, score, best first) of every indexed paper from one answer a paper; without an answer no description nor items."""
        task = self.registry.get(key)
        found = self.evidence(task).groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "text", "score"))).alias("evidences"))  # task.top_k at most
        read = responses.select("paper_id", answers.mined(F.col("raw")).alias("m"))
        return self.papers().select("paper_id").join(read, "paper_id", "left").join(found, "paper_id", "left").select("paper_id", "m.description", "m.items", "evidences")

    def prompt(self, key: str) -> DataFrame:
        """paper_id, block: the evidence of a classifier by category."""
        return prompts.by_category(self.evidence(self.registry.get(key)), "paper_id")

    def rescored(self, results: DataFrame, queries: DataFrame, k: int, scorer=overlap_score) -> DataFrame:
        """Results reranked with their original queries."""
        rows = results.drop("rank", "rank_score").join(retrieval.small(queries.select("query_id", F.col("text").alias("query"))), "query_id")
        return rerank.rerank(rows, scorer, k, ["query_id"])
