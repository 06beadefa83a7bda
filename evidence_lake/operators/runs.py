"""Jobs, runs and exports as tables: states, roll-ups, listings, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Job states and what may follow each.
STATES = {
    "queued": {"running", "cancelled", "interrupted"},
    "running": {"completed", "completed_with_errors", "failed", "cancel_requested", "interrupted"},
    "cancel_requested": {"cancelled", "interrupted", "completed", "completed_with_errors", "failed"},
    "completed": set(), "completed_with_errors": set(), "failed": set(), "cancelled": set(), "interrupted": set(),
}
RETRYABLE = frozenset(["failed", "cancelled", "interrupted", "completed_with_errors"])


def advance(state: str, to: str) -> str:
    if to not in STATES[state]:
        raise ValueError(f"a {state} job can't become {to}")
    return to


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each job in an append-only log."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def status(ok: Column, errors: Column, cancelled: Column | None = None) -> Column:
    out = F.when(cancelled, "cancelled") if cancelled is not None else F.when(F.lit(False), "")
    return out.when((errors > 0) & (ok > 0), "completed_with_errors").when(errors > 0, "failed").otherwise("completed")


def rollup(items: DataFrame, key: str, error: str = "error") -> DataFrame:
    """key, n_ok, n_errors, status of a run's items."""
    counts = items.groupBy(key).agg(F.count_if(F.col(error).isNull()).alias("n_ok"), F.count_if(F.col(error).isNotNull()).alias("n_errors"))
    return counts.withColumn("status", status(F.col("n_ok"), F.col("n_errors")))


def first_valid(attempts: DataFrame, key: str, valid: Column, most: int = 3) -> DataFrame:
    """The first valid attempt of each paper among the first `most`; those without one keep none."""
    tried = attempts.where(F.col("attempt") <= most).withColumn("_ok", valid)
    return tried.groupBy(key).agg(F.min(F.when(F.col("_ok"), F.col("attempt"))).alias("attempt"), F.min_by("raw", F.when(F.col("_ok"), F.col("attempt"))).alias("raw"), F.count(F.lit(1)).alias("tried"))


def export_rows(ok: DataFrame, errors: DataFrame) -> DataFrame:
    """paper_id, status, result: results as JSON, errors as their message."""
    good = ok.select("paper_id", F.lit("completed").alias("status"), F.to_json("result").alias("result"))
    return good.unionByName(errors.select("paper_id", F.lit("failed").alias("status"), F.col("error").alias("result")))


def write_export(rows: DataFrame, path: str, kind: str) -> None:
    if kind not in ("json", "csv"):
        raise ValueError("export format must be json or csv")
    writer = rows.write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.option("header", "true").option("escape", '"').csv(path)


def listing(papers: DataFrame, sections: DataFrame, refs: DataFrame, key: str = "paper_id") -> DataFrame:
    """Each paper with its numbers of sections and references, 0 for none."""
    count = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    joined = papers.join(count(sections, "n_sections"), key, "left").join(count(refs, "n_refs"), key, "left")
    return joined.withColumn("n_sections", F.coalesce("n_sections", F.lit(0).cast("long"))).withColumn("n_refs", F.coalesce("n_refs", F.lit(0).cast("long")))


def recent(rows: DataFrame, most: int, key: str, created: str = "created_at") -> DataFrame:
    """The `most` rows created last, with their place from 1; ties by key."""
    order = [F.desc(created), F.desc(key)]
    return rows.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def workspace_counts(documents: DataFrame, papers: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row: how many documents, distinct papers (paper_id) and distinct tasks (task_key) there are."""
    one = lambda df, c, name: df.agg(c.alias(name))
    counts = [one(documents, F.count(F.lit(1)), "document_count"), one(papers, F.countDistinct("paper_id"), "paper_count"), one(tasks, F.countDistinct("task_key"), "task_count")]
    return counts[0].join(F.broadcast(counts[1]), F.lit(True)).join(F.broadcast(counts[2]), F.lit(True))  # rows of one number


def result_records(papers: DataFrame, sections: DataFrame, refs: DataFrame, key: str = "paper_id") -> DataFrame:
    """A flat record for each paper: its columns, arrays as JSON, and its numbers of sections, references and references to data sources."""
    n_sections = sections.groupBy(key).agg(F.count(F.lit(1)).alias("num_sections"))
    n_refs = refs.groupBy(key).agg(F.count(F.lit(1)).alias("num_references"), F.count_if("is_data_source").alias("data_source_references"))
    flat = [F.to_json(c).alias(c) if kind.startswith("array") else F.col(c) for c, kind in papers.dtypes]
    joined = papers.select(*flat).join(n_sections, key, "left").join(n_refs, key, "left")
    return joined.na.fill(0, ["num_sections", "num_references", "data_source_references"])


class RunStore:
    """Runs on shared storage: a row for each run (run_id, kind, status, created_at), and its results as JSON lines."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, run_id: str, kind: str, status: str, created_at: str, results: DataFrame) -> None:
        """The results first, the run's row last: a run that is listed has its results."""
        results.write.json(f"{self.path}/results/{run_id}")
        row = self.spark.createDataFrame([(run_id, kind, status, created_at)], "run_id string, kind string, status string, created_at string")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/runs")

    def runs(self, most: int = 100) -> DataFrame:
        return recent(self.spark.read.parquet(f"{self.path}/runs"), most, "run_id").drop("place")

    def results(self, run_id: str) -> DataFrame:
        return self.spark.read.json(f"{self.path}/results/{run_id}")


def usage_so_far(calls: DataFrame, by: list[str], order: list[str], used: str, provider: str, last: int) -> DataFrame:
    """calls with so_far (the sum in their order), by_<provider> (that of the provider's calls alone) and last_<n> over the last n calls."""
    all_, own = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by, provider).orderBy(*order)
    return calls.withColumns({"so_far": F.sum(used).over(all_), f"by_{provider}": F.sum(used).over(own), f"last_{last}": F.sum(used).over(all_.rowsBetween(1 - last, 0))})
