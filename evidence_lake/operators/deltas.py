"""An index of documents that grows by deltas: each write adds a part, reads merge, compaction rewrites buckets.

A document's rows lie in a bucket by the hash of its id. A part is one write: rows of whole documents, or
tombstones, each with the write's number. Reads keep a document's rows of the highest number. A manifest
lists the live parts and which of their buckets count; manifests are numbered, written aside and renamed to
the next number, so that a failed write changes nothing and of two writers one is told. A write touches only
its own part and the manifest: its cost doesn't grow with the index.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_lake.operators.index import Numbered

#: Deltas' newest numbers of at most so many documents are broadcast when reads merge.
BROADCAST_DOCS = 500_000
NUMBER, GONE, BUCKET = "_number", "_gone", "_bucket"


def checked(rows: DataFrame, documents: DataFrame | None = None, key: str = "paper_id", vector: str = "dense", dims: int | None = None, required: tuple[str, ...] = ("id",)) -> tuple[DataFrame, DataFrame]:
    """(rows of good documents, (key, error) of the others): one bad row rejects its whole document and no other.

    Bad: a null in `required`, a vector that is null, of other than `dims` dimensions or holding null, NaN or
    infinity; a document of `documents` without rows has none to index. Rows with a null key are an error
    of the null document.
    """
    entries = F.size(F.filter(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))) if dims else F.lit(0)
    size = F.coalesce(F.size(vector), F.lit(-1)) if dims else F.lit(0)
    error = (
        F.when(F.col(key).isNull(), "no document id")
        .when(F.greatest(*[F.col(c).isNull().cast("int") for c in required], F.lit(0), F.lit(0)) == 1, "a required field is null")
        .when(size != (dims or 0), f"vector of other than {dims} dimensions")
        .when(entries > 0, "vector with entries that are no numbers")
    )
    bad = rows.groupBy(key).agg(F.min(error).alias("error")).where("error IS NOT NULL")
    good = rows.where(F.col(key).isNotNull()).join(bad.select(F.col(key).alias("_bad")), F.col(key) == F.col("_bad"), "left_anti")
    if documents is not None:
        empty = documents.select(key).distinct().join(rows.select(key), key, "left_anti").select(key, F.lit("no rows to index").alias("error"))
        bad = bad.unionByName(empty)
    return good, bad


class DeltaIndex:
    """Documents' rows on shared storage. key: the column that names a document."""

    def __init__(self, spark: SparkSession, path: str, key: str = "paper_id", buckets: int = 16):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.log = Numbered(spark, f"{self.path}/manifests")
        self.buckets = (self.log.read() or {}).get("buckets", buckets)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def manifest(self) -> dict:
        return self.log.read() or {"number": 0, "buckets": self.buckets, "parts": [], "settings": {}, "batches": {}}

    def _write(self, rows: DataFrame, number: int, dealt: bool = False) -> dict:
        """A part of rows; its buckets, as written."""
        part = f"part-{uuid.uuid4().hex}"
        laid = rows if dealt else rows.withColumn(NUMBER, F.lit(number).cast("long"))
        laid.withColumn(BUCKET, self._bucket()).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{part}")
        found = self.log.names(f"{self.path}/{part}")
        return {"path": part, "number": number, "buckets": sorted(int(x.split("=")[1]) for x in found if x.startswith(f"{BUCKET}="))}

    def _commit(self, at: int, manifest: dict) -> None:
        self.log.add(at + 1, manifest | {"number": at + 1})

    def upsert(self, rows: DataFrame, settings: dict | None = None, batch: tuple[str, int] | None = None) -> None:
        """All rows of the documents in `rows`; what the index had of these documents goes. Settings must not change.

        batch: (name of a stream, number): a batch that is committed already is left out, as is one before it.
        """
        now = self.manifest()
        if batch and now["batches"].get(batch[0], -1) >= batch[1]:
            return
        for name, value in (settings or {}).items():
            if now["settings"].get(name, value) != value:
                raise ValueError(f"index has {name}={now['settings'][name]!r}, not {value!r}")
        at = now["number"]
        part = self._write(rows.withColumn(GONE, F.lit(False)), at + 1)
        done = now["batches"] | ({batch[0]: batch[1]} if batch else {})
        self._commit(at, now | {"parts": [*now["parts"], part], "settings": now["settings"] | (settings or {}), "batches": done})

    def delete(self, documents: DataFrame) -> None:
        """Tombstones for documents (key)."""
        now = self.manifest()
        gone = documents.select(self.key).where(F.col(self.key).isNotNull()).distinct().withColumn(GONE, F.lit(True))
        self._commit(now["number"], now | {"parts": [*now["parts"], self._write(gone, now["number"] + 1)]})

    def _rows(self, part: dict, only: set[int] | None = None) -> DataFrame | None:
        """A part's rows in the buckets that count."""
        live = sorted(set(part["buckets"]) & only if only is not None else part["buckets"])
        return self.spark.read.parquet(f"{self.path}/{part['path']}").where(F.col(BUCKET).isin(live)) if live else None

    def _merged(self, only: set[int] | None = None) -> DataFrame | None:
        """The live rows, with numbers: first the largest part, whose rows only meet the newest numbers of the others' documents."""
        parts = [(p, x) for p in self.manifest()["parts"] if (x := self._rows(p, only)) is not None]
        if not parts:
            return None
        rows = parts[0][1]
        if len(parts) == 1:
            return rows.where(~F.col(GONE))
        later = parts[1][1]
        for _, x in parts[2:]:
            later = later.unionByName(x, allowMissingColumns=True)
        newest = later.groupBy(F.col(self.key).alias("_key")).agg(F.max(NUMBER).alias("_newest"))
        if newest.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS:
            newest = F.broadcast(newest)
        first = rows.join(newest, F.col(self.key) == F.col("_key"), "left_anti")  # compaction keeps numbers in order: the first part is the oldest
        rest = later.join(newest, (F.col(self.key) == F.col("_key")) & (F.col(NUMBER) == F.col("_newest"))).drop("_key", "_newest")
        return first.unionByName(rest, allowMissingColumns=True).where(~F.col(GONE))

    def read(self, documents: list | None = None) -> DataFrame | None:
        """The live rows, of all documents or (few) named ones, for which only their buckets are read; None before the first write."""
        only = None
        if documents is not None:
            names = self.spark.createDataFrame([(str(x),) for x in documents], "name string")
            only = {r[0] for r in names.select(F.pmod(F.xxhash64("name"), F.lit(self.buckets)).cast("int")).collect()}
        rows = self._merged(only)
        if rows is None:
            return None
        rows = rows.drop(NUMBER, GONE, BUCKET)
        return rows if documents is None else rows.where(F.col(self.key).isin(list(documents)))

    def compact(self, most_parts: int = 1) -> int:
        """Rewrite the buckets that lie in more than `most_parts` parts as one part; how many these are.

        The others, and readers of an older manifest, keep their files.
        """
        now = self.manifest()
        counts: dict[int, int] = {}
        for p in now["parts"]:
            for b in p["buckets"]:
                counts[b] = counts.get(b, 0) + 1
        crowded = {b for b, n in counts.items() if n > most_parts}
        if not crowded:
            return 0
        merged = self._merged(crowded).drop(BUCKET)
        part = self._write(merged, now["number"] + 1, dealt=True)
        left = [p | {"buckets": [b for b in p["buckets"] if b not in crowded]} for p in now["parts"]]
        self._commit(now["number"], now | {"parts": [part, *[p for p in left if p["buckets"]]]})
        return len(crowded)

    def vacuum(self, keep: int = 2) -> int:
        """Delete parts that none of the last `keep` manifests names, and older manifests; how many parts went."""
        last = self.manifest()["number"]
        numbers = [n for n in self.log.numbers() if n <= last]
        named = {p["path"] for n in numbers[-keep:] for p in self.log.read(n)["parts"]}
        gone = [x for x in self.log.names(self.path) if x.startswith("part-") and x not in named]
        for x in gone:
            self.log.remove(f"{self.path}/{x}")
        for n in numbers[:-keep]:
            self.log.remove(f"{self.log.path}/{n:012d}")
        return len(gone)
