"""Index and metadata maintenance over tables: upsert, delete, lookups, guards, staged writes."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The last row written for each key."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).where("_n = 1").drop("_n")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First write wins: rows of new whose keys aren't there, the first of each."""
    fresh = new.join(old.select(*keys).distinct(), keys, "left_anti")
    fresh = fresh.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
    return old.unionByName(fresh)


def delete_namespace(points: DataFrame, paper_id: str, col: str = "paper_id") -> DataFrame:
    return points.where(~F.col(col).eqNullSafe(F.lit(paper_id)))


def replace_papers(points: DataFrame, new: DataFrame, col: str = "paper_id") -> DataFrame:
    """All rows of the new papers, and the old rows of the others."""
    return points.join(new.select(col).distinct(), col, "left_anti").select(points.columns).unionByName(new)


def delete_counted(rows: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one row `removed` with the number of those that go) of a delete; a null condition keeps the row."""
    hit = F.coalesce(gone, F.lit(False))
    return rows.where(~hit), rows.agg(F.count_if(hit).alias("removed"))


class MetadataStore:
    """Metadata rows keyed by (doc_id, type, strategy) on shared storage: the first write of a key stays, deletes say how many went."""

    KEYS = ["doc_id", "type", "strategy"]

    def __init__(self, spark: SparkSession, path: str):
        self.store = Store(spark, path)

    def _rows(self) -> DataFrame:
        found = self.store.read()
        return found if found is not None else self.store.spark.createDataFrame([], "doc_id string, type string, strategy string, content string")

    def insert(self, new: DataFrame) -> None:
        self.store.write(insert_absent(self._rows(), new.select(*self.KEYS, "content"), self.KEYS, "content"))

    def retrieve(self, doc_id: str, type_: str, strategy: str) -> str | None:
        """The content; None where there is none or it is empty."""
        row = self._rows().where((F.col("doc_id") == doc_id) & (F.col("type") == type_) & (F.col("strategy") == strategy)).select("content").first()  # a key has one row
        return row[0] if row and row[0] else None

    def list_docs(self) -> DataFrame:
        return self._rows().select("doc_id").distinct().orderBy("doc_id")

    def _delete(self, gone: Column) -> int:
        kept, removed = delete_counted(self._rows(), gone)
        n = removed.first()[0]
        if n:
            self.store.write(kept)
        return n

    def delete_doc(self, doc_id: str) -> int:
        return self._delete(F.col("doc_id") == doc_id)

    def delete_by_strategy(self, strategy: str) -> int:
        return self._delete(F.col("strategy") == strategy)


def payload_keys(points: DataFrame, payload: str = "payload") -> DataFrame:
    """The distinct keys of a map column."""
    return points.select(F.explode(F.map_keys(payload)).alias("key")).distinct()


def without_chunks(papers: DataFrame, chunks: DataFrame, key: str = "paper_id") -> DataFrame:
    """Papers that yielded no chunk, as error rows."""
    return papers.join(chunks.select(key).distinct(), key, "left_anti").select(key, F.lit("no chunks").alias("error"))


def upload_status(uploads: DataFrame) -> DataFrame:
    """sha256 of content; a later upload (seq) of equal content is a duplicate of the first."""
    hashed = uploads.withColumn("sha256", F.sha2(F.col("content"), 256))
    order = Window.partitionBy("sha256").orderBy("seq")
    return hashed.withColumn("duplicate", F.row_number().over(order) > 1).withColumn("first_seq", F.first("seq").over(order))


def upload_errors(uploads: DataFrame, most_bytes: int, suffixes: tuple[str, ...] = (".pdf", ".txt", ".md", ".text")) -> DataFrame:
    """filename and the reason of each upload that isn't accepted."""
    name = F.lower("filename")
    reason = (
        F.when(F.col("filename").rlike(r"[/\\]"), "path in name")
        .when(~F.array_contains(F.array(*[F.lit(s) for s in suffixes]), F.regexp_extract(name, r"(\.[^.]*)$", 1)), "unsupported type")
        .when(F.octet_length("content") == 0, "empty")
        .when(F.octet_length("content") > most_bytes, "too large")
    )
    return uploads.select("filename", reason.alias("reason")).where("reason IS NOT NULL")


class Numbered:
    """Small JSON records on shared storage, numbered from 1. A record is written aside and renamed to a number that isn't taken, so that one writer of two is told.

    A rename is atomic on HDFS and local disks; on object stores without one, two writers need a lock of their own.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, path: str) -> list[str]:
        """Names in a folder; none if it isn't there."""
        top = self._fs_path(path)
        return [f.getPath().getName() for f in self._fs.listStatus(top)] if self._fs.exists(top) else []

    def numbers(self) -> list[int]:
        return sorted(int(n) for n in self.names(self.path) if n.isdigit())

    def last(self) -> int:
        """The highest number; 0 without any."""
        return max(self.numbers(), default=0)

    def read(self, n: int | None = None) -> dict | None:
        """A record, the last by default."""
        n = self.last() if n is None else n
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/{n:012d}").collect())) if n else None

    def add(self, n: int, record: dict) -> None:
        aside, there = self._fs_path(f"{self.path}/_{uuid.uuid4().hex}"), self._fs_path(f"{self.path}/{n:012d}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        if self._fs.exists(there) or not self._fs.rename(aside, there):
            self._fs.delete(aside, False)
            raise RuntimeError("another writer was first")

    def remove(self, path: str) -> None:
        self._fs.delete(self._fs_path(path), True)


class Store:
    """A points table on shared storage: versions as Parquet folders, and numbered pointers to them.

    A reader follows the pointer of the highest number; so a write that fails at any step leaves the live
    version as it is, and of two writers one is told. Each write is a whole version: for many small ones see
    deltas.DeltaIndex.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.pointers = Numbered(spark, f"{self.path}/pointers")
        self._fs_path, self._fs = self.pointers._fs_path, self.pointers._fs

    def _last(self) -> int:
        return self.pointers.last()

    def _pointer(self) -> dict | None:
        return self.pointers.read()

    def _point(self, n: int, pointer: dict) -> None:
        self.pointers.add(n, pointer)

    def read(self) -> DataFrame | None:
        now = self._pointer()
        return self.spark.read.parquet(f"{self.path}/{now['version']}") if now else None

    def settings(self) -> dict:
        return (self._pointer() or {}).get("settings", {})

    def write(self, points: DataFrame, settings: dict | None = None, dims: int | None = None, vector: str = "dense") -> None:
        """A new version; settings (model, chunking) must not change once there are points; vectors must have `dims`."""
        n = self._last()
        old = self.settings()
        for key, value in (settings or {}).items():
            if key in old and old[key] != value:
                raise ValueError(f"index has {key}={old[key]!r}, not {value!r}")
        version = f"v-{uuid.uuid4().hex}"
        points.write.parquet(f"{self.path}/{version}")
        if dims is not None and not self.spark.read.parquet(f"{self.path}/{version}").where(F.coalesce(F.size(vector), F.lit(-1)) != dims).isEmpty():
            raise ValueError(f"vectors of other than {dims} dimensions")
        self._point(n + 1, {"version": version, "settings": old | (settings or {})})

    def upsert(self, new: DataFrame, **kind) -> None:
        old = self.read()
        self.write(upsert(old, new) if old is not None else upsert(new.limit(0), new), **kind)
