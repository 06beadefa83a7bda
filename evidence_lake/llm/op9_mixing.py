"""Mixing sources to target token weights by cube-method balanced sampling.

A source's target over its size gives whole repeats of every document and a fraction, the
probability of one more. The cube method's flight moves these probabilities along the null space of
two constraints (documents and words taken) until each is 0 or 1, keeping both totals. A source's
documents are dealt into buckets by a hash of themselves; a bucket streams through with at most three
undecided documents; what stays undecided, two at most a bucket, flies again over the whole source, and
the last two land. Buckets, their order and their random numbers hang on documents and the seed alone,
so neither the partitioning nor the order of the input changes the mix.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_lake.llm.common import WORD, documents, in_arrow, released, staged

#: Weights of the sources in code-point order, null last, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2.0
#: Tables of sources up to so many rows and characters of names are broadcast.
BROADCAST_SOURCES = 100_000
BROADCAST_CHARS = 8 << 20
#: Documents of a source's bucket, about.
BUCKET_ROWS = 2_000
NEAR = 1e-9


def targets(sizes: list[int], weights: tuple = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> list[float]:
    """Words to take of each source: by weight, at most `repeats` times its size, the excess shared out again (the rule of `wanted`, on lists)."""
    own = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    rate, before = 0.0, None  # words for each unit of weight
    while rate != before:
        full = [w * rate > repeats * n for w, n in zip(own, sizes)]
        free = sum(w for w, f in zip(own, full) if not f)
        before, rate = rate, max(rate, (share * sum(sizes) - sum(repeats * n for n, f in zip(sizes, full) if f)) / free if free else rate)
    return [min(w * rate, repeats * n) for w, n in zip(own, sizes)]


def wanted(totals: DataFrame) -> DataFrame:
    """totals (source, n) with weight and target. Sources are ranked by ranges, so that no task holds them all; only sums reach the driver."""
    ranked = totals.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ranked = staged(ranked.select("source", "n", F.monotonically_increasing_id().alias("at")), "sources")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    base, sizes = 0, ranked.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row for each task
    bases = []
    for r in sizes:
        bases.append((r["part"], base))
        base += r["count"]
    first = totals.sparkSession.createDataFrame(bases, "part long, base long")
    number = ranked.withColumn("part", part).join(F.broadcast(first), "part").select("source", "n", (F.col("base") + place).alias("number"))
    weighed = staged(number.select("source", "n", F.element_at(F.array(*map(F.lit, map(float, WEIGHTS))), (F.col("number") % len(WEIGHTS) + 1).cast("int")).alias("weight")), "weights")
    most = REPEATS * F.col("n")
    rate, before = 0.0, None
    while rate != before:  # each round fills sources up; there are a few rounds
        is_full = F.col("weight") * F.lit(rate) > most
        r = weighed.agg(F.sum("n").alias("n"), F.sum(F.when(is_full, most)).alias("full"), F.sum(F.when(~is_full, F.col("weight"))).alias("free")).first()
        before, rate = rate, max(rate, (SHARE * r["n"] - (r["full"] or 0.0)) / r["free"] if r["free"] else rate)
    released(ranked)
    return weighed.withColumn("target", F.least(F.col("weight") * F.lit(rate), most))


def _move(pool: list[list], rng: random.Random) -> None:
    """One step of the flight for units [p, size, ...]: along the null space, until one of them is decided."""
    if len(pool) > 2:
        a, b, c = (u[1] for u in pool[:3])
        u = (c - b, a - c, b - a)
        if not any(u):
            u = (1, -1, 0)
    elif len(pool) == 2:  # landing: the words' total alone is kept
        u = (pool[1][1], -pool[0][1])
        u = u if any(u) else (1, -1)
    else:
        pool[0][0] = float(rng.random() < pool[0][0])
        return
    up = min(((1 - x[0]) / v if v > 0 else x[0] / -v) for x, v in zip(pool, u) if v)
    down = min((x[0] / v if v > 0 else (1 - x[0]) / -v) for x, v in zip(pool, u) if v)
    step = up if rng.random() * (up + down) < down else -down
    for x, v in zip(pool, u):
        p = x[0] + step * v
        x[0] = 0.0 if p < NEAR else 1.0 if p > 1 - NEAR else p


UNITS = "doc_id long, row_key long, source string, size long, bucket long, h long, p double"
NAMES = ["doc_id", "row_key", "source", "size", "bucket", "h", "p"]


def _flight(land: bool, seed: int):
    """The flight of each bucket (source if `land`); rows come bucket by bucket, in order."""

    def run(batches):
        key, held, pool, rng = None, [], [], None

        def batch():
            columns = list(zip(*held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=NAMES)

        def settle(pool):
            held.extend((*u[2], u[0]) for u in pool if u[0] in (0.0, 1.0))
            pool[:] = [u for u in pool if u[0] not in (0.0, 1.0)]

        def close():
            while land and pool:
                _move(pool, rng)
                settle(pool)
            held.extend((*u[2], u[0]) for u in pool)
            pool.clear()

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in NAMES)):
                at = (row[2],) if land else (row[2], row[4])
                if at != key:
                    close()
                    key, rng = at, random.Random(f"{seed}/{land}/{at}")
                p = row[-1]
                pool.append([float(round(p)) if p <= NEAR or p >= 1 - NEAR else p, row[3], row[:-1]])
                settle(pool)
                while len(pool) > 2:
                    _move(pool, rng)
                    settle(pool)
                if len(held) >= 20_000:
                    yield batch()
        close()
        if held:
            yield batch()

    return run


def mix(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keys: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row (and `row_key`, its place in `docs`, if `keys`).

    taken is size times the whole repeats and perhaps one more; the words taken of a source miss its
    target by about one document at most. The choice follows from the documents (doc_id, size and text;
    rows that agree in all of these stand for each other) and `seed`, not from files, partitions or
    settings. Null or empty text: size 0, nothing taken. A null source is a source of its own; rows that
    repeat a doc_id are documents of their own. Empty table: no rows. Extra columns are ignored.
    """
    text = F.col(text_col).cast("string")
    own = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row_key"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), text).alias("h"),
    )
    sizes = staged(own, "sizes")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"))
    goals = wanted(totals.select("source", "n")).join(totals.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s")))
    rate = F.when(F.col("n") > 0, F.col("target") / F.col("n")).otherwise(0.0)
    whole = F.least(F.floor(rate + NEAR), F.lit(int(REPEATS)).cast("long"))
    table = staged(goals.select(F.col("source").alias("name"), F.col("n").alias("source_size"), "target", whole.alias("whole"), F.greatest(rate - whole, F.lit(0.0)).alias("fraction"), F.ceil(F.col("rows") / BUCKET_ROWS).alias("buckets")), "goals")
    many = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("name")), F.lit(0))).first()
    table = F.broadcast(table) if many[0] <= BROADCAST_SOURCES and many[1] <= BROADCAST_CHARS else table
    same = sizes["source"].eqNullSafe(table["name"])
    p = F.when(F.col("size") > 0, F.col("fraction")).otherwise(0.0)
    units = sizes.join(table, same).select("doc_id", "row_key", "source", "size", F.pmod("h", "buckets").alias("bucket"), "h", p.alias("p"))
    order = ["source", "bucket", "h", "doc_id", "size", "row_key"]
    one = staged(units.repartition("source", "bucket").sortWithinPartitions(*order).transform(in_arrow, _flight(False, seed), UNITS), "flight")
    open_ = one.where("p > 0 AND p < 1").repartition("source").sortWithinPartitions(*order)
    decided = one.where("p = 0 OR p = 1").unionByName(open_.transform(in_arrow, _flight(True, seed), UNITS))
    out = decided.join(table, decided["source"].eqNullSafe(table["name"]))
    taken = (F.col("size") * (F.col("whole") + F.col("p").cast("long"))).alias("taken")
    return out.select("doc_id", *(["row_key"] if keys else []), "size", "source_size", "target", taken)


def mixed_rows(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs (a stable table), each as often as the mix takes it, with their own columns."""
    taken = mix(docs, seed, id_col, text_col, source_col, keys=True)
    times = taken.where("taken > 0").select("row_key", (F.col("taken") / F.col("size")).cast("int").alias("times"))
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("row_key"))
    return own.join(times, "row_key").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time")).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))
