"""Near-duplicate documents by MinHash: an inverted join on signature coordinates.

Equal shingle sets form a class; a class is posted under each coordinate-value pair of its signature.
Two sets of similarity 0.75 share at least MATCHES of the COORDINATES values, and one of the FIRST, but
for a chance of 1e-7 (`miss`). So classes that share none of their FIRST values drop out. The others'
values are ordered by how many classes have them, and only the rarest are posted, all but MATCHES - 1
(a prefix: values of very common passages come last and are skipped). A posting list is merged with its
most and its least central member, never pairwise with itself: collisions are counted on the whole signatures, and
pairs with MATCHES of them are confirmed on the full sets. Members of a list that are then still in
different components are resolved exactly: they post the rarest shingles of their full sets, a quarter
and one, of which two linked sets share one at least, and meet across components there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_lake.llm.common import documents, in_arrow, released, staged
from evidence_lake.llm.components import components, merged
from evidence_lake.llm.tokens import slices

SHINGLE = 5
SIMILAR = 75  # per cent
COORDINATES = 64
MATCHES = 28
#: Coordinates of which linked classes share one.
FIRST = 12

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.array([xxhash.xxh64_intdigest(b"coordinate", i) for i in range(COORDINATES)], np.uint64)
_SALTS = np.array([xxhash.xxh64_intdigest(b"posting", i) for i in range(COORDINATES)], np.uint64)


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles; fewer words than `size`: one of them all."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = pc.list_flatten(parts).dictionary_encode()
    vocab = flat.dictionary.to_pylist()
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w.encode().lower()) for w in vocab), np.uint64, len(vocab))
    filled = np.fromiter((w != "" for w in vocab), bool, len(vocab))
    code = flat.indices.to_numpy(zero_copy_only=False)
    real = filled[code] if len(code) else np.zeros(0, bool)
    edge = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False), out=edge[1:])
    kept = np.zeros(len(code) + 1, np.int64)
    np.cumsum(real, out=kept[1:])
    edge = kept[edge]
    h = hashed[code[real]] if len(code) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for i in range(size):
        rolled = rolled * _MIX + h[i : len(h) - size + 1 + i] if len(rolled) else rolled
    rolled = _finish(rolled + np.uint64(size))
    out = []
    for a, b in zip(edge.tolist(), edge[1:].tolist()):
        if b - a >= size:
            s = np.sort(rolled[a : b - size + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            x = np.zeros(1, np.uint64)
            for v in h[a:b]:
                x = x * _MIX + v
            out.append(_finish(x + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """The least value of each coordinate's hash, told apart by coordinate."""
    least = np.full(COORDINATES, np.uint64(2**64 - 1))
    for a in range(0, len(s), 4096):
        x = (s[a : a + 4096, None] ^ _SEEDS) * _MIX
        x ^= x >> np.uint64(32)
        np.minimum(least, (x * _MIX).min(axis=0), out=least)
    return least ^ _SALTS


def _features(batches):
    for batch in batches:
        for rows in slices(batch, "text", 3 << 20):
            sets = shingle_sets(rows.column("text"))
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            classes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            sigs = [signature(s).view(np.int64) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [rows.column("row_key"), rows.column("doc_id"), pa.array(size), pa.array(classes, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))],
                names=["row_key", "doc_id", "n_shingles", "digest", "sig"],
            )


def _sets(batches):
    for batch in batches:
        for rows in slices(batch, "text", 3 << 20):
            sets = [s.tobytes() for s in shingle_sets(rows.column("text"))]
            yield pa.RecordBatch.from_arrays([*map(rows.column, ("class", "n", "sig")), pa.array(sets, pa.binary())], names=["class", "n", "sig", "cells"])


def _confirmed(batches):
    """u, v of pairs whose full sets are similar."""
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("a"), batch.column("b")):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= SIMILAR * (len(x) + len(y) - both))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (u, v) that are linked, of those with enough collisions and sizes near enough. held: class, n, sig, cells."""
    side = lambda x, c: held.select(F.col("class").alias(x), F.col("sig").alias(f"{c}_sig"), F.col("n").alias(f"{c}_n"))
    near = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v")
    near = near.where((100 * F.least("a_n", "b_n") >= SIMILAR * F.greatest("a_n", "b_n")) & (F.size(F.array_intersect("a_sig", "b_sig")) >= MATCHES))
    cells = lambda x, c: held.select(F.col("class").alias(x), F.col("cells").alias(c))
    return near.select("u", "v").join(cells("u", "a"), "u").join(cells("v", "b"), "v").select("u", "v", "a", "b").transform(in_arrow, _confirmed, "u long, v long")


def _across(lists: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs u > v of members of one list (key, class, place of the key in the set, n the set's size) in different components.

    Members of a list's largest component are met by the others only. Pairs' sets can overlap enough from
    their places on; linked sets can from their first common key.
    """
    named = lists.join(parts.select(F.col("node").alias("class"), "component"), "class", "left").select(*lists.columns, F.coalesce("component", "class").alias("part"))
    counts = named.groupBy("key", "part").count().groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("count", "part")).alias("m"))
    mixed = named.join(counts.where("parts > 1").select("key", F.col("m.part").alias("most")), "key")
    side = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("class", "part", "place", "n")]
    pairs = mixed.where("part <> most").select("key", *side("a")).join(mixed.select("key", "most", *side("b")), "key")
    met = "a_part <> b_part AND (b_part = most OR a_class > b_class)"
    met += f" AND {100 + SIMILAR} * (least(a_n - a_place, b_n - b_place) + 1) >= {SIMILAR} * (a_n + b_n)"
    return pairs.where(met).select(F.greatest("a_class", "b_class").alias("u"), F.least("a_class", "b_class").alias("v")).distinct()


def _shingles(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            s = np.frombuffer(batch.column("cells")[i].as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), batch.column("class")[i].as_py(), np.int64)), pa.array(s), pa.array(np.full(len(s), len(s), np.int64))], names=["class", "key", "n"])


def _rare_shingles(classes: DataFrame, held: DataFrame) -> DataFrame:
    """key, class, place (from 1), n: a prefix of each set in order of frequency; sets with |A and B| >= 3/4 |A or B| share a key of their prefixes.

    Shingles of one class come first and need no posting; a class with enough of them posts nothing.
    """
    every = held.select("class", "cells").join(classes, "class", "left_semi").transform(in_arrow, _shingles, "class long, key long, n long")
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    own = every.join(shared, "key").groupBy("class").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("many", "key"))).alias("keys"))  # one set
    alone = F.col("n") - F.size("keys")
    post = F.col("n") - F.ceil(F.col("n") * SIMILAR / 100) + 1 - alone
    rows = own.where(post > 0).select("class", "n", alone.alias("alone"), F.posexplode(F.slice("keys", F.lit(1), post.cast("int"))["key"]).alias("at", "key"))
    return rows.select("key", "class", (F.col("alone") + F.col("at") + 1).alias("place"), "n")


def miss(similar: float = SIMILAR / 100) -> float:
    """The chance that two sets of this similarity meet under no coordinate looked at."""
    few = sum(math.comb(COORDINATES, i) * similar**i * (1 - similar) ** (COORDINATES - i) for i in range(MATCHES))
    return (1 - similar) ** FIRST + few


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs, which must be a stable table (files).

    Rows are linked when 100 * |A and B| >= 75 * |A or B| for their sets of 5-word shingles (ASCII
    lower case; fewer words: all of them as one); component_id is the smallest doc_id reachable. Null
    text or no words: n_shingles 0, linked with nothing, kept. A null doc_id has the component of its
    group, null if the group has no id; it is kept only when linked with nothing. Rows that repeat a
    doc_id are compared by their texts. Empty table: no rows. Extra columns are ignored.
    """
    found = near_duplicate_rows(docs, id_col, text_col)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)) | (F.col("doc_id").isNull() & F.col("alone"))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_key (the row's place in docs), doc_id, text."""
    return docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def near_duplicate_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_key, doc_id, n_shingles, component_id, alone (linked with nothing), first (of its group: smallest doc_id, null last, then row_key).

    docs must be a stable table (files): row_key is monotonically_increasing_id over it.
    """
    rows = keyed(docs, id_col, text_col)
    found = staged(rows.transform(in_arrow, _features, "row_key long, doc_id long, n_shingles long, digest binary, sig array<long>"), "signatures", "snappy")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row_key")
    grouped = found.where("digest IS NOT NULL").groupBy("digest").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = staged(grouped.select("digest", F.col("place.row_key").alias("class"), "place", "copies", "n", "sig"), "classes", "snappy")

    # classes that share one of their first values
    few = classes.select("class", F.explode(F.slice("sig", 1, FIRST)).alias("key"))
    met = few.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("key")
    near = staged(classes.join(few.join(met, "key", "left_semi").select("class").distinct(), "class", "left_semi").select("class", "n", "sig"), "near-classes", "snappy")

    # their postings, the rarest values first
    postings = near.select("class", F.explode("sig").alias("key"))
    many = postings.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    ranked = postings.join(many, "key").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("many", "key"))).alias("keys"))  # COORDINATES at most
    central = F.aggregate("keys", F.lit(0).cast("long"), lambda s, x: s + x["many"])
    prefix = ranked.where(F.size("keys") >= MATCHES).select("class", central.alias("central"), F.explode(F.slice("keys", F.lit(1), F.size("keys") - (MATCHES - 1))["key"]).alias("key"))
    posted = staged(prefix, "postings")
    at = F.struct("central", (-F.col("class")).alias("class"))
    pivots = posted.groupBy("key").agg(F.max(at).alias("a"), F.min(at).alias("b"), F.count(F.lit(1)).alias("members")).where("members > 1")
    lists = staged(posted.join(pivots.select("key", F.array(-F.col("a.class"), -F.col("b.class")).alias("pivots")), "key").select("key", "class", "pivots"), "lists")
    met = lists.select("class", F.explode("pivots").alias("pivot")).where("class <> pivot")
    stars = staged(met.select(F.greatest("class", "pivot").alias("u"), F.least("class", "pivot").alias("v")).distinct(), "stars")

    ids = stars.select(F.explode(F.array("u", "v")).alias("class")).distinct()
    texts = near.join(ids, "class", "left_semi").join(rows.select(F.col("row_key").alias("class"), "text"), "class")
    held = staged(texts.select("class", "n", "sig", "text").transform(in_arrow, _sets, "class long, n long, sig array<long>, cells binary"), "held-classes", "snappy")
    links = staged(_links(stars, held), "links")
    parts = components(links)

    # pairs the stars have not met: members of one list, no pivots, that are in different components
    named = lists.where(~F.array_contains("pivots", F.col("class"))).join(parts.withColumnRenamed("node", "class"), "class", "left").select("key", "class", F.coalesce("component", "class").alias("part"))
    mixed = named.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("key")
    apart = staged(named.join(mixed, "key", "left_semi").select("class").distinct(), "apart")
    rest = _across(_rare_shingles(apart, held), parts).join(stars, ["u", "v"], "left_anti")
    more = staged(_links(rest, held), "links")
    whole = parts if more.isEmpty() else merged(parts, more)

    # the first row of each component; classes of one row that link with nothing need no entry
    known = classes.select("digest", "class", "place", "copies").join(whole.withColumnRenamed("node", "class"), "class", "left").where("component IS NOT NULL OR copies > 1")
    known = staged(known.select("digest", "place", F.coalesce("component", "class").alias("component")), "grouped-classes")
    least = known.groupBy("component").agg(F.min("place").alias("best"))
    groups = known.join(least, "component").select("digest", F.col("best.doc_id").alias("group_id"), F.col("best.row_key").alias("group_row"))
    released(near, posted, lists, stars, held, links, apart, more)
    out = found.select("row_key", "doc_id", "n_shingles", "digest").join(groups, "digest", "left")
    alone = F.col("group_row").isNull()
    return out.select("row_key", "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("group_id")).alias("component_id"), alone.alias("alone"), (alone | (F.col("row_key") == F.col("group_row"))).alias("first"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
