"""Ranked lexical search over a clustered index whose documents recursive graph bisection has reordered.

Index: documents become (terms, counts). A tree of bisections, fitted on a bounded sample, deals all documents
into leaves (very long ones lie apart); a leaf's documents lie in blocks of bounded size, and each block is reordered by recursive graph
bisection: halves swap the documents that most lower the cost of the terms' gaps, then each half does the same.
Runs of the order are shards: postings of all terms, with the largest impact of each term.

Search: an item's bound on a shard is the sum of its weights times these impacts. Items visit shards by falling
bound, in rounds; an item is done when no bound is left that reaches its k-th best score. Only bounds below it
are passed over, so the result is that of all documents. Hits go back to doc_id, which decides ties.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidence_lake.llm.common import in_arrow, staged

#: A block is reordered in one piece: at most so many documents and, but for a single document, bytes of terms.
BLOCK_DOCS = 8192
BLOCK_BYTES = 16 << 20
SHARD_DOCS = 1024
#: Bisection ends at so few documents.
LEAST_DOCS = 32
#: Rounds of swaps in a bisection.
SWAPS = 8
#: The tree is fitted on about so many documents, whose terms take at most SAMPLE_BYTES each.
SAMPLE = 2048
SAMPLE_BYTES = 1 << 15
#: Leaves of the tree at most; larger corpora have more blocks in a leaf.
LEAVES = 64
#: Items and distinct terms that are searched for at once; more items are searched in several goes.
ITEMS = 4096
TERMS = 1 << 20
#: Shards that an item visits in each round but the last, which has no limit.
ROUNDS = (1, 8)

#: ASCII but digits and letters parts terms; only A-Z are lower-cased.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))

FORWARD = "row long, doc_id long, n long, terms binary, counts binary"
SHARDS = "shard long, doc_ids array<long>, sizes binary, terms binary, dfs binary, bests binary, at binary, counts binary"


def terms_of(text: str) -> list[bytes]:
    """A text's terms as UTF-8, repeats included."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def impacts(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A term's share of a score for each posting: counts of the term, sizes of the documents (m)."""
    return (1_000_000_000 * counts) // (1000 * counts + 20 * sizes)


def _cost(degree: np.ndarray, n: int) -> np.ndarray:
    degree = np.maximum(degree, 0.0)
    return degree * np.log2(n / (degree + 1.0))


def halved(doc: np.ndarray, term: np.ndarray, n: int, n_terms: int) -> np.ndarray:
    """Whether each of n documents belongs to the second half, by swaps of documents between halves of equal size (but for one).

    doc, term: the graph's edges.
    """
    second = np.arange(n) >= n // 2
    sizes = n // 2, n - n // 2
    for _ in range(SWAPS):
        side = second[doc]
        there = np.bincount(term[side], minlength=n_terms).astype(float)
        here = np.bincount(term, minlength=n_terms) - there
        now = _cost(here, sizes[0]) + _cost(there, sizes[1])
        leave = now - _cost(here - 1, sizes[0]) - _cost(there + 1, sizes[1])
        come = now - _cost(here + 1, sizes[0]) - _cost(there - 1, sizes[1])
        gain = np.bincount(doc, np.where(side, come[term], leave[term]), minlength=n)
        a, b = np.flatnonzero(~second), np.flatnonzero(second)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        worth = gain[a] + gain[b[: len(a)]] > 1e-9
        many = len(worth) if worth.all() else int(worth.argmin())
        if not many:
            break
        second[a[:many]], second[b[:many]] = True, False
    return second


def _told_apart(doc: np.ndarray, term: np.ndarray, n: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges of terms that some but not all documents share, with terms numbered anew, and their old numbers."""
    degree = np.bincount(term, minlength=n_terms)
    useful = (degree > 1) & (degree < n)
    keep = useful[term]
    return doc[keep], (np.cumsum(useful) - 1)[term[keep]], np.flatnonzero(useful)


def reordered(doc: np.ndarray, term: np.ndarray, n: int, n_terms: int) -> np.ndarray:
    """The documents in an order in which near ones share terms."""
    if n <= LEAST_DOCS:
        return np.arange(n)
    doc, term, own = _told_apart(doc, term, n, n_terms)
    second = halved(doc, term, n, len(own))
    out = []
    for part in (False, True):
        members, edges = np.flatnonzero(second == part), second[doc] == part
        place = np.cumsum(second == part) - 1
        out.append(members[reordered(place[doc[edges]], term[edges], len(members), len(own))])
    return np.concatenate(out)


class _Ids(dict):
    """Numbers for terms, in the order of their first use."""

    def __missing__(self, key):
        self[key] = value = len(self)
        return value


def _edges(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, _Ids]:
    """(document, term) of documents with their terms joined by blanks."""
    ids = _Ids()
    number = ids.__getitem__
    terms = [np.fromiter(map(number, x.split()), np.int64) for x in docs]
    return np.repeat(np.arange(len(docs)), [len(x) for x in terms]), np.concatenate(terms) if terms else np.zeros(0, np.int64), ids


@dataclass
class Tree:
    """Leaves by number: node i has the children 2i and 2i + 1, and for each known term what it says for the second one; documents go there whose terms say more than those of half the node's sample.

    shares: the leaves' shares of the sample, by documents and by bytes of terms.
    """

    depth: int
    numbers: dict[bytes, int]
    weights: dict[int, np.ndarray]
    least: dict[int, float]
    shares: dict[int, tuple[float, float]]

    def leaf(self, terms: list[bytes]) -> int:
        known, node = [n for n in map(self.numbers.get, terms) if n is not None], 1
        for _ in range(self.depth):
            node = 2 * node + (node in self.weights and bool(self.weights[node][known].sum(dtype=float) > self.least[node]))
        return node


def fitted_tree(sample: list[bytes], depth: int) -> Tree:
    """Bisections of a sample's documents, depth levels of them."""
    weights: dict[int, np.ndarray] = {}
    least: dict[int, float] = {}
    doc, term, ids = _edges(sample)
    doc, term, useful = _told_apart(doc, term, len(sample), len(ids))
    words = list(ids)
    numbers = {words[i]: n for n, i in enumerate(useful.tolist())}

    def grow(node: int, doc: np.ndarray, term: np.ndarray, n: int, names: np.ndarray) -> None:
        if node >= 1 << depth or n < 2:
            return
        doc, term, own = _told_apart(doc, term, n, len(names))
        names = names[own]
        second = halved(doc, term, n, len(names))
        side, sizes = second[doc], (n // 2, n - n // 2)
        there = np.bincount(term[side], minlength=len(names))
        here = np.bincount(term, minlength=len(names)) - there
        weights[node] = np.zeros(len(numbers), np.float32)
        weights[node][names] = np.log((there + 1) / (sizes[1] + 2)) - np.log((here + 1) / (sizes[0] + 2))
        said = np.bincount(doc, weights[node][names][term].astype(float), minlength=n)
        least[node] = float(np.median(said))
        second = said > least[node]
        side = second[doc]
        for part in (False, True):
            edges, place = side == part, np.cumsum(second == part) - 1
            grow(2 * node + part, place[doc[edges]], term[edges], int((second == part).sum()), names)

    grow(1, doc, term, len(sample), np.arange(len(numbers)))
    tree = Tree(depth, numbers, weights, least, {})
    docs, size = Counter(), Counter()
    for x in sample:
        leaf = tree.leaf(x.split())
        docs[leaf] += 1
        size[leaf] += len(x)
    tree.shares = {leaf: (many / len(sample), size[leaf] / sum(size.values())) for leaf, many in docs.items()}
    return tree


def _forward(batches):
    """Terms and counts of each document that has a term."""
    part, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        rows, ids = [], batch.column("doc_id")
        for i, text in enumerate(batch.column("text")):
            if text.is_valid and (found := terms_of(text.as_py())):
                many = Counter(found)
                made += 1
                rows.append(((part << 33) + made, ids[i].as_py(), len(found), b" ".join(many), np.fromiter(many.values(), "<u4").tobytes()))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["row", "doc_id", "n", "terms", "counts"])


def _dealt(batches, tree: Tree, lanes: dict[int, int]):
    """Each document with its leaf and one of the leaf's lanes; long documents have lanes of their own, as leaf 0."""
    for batch in batches:
        leaves = [0 if len(x) > SAMPLE_BYTES else tree.leaf(x.split()) if tree.depth else 1 for x in batch.column("terms").to_pylist()]
        turn = (batch.column("row").to_numpy() * 0x9E3779B1 >> 7).tolist()
        lane = [t % lanes.get(leaf, 1) for leaf, t in zip(leaves, turn)]
        yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int32()), pa.array(lane, pa.int32()), *batch.columns], names=["leaf", "lane", *batch.schema.names])


def _narrow(x: np.ndarray) -> bytes:
    """Numbers as bytes, the first of which is their width."""
    kind = "<u1" if x.max(initial=0) < 1 << 8 else "<u2" if x.max(initial=0) < 1 << 16 else "<u4"
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _sharded(batches, n_docs: int, n_terms: int, block_docs: int, shard_docs: int):
    """Shards of reordered blocks; rows come sorted by leaf and lane."""
    part, made = TaskContext.get().partitionId(), 0
    held: list[tuple] = []

    def shards():
        nonlocal made
        doc, term, ids = _edges([r[2] for r in held])
        words = np.array(list(ids), object)
        counts = np.concatenate([np.frombuffer(r[3], "<u4") for r in held]).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(held)))])
        order = reordered(doc, term, len(held), len(words))
        for a in range(0, len(order), shard_docs):
            own = order[a : a + shard_docs]
            edges = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in own.tolist()])
            at = np.repeat(np.arange(len(own)), starts[own + 1] - starts[own])
            by = np.argsort(term[edges], kind="stable")
            used, first, dfs = np.unique(term[edges][by], return_index=True, return_counts=True)
            sizes = 50 + (50 * np.array([held[i][1] for i in own.tolist()], np.int64) * n_docs) // n_terms
            best = np.maximum.reduceat(impacts(counts[edges][by], sizes[at[by]]), first)
            made += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + made], pa.int64()),
                    pa.array([[held[i][0] for i in own.tolist()]], pa.list_(pa.int64())),
                    *[pa.array([x], pa.binary()) for x in (sizes.astype("<i8").tobytes(), b" ".join(words[used]), _narrow(dfs), best.astype("<u4").tobytes(), _narrow(at[by]), _narrow(counts[edges][by]))],
                ],
                names=["shard", "doc_ids", "sizes", "terms", "dfs", "bests", "at", "counts"],
            )

    last, size = None, 0
    for batch in batches:
        for r in batch.to_pylist():
            if held and ((r["leaf"], r["lane"]) != last or len(held) >= block_docs or size >= BLOCK_BYTES):
                yield from shards()
                held, size = [], 0
            last, size = (r["leaf"], r["lane"]), size + len(r["terms"])
            held.append((r["doc_id"], r["n"], r["terms"], r["counts"]))
    if held:
        yield from shards()


@dataclass
class Index:
    """Shards of all documents with a term; how many these are, and their terms with repeats."""

    shards: DataFrame
    n_docs: int
    n_terms: int


def indexed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS, shard_docs: int = SHARD_DOCS) -> Index:
    """The index of all documents; those without a term, or text, aren't in it. Ids may be null or repeat."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    forward = staged(own.transform(in_arrow, _forward, FORWARD), "lexical-forward")
    long = F.length("terms") > SAMPLE_BYTES
    sums = [F.coalesce(F.sum(x), F.lit(0)) for x in ("n", F.when(~long, F.length("terms")), F.when(long, F.length("terms")))]
    n_docs, n_terms, short_bytes, long_bytes = forward.agg(F.count(F.lit(1)), *sums).first()
    depth = min(LEAVES.bit_length() - 1, max(0, math.ceil(math.log2(max(1, n_docs) / block_docs))))
    tree = Tree(0, {}, {}, {}, {1: (1.0, 1.0)})
    if depth:
        rate = max(1, n_docs // SAMPLE)
        taken = forward.where((F.pmod(F.xxhash64("row"), F.lit(rate)) == 0) & ~long).select("row", "terms")
        tree = fitted_tree([bytes(r.terms) for r in sorted(taken.collect(), key=lambda r: r.row)], depth)  # a bounded sample
    lanes = {leaf: math.ceil(max(docs * n_docs / block_docs, size * short_bytes / BLOCK_BYTES)) for leaf, (docs, size) in tree.shares.items()} | {0: math.ceil(long_bytes / BLOCK_BYTES) or 1}
    dealt = forward.transform(in_arrow, lambda b: _dealt(b, tree, lanes), f"leaf int, lane int, {FORWARD}")
    blocks = dealt.repartition("leaf", "lane").sortWithinPartitions("leaf", "lane", "row")
    return Index(staged(blocks.transform(in_arrow, lambda b: _sharded(b, n_docs, n_terms, block_docs, shard_docs), SHARDS), "lexical-shards"), n_docs, n_terms)


def _questions(batches):
    """Distinct terms of each item that has one."""
    part, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        rows, ids = [], batch.column("item_id")
        for i, text in enumerate(batch.column("text")):
            if text.is_valid and (found := sorted(set(terms_of(text.as_py())))):
                made += 1
                rows.append(((part << 33) + made, ids[i].as_py(), found))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], ids.type), pa.array([r[2] for r in rows], pa.list_(pa.binary()))], names=["item", "item_id", "terms"])


def _asked_in(batch: pa.RecordBatch, i: int, asked: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(places in the shard's lexicon, numbers of the asked terms) of those that the shard holds."""
    found = [(p, n) for p, t in enumerate(batch.column("terms")[i].as_py().split()) if (n := asked.get(t)) is not None]
    return tuple(np.array(found, np.int64).reshape(-1, 2).T)


def _best(scores: np.ndarray, ids: np.ndarray, absent: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best hits, ties by id, absent ids last."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return at[np.lexsort((ids[at], absent[at], -scores[at]))[:k]]
    return np.lexsort((ids, absent, -scores))


def _scored(batches, asked: dict[bytes, int], items: list[np.ndarray], weights: np.ndarray, cutoffs: list[int], k: int):
    """The k best documents of each item in a task's shards; a visit is left out if its bound is below the item's k-th best score so far."""
    best: dict[int, tuple] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            go = [(x["item"], x["bound"]) for x in batch.column("visits")[i].as_py()]
            go = [j for j, bound in go if bound >= max(cutoffs[j], int(best[j][0][-1]) if j in best and len(best[j][0]) == k else 1)]
            if not go:
                continue
            place, number = _asked_in(batch, i, asked)
            where = dict(zip(number.tolist(), place.tolist()))
            ends = np.cumsum(_wide(batch.column("dfs")[i].as_py()))
            at, counts = _wide(batch.column("at")[i].as_py()), _wide(batch.column("counts")[i].as_py())
            sizes = np.frombuffer(batch.column("sizes")[i].as_py(), "<i8")
            names = batch.column("doc_ids")[i].values
            absent, ids = names.is_null().to_numpy(zero_copy_only=False), names.fill_null(0).to_numpy()
            parts: dict[int, tuple] = {}
            for j in go:
                total = np.zeros(len(sizes), np.int64)
                for t in items[j].tolist():
                    if t in where:
                        if t not in parts:
                            span = slice(int(ends[where[t] - 1]) if where[t] else 0, int(ends[where[t]]))
                            parts[t] = at[span], weights[t] * impacts(counts[span], sizes[at[span]])
                        total[parts[t][0]] += parts[t][1]
                hit = np.flatnonzero(total > 0)
                found = (total[hit], ids[hit], absent[hit])
                if j in best:
                    found = tuple(np.concatenate(x) for x in zip(best[j], found))
                keep = _best(*found, k)
                best[j] = tuple(x[keep] for x in found)
    for j, (score, ids, absent) in best.items():
        if len(score):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), j, np.int32)), pa.array(ids, mask=absent), pa.array(score)], names=["item", "doc_id", "score"])


def _go(index: Index, asked: dict[bytes, int], items: list[np.ndarray], k: int) -> DataFrame:
    """item, doc_id, score: hits that hold the k best of each item."""
    spark = index.shards.sparkSession

    def frequencies(batches):
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                place, number = _asked_in(batch, i, asked)
                total[number] += _wide(batch.column("dfs")[i].as_py())[place]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "df"])

    weights = np.zeros(len(asked), np.int64)
    lexicons = index.shards.select("shard", "terms", "dfs", "bests")
    for term, df in lexicons.transform(in_arrow, frequencies, "term int, df long").groupBy("term").agg(F.sum("df")).collect():  # the asked terms at most
        weights[term] = math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * df + 1)))
    flat, starts = np.concatenate(items), np.concatenate([[0], np.cumsum([len(x) for x in items])[:-1]])

    def bounds(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                most = np.zeros(len(asked), np.int64)
                place, number = _asked_in(batch, i, asked)
                most[number] = np.frombuffer(batch.column("bests")[i].as_py(), "<u4")[place]
                bound = np.add.reduceat((weights * most)[flat], starts)
                go = np.flatnonzero(bound)
                yield pa.RecordBatch.from_arrays([pa.array(go.astype(np.int32)), pa.array(np.full(len(go), batch.column("shard")[i].as_py())), pa.array(bound[go])], names=["item", "shard", "bound"])

    falling = Window.partitionBy("item").orderBy(F.desc("bound"), "shard")
    reach = staged(lexicons.transform(in_arrow, bounds, "item int, shard long, bound long").withColumn("place", F.row_number().over(falling)), "lexical-bounds")
    cutoffs, hits, done = [0] * len(items), None, 0
    for many in (*ROUNDS, None):
        known = spark.createDataFrame(list(enumerate(cutoffs)), "item int, cut long")  # one row an item
        left = reach.where((F.col("place") > done) & (F.lit(True) if many is None else F.col("place") <= done + many))
        left = left.join(F.broadcast(known), "item").where("bound >= cut").groupBy("shard").agg(F.collect_list(F.struct("item", "bound")).alias("visits"))  # an entry an item at most
        visited = index.shards.join(left if many is None else F.broadcast(left), "shard")
        found = visited.transform(in_arrow, lambda b, c=list(cutoffs): _scored(b, asked, items, weights, c, k), "item int, doc_id long, score long")
        hits = staged(found if hits is None else hits.unionByName(found), "lexical-hits")
        if many is not None:
            done += many
            best = Window.partitionBy("item").orderBy(F.desc("score"))
            for item, cut in hits.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("item", "score").collect():  # one row an item
                cutoffs[item] = cut
    return hits


def search(index: Index, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text", most_items: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item; see `ranked`. At most about most_items are searched for at once."""
    own = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    asking = staged(own.transform(in_arrow, _questions, f"item long, item_id {dict(own.dtypes)['item_id']}, terms array<binary>"), "lexical-items")
    n_items, n_terms = asking.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    goes, out = max(math.ceil(n_items / most_items), math.ceil(n_terms / TERMS)), None
    for go in range(goes):
        rows = asking.where(F.pmod(F.xxhash64("item"), F.lit(goes)) == go).select("item", "terms").collect()  # about ITEMS items, TERMS terms
        if not rows:
            continue
        ids = _Ids()
        terms = [np.fromiter((ids[bytes(t)] for t in r.terms), np.int64) for r in rows]
        hits = _go(index, dict(ids), terms, k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = index.shards.sparkSession.createDataFrame([(i, r.item) for i, r in enumerate(rows)], "item int, item_row long")
        named = best.join(F.broadcast(names), "item").drop("item").withColumnRenamed("item_row", "item")
        out = named if out is None else out.unionByName(named)
    if out is None:
        return asking.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    return out.join(asking.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest score above 0 for each row of items.

    Ties go to the smaller doc_id, null last; documents that repeat a doc_id are ranked each, as are items that
    repeat an item_id. Texts that are null or without terms have no hits. Empty tables: no rows. Extra columns
    are ignored.
    """
    return search(indexed(docs), items, k)


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("text")} AS ts FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*) AS big_n, CAST(sum(len(ts)) AS BIGINT) AS big_l FROM d WHERE len(ts) > 0),
q AS (SELECT i, item_id, unnest(list_distinct(ts)) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS.format("text")} AS ts FROM benchmark WHERE text IS NOT NULL)),
t AS (SELECT DISTINCT term FROM q),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) SEMI JOIN t USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term),
x AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))) AS part FROM p JOIN w USING (term), c),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(part) AS BIGINT) AS score FROM q JOIN x USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50
"""
