"""Line dedup by a deletion-neighbourhood join.

A line is dropped when an earlier line of the corpus equals it or is one edit away (a character
inserted, deleted or replaced); a caller can ask for more characters before one edit counts. Equal
lines are found by their digest alone. Of two lines one edit apart, either the first characters are the
same, up to nearly half, or the last ones; so a distinct line posts keys of these two ends, and where
another has the same end, emits the variants of the rest: itself and itself without each of its
characters, hashed with the end's key. Lines too short to have ends emit the variants of the whole line.
Lines that share a variant with the deletion at the same place differ by a replacement, a line that is
another's variant by an insertion; so the earliest line of each variant is found by windows, never by
pairs (distinct lines of one variant are as many as a place has characters, at most); the edit distance
to it is verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidence_lake.llm.common import BROADCAST_ROWS, documents, in_arrow, released, staged
from evidence_lake.llm.tokens import slices

#: Characters (without the white space around a line) from which on repeats, or lines one edit away, are dropped: all but blank lines.
NOT_BLANK = 1
_BLANK = "\t\n\v\f\r "
_BASE = np.uint64(0x9E3779B97F4A7C15)

LINES = "doc_id long, row_key long, line int, digest binary, ends array<long>"
#: Lengths of the ends are multiples of it, so that lines of neighbouring lengths mostly have the same.
STEP = 8


def end_size(n: int) -> int:
    """Characters of each end of a line of n characters; two of them, and one character more, fit into it."""
    return (n - 1) // 2 // STEP * STEP


def ends(line: str) -> list[int]:
    """Keys of the line's two ends; also of those of a line that is longer by one, where these are of another size."""
    n, out = len(line), []
    for size in dict.fromkeys((end_size(n), end_size(n + 1))):
        for kind, part in (("a", line[:size]), ("b", line[n - size :])):
            out.append(xxhash.xxh3_64_intdigest(f"{kind}{size} {part}".encode("utf-8", "surrogatepass")) - (1 << 63))
    return out


def posted(line: str) -> list[int | None]:
    """`ends` of the line; null for an end of no characters, which every short line would share."""
    n, keys = len(line), ends(line)
    return [k if end_size(n + (r > 1)) else None for r, k in enumerate(keys)]


def _lines(batches, least_repeat: int, least_edited: int):
    for batch in batches:
        for rows in slices(batch, "text", 4 << 20):
            d, k, n, g, h = [], [], [], [], []
            for doc, key, text in zip(rows.column("doc_id").to_pylist(), rows.column("row_key").to_pylist(), rows.column("text").to_pylist()):
                for i, line in enumerate((text or "").split("\n")):
                    line = line.strip(_BLANK)
                    if len(line) >= least_repeat:
                        d.append(doc), k.append(key), n.append(i), g.append(xxhash.xxh3_128_digest(line.encode())), h.append(posted(line) if len(line) >= least_edited else [])
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(k, pa.int64()), pa.array(n, pa.int32()), pa.array(g, pa.binary()), pa.array(h, pa.list_(pa.int64()))], names=["doc_id", "row_key", "line", "digest", "ends"])


def variants(line: str) -> np.ndarray:
    """Hashes of the line and of the line without each of its characters, by polynomial hashing."""
    x = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(x)
    x = (x + np.uint64(1)) * _BASE
    x ^= x >> np.uint64(29)
    power = np.ones(n + 1, np.uint64)
    np.multiply.accumulate(np.full(n, _BASE), out=power[1:])
    # head[i]: hash of the first i characters as a sum of x[j] * power[j]
    head = np.zeros(n + 1, np.uint64)
    np.cumsum(x * power[:n], out=head[1:])
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    whole = head[n]
    without = head[:n] + (whole - head[1:]) * inverse
    out = np.concatenate(([whole], without)) + np.concatenate(([n], np.full(n, n - 1))).astype(np.uint64)
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def line_variants(line: str, roles: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(variants, deleted places; -1: nothing deleted) of what the line has besides its ends of these numbers (in `ends`).

    The third and the fourth end are those of a longer line, whose variant only the whole line can be.
    """
    n, keys, out, places = len(line), ends(line), [], []
    for r in roles:
        size = end_size(n + (r > 1))
        got = variants(line[: n - size] if r % 2 else line[size:])
        got = got[:1] if r > 1 else got
        out.append((got ^ np.uint64(keys[r] % (1 << 64))) * _BASE)
        places.append(np.arange(-1, len(got) - 1, dtype=np.int32))
    return np.concatenate(out), np.concatenate(places)


def _variants(batches):
    """variant, deleted and number of the line, for each variant."""
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            rows = batch.slice(a, 512)
            made = [line_variants(t, r) for t, r in zip(rows.column("text").to_pylist(), rows.column("roles").to_pylist())]
            keys, places = np.concatenate([x for x, _ in made]), np.concatenate([x for _, x in made])
            number = np.repeat(rows.column("number").to_numpy(), [len(x) for x, _ in made])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(places), pa.array(number)], names=["variant", "deleted", "number"])


def one_edit(a: str, b: str) -> bool:
    """Whether the edit distance is 1 at most."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _verified(batches):
    for batch in batches:
        good = [one_edit(a, b) for a, b in zip(batch.column("text").to_pylist(), batch.column("other").to_pylist())]
        yield batch.select(["number"]).filter(pa.array(good, pa.bool_()))


def place() -> Column:
    """The order of lines: doc_id (null last), row, line."""
    return F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row_key", "line")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_repeat: int = NOT_BLANK, least_edited: int = NOT_BLANK) -> DataFrame:
    """row_key, doc_id, dropped: the numbers (from 0) of the lines to drop, ascending, of each row that has some.

    row_key is monotonically_increasing_id over docs, which must be a stable table (files). Lines are
    what `\\n` separates, compared without the ASCII white space around them. Null or empty texts have
    no lines to drop. Lines under least_repeat (1 or more) characters stay; lines under least_edited
    (least_repeat or more) go as exact repeats only. Rows that repeat a doc_id are documents of their own. Empty table: no rows.
    Extra columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_key"), F.col(text_col).cast("string").alias("text"))
    lines = staged(own.transform(in_arrow, lambda batches: _lines(batches, least_repeat, least_edited), LINES), "lines")
    keyed = lines.select("digest", place().alias("p"))
    distinct = staged(lines.select("digest", place().alias("p"), "ends").groupBy("digest").agg(F.min("p").alias("first"), F.first("ends").alias("ends"), F.count(F.lit(1)).alias("many")), "distinct-lines")

    # lines that share an end with another, which has it as its own and not as that of a longer line
    at = F.struct("first.row_key", "first.line")
    end = distinct.select(at.alias("at"), F.posexplode("ends").alias("role", "end")).where("end IS NOT NULL")
    shared = end.groupBy("end").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") < 2).alias("own")).where("n > 1 AND own > 0").select("end")
    roles = end.join(shared, "end", "left_semi").groupBy("at").agg(F.collect_set("role").alias("roles"))  # four at most
    short = F.when((F.size("ends") > 0) & F.col("ends")[0].isNull(), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))  # the whole line
    near = distinct.select("digest", "first", at.alias("at"), short.alias("short")).join(roles, "at", "left")
    near = near.withColumn("roles", F.array_union("short", F.coalesce("roles", F.array().cast("array<int>")))).where(F.size("roles") > 0)
    near = staged(near.select("digest", "first", F.sort_array("roles").alias("roles")), "near-lines")
    near = near.orderBy("first").select(F.monotonically_increasing_id().alias("number"), "digest", "first", "roles")  # numbers follow the order of lines
    by_row = near.groupBy(F.col("first.row_key").alias("row_key")).agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "number", "digest", "roles")).alias("want"))  # a text's own lines
    by_row = staged(by_row, "wanted-lines")
    having = own.select("row_key", "text")
    if by_row.count() <= BROADCAST_ROWS:
        having = having.join(F.broadcast(by_row.select("row_key")), "row_key", "left_semi")
    split = having.join(by_row, "row_key").select(F.split("text", "\n").alias("all"), "want")
    cut = F.transform("want", lambda w: F.struct(w["digest"].alias("digest"), w["number"].alias("number"), w["roles"].alias("roles"), F.element_at("all", w["line"] + 1).alias("text")))
    texts = split.select(F.explode(cut).alias("x")).select("x.digest", "x.number", "x.roles", F.regexp_replace("x.text", r"^[\t-\r ]+|[\t-\r ]+$", "").alias("text"))
    texts = staged(texts, "line-texts")
    made = texts.select("number", "text", "roles").transform(in_arrow, _variants, "variant long, deleted int, number long").repartition("variant")

    # an earlier line: with the same deletion at the same place; of which the line is a variant; that is one of the line's variants
    same, group = Window.partitionBy("variant", "deleted"), Window.partitionBy("variant")
    met = made.withColumn("replaced", F.min("number").over(same))
    met = met.withColumn("whole", F.min(F.when(F.col("deleted") < 0, F.col("number"))).over(group)).withColumn("longer", F.min(F.when(F.col("deleted") >= 0, F.col("number"))).over(group))
    earlier = F.when(F.col("deleted") < 0, F.array("longer")).otherwise(F.array("replaced", "whole"))
    witnesses = met.select("number", F.explode(earlier).alias("witness")).where("witness < number").distinct()
    sides = witnesses.join(texts.select("number", "text"), "number").join(texts.select(F.col("number").alias("witness"), F.col("text").alias("other")), "witness")
    edited = sides.select("number", "text", "other").transform(in_arrow, _verified, "number long").distinct()
    near_dropped = texts.join(edited, "number", "left_semi").select("digest", F.lit(True).alias("near"))

    verdict = distinct.select("digest", "first", "many").join(near_dropped, "digest", "left").where("many > 1 OR near")
    verdict = staged(verdict.select("digest", F.col("first.row_key").alias("first_row"), F.col("first.line").alias("first_line"), "near"), "line-verdicts")
    released(distinct, by_row, texts)
    out = keyed.join(verdict, "digest").where(F.col("near") | (F.col("p.row_key") != F.col("first_row")) | (F.col("p.line") != F.col("first_line")))
    return out.groupBy(F.col("p.row_key").alias("row_key")).agg(F.first("p.doc_id").alias("doc_id"), F.sort_array(F.collect_list("p.line")).alias("dropped"))  # a text's own lines


def without_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_repeat: int = NOT_BLANK, least_edited: int = NOT_BLANK) -> DataFrame:
    """docs (a stable table) with the dropped lines cut out of the text; rows of which no word is left go, rows without lines to drop stay as they are; other columns keep names and values."""
    cols = docs.columns
    drops = dropped_lines(docs, id_col, text_col, least_repeat, least_edited).select("row_key", "dropped")
    own = docs.select(F.struct(*[F.col(c) for c in cols]).alias("row"), F.monotonically_increasing_id().alias("row_key")).join(drops, "row_key", "left")
    left = F.filter(F.split(F.col("row")[text_col], "\n"), lambda x, i: ~F.array_contains("dropped", i))
    text = F.when(F.col("dropped").isNull(), F.col("row")[text_col]).otherwise(F.array_join(left, "\n"))
    out = own.select("row", F.col("dropped").isNull().alias("whole"), text.alias("left")).where(F.col("whole") | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.col("left").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in cols])


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, dropped (line numbers), n_dropped of every document that loses lines."""
    return dropped_lines(documents(spark, sf_dir)).select("doc_id", "dropped", F.size("dropped").cast("long").alias("n_dropped"))
