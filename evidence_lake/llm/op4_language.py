"""Language identification, word first with back-off to shorter character n-grams.

A known word scores its log frequency in each language. A word not known is taken apart into the
4-grams of itself between blanks; if none is known, into 3-grams, and so on down to single
characters; the known n-grams' log frequencies are averaged. A text's scores are sums over its words.

The model is the counts of all documents that may be learned from, kept as tables of words and n-grams.
Only its most frequent words, of a bounded number, are held by every worker; a text's other words meet
the tables in joins. Log frequencies are whole numbers of 1 / UNIT, so a text's sums are the same
whichever words are held and in whatever order they are added.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_lake.llm.common import documents, in_arrow, released, staged, trim
from evidence_lake.llm.tokens import slices

LONGEST = 4
SMOOTH = 0.5
UNIT = 1 << 20
UNKNOWN = "und"
#: Pairs of a language and a word that every worker holds at most; the other words are joined.
HELD_PAIRS = 400_000
#: Keys that so many rows have, or more, are joined by broadcast: there is one for HOT rows at most.
HOT = 4096
SLICE = 2 << 20  # bytes of text at a time; the workers stay for the next stages
CELLS = 1 << 20  # totals of texts by language at a time
STEPS = 10_000  # a median of shares is exact to 1 / STEPS

_LETTERS = regex.compile(r"\p{L}+|\n")
_ENTRIES = "array<struct<lang:int,delta:bigint,n:bigint>>"


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learned(doc_id: Column, text: Column, lang: Column) -> Column:
    """Whether a row is learned from."""
    return doc_id.isNotNull() & text.isNotNull() & lang.isNotNull() & ~held_out(doc_id)


def _spread(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places low, low + 1 ... of each run."""
    return np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _sums(key: np.ndarray, cells: int, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct keys (under cells) in order, and the sums of values of each."""
    if cells <= 4 * len(key) + (1 << 16):
        at = np.flatnonzero(np.bincount(key, minlength=cells))
        return at, [np.bincount(key, v, cells)[at].astype(np.int64) for v in values]
    at, back = np.unique(key, return_inverse=True)
    return at, [np.bincount(back, v, len(at)).astype(np.int64) for v in values]


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Text and word number of each word; of each distinct word the first of its pieces (runs of letters, lower case) and how many; all their piece numbers; the pieces."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    coded = pc.list_flatten(parts).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    place: dict[str, int] = {}
    runs = _LETTERS.findall("\n".join(coded.dictionary.to_pylist()).lower()) if len(code) else []
    at = np.fromiter((-1 if p == "\n" else place.setdefault(p, len(place)) for p in runs), np.int64, len(runs))
    word = np.cumsum(at < 0)  # each break ends a word
    n_pieces = np.bincount(word[at >= 0], minlength=len(coded.dictionary))
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    return text, code, np.cumsum(n_pieces) - n_pieces, n_pieces, at[at >= 0], list(place)


def _pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Text, number of the piece and how often the text has it, by text; the pieces."""
    text, code, first, n_pieces, pieces, names = _split(texts)
    size = n_pieces[code]
    both, n = np.unique(np.repeat(text, size) * max(len(names), 1) + pieces[_spread(first[code], size)], return_counts=True)
    return both // max(len(names), 1), both % max(len(names), 1), n, names


def _grams(names: list[str], sizes: range) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """Of each size: word and number of each n-gram of the words, and the n-grams; those of two characters and more also reach over a word's ends."""
    text = "".join(f" {w} " for w in names)
    length = np.fromiter(map(len, names), np.int64, len(names)) + 2
    word, end = np.repeat(np.arange(len(names)), length), np.cumsum(length)
    at = np.arange(len(word))
    codes: dict[int, np.ndarray] = {1: np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_inverse=True)[1].astype(np.int64)}
    for size in range(1, LONGEST + 1):
        if size > 1:  # of a shorter n-gram's number and its last character's
            one, shorter = codes[1][size - 1 :], codes[size - 1][: max(len(word) - size + 1, 0)]
            codes[size] = np.unique(shorter * (int(codes[1].max(initial=0)) + 1) + one, return_inverse=True)[1].astype(np.int64)
        if size in sizes:
            good = at[at + size <= end[word]] if size > 1 else at[(at + 1 < end[word]) & (at > end[word] - length[word])]
            distinct, where, gram = np.unique(codes[size][good], return_index=True, return_inverse=True)
            yield size, word[good], gram, pa.array([text[i : i + size] for i in good[where].tolist()], pa.string())


def _lists(owner: np.ndarray, n_lists: int, **values) -> pa.Array:
    """A list of structs for each of n_lists rows; owner is sorted."""
    made = [v if isinstance(v, pa.Array) else pa.array(v) for v in values.values()]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n_lists + 1)), pa.int32()), pa.StructArray.from_arrays(made, list(values)))


class Model:
    """langs; held: the words held, tables[0]: word -> row of them; a row's counts and weights (log frequency over base[0]) are
    those of the languages that have it; base[n] is the log frequency of a word (0) or n-gram that a language hasn't.

    words(gram, entries) and grams(size, gram, entries) are the whole tables, unless the words held are all there is.
    The driver only has columns; tables and weights are made where they are used.
    """

    def __init__(self, langs: list[str], counts: dict[int, dict[tuple[str, str], int]], totals: dict[tuple[int, str], int], sizes: dict[int, int] | None = None):
        self.langs, self.words, self.grams = langs, None, None
        number = {x: i for i, x in enumerate(langs)}
        sizes = sizes or {n: len({gram for _, gram in own}) for n, own in counts.items()}
        total = np.array([[totals.get((n, x), 0) + SMOOTH * (sizes.get(n, 0) + 1) for x in langs] for n in range(LONGEST + 1)])
        self.base = np.rint(np.log(SMOOTH / total) * UNIT).astype(np.int64)
        own = counts.get(0, {})
        self.hold(pa.array([gram for _, gram in own], pa.string()), np.fromiter((number[lang] for lang, _ in own), np.int64, len(own)), np.fromiter(own.values(), np.int64, len(own)))

    def hold(self, gram: pa.Array, owner: np.ndarray, count: np.ndarray) -> None:
        """Hold these words: of each pair the word, the number of the language and the count."""
        coded = gram.dictionary_encode()
        row = coded.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((owner, row))
        self.held = coded.dictionary
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(self.held))))).astype(np.int64)
        self.owners, self.counts = owner[order].astype(np.int32), count[order].astype(np.int64)

    @cached_property
    def weights(self) -> list[np.ndarray]:
        return [np.rint(np.log1p(self.counts / SMOOTH) * UNIT).astype(np.int64)]

    @cached_property
    def tables(self) -> list[dict[str, int]]:
        return [dict(zip(self.held.to_pylist(), range(len(self.held))))]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("tables", "weights")} | {"words": None, "grams": None}

    def number(self, langs: pa.Array) -> np.ndarray:
        """Numbers of languages, -1 for others."""
        return np.array([{x: i for i, x in enumerate(self.langs)}.get(x, -1) for x in langs.to_pylist()], np.int64)

    def read(self, texts: pa.Array, own: np.ndarray) -> list[pa.Array]:
        """Of each text: its pieces, those held, their sums by language, and the pieces not held.

        A piece is known in a language if other texts have it there: own is the language a text was learned in (-1: none).
        """
        text, piece, n, names = _pieces(texts)
        find = self.tables[0].get
        row = np.fromiter((find(x, -1) for x in names), np.int64, len(names))[piece]
        held = row >= 0
        low, size = self.starts[row[held]], self.starts[row[held] + 1] - self.starts[row[held]]
        flat = _spread(low, size)
        who, times, lang = np.repeat(text[held], size), np.repeat(n[held], size), self.owners[flat]
        known = np.where(self.counts[flat] > np.where(lang == own[who], times, 0), times, 0)
        cell, sums = _sums(who * len(self.langs) + lang, len(texts) * len(self.langs), times * self.weights[0][flat], known)
        count = lambda of, by: pa.array(np.bincount(of, by, len(texts)).astype(np.int64))
        found = _lists(cell // len(self.langs), len(texts), lang=(cell % len(self.langs)).astype(np.int32), delta=sums[0], known=sums[1])
        rest = _lists(text[~held], len(texts), piece=pa.array(names, pa.string()).take(pa.array(piece[~held])), n=n[~held])
        return [count(text, n), count(text[held], n[held]), found, rest]

    def verdicts(self, n_pieces: pa.Array, n_held: pa.Array, *found: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, pieces known in it) of each text from its sums by language; a language under 0 is the number of pieces read as words (-1) or n-grams (-1 - n)."""
        out: list[str] = []
        scores, knowns = np.zeros(len(n_pieces)), np.zeros(len(n_pieces), np.int64)
        some = n_pieces.to_numpy(zero_copy_only=False) > 0
        step = max(1, CELLS // len(self.langs))
        for a in range(0, len(n_pieces), step):
            b = min(a + step, len(n_pieces))
            level = np.zeros((b - a, LONGEST + 1), np.int64)
            level[:, 0] = n_held.to_numpy(zero_copy_only=False)[a:b]
            delta, known = np.zeros((2, b - a, len(self.langs)), np.int64)
            for lists in (f.slice(a, b - a) for f in found):
                who = np.repeat(np.arange(b - a), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                lang, d, k = (x.to_numpy(zero_copy_only=False) for x in pc.list_flatten(lists).flatten())
                of = lang >= 0
                np.add.at(level, (who[~of], -1 - lang[~of]), d[~of])
                np.add.at(delta, (who[of], lang[of]), d[of])
                np.add.at(known, (who[of], lang[of]), k[of])
            total = level @ self.base + delta
            best = total.argmax(axis=1)
            knowns[a:b] = known[np.arange(b - a), best]
            scores[a:b] = np.where(some[a:b], 1 / np.exp((total - total.max(axis=1, keepdims=True)) / UNIT).sum(axis=1), 0.0)
            out += [self.langs[x] if s else UNKNOWN for x, s in zip(best.tolist(), some[a:b].tolist())]
        return out, scores, knowns

    def judge(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text by the words held alone."""
        n_pieces, n_held, found, _ = self.read(texts, np.full(len(texts), -1))
        return self.verdicts(n_pieces, n_held, found)[:2]


def _counted(docs: DataFrame) -> DataFrame:
    """lang, gram, n of docs(lang, text); each language also has the gram ''."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for rows in slices(batch, "text", SLICE):
                lang = rows.column("lang").dictionary_encode()
                text, code, first, n_pieces, pieces, names = _split(rows.column("text"))
                own, n_words, n_names = len(lang.dictionary), len(n_pieces), max(len(names), 1)
                cell, (n,) = _sums(lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[text] * n_words + code, own * n_words, np.ones(len(code)))
                size = n_pieces[cell % n_words]
                cell, (n,) = _sums(np.repeat(cell // n_words, size) * n_names + pieces[_spread(first[cell % n_words], size)], own * n_names, np.repeat(n, size))
                langs = pa.concat_arrays([lang.dictionary, lang.dictionary.take(pa.array(cell // n_names))])
                grams = pa.concat_arrays([pa.array([""] * own, pa.string()), pa.array(names, pa.string()).take(pa.array(cell % n_names))])
                yield pa.RecordBatch.from_arrays([langs, grams, pa.array(np.concatenate((np.zeros(own, np.int64), n)))], names=["lang", "gram", "n"])

    return docs.select(F.col("lang"), F.col("text")).transform(in_arrow, run, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _gram_counts(words: DataFrame) -> DataFrame:
    """size, gram, entries of the n-grams of words(gram, entries), a word as often as it occurs."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            names, entries = batch.column("gram").to_pylist(), batch.column("entries")
            n_own = pc.list_value_length(entries).to_numpy(zero_copy_only=False)
            lang, n = (x.to_numpy(zero_copy_only=False) for x in pc.list_flatten(entries).flatten())
            for size, of, gram, distinct in _grams(names, range(1, LONGEST + 1)):
                flat = _spread((np.cumsum(n_own) - n_own)[of], n_own[of])
                cell, (total,) = _sums(lang[flat].astype(np.int64) * len(distinct) + np.repeat(gram, n_own[of]), (int(lang.max(initial=-1)) + 1) * len(distinct), n[flat])
                arrays = [pa.array(np.full(len(cell), size, np.int32)), distinct.take(pa.array(cell % len(distinct))), pa.array((cell // len(distinct)).astype(np.int32)), pa.array(total)]
                yield pa.RecordBatch.from_arrays(arrays, names=["size", "gram", "lang", "n"])

    dealt = words.select("gram", "entries").repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = dealt.transform(in_arrow, run, "size int, gram string, lang int, n bigint").groupBy("size", "gram", "lang").agg(F.sum("n").alias("n"))
    return counts.groupBy("size", "gram").agg(F.collect_list(F.struct("lang", "n")).alias("entries"))


def _hold(model: Model, words: DataFrame) -> None:
    """The model holds these words(gram, entries)."""
    pairs = words.select("gram", F.explode("entries").alias("e")).select("gram", "e.lang", "e.n").toArrow()
    pairs = pairs.take(pc.sort_indices(pairs, [("gram", "ascending"), ("lang", "ascending")]))
    gram, lang, n = (pairs.column(x).combine_chunks() for x in ("gram", "lang", "n"))
    model.hold(gram, lang.to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of all documents whose crc32(doc_id as text) mod 4 isn't 2; every label is learned, and every word."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    pairs = staged(_counted(own.where(learned(F.col("doc_id"), F.col("text"), F.col("lang")))), "op4_pairs")
    langs = sorted((r[0] for r in pairs.where("gram = ''").select("lang").collect()), key=lambda x: x.encode())
    if not langs:
        return Model([], {}, {})
    numbers = docs.sparkSession.createDataFrame(list(enumerate(langs)), "number int, lang string")
    numbered = pairs.where("gram <> ''").join(F.broadcast(numbers), "lang").groupBy("gram").agg(F.array_sort(F.collect_list(F.struct(F.col("number").alias("lang"), "n"))).alias("entries"), F.sum("n").alias("n"))
    words = staged(numbered, "op4_words")
    grams = staged(_gram_counts(words), "op4_grams")
    released(pairs)
    bits = F.length(F.bin("n"))
    least, held = 65, 0
    for b, n in sorted(words.groupBy(bits.alias("bits")).agg(F.sum(F.size("entries"))).collect(), reverse=True):
        if (held := held + n) > HELD_PAIRS:
            break
        least = b
    every = words.select(F.lit(0).alias("size"), "gram", "entries").unionByName(grams)
    marked = F.concat("entries", F.array(F.struct(F.lit(-1).alias("lang"), F.lit(1).cast("long").alias("n"))))
    sums = [tuple(r) for r in every.select("size", F.explode(marked).alias("e")).groupBy("size", "e.lang").agg(F.sum("e.n")).collect()]
    model = Model(langs, {}, {(size, langs[lang]): n for size, lang, n in sums if lang >= 0}, {size: n for size, lang, n in sums if lang < 0})
    _hold(model, words.where(bits >= least))
    trim()
    model.words, model.grams = words, grams
    return model


def _met(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame | None = None) -> DataFrame:
    """left (stored) joined with right by keys; keys that HOT rows of left have, or more, are broadcast. counts: keys and their number in left (`count`)."""
    often = F.broadcast((counts or left.groupBy(*keys).count()).where(F.col("count") >= HOT).select(*keys))
    hot = left.join(F.broadcast(right.join(often, keys)), keys)
    return hot.unionByName(left.join(often, keys, "left_anti").join(right, keys))


def _weight(n: Column) -> Column:
    return F.rint(F.log1p(n / SMOOTH) * UNIT).cast("long")


def _read_as(size: Column) -> Column:
    """An entry that counts a piece as a word (0) or as n-grams."""
    return F.array(F.struct((-1 - size).cast("int").alias("lang"), F.lit(1).cast("long").alias("delta"), F.lit(0).cast("long").alias("n"))).cast(_ENTRIES)


def _entries(pieces: DataFrame, model: Model) -> DataFrame:
    """piece, entries of pieces(piece, stored): counts and weights of a word, or the mean weights of the n-grams of the greatest size of which some are known."""
    words = model.words.select(F.col("gram").alias("piece"), "entries")
    as_word = F.transform("entries", lambda e: F.struct(e["lang"].alias("lang"), _weight(e["n"]).alias("delta"), e["n"].alias("n"))).cast(_ENTRIES)
    out = pieces.select("piece").join(words, "piece").select("piece", F.concat(as_word, _read_as(F.lit(0))).alias("entries"))
    left = pieces.select("piece").join(words, "piece", "left_anti")
    for sizes in (range(LONGEST, LONGEST + 1), range(1, LONGEST)):

        def run(batches: Iterator[pa.RecordBatch], sizes=sizes):
            for batch in batches:
                for rows in slices(batch, "piece", SLICE >> 4):
                    for size, of, gram, distinct in _grams(rows.column("piece").to_pylist(), sizes):
                        yield pa.RecordBatch.from_arrays([rows.column("piece").take(pa.array(of)), pa.array(np.full(len(of), size, np.int32)), distinct.take(pa.array(gram))], names=["piece", "size", "gram"])

        cut = staged(left.transform(in_arrow, run, "piece string, size int, gram string"), "op4_cut")
        met = _met(cut, model.grams, ["size", "gram"]).select("piece", "size", F.explode(F.concat(F.transform("entries", lambda e: F.struct(e["lang"].alias("lang"), _weight(e["n"]).alias("delta"))), F.array(F.struct(F.lit(-1).alias("lang"), F.lit(1).cast("long").alias("delta"))))).alias("e"))
        sums = met.groupBy("piece", "size", F.col("e.lang").alias("lang")).agg(F.sum("e.delta").alias("delta")).groupBy("piece", "size").agg(F.collect_list(F.struct("lang", "delta")).alias("sums"))
        best = sums.groupBy("piece").agg(F.max("size").alias("size"), F.max_by("sums", "size").alias("sums"))
        n_known = F.filter("sums", lambda s: s["lang"] < 0)[0]["delta"]
        mean = F.transform(F.filter("sums", lambda s: s["lang"] >= 0), lambda s: F.struct(s["lang"].alias("lang"), F.floor(s["delta"] / F.col("n_known")).alias("delta"), F.lit(0).cast("long").alias("n"))).cast(_ENTRIES)
        scored = staged(best.withColumn("n_known", n_known).select("piece", F.concat(mean, _read_as(F.col("size"))).alias("entries")), "op4_scored")
        released(cut)
        out, left = out.unionByName(scored), left.join(scored, "piece", "left_anti")
    return staged(out, "op4_entries")


def identify(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None, own_col: str | None = None, counted: bool = False) -> DataFrame:
    """The columns carry of docs (all) with lang_pred and score (the language's share of the likelihood, 0 to 1); if counted,
    also n_pieces (runs of letters) and n_known (those of them that the language knows from other texts than this one, if
    own_col names the language it was learned in).

    Null text or no letter: `und`, 0. Ties go to the smaller language code. Without a model every text
    is `und`. Empty table: no rows. docs must not have columns of these names.
    """
    carry = carry or docs.columns
    named = ["lang_pred", "score"] + ["n_pieces", "n_known"] * counted
    if not model.langs:
        return docs.select(*carry, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), *[F.lit(0).cast("long").alias(x) for x in named[2:]])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = (F.col(own_col) if own_col else F.lit(None)).cast("string").alias("own")
    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), F.struct(*carry).alias("row"), F.col(text_col).cast("string").alias("text"), own)
    row_type = rows.schema["row"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                learned_in = shared.value.number(part.column("own"))
                made = shared.value.read(part.column("text"), learned_in)
                yield pa.RecordBatch.from_arrays([part.column("row_key"), part.column("row"), pa.array(learned_in.astype(np.int32)), *made], names=["row_key", "row", "own", "n_pieces", "n_held", "found", "rest"])

    sums = "array<struct<lang:int,delta:bigint,known:bigint>>"
    texts = staged(rows.transform(in_arrow, read, f"row_key bigint, row {row_type}, own int, n_pieces bigint, n_held bigint, found {sums}, rest array<struct<piece:string,n:bigint>>"), "op4_read")
    rest = texts.select("row_key", "own", F.explode("rest").alias("x")).select("row_key", "own", "x.piece", "x.n")
    pieces = staged(rest.groupBy("piece").count(), "op4_pieces")
    e, n = F.col("e"), F.col("n")
    known = F.when(e["n"] > F.when(e["lang"] == F.col("own"), n).otherwise(0), n).otherwise(0)
    met = _met(rest, _entries(pieces, model), ["piece"], pieces).select("row_key", "own", "n", F.explode("entries").alias("e"))
    by_lang = met.groupBy("row_key", e["lang"].alias("lang")).agg(F.sum(n * e["delta"]).alias("delta"), F.sum(known).alias("known"))
    more = by_lang.groupBy("row_key").agg(F.collect_list(F.struct("lang", "delta", "known")).alias("more"))

    def judge(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            lang, score, n_known = shared.value.verdicts(*(batch.column(x) for x in ("n_pieces", "n_held", "found", "more")))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(lang, pa.string()), pa.array(score), batch.column("n_pieces"), pa.array(n_known)], names=["row", "lang_pred", "score", "n_pieces", "n_known"])

    judged = texts.select("row_key", "row", "n_pieces", "n_held", "found").join(more, "row_key", "left").drop("row_key")
    return judged.transform(in_arrow, judge, f"row {row_type}, lang_pred string, score double, n_pieces bigint, n_known bigint").select("row.*", *named)


def known_shares(judged: DataFrame, label_col: str) -> DataFrame:
    """lang_pred, share: the median share of known pieces, to 1 / STEPS, in all texts of judged that are judged as their label."""
    right = judged.where((F.col("lang_pred") == F.col(label_col)) & (F.col("n_pieces") > 0))
    counts = right.groupBy("lang_pred", F.floor(F.col("n_known") * STEPS / F.col("n_pieces")).alias("share")).count()
    return counts.groupBy("lang_pred").agg((F.percentile("share", F.lit(0.5), F.col("count")) / STEPS).alias("share"))


def is_typical(n: Column, known: Column, least: Column) -> Column:
    """Whether the share of known pieces is least or more, but for what chance explains (two deviations) in a text of n pieces."""
    return known >= n * least - 2 * F.sqrt(n * least * (1 - least))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; a null doc_id is neither held out nor learned from."""
    docs = documents(spark, sf_dir)
    out = identify(docs, fit(docs), carry=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
