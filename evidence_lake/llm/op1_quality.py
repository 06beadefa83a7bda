"""Quality rules by distribution divergence, in DataFrame functions only.

A document's character classes and its language's common words are histograms; the language's own,
over all its documents that pass the base rules, are the references. A document is kept when it
passes the base rules and neither Jensen-Shannon distance (base 2, 0 to 1) is too large. The base
rules' minimum length guards the histograms of short texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidence_lake.llm.common import GAP, documents, staged, words

MIN_WORDS = 50
COMMON_WORDS = 40
MOST_CHAR_DISTANCE = 0.30
MOST_WORD_DISTANCE = 0.38
#: A language needs so many documents for a reference of its own; others use that of all documents.
MIN_REFERENCE = 20
#: Reference tables up to so many rows are broadcast.
BROADCAST_LANGS = 10_000
#: With so many languages at most, their common words make one set in the expression.
SIEVE_LANGS = 200

SYMBOLS = r"[#*$%&|<>]"
#: Character classes by pattern; white space is another, and what none matches (lower case above all) is the last.
CLASSES = {
    "upper": "[A-Z]",
    "digit": "[0-9]",
    "symbol": SYMBOLS,
    "punct": r"[.,;:!?'\"()\-]",
    "wide": r"[^\x00-\x7F]",
}
BINS = [f"c_{c}" for c in [*CLASSES, "gap", "rest"]]
#: Common words are letters of any script with their marks.
COMMON = r"^\p{L}[\p{L}\p{M}]*$"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def n_matching(text: Column, pattern: str) -> Column:
    """Characters of a text in a class."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))).cast("long")


#: Places of windows take so many low bits of the sorted keys; longer texts have structs as keys.
PLACE_BITS = 20


def n_repeat_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more: equal windows become neighbours in an order by hash."""

    def covered(places: Column) -> Column:
        nexts = F.concat(F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))), F.array(F.lit(1 << 30)))
        spans = F.when(F.size(places) == 0, F.array().cast("array<int>")).otherwise(F.zip_with(places, nexts, lambda a, b: F.least(b - a, F.lit(3))))
        return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x)

    def flagged(s: Column, same, place) -> Column:
        """Places of the sorted windows that equal a neighbour, ascending."""
        before = lambda i: F.try_element_at(s, F.when(i > 0, i).otherwise(-1))
        near = lambda t, i: same(F.try_element_at(s, i + 2), t) | ((i > 0) & same(before(i), t))
        return F.sort_array(F.transform(F.filter(s, near), place))

    def of_hashes(h: Column) -> Column:
        mask = (1 << PLACE_BITS) - 1
        place = lambda t: t.bitwiseAND(F.lit(mask).cast("long")).cast("int")
        same = lambda a, b: (F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS)) & (h[place(a)] == h[place(b)])
        short = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, PLACE_BITS).bitwiseOR(i.cast("long"))))
        long = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        by_key = let(short, lambda s: flagged(s, same, place))
        by_struct = let(long, lambda s: flagged(s, lambda a, b: a["h"] == b["h"], lambda t: t["i"]))
        return F.when(F.size(h) <= mask, by_key).otherwise(by_struct)

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(let(hashes, of_hashes), covered))


def common_counts(w: Column, ref: Column, any_ref: list[str] | None) -> Column:
    """Of each reference word that occurs (in any case): its count. any_ref: all groups' words, a hashed first sieve."""
    low = F.transform(w, F.lower)
    found = F.filter(low, lambda x: x.isin(any_ref)) if any_ref is not None else low
    return let(found, lambda f: F.map_from_entries(F.transform(F.array_intersect(f, ref), lambda c: F.struct(c.alias("word"), (F.size(f) - F.size(F.array_remove(f, c))).alias("n")))))


def features(docs: DataFrame, any_ref: list[str] | None) -> DataFrame:
    """Base counts, class counts and common-word counts of rows (doc_id, text, lang_group, common)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    ref = F.coalesce(F.col("common"), F.array().cast("array<string>"))
    by_words = let(
        words(F.col("text")),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("word_chars"),
            n_repeat_words(w).alias("n_repeat_words"),
            common_counts(w, ref, any_ref).alias("common_n"),
        ),
    )
    return docs.select(
        "doc_id",
        "lang_group",
        by_words.alias("w"),
        F.length(text).cast("long").alias("n_chars"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        *[n_matching(text, p).alias(f"c_{c}") for c, p in CLASSES.items()],
    ).select("doc_id", "lang_group", "w.*", "n_chars", "n_dup_lines", *[f"c_{c}" for c in CLASSES])


def js_distance(parts: Column) -> Column:
    """Distance of the histograms p and q in parts, an array of struct(p, q)."""

    def term(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def both(s: Column, b: Column) -> Column:
        m = (b["p"] + b["q"]) / 2
        return s + term(b["p"], m) + term(b["q"], m)

    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), both) / 2, F.lit(0.0)))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance.

    Null or empty text: zeros, base_failed. Documents of a null lang, or of one with fewer than
    MIN_REFERENCE documents, are a group of their own. A group of which no document passes the base
    rules has no reference and null distances, and its documents fail anyway. Repeated rows are rows
    of their own. Empty table: no rows. Extra columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = own.groupBy("lang").count().where(f"lang IS NOT NULL AND count >= {MIN_REFERENCE}").select("lang", F.concat(F.lit("="), "lang").alias("known"))
    n_known = known.count()
    small = n_known <= BROADCAST_LANGS
    hint = F.broadcast if small else (lambda df: df)
    group = F.coalesce("known", F.lit("*")).alias("lang_group")

    # scan one: the words that most documents of each group have, over the whole corpus
    low_words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), GAP))
    # outer, as else Spark computes the words once more to see whether there are any
    token = F.explode_outer(F.filter(low_words, lambda w: w.rlike(COMMON)))
    counts = own.select("lang", token.alias("word")).where("word IS NOT NULL").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(hint(known), "lang", "left").groupBy(group, "word").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang_group").orderBy(F.desc("n"), F.asc("word")))
    top = counts.withColumn("place", place).where(F.col("place") <= COMMON_WORDS)
    top = staged(top.select("lang_group", "word"), "common-words")
    any_ref = [r[0] for r in top.select("word").distinct().collect()] if n_known <= SIEVE_LANGS else None
    common = top.groupBy("lang_group").agg(F.sort_array(F.collect_list("word")).alias("common"))

    # scan two: every document's counts, as a narrow table
    grouped = own.join(hint(known), "lang", "left").select("doc_id", "text", group).join(hint(common), "lang_group", "left")
    base = features(grouped, any_ref).select(
        "*",
        (F.col("n_chars") - F.col("word_chars")).alias("c_gap"),
        (F.col("word_chars") - sum(F.col(f"c_{c}") for c in CLASSES)).alias("c_rest"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )
    return verdicts(staged(base, "quality-counts"), hint)


def verdicts(base: DataFrame, hint) -> DataFrame:
    """Distances to the groups' references, and the verdict."""
    bins = BINS
    good = base.where("NOT base_failed")
    chars = good.groupBy("lang_group").agg(F.sum("n_chars").alias("all_chars"), F.sum("n_words").alias("all_words"), *[F.sum(b).alias(b) for b in bins])
    chars = chars.select("lang_group", "all_words", F.array(*[F.col(b) / F.col("all_chars") for b in bins]).alias("q_chars"))
    per_word = good.select("lang_group", F.explode("common_n").alias("word", "n")).groupBy("lang_group", "word").agg(F.sum("n").alias("n"))
    per_word = per_word.groupBy("lang_group").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("ref_n"))  # COMMON_WORDS at most
    refs = chars.join(per_word, "lang_group", "left").select(
        F.col("lang_group").alias("g"),
        "q_chars",
        F.coalesce(F.transform("ref_n", lambda x: F.struct(x["word"].alias("word"), (x["n"] / F.col("all_words")).alias("q"))), F.expr("cast(array() as array<struct<word:string,q:double>>)")).alias("q_words"),
    )
    p = F.array(*[F.col(b) / F.col("n_chars") for b in bins])
    by_char = js_distance(F.zip_with(p, F.col("q_chars"), lambda a, b: F.struct(a.alias("p"), b.alias("q"))))
    named = F.transform("q_words", lambda x: F.struct((F.coalesce(F.try_element_at("common_n", x["word"]), F.lit(0)) / F.col("n_words")).alias("p"), x["q"].alias("q")))
    def with_rest(n: Column) -> Column:
        left = lambda side: F.greatest(F.lit(1.0) - F.aggregate(n, F.lit(0.0), lambda s, x: s + x[side]), F.lit(0.0))
        return F.concat(n, F.array(F.struct(left("p").alias("p"), left("q").alias("q"))))

    by_word = let(let(named, with_rest), js_distance)
    some = F.col("n_words") > 0
    out = base.join(hint(refs), base["lang_group"] == refs["g"], "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        F.col("c_symbol").alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.when(some, F.round(by_char, 6)).alias("char_distance"),
        F.when(some, F.round(by_word, 6)).alias("word_distance"),
    )
    kept = ~F.col("base_failed") & F.coalesce((F.col("char_distance") <= MOST_CHAR_DISTANCE) & (F.col("word_distance") <= MOST_WORD_DISTANCE), F.lit(False))
    return out.withColumn("kept", kept)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


def _sql() -> str:
    classes = ",\n    ".join(f"length(t) - length(regexp_replace(t, '{p.replace(chr(39), chr(39) * 2)}+', '', 'g')) AS c_{c}" for c, p in CLASSES.items() if c != "wide")
    wide = "length(t) - length(regexp_replace(t, '[^\\x00-\\x7F]+', '', 'g')) AS c_wide"
    bins = BINS
    term = "CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
    js = lambda p, q: f"{term.format(x=p, p=p, q=q)} + {term.format(x=q, p=p, q=q)}"
    char_js = " + ".join(js(f"(b.{b} / b.n_chars)", f"(r.{b} / r.all_chars)") for b in bins)
    return f"""
WITH own AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, lang FROM documents
), known AS (
  SELECT lang, '=' || lang AS known FROM own WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= {MIN_REFERENCE}
), g AS (
  SELECT own.*, coalesce(known, '*') AS lang_group,
    list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM own LEFT JOIN known USING (lang)
), tok AS (
  SELECT rid, lang_group, unnest(list_transform(w, lambda x: lower(x))) AS word FROM g
), cnt AS (
  SELECT lang_group, word, count(DISTINCT rid) AS n FROM tok WHERE regexp_matches(word, '{COMMON}') GROUP BY ALL
), common AS (
  SELECT lang_group, word FROM cnt QUALIFY row_number() OVER (PARTITION BY lang_group ORDER BY n DESC, word) <= {COMMON_WORDS}
), win AS (
  SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM g WHERE len(w) > 2)
), rep AS (
  SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1
), cover AS (
  SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY rid
), base AS (
  SELECT g.rid, doc_id, lang_group, len(w) AS n_words, length(t) AS n_chars, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    {classes}, {wide}, length(t) - length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS c_gap
  FROM g LEFT JOIN cover USING (rid)
), full_base AS (
  SELECT *, n_chars - c_gap - ({" + ".join(f"c_{c}" for c in CLASSES)}) AS c_rest,
    (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed
  FROM base
), refs AS (
  SELECT lang_group, sum(n_chars) AS all_chars, sum(n_words) AS all_words, {", ".join(f"sum({b}) AS {b}" for b in bins)}
  FROM full_base WHERE NOT base_failed GROUP BY lang_group
), doc_common AS (
  SELECT tok.rid, tok.lang_group, tok.word, count(*) AS n FROM tok JOIN common ON tok.lang_group = common.lang_group AND tok.word = common.word GROUP BY ALL
), ref_words AS (
  SELECT d.lang_group, d.word, sum(d.n) / any_value(r.all_words) AS q
  FROM doc_common d JOIN full_base b USING (rid) JOIN refs r ON r.lang_group = d.lang_group WHERE NOT b.base_failed GROUP BY ALL
), pq AS (
  SELECT b.rid, coalesce(d.n, 0) / b.n_words AS p, q.q AS q
  FROM full_base b JOIN ref_words q ON q.lang_group = b.lang_group LEFT JOIN doc_common d ON d.rid = b.rid AND d.word = q.word WHERE b.n_words > 0
), pq_all AS (
  SELECT rid, p, q FROM pq UNION ALL SELECT rid, greatest(1 - sum(p), 0), greatest(1 - sum(q), 0) FROM pq GROUP BY rid
), word_js AS (
  SELECT rid, round(sqrt(greatest(sum({js("p", "q")}) / 2, 0)), 6) AS word_distance FROM pq_all GROUP BY rid
), dist AS (
  SELECT b.*, CASE WHEN b.n_words > 0 THEN round(sqrt(greatest(({char_js}) / 2, 0)), 6) END AS char_distance, word_distance
  FROM full_base b LEFT JOIN refs r USING (lang_group) LEFT JOIN word_js USING (rid)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_chars - c_gap AS BIGINT) AS word_chars, CAST(c_symbol AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, char_distance, word_distance,
  NOT base_failed AND coalesce(char_distance <= {MOST_CHAR_DISTANCE} AND word_distance <= {MOST_WORD_DISTANCE}, false) AS kept
FROM dist
"""


OP1_SQL = _sql()
