"""Matching titles to a reference table: a similarity join of token sets with prefix filters.

The likeness of two titles is 1 if one's tokens are all in the other's, else the Dice coefficient of the token
sets. A title that holds all of a reference, or has a Dice coefficient of at least `least` with it, has one of so many
of the reference's rarest tokens; a title that a reference holds has its longest token there, too. So only
pairs that meet in such a token are compared, where they meet, and no pair that qualifies is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_lake.functions.text import word_tokens
from evidence_lake.session import stored

#: Postings of references of at most so many bytes are broadcast.
BROADCAST_BYTES = 32 << 20


def likeness(x: Column, y: Column) -> Column:
    """Of two arrays of distinct tokens, neither empty; six digits."""
    both = F.size(F.array_intersect(x, y))
    return F.when(both == F.least(F.size(x), F.size(y)), 1.0).otherwise(F.round(2.0 * both / (F.size(x) + F.size(y)), 6))


def _sets(df: DataFrame, title: str) -> DataFrame:
    return df.withColumn("tokens", F.array_sort(F.array_distinct(F.coalesce(word_tokens(F.col(title)), F.array().cast("array<string>"))))).where(F.size("tokens") > 0)


def _posted(refs: DataFrame, own: DataFrame, share: float) -> DataFrame:
    """meet, doi, y: the references under their rarest tokens (a), as many as a likeness may do without and one more, and under all tokens (b)."""
    each = refs.select("ref", F.explode("tokens").alias("token"))
    asked = own.select(F.explode("tokens").alias("token")).join(each.select("token").distinct(), "token", "left_semi")
    counts = asked.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    by_rarity = each.join(counts, "token", "left").groupBy("ref").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("rare"))  # a reference's tokens
    size = F.size("rare")
    first = F.slice(F.col("rare.token"), F.lit(1), (size - F.ceil(size * share - 1e-9) + 1).cast("int"))
    keyed = by_rarity.select("ref", F.explode(F.concat(_keys("a", first), _keys("b", F.col("rare.token")))).alias("meet"))
    return keyed.join(refs, "ref").select("meet", "ref", "doi", F.col("tokens").alias("y"))


def _keys(kind: str, tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.concat(F.lit(kind), t))


def matched(titles: DataFrame, references: DataFrame, least: float = 0.9, title_id: str = "title_id", name: str = "title") -> DataFrame:
    """title_id, doi, score: for each title (title_id, title) the reference (doi, title) of the greatest likeness, if it is at least `least`; ties to the smaller doi.

    Titles that are null or without tokens match nothing. Postings of references of at most `BROADCAST_BYTES` go
    to the titles, which stay where they are; with more, only keys of titles and references meet by token.
    """
    own = _sets(titles.select(title_id, name), name).select(title_id, F.col("tokens")).withColumn("row_key", F.monotonically_increasing_id())
    known = _sets(references.select("doi", name), name).where(F.col("doi").isNotNull())
    refs = stored(known.groupBy("tokens").agg(F.min("doi").alias("doi")).withColumn("ref", F.monotonically_increasing_id()), "references")
    share = least / (2 - least)  # of a reference's tokens that a likeness of `least` needs in common, at any length of the title
    posted = stored(_posted(refs, own, share), "postings")
    large = (posted.agg(F.sum(F.length("meet") + F.length(F.array_join("y", " ")) + 16)).first()[0] or 0) > BROADCAST_BYTES
    own = stored(own, "titles") if large else own  # keys have to stay
    longest = F.array_max(F.transform("tokens", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    meets = F.explode(F.concat(_keys("a", F.col("tokens")), F.array(F.concat(F.lit("b"), longest)))).alias("meet")
    fits = F.when(F.col("meet").startswith("a"), F.col("size") >= F.col("y_size") * share - 1e-9).otherwise(F.col("size") <= F.col("y_size"))
    sized = posted.withColumn("y_size", F.size("y"))
    if large:
        keys = own.select("row_key", F.size("tokens").alias("size"), meets).join(sized.select("meet", "ref", "y_size"), "meet").where(fits).select("row_key", "ref").distinct()
        pairs = keys.join(refs.withColumnRenamed("tokens", "y"), "ref").join(own, "row_key")
    else:
        pairs = own.withColumn("size", F.size("tokens")).select("*", meets).join(F.broadcast(sized), "meet").where(fits)
    score = likeness(F.col("tokens"), F.col("y"))
    best = pairs.select("row_key", title_id, "doi", score.alias("score")).where(F.col("score") >= least).groupBy("row_key", title_id).agg(F.min(F.struct((-F.col("score")).alias("s"), "doi")).alias("best"))
    return best.select(title_id, F.col("best.doi").alias("doi"), (-F.col("best.s")).alias("score"))
