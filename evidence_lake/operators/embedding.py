"""Embedders. The shipped ones are deterministic expressions; models plug in as vectorised functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidence_lake.functions.text import bucket, word_tokens
from evidence_lake.functions.vectors import let, unit

Embedder = Callable[[Column], Column]


#: Characters that stand for buckets follow this one.
_FIRST_CHAR = ord("!")


def hashed(dims: int = 32) -> Embedder:
    """Counts of hashed tokens, of unit length; without tokens the zero vector."""

    def embed(text: Column) -> Column:
        def counts(drawn: Column) -> Column:
            # a character for each token's bucket; each count is the length that goes without its character
            return F.array(*[(F.length(drawn) - F.length(F.replace(drawn, F.lit(chr(_FIRST_CHAR + i)), F.lit("")))).cast("double") for i in range(dims)])

        alphabet = F.lit("".join(chr(_FIRST_CHAR + i) for i in range(dims)))
        return unit(let(F.array_join(F.transform(word_tokens(text), lambda t: F.substring(alphabet, bucket(t, dims) + 1, F.lit(1))), ""), counts))

    return embed


def keywords(vocabulary: list[str]) -> Embedder:
    """One dimension a term: its occurrences as a word, plural included; of unit length."""

    def embed(text: Column) -> Column:
        low = F.lower(text)
        return unit(F.array(*[F.regexp_count(low, F.lit(rf"(?<![\p{{L}}\p{{N}}_]){t}s?(?![\p{{L}}\p{{N}}_])")).cast("double") for t in vocabulary]))

    return embed


def sparse_terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, weight: log(1 + occurrences) of each token.

    A key's texts are counted as one row (its tokens in order, runs of equal ones), so no task holds a table of its terms.
    """
    texts = df.where(F.col(text).isNotNull()).repartition(key).groupBy(key).agg(F.array_join(F.collect_list(text), "\n").alias("_text"))  # mostly one a key

    def counted(tokens: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.size(tokens)), lambda i: (i == 1) | (F.get(tokens, i - 1) != F.get(tokens, i - 2)))
        runs = lambda at: F.transform(at, lambda i, j: F.struct(F.get(tokens, i - 1).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(tokens) + 1) - i).alias("n")))
        return F.when(F.size(tokens) > 0, let(begins, runs))

    terms = texts.select(key, F.explode(let(F.array_sort(word_tokens(F.col("_text"))), counted)).alias("t"))
    return terms.select(key, "t.term", F.round(F.log1p(F.col("t.n").cast("long")), 6).alias("weight"))


def late_tokens(dims: int = 8) -> Embedder:
    """One unit vector for each distinct token of the whole text: the token's bucket set to one."""

    def embed(text: Column) -> Column:
        def one(b: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (b == i).cast("double"))

        return F.transform(F.array_distinct(word_tokens(text)), lambda t: let(bucket(t, dims), one))

    return embed


def model_udf(load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 32):
    """A vectorised function for a real model: loaded once a worker, texts encoded in batches."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = load()
        for s in texts:
            got: list = []
            for i in range(0, len(s), batch):
                got += list(run([x or "" for x in s.iloc[i : i + batch]]))
            yield pd.Series(got, index=s.index)

    return encode


def resolve_provider(name: str | None, provider: str | None = None, default: str = "hashed") -> str:
    """The embedder family for a model name; names that could mean several raise."""
    if provider:
        return provider.lower()
    if not name:
        return default
    low = name.lower()
    hits = {p for p, marks in {"gemini": ("gemini", "embedding-001"), "openai": ("text-embedding-",), "ollama": ("nomic", "mxbai"), "local": ("bge", "minilm", "specter", "scibert", "splade", "colbert"), "hashed": ("hash",)}.items() if any(m in low for m in marks)}
    if len(hits) != 1:
        raise ValueError(f"can't tell the provider of {name!r}; name it")
    return hits.pop()
