"""Label codes of the built-in classifiers and the rules that bring answers into canonical form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes and labels of the built-in tasks.
ACCESS_LABELS = {"A": "OPEN", "B": "REPORTED", "C": "REFERENCED", "D": "AVAILABLE_UPON_REQUEST", "E": "CLOSED", "F": "NOT_STATED"}
REGION_LABELS = {"A": "Africa", "B": "Asia", "C": "Europe", "D": "North America", "E": "South America", "F": "Oceania", "G": "IRRELEVANT", "H": "UNCLEAR / Not specified"}
TYPE_LABELS = {"A": "Traditional", "B": "Non-Traditional Health", "C": "Non-Traditional Mobility", "D": "Non-Traditional Sentiment", "E": "Non-Traditional Economic", "F": "Synthetic", "G": "No Empirical Data", "H": "Unclear / Not specified"}


def lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def known_codes(codes: Column, table: dict[str, str], default: str | None) -> Column:
    """Codes of the table in the given order; none: the default."""
    kept = F.filter(codes, lambda c: c.isin(list(table)))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(default))) if default is not None else kept


def labels_of(codes: Column, table: dict[str, str]) -> Column:
    return F.transform(codes, lambda c: F.try_element_at(lookup(table), c))


def canonical(codes: Column, order: str) -> Column:
    """Distinct codes in the order of the letters."""
    return F.filter(F.array(*[F.lit(c) for c in order]), lambda c: F.array_contains(codes, c))


def dominated(codes: Column, over: str, unclear: str) -> Column:
    """`over` absorbs all others; `unclear` stays only alone, and stands for nothing."""
    kept = F.filter(codes, lambda c: c != unclear)
    return F.when(F.array_contains(codes, over), F.array(F.lit(over))).when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(unclear)))


def primary_of(codes: Column, primary: Column) -> Column:
    """A primary label that isn't among the codes goes; a single code becomes it."""
    valid = F.when(F.array_contains(codes, primary), primary)
    return F.coalesce(valid, F.when(F.size(codes) == 1, codes[0]))


def access_codes(codes: Column) -> Column:
    return canonical(codes, "ABCDEF")


def region_codes(codes: Column) -> Column:
    return dominated(canonical(codes, "ABCDEFGH"), "G", "H")


type_codes = region_codes


def secondary_labels(primary: Column, secondary: Column, other: str = "OTHER", unclear: str = "UNCLEAR") -> Column:
    """Distinct secondary labels without the primary one and the two catch-alls; none beside a catch-all."""
    none = F.array().cast("array<string>")
    rest = F.array_except(F.array_distinct(secondary), F.array(primary, F.lit(unclear), F.lit(other)))
    return F.when(primary.isin(other, unclear), none).otherwise(rest)


def clean_names(names: Column) -> Column:
    """Names with single blanks, blank ones dropped, each once."""
    return F.array_distinct(F.filter(F.transform(names, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""))
