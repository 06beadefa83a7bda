"""Column expressions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespace of name-based ids (fixed value: RFC 4122's DNS namespace).
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def py_strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_blanks(c: Column) -> Column:
    return py_strip(F.regexp_replace(c, r"\s+", " "))


def nonblank(parts: Column) -> Column:
    """Stripped parts of an array, the empty ones dropped."""
    return F.filter(F.transform(parts, py_strip), lambda x: x != "")


def uuid5(name: Column) -> Column:
    """The name-based UUID (version 5) of a string in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def word_tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def bucket(token: Column, dims: int) -> Column:
    """A hash bucket of a token: the first 32 bits of its md5, modulo dims."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dims).cast("int")


def stem(path: Column) -> Column:
    """A file's name without folder and last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def truncate(c: Column, most: int) -> Column:
    """At most `most` characters on one line, the last three of a longer text being dots."""
    line = collapse_blanks(c)
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, most - 3)), F.lit("...")))


def title_from_key(c: Column) -> Column:
    return F.initcap(F.regexp_replace(c, "_", " "))


def overlap_score(a: Column, b: Column) -> Column:
    """Jaccard similarity of the word sets of two texts, to six digits."""
    return set_similarity(F.array_distinct(word_tokens(a)), F.array_distinct(word_tokens(b)))


def set_similarity(x: Column, y: Column) -> Column:
    """Jaccard similarity of two arrays of distinct elements, to six digits."""
    both = F.size(F.array_intersect(x, y))
    return F.round(F.coalesce(F.try_divide(both, F.size(x) + F.size(y) - both), F.lit(0.0)), 6)
