"""Model answers: finding the JSON object in free text, reading it, falling back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidence_lake.functions.codes import known_codes
from evidence_lake.functions.vectors import let

ANSWER = T.StructType(
    [
        T.StructField("reasoning", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("class_probabilities", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("classification", T.ArrayType(T.StringType())),
        T.StructField("primary_label", T.StringType()),
        T.StructField("secondary_labels", T.ArrayType(T.StringType())),
    ]
)
ITEMS = "description string, items array<struct<name:string,url:string,explanation:string,raw_text:string>>"
#: A fence is a run of three backticks or more.
_FENCE = "`{3,}"
#: Pieces that make up a text: quoted strings with their escapes (the last may be open), single braces, and what lies between.
_PIECES = r"""(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"?|[{}]|[^"{}]++"""


def balanced(text: Column) -> Column:
    """The first balanced brace object, braces in strings left aside; null without one. A fold over the text's pieces with the depth so far."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("done"))

    def step(state: Column, piece: Column) -> Column:
        depth = state["depth"] + F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        return F.when(state["done"], state).otherwise(F.struct(depth.alias("depth"), (state["size"] + F.length(piece)).alias("size"), ((piece == "}") & (depth == 0)).alias("done")))

    def cut(rest: Column) -> Column:
        end = F.aggregate(F.regexp_extract_all(rest, F.lit(_PIECES), F.lit(0)), start, step)
        return let(end, lambda e: F.when(e["done"], F.substring(rest, F.lit(1), e["size"])))

    return let(text, lambda t: let(F.when(F.instr(t, "{") > 0, t.substr(F.instr(t, "{"), F.length(t))), cut))


def fenced(text: Column, tag: str = "") -> Column:
    """What stands between a fence with the tag and a later fence, from a brace to a brace; the first such, null without one.

    The text is cut at its fences: an object begins with the first part that the tag and a brace lead, and ends
    with the next part (it or a later one) that a brace ends.
    """

    def joined(parts: Column, first: Column, last: Column) -> Column:
        found = F.array_join(F.slice(parts, first, last - first + 1), "```")
        return F.when(first.isNotNull(), F.regexp_replace(F.regexp_replace(found, rf"(?i)^{tag}\s*", ""), r"\s+$", ""))

    def among(parts: Column) -> Column:
        inner = F.size(parts) - 1  # the last part has no fence after it
        at = F.when(inner >= 2, F.sequence(F.lit(2), inner)).otherwise(F.array().cast("array<int>"))
        ends = F.filter(at, lambda i: F.element_at(parts, i).rlike(r"\}\s*$"))
        begins = F.filter(at, lambda i: F.element_at(parts, i).rlike(rf"(?i)^{tag}\s*\{{"))
        first = lambda e: F.get(F.filter(begins, lambda i: i <= F.array_max(e)), F.lit(0))
        return let(ends, lambda e: let(first(e), lambda f: joined(parts, f, F.get(F.filter(e, lambda i: i >= f), F.lit(0)))))

    return let(F.split(text, _FENCE), among)


def json_candidate(text: Column) -> Column:
    """A fenced object, tagged ones first, else the first balanced one."""
    return let(text, lambda t: F.coalesce(fenced(t, "json"), fenced(t), balanced(t)))


def parsed(raw: Column) -> Column:
    """The answer: the whole text if it is one JSON object, else its candidate; null if neither holds a classification.

    extras: the object of that name as JSON text, by the key's order; null if there is none.
    """

    def read(text: Column) -> Column:
        extras = F.to_json(F.try_variant_get(F.try_parse_json(text), "$.extras", "variant"))
        return F.from_json(text, ANSWER).withField("extras", let(extras, lambda x: F.when(x.startswith("{"), x)))

    def chosen(whole: Column) -> Column:
        good = lambda a: F.when(a["classification"].isNotNull(), a)
        return F.coalesce(good(whole), let(let(json_candidate(raw), read), good))  # the scan is for the rest

    return let(read(raw), chosen)


def decision(answer: Column, table: dict[str, str], default: str, multi: bool = True) -> Column:
    """codes, confidence, probabilities, secondary_labels, extras and parsed_ok of an answer; the fallback is the default code, no confidence, a uniform distribution over label names."""
    codes = known_codes(F.coalesce(answer["classification"], F.array().cast("array<string>")), table, default)
    codes = codes if multi else F.slice(codes, 1, 1)
    uniform = F.map_from_arrays(F.array(*[F.lit(v) for v in table.values()]), F.array_repeat(F.lit(1.0 / len(table)), len(table)))
    empty = F.create_map().cast("map<string,double>")
    ok = answer.isNotNull()
    return F.struct(
        F.when(ok, codes).otherwise(F.array(F.lit(default))).alias("codes"),
        F.when(ok, F.coalesce(answer["confidence"], F.lit(0.0))).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(ok, F.coalesce(answer["class_probabilities"], empty)).otherwise(uniform).alias("probabilities"),
        answer["secondary_labels"].alias("secondary_labels"),
        answer["extras"].alias("extras"),
        ok.alias("parsed_ok"),
    )


#: Fixed value: what a mining answer that can't be read is described as.
UNREADABLE = "Parsing/validation failed"


def mined(raw: Column) -> Column:
    """description and items of a mining answer; a json fence around it is taken off, a bad answer gives no items."""
    text = F.trim(raw)
    opening = F.lower(F.substring(text, 1, 7)) == "```json"
    body = F.when(opening, F.substring(text, F.lit(8), F.length(text))).otherwise(text)
    closing = F.rtrim(body).endswith("```")
    got = F.from_json(F.when(closing, F.substring(F.rtrim(body), F.lit(1), F.length(F.rtrim(body)) - 3)).otherwise(body), ITEMS)
    bad = F.struct(F.lit(UNREADABLE).alias("description"), F.array().cast("array<struct<name:string,url:string,explanation:string,raw_text:string>>").alias("items"))
    return F.when(got["items"].isNotNull(), got).otherwise(bad)


def reward(predicted: Column, gold: Column) -> Column:
    """1 when the label sets agree, 0 when not, null without gold."""
    return F.when(gold.isNotNull(), F.when(F.array_sort(predicted) == F.array_sort(gold), 1.0).otherwise(0.0))
