"""Objects in model answers: fences, balanced braces, extras."""

import pytest
from pyspark.sql import functions as F

from evidence_lake.functions import answers

TICKS = "`" * 3


@pytest.mark.parametrize(
    "text, want",
    [
        (f"a {TICKS}json\n{{\"x\": 1}}\n{TICKS} b", '{"x": 1}'),
        (f"{TICKS}JSON {{\"x\": {{\"y\": 2}}}} {TICKS}", '{"x": {"y": 2}}'),
        (f"{TICKS}\n{{1}}\n{TICKS} {TICKS}json{{2}}{TICKS}", "{2}"),  # a tagged one first
        (f"{TICKS}\n{{1}}\n{TICKS} and {{2}}", "{1}"),
        (f"{TICKS}python\nx = {{}}\n{TICKS} {{3}}", "{}"),  # no fence of an object: the first balanced
        (f"{TICKS}json\n{{\"x\": \"{TICKS} inside\"}}\n{TICKS}", f'{{"x": "{TICKS} inside"}}'),
        (f"{TICKS}json\n{{\"open\": 1}} no end", '{"open": 1}'),
        ('so {"a": "} {", "b": {"c": "\\"}"}} and {"d": 1}', '{"a": "} {", "b": {"c": "\\"}"}}'),
        ('{"a": {"b": 1}', None),
        ('{"a": "never closed }', None),
        ("} {x} {", "{x}"),
        ("none", None),
        ("", None),
        (None, None),
    ],
)
def test_candidates(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(answers.json_candidate(F.col("t")).alias("c")).first().c == want


def test_long_texts(spark):
    long = '{"reasoning": "' + 'say \\"{\\" ' * 20_000 + '", "classification": ["A"]}'
    rows = [("x " * 50_000 + long,), ("{" * 3_000 + "}" * 3_000,), ('{"a": "' + "b" * 1_000_000,)]
    got = [r.c for r in spark.createDataFrame(rows, "t string").select(answers.json_candidate(F.col("t")).alias("c")).collect()]
    assert got == [long, rows[1][0], None]


def test_extras_and_secondary_labels(spark):
    raw = 'Here: {"classification": ["A"], "secondary_labels": ["B", "C"], "extras": {"z": [1, {"k": null}], "a": "t"}, "confidence": 0.25} end'
    rows = [(raw,), ('{"classification": ["A"], "extras": 3}',), ('{"classification": ["A"]}',)]
    df = spark.createDataFrame(rows, "raw string").select(answers.decision(answers.parsed(F.col("raw")), {"A": "one", "B": "two"}, "B").alias("d"))
    first, second, third = [r.d for r in df.collect()]
    assert first.secondary_labels == ["B", "C"] and first.extras == '{"a":"t","z":[1,{"k":null}]}' and first.confidence == 0.25 and first.codes == ["A"]
    assert second.parsed_ok and second.extras is None and third.extras is None
