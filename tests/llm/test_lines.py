import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from evidence_lake.llm import op5_lines as o


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] <= 1


@settings(max_examples=200, deadline=None)
@given(st.text("abé", max_size=9), st.text("abé", max_size=9))
def test_neighbours_share_halves_and_variants(a, b):
    assert o.one_edit(a, b) == distance_one(a, b)
    if distance_one(a, b):
        assert set(o.variants(a).tolist()) & set(o.variants(b).tolist())


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 60), st.integers(0, 59), st.sampled_from("idr"), st.data())
def test_neighbours_share_an_end_and_a_variant_there(n, at, what, data):
    a = data.draw(st.text("ab", min_size=n, max_size=n))
    i = at % n
    b = {"i": a[:i] + "#" + a[i:], "d": a[:i] + a[i + 1 :], "r": a[:i] + "#" + a[i + 1 :]}[what]
    if not b:
        return
    keys, other = o.ends(a), o.ends(b)
    both = [(r, other.index(k)) for r, k in enumerate(keys) if k in other and min(r, other.index(k)) < 2]
    assert both
    mine, his = (set(zip(*(x.tolist() for x in o.line_variants(x, roles)))) for x, roles in ((a, [r for r, _ in both]), (b, [q for _, q in both])))
    if what == "r":
        assert mine & his
    else:
        wholes = {v for v, p in mine if p < 0} & {v for v, p in his if p >= 0} | {v for v, p in his if p < 0} & {v for v, p in mine if p >= 0}
        assert wholes


def edit(rng, line, times):
    for _ in range(times):
        i = rng.randrange(len(line))
        line = rng.choice([line[:i] + "#" + line[i:], line[:i] + line[i + 1 :], line[:i] + "é" + line[i + 1 :]])
    return line


def corpus():
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(n)) + "." for n in [19, 24, 40] * 13 + list(range(1, 20)) * 2]
    rows = [(None, None), (3, ""), (3, "\n\n"), (8, " \t" + base[0] + " ")]
    for i in range(80):
        rows.append((rng.randrange(40) if i % 9 else None, "\n".join(edit(rng, rng.choice(base), rng.randrange(3)) for _ in range(rng.randrange(1, 5)))))
    rows += [(100 + i, f"the page with the number {i % 10}{i}") for i in range(30)]
    return rows


@pytest.mark.parametrize("least", [1, 20])
def test_against_brute_force(spark, tmp_path, least):
    df = spark.createDataFrame([(d, t, 5, "x") for d, t in corpus()], "doc_id long, text string, line int, digest string").repartition(3)
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    from pyspark.sql import functions as F

    rows = df.select(F.monotonically_increasing_id().alias("k"), "doc_id", "text").collect()
    got = {r.row_key: (r.doc_id, r.dropped) for r in o.dropped_lines(df, least_repeat=least, least_edited=least).collect()}
    lines = sorted((((r.doc_id is None, r.doc_id or 0, r.k), i, x.strip(o._BLANK)) for r in rows for i, x in enumerate((r.text or "").split("\n"))), key=lambda z: z[:2])
    lines = [x for x in lines if len(x[2]) >= least]
    want = {}
    for j, (key, i, x) in enumerate(lines):
        if any(distance_one(x, y) for _, _, y in lines[:j]):
            want.setdefault(key[2], []).append(i)
    assert {k: v[1] for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    out = o.without_lines(df, least_repeat=least, least_edited=least)
    left = {r.text for r in out.collect()}
    assert out.columns == df.columns
    assert None in left and "" in left  # rows without lines to drop stay
    n_gone = sum(1 for r in rows if r.k in want and all(i in want[r.k] or not x.strip(o._BLANK) for i, x in enumerate(r.text.split("\n"))))
    assert out.count() == len(rows) - n_gone


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "short")]])
def test_nothing_to_drop(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert o.dropped_lines(df).count() == 0
    assert o.without_lines(df).count() == len(rows)


def test_short_lines(spark, tmp_path):
    rows = [(1, "And ornd.\n\n}"), (2, " And ornd.\t\nAnd orn.\n\n"), (3, "And ornd."), (None, "}\nx"), (4, "y\nz\ny\nbut this line is a long one")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    repeats = o.dropped_lines(df, least_edited=20).collect()  # of lines this short, exact repeats only
    assert {r.doc_id: r.dropped for r in repeats} == {2: [0], 3: [0], None: [0], 4: [2]}
    want = {1: "And ornd.\n\n}", 2: "And orn.\n\n", None: "x", 4: "y\nz\nbut this line is a long one"}
    assert {r.doc_id: r.text for r in o.without_lines(df, least_edited=20).collect()} == want
    # lines of any length that are one edit away
    assert {r.doc_id: r.dropped for r in o.op5_lines(spark, str(tmp_path)).collect()} == {2: [0, 1], 3: [0], None: [0, 1], 4: [0, 1, 2]}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, df, str(tmp_path)).collect()} == {1: "And ornd.\n\n}", 4: "but this line is a long one"}
