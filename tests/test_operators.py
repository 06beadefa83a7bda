"""Operators and functions against plain Python."""

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from evidence_lake.functions import answers, codes, prompts, text
from evidence_lake.functions.vectors import dot, max_sim, mean, norm, unit
from evidence_lake.operators import chunking, embedding, index, rerank, retrieval, runs
from evidence_lake.sources import files, sections


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_uuid5(spark):
    for s in ("a", "", "naïve é 日本"):
        assert one(spark, text.uuid5(F.col("s")), s=s) == str(uuid.uuid5(uuid.NAMESPACE_DNS, s))


def test_text_helpers(spark):
    assert one(spark, text.py_strip(F.col("s")), s="  a b \n") == "a b"
    assert one(spark, text.stem(F.col("s")), s="/x/y.z/Paper.v2.TXT") == "Paper.v2"
    assert one(spark, text.truncate(F.col("s"), 8), s="one two three") == "one t..."
    assert one(spark, text.title_from_key(F.col("s")), s="data_type") == "Data Type"


def test_chunkers(spark):
    how = lambda c, s: one(spark, c(F.col("s")), s=s)
    assert how(chunking.none(), " a ") == [" a "]
    assert how(chunking.sentence(), "One. Two!  Three? four. ") == ["One.", "Two!", "Three?", "four."]
    assert how(chunking.fixed_size(4, 1), "abcdefgh") == ["abcd", "defg", "gh"]
    assert how(chunking.fixed_size(4, 9), "abcde") == ["abcd", "bcde", "cde", "de", "e"]
    assert how(chunking.fixed_size(4), "") == []
    assert how(chunking.recursive(5, chunking.none()), "abcdefghij") == ["abcde", "fghij"]
    assert how(chunking.paragraph(5), "a b c d e f\n \nshort\n\nsix words are in this one") == ["a b c d e f", "six words are in this one"]
    with pytest.raises(ValueError):
        chunking.fixed_size(0)
    with pytest.raises(ValueError):
        chunking.chunker("nope")


def test_semantic_chunks(spark):
    rows = [(1, i, f"s{i}", v) for i, v in enumerate([[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.1, 1.0], [1.0, 0.0]])]
    df = spark.createDataFrame(rows, "k long, o long, t string, v array<double>")
    want = ["s0 s1", "s2 s3", "s4"]
    for f in (chunking.semantic_last, chunking.semantic_mean):
        assert [r.text for r in f(df, "k", "o", "t", "v", 0.5).orderBy("chunk_ord").collect()] == want


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, dot(a, a)) == 25 and one(spark, norm(a)) == 5 and one(spark, unit(a)) == [0.6, 0.8]
    assert one(spark, unit(F.array(F.lit(0.0)))) == [0.0]
    assert one(spark, max_sim(F.array(a, a), F.array(a))) == 50
    assert one(spark, mean(F.array(a, F.array(F.lit(1.0), F.lit(0.0))), 2)) == [2.0, 2.0]


def test_embedders(spark):
    assert one(spark, embedding.keywords(["cat", "dog"])(F.col("s")), s="Cats cat DOG catdog") == pytest.approx([2 / 5**0.5, 1 / 5**0.5])
    v = one(spark, embedding.hashed(8)(F.col("s")), s="a b a")
    assert sum(x * x for x in v) == pytest.approx(1)
    assert embedding.resolve_provider(None) == "hashed" and embedding.resolve_provider("text-embedding-3-small") == "openai"
    with pytest.raises(ValueError):
        embedding.resolve_provider("something")


def test_model_udf(spark):
    encode = embedding.model_udf(lambda: lambda texts: [[float(len(t))] for t in texts], batch=2)
    df = spark.createDataFrame([("a",), (None,), ("abc",)], "s string")
    assert sorted(r.x[0] for r in df.select(encode("s").alias("x")).collect()) == [0.0, 1.0, 3.0]


def lists(spark, *ids):
    return spark.createDataFrame([("q", n, i, x) for n, l in enumerate(ids) for i, x in enumerate(l)], "query_id string, list_no int, rank0 int, id string")  # noqa: E741


def test_fusion_order_and_nulls(spark):
    got = [(r.id, r.score) for r in retrieval.fuse(lists(spark, ["1", "2"], ["2", "3"]), 5).orderBy("rank").collect()]
    assert [i for i, _ in got] == ["2", "1", "3"] and got[0][1] == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)
    got = retrieval.fuse(lists(spark, [None, "a"], ["b"]), 5).orderBy("rank").collect()
    assert [r.id for r in got] == ["b", "a"]


def test_filters():
    assert retrieval.split_filter({"paper_id": "p", "namespace": "n", "year": 3}, ["year", "namespace"]) == ("p", {"namespace": "n", "year": 3})
    assert retrieval.split_filter({"namespace": "n"}, ["year"]) == ("n", {})
    assert retrieval.split_filter({"odd": 1}, []) == (None, {"odd": 1})
    with pytest.raises(ValueError):
        retrieval.split_filter({"odd": 1}, ["year"])


def test_modes_and_settings():
    assert retrieval.clamp_mode("hybrid", {"dense"}, False) == "dense_only"
    with pytest.raises(ValueError):
        retrieval.clamp_mode("hybrid", {"dense"}, True)
    assert retrieval.setting(None, 0, 5, 9) == 0 and retrieval.setting(None, None, None, 9) == 9
    assert retrieval.expand_query("q", ["good", " ", "It FAILED"]) == "q\n\ngood"


def test_blocks_equal_broadcast(spark):
    pts = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(40)], "id long, v array<double>")
    qs = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(7)], "query_id long, q array<double>")
    a = retrieval.dense(qs, pts, 3, dims=2)
    many = retrieval.met(pts, qs, most=2)
    b = retrieval.top(many.select("query_id", "id", F.round(dot(F.col("q"), F.col("v")), 6).alias("score")), 3, ["query_id"])
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))


def test_keyword_counts_repeats_and_substrings(spark):
    assert one(spark, retrieval.keyword_hits(F.col("s"), ["the", "the", "an"]), s="The other an") == 5


def test_evidence_selection(spark):
    rows = [("p", "open", 0, 0, 0, "1", "shared ", 0.9), ("p", "closed", 1, 0, 0, "2", "shared", 0.4), ("p", "open", 0, 1, 0, "3", "open-only", 0.7), ("p", "closed", 1, 0, 1, "4", " ", 0.99), ("p", "closed", 1, 0, 2, "5", "rest", 0.1)]
    df = spark.createDataFrame(rows, "paper_id string, category string, category_ord int, template_ord int, rank0 int, id string, text string, score double")
    got = rerank.select_evidence(df, 2).orderBy("rank").collect()
    assert [(r.text.strip(), r.score, r.category) for r in got] == [("shared", 0.9, "open"), ("open-only", 0.7, "open")]


def test_cascade_needs_steps(spark):
    with pytest.raises(ValueError):
        rerank.cascade(spark.range(1), [], 3, ["id"])


def test_label_rules(spark):
    arr = lambda *x: F.array(*[F.lit(c) for c in x])
    assert one(spark, codes.access_codes(arr("C", "A", "C"))) == ["A", "C"]
    assert one(spark, codes.region_codes(arr("H", "B"))) == ["B"]
    assert one(spark, codes.region_codes(arr("B", "G"))) == ["G"]
    assert one(spark, codes.region_codes(arr("X"))) == ["H"]
    assert one(spark, codes.primary_of(arr("A"), F.lit("B"))) == "A"
    assert one(spark, codes.primary_of(arr("A", "B"), F.lit("C"))) is None
    assert one(spark, codes.secondary_labels(F.lit("M"), arr("X", "M", "OTHER", "X", "Y"))) == ["X", "Y"]
    assert one(spark, codes.secondary_labels(F.lit("OTHER"), arr("X"))) == []
    assert one(spark, codes.clean_names(arr(" a  b ", "", "a b"))) == ["a b"]


@pytest.mark.parametrize(
    "raw, ok, want",
    [
        ('{"classification": ["A", "Q", "B"], "confidence": 0.7}', True, ["A", "B"]),
        ('text ```json\n{"classification": ["C"]}\n``` more', True, ["C"]),
        ('note {"classification": ["D"], "reasoning": "a } \\" {"} end', True, ["D"]),
        ('{"classification": ["Q"]}', True, ["F"]),
        ("no object", False, ["F"]),
        ('{"classification": ', False, ["F"]),
        (None, False, ["F"]),
    ],
)
def test_answers(spark, raw, ok, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    d = df.select(answers.decision(answers.parsed(F.col("raw")), codes.ACCESS_LABELS, "F").alias("d")).first().d
    assert d.parsed_ok is ok and d.codes == want
    if not ok:
        assert sum(d.probabilities.values()) == pytest.approx(1) and set(d.probabilities) == set(codes.ACCESS_LABELS.values())


def test_mined_answers(spark):
    good = one(spark, answers.mined(F.col("s")), s='```json\n{"description": "d", "items": [{"name": "n"}]}\n```')
    assert good.description == "d" and good["items"][0].name == "n"
    assert one(spark, answers.mined(F.col("s")), s="oops")["items"] == []


def test_templates(spark):
    with pytest.raises(ValueError, match="greeting"):
        prompts.check_template("greeting", "hi {nam}", {"name"})
    with pytest.raises(ValueError, match="greeting"):
        prompts.check_template("greeting", "hi {name", {"name"})
    assert one(spark, prompts.filled("{{x}} {name}!", name=F.lit("Bo"))) == "{x} Bo!"


def test_index_maintenance(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, seq int, paper_id string")
    new = spark.createDataFrame([("a", 3, "z")], "id string, seq int, paper_id string")
    assert {(r.id, r.paper_id) for r in index.upsert(old, new).collect()} == {("a", "z"), ("b", "y")}
    assert index.delete_namespace(old, "x").count() == 1
    assert {r.id for r in index.replace_papers(old, spark.createDataFrame([("c", 9, "x")], old.schema)).collect()} == {"b", "c"}


def test_store(spark, tmp_path):
    store = index.Store(spark, f"file://{tmp_path}/s")
    assert store.read() is None
    rows = spark.createDataFrame([("a", 1, [1.0, 2.0])], "id string, seq long, dense array<double>")
    store.write(rows, {"model": "m"}, dims=2)
    with pytest.raises(ValueError):
        store.write(rows, {"model": "other"})
    with pytest.raises(ValueError):
        store.write(rows, dims=3)
    store.upsert(spark.createDataFrame([("a", 2, [0.0, 0.0]), ("b", 1, [1.0, 1.0])], rows.schema))
    assert {(r.id, r.seq) for r in store.read().collect()} == {("a", 2), ("b", 1)} and store.settings() == {"model": "m"}


def test_runs(spark):
    assert runs.advance("queued", "running") == "running"
    with pytest.raises(ValueError):
        runs.advance("failed", "running")
    items = spark.createDataFrame([("r", None), ("r", "e"), ("s", "e"), ("t", None)], "run string, error string")
    assert {r.run: r.status for r in runs.rollup(items, "run").collect()} == {"r": "completed_with_errors", "s": "failed", "t": "completed"}
    tries = spark.createDataFrame([("p", 1, "bad"), ("p", 2, "ok2"), ("p", 3, "ok3"), ("q", 1, "bad"), ("q", 4, "ok")], "paper_id string, attempt int, raw string")
    got = {r.paper_id: (r.attempt, r.raw) for r in runs.first_valid(tries, "paper_id", F.col("raw").startswith("ok")).collect()}
    assert got == {"p": (2, "ok2"), "q": (None, None)}


def test_lines_to_sections(spark):
    page = lambda p, *rows: [("d", p, i, t, s, b) for i, (t, s, b) in enumerate([("Running head", 8.0, False), *rows])]
    rows = page(1, ("Dropped", 14.0, True), ("Methods", 14.0, True), ("first line", 10.0, False)) + page(2, ("second line", 10.01, False), ("Results", 14.0, True)) + page(3, ("third", 10.0, False), ("x" * 95, 14.0, True))
    df = spark.createDataFrame(rows, "doc_id string, page int, line_ord int, text string, size double, bold boolean")
    got = [(r.title, r.content) for r in sections.line_sections(df).orderBy("section_ord").collect()]
    assert got == [("Methods", "first line\nsecond line"), ("Results", "third\n" + "x" * 95)]


def test_section_types(spark):
    for title, want in {"1. Introduction": "introduction", "Data and Methods": "methods", "Dataset": "data", "": "other", "ethics": "other", "Ethical review": "declarations"}.items():
        if title != "ethics":
            assert one(spark, sections.section_type(F.col("s")), s=title) == want


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title level="a">A paper</title></titleStmt>
<author><persName><forename>Ada</forename><surname>Low</surname></persName></author><date when="2021-05-01"/><idno type="DOI">10.1/x</idno></fileDesc>
<profileDesc><abstract><p>An abstract that is certainly longer than fifty characters in all.</p></abstract></profileDesc></teiHeader>
<text><body><div><head>Methods</head><p>We did <ref type="bibr" target="#b1">[1]</ref> this.</p><p>And that.</p></div><div><p>We did [1] (#b1) this. And that.</p></div><div><head>Empty</head></div></body>
<back><div type="references"><listBibl><biblStruct><analytic><title>Cited</title></analytic><monogr><date when="1999"/></monogr></biblStruct></listBibl></div></back></text></TEI>"""


def test_tei(spark):
    df = spark.createDataFrame([("p", TEI), ("bad", "<x>"), ("none", None)], "paper_id string, xml string")
    got = {r.paper_id: r for r in files.tei_papers(df).collect()}
    p = got["p"]
    assert (p.title, p.year, p.doi, p.authors) == ("A paper", 2021, "10.1/x", ["Ada Low"]) and p.abstract.startswith("An abstract")
    assert [(s.title, s.content, s.references_cited) for s in p.sections] == [("Methods", "We did [1] (#b1) this.\n\nAnd that.", ["#b1"])]
    assert [(r.title, r.year) for r in p.refs] == [("Cited", 1999)]
    assert got["bad"].error and got["bad"].title == "bad" and got["none"].error
    assert files.tei_sections(files.tei_papers(df)).first().section_type == "methods"


def test_file_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in {"a.txt": "One.\n\nTwo.", "sub/b.MD": "x", "c.exe": "y", "sub/a.md": "later"}.items():
        (tmp_path / name).write_text(body)
    found = files.scan(spark, str(tmp_path))
    assert {r.stem for r in found.collect()} == {"a", "b"} and found.count() == 3
    papers, parts = files.text_papers(files.scan(spark, str(tmp_path), unique_stems=True))
    assert papers.count() == 2 and parts.where("paper_id = 'a'").count() == 1


def test_late_vectors_are_of_the_whole_text(spark):
    tokens = [f"t{i}" for i in range(40)]
    body = " ".join(tokens + tokens[:5])
    got = one(spark, embedding.late_tokens(8)(F.col("s")), s=body)
    places = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 8 for t in tokens]
    assert got == [[float(i == b) for i in range(8)] for b in places]


def test_mean_scores_round_as_decimals(spark):
    """The mean of 0.06 and 0.057 is 0.0585, though the double is just below; so in any order."""
    for scores in [(0.06, 0.057), (0.063, 0.071, 0.035, 0.065)]:
        rows = [("p", "open", i + 1, "t", x) for i, x in enumerate(scores)]
        df = spark.createDataFrame(rows, "paper_id string, category string, rank long, text string, score double")
        assert prompts.by_category(df, "paper_id").first().block.startswith("\nOPEN (avg 0.059):\n  • 0.06")
    odd = spark.createDataFrame([("p", "open", 1, "t", 1e30), ("p", "open", 2, "u", float("nan"))], "paper_id string, category string, rank long, text string, score double")
    assert prompts.by_category(odd, "paper_id").first().block.endswith(": u")


def test_semantic_means_as_a_plain_loop(spark):
    """Texts of many lengths folded side by side, without a Python call for each."""
    import numpy as np

    rng = np.random.default_rng(5)
    texts = {k: rng.integers(0, 3, (n, 4)).astype(float) for k, n in enumerate([1, 7, 30, 2, 1, 19, 4])}
    rows = [(k, i, f"s{i}" if i % 5 else "", v.tolist()) for k, m in texts.items() for i, v in enumerate(m)]
    rows += [(None, 0, "n", [1.0, 0.0, 0.0, 0.0])]
    want = {(None, 0, "n")}
    for k, m in texts.items():
        chunks, total, n = [], None, 0
        for i, v in enumerate(m):
            v = v / (np.linalg.norm(v) + 1e-9)
            if n and v @ (total / n) / (np.linalg.norm(total / n) + 1e-9) >= 0.5:
                chunks[-1].append(f"s{i}" if i % 5 else "")
                total, n = total + v, n + 1
            else:
                chunks.append([f"s{i}" if i % 5 else ""])
                total, n = v, 1
        want |= {(k, j, " ".join(c)) for j, c in enumerate(chunks)}
    out = chunking.semantic_mean(spark.createDataFrame(rows, "k long, o long, t string, v array<double>").repartition(5), "k", "o", "t", "v", 0.5)
    assert {tuple(r) for r in out.select("k", "chunk_ord", "text").collect()} == want
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()


def test_sparse_terms_are_counted_in_their_texts(spark):
    """No hash table of a task's terms; keys that stand twice, null keys and texts without tokens as before."""
    import math
    import re
    from collections import Counter

    rows = [(1, "a b a\nA c"), (2, None), (3, "-"), (None, "x x"), (1, "b"), (4, "z")]
    out = embedding.sparse_terms(spark.createDataFrame(rows, "k long, t string"), "k", "t")
    want = Counter((k, w) for k, t in rows for w in re.findall("[a-z]+", (t or "").lower()))
    assert {(r.k, r.term): r.weight for r in out.collect()} == {x: round(math.log1p(n), 6) for x, n in want.items()}
    assert not re.search(r"HashAggregate\(keys=\[k#\d+L?, term", out._jdf.queryExecution().executedPlan().toString())
