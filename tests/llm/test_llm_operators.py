"""Edge cases and brute-force comparisons of the other operators."""

import math
import os
import pickle
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from evidence_lake.llm import op1_quality, op4_language, op6_substring, op7_html, op8_topk, op9_mixing


def saved(spark, tmp_path, rows, schema, parts=3):
    spark.createDataFrame(rows, schema).repartition(parts).write.mode("overwrite").parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


DOCS = "doc_id long, text string, lang string, source string, n_words int, kept boolean, size long, part long"


def doc(i, text, lang="en", source="a"):
    return (i, text, lang, source, 1, False, 5, 6)


def brute_quality(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    tri = {}
    for i in range(len(w) - 2):
        tri.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for at in tri.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    words = "the and of a thing wine day long house été".split()
    texts = [None, "", " \n", "one", "a b c a b c", "a b a b a b a", "x" * 500, "été\n\nété\n été", "# $ | <b>\n# $ | <b>"]
    texts += [" ".join(rng.choice(words) + (rng.choice(words) if rng.random() < 0.5 else "") for _ in range(rng.randrange(40, 120))) for _ in range(60)]
    texts += ["word%%% " * 80, " ".join(f"{rng.choice(words)}{i}" for i in range(3000)), " ".join(f"w{i}***$$$" for i in range(90))]
    df = saved(spark, tmp_path, [doc(i if i % 4 else None, t, [None, "en", "fr"][i % 3]) for i, t in enumerate(texts)], DOCS)
    got = op1_quality.quality(df).toPandas()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted(map(tuple, got[names].astype(int).values.tolist())) == sorted(map(brute_quality, texts))
    failed = (got["n_words"] < 50) | (100 * got["n_repeat_words"] > 50 * got["n_words"])
    assert (got["base_failed"] == failed).all() and not (got["kept"] & got["base_failed"]).any()
    assert got["kept"].any()
    assert op1_quality.quality(df.limit(0)).count() == 0


def test_quality_knows_common_words_of_every_script(spark, tmp_path):
    rng = random.Random(12)
    common = {"ru": "это который непосредственно жизнь", "pl": "się źródło społeczeństwo żeby", "el": "και αυτός άνθρωπος όταν", "hi": "में और विश्वविद्यालय नहीं", "de": "gesellschaft wissenschaft und das"}
    rows = []
    for n, (lang, own) in enumerate(common.items()):
        rare = ["".join(rng.choice(own.replace(" ", "")[:6]) for _ in range(6)) for _ in range(3000)]
        for i in range(30):
            text = " ".join(rng.choice(own.split()) if rng.random() < 0.5 else rng.choice(rare) for _ in range(80))
            rows.append(doc(100 * n + i, text, lang))
        rows.append(doc(100 * n + 99, " ".join(rng.choice(rare) for _ in range(80)), lang))
    got = {r.doc_id: r for r in op1_quality.quality(saved(spark, tmp_path, rows, DOCS)).collect()}
    for n in range(len(common)):
        assert not got[100 * n + 99].base_failed and got[100 * n + 99].word_distance > op1_quality.MOST_WORD_DISTANCE and not got[100 * n + 99].kept
        assert sum(got[100 * n + i].kept for i in range(30)) == 30


def test_long_texts_use_struct_keys(spark, monkeypatch):
    monkeypatch.setattr(op1_quality, "PLACE_BITS", 2)
    texts = ["a b c d a b c x y", "q w e r t y u i o p q w e", "m n o"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", op1_quality.n_repeat_words(F.split("t", " ")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == {t: brute_quality(t)[4] for t in texts}


def test_language(spark, tmp_path):
    rng = random.Random(1)
    vocab = {"en": "the house and with water".split(), "fr": "une maison avec été eau".split(), "de": "das haus und mit wasser".split()}
    rows = [doc(i, " ".join(rng.choice(vocab[lang]) for _ in range(rng.randrange(5, 40))), lang) for i, lang in enumerate(["en", "fr", "de"] * 60)]
    rows += [doc(900, None), doc(901, "", None), doc(902, "123 !!! \n"), doc(None, "the water", None), doc(903, "HAUSEN wassers", None), doc(903, "maisonette", None)]
    df = saved(spark, tmp_path, rows, DOCS)
    model = op4_language.fit(df)
    out = op4_language.identify(df.select("doc_id", "text", "lang"), model).collect()
    right = [r.lang_pred == r.lang for r in out if r.lang and r.doc_id is not None and r.doc_id < 900]
    assert sum(right) / len(right) > 0.97
    by = {(r.doc_id, r.text): r for r in out}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in ((900, None), (901, ""), (902, "123 !!! \n")))
    assert by[(903, "HAUSEN wassers")].lang_pred == "de" and by[(903, "maisonette")].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in out)
    assert op4_language.fit(df.limit(0)).langs == []
    assert op4_language.identify(df.select("text").limit(3), op4_language.fit(df.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_every_label_is_learned(spark, tmp_path):
    rng = random.Random(9)
    names = [f"l{i:02d}" for i in range(70)]
    vocab = {x: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(6)] for x in names}
    rows = [doc(i, " ".join(rng.choice(vocab[x]) for _ in range(30)), x) for i, x in enumerate(names * 6)]
    rows += [doc(9000 + i, " ".join(vocab[x] * 2), x) for i, x in enumerate(names[:64])]  # the last six are the rarest
    df = saved(spark, tmp_path, rows, DOCS)
    model = op4_language.fit(df)
    assert model.langs == names
    out = op4_language.identify(df.select("text", "lang"), model).collect()
    assert all(r.lang_pred == r.lang and r.score > 0.99 for r in out)


def test_held_out_documents_do_not_change_the_model(spark, tmp_path):
    rows = [doc(i, f"word{i % 7} text", "en") for i in range(80)]
    df = saved(spark, tmp_path, rows, DOCS, 1)
    changed = df.withColumn("text", F.when(op4_language.held_out(F.col("doc_id")), "zzz yyy").otherwise(F.col("text")))
    a, b = op4_language.fit(df), op4_language.fit(changed)
    assert a.tables == b.tables and all(np.array_equal(x, y) for x, y in zip([*a.weights, *a.base], [*b.weights, *b.base]))


def test_ties_go_to_the_smaller_code():
    model = op4_language.Model(["aa", "xx"], {0: {("aa", "same"): 3, ("xx", "same"): 3}}, {(0, "aa"): 3, (0, "xx"): 3})
    assert model.judge(pa.array(["same", "same same", "", None]))[0] == ["aa", "aa", "und", "und"]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test tables")
def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = op4_language.op4_language(spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'")
    got = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count(F.lit(1))).first()
    assert got[1] > 150 and got[0] > 0.97


def test_chunks_resist_shifts():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 123, 6000, dtype=np.uint8).tobytes()

    def pieces(raw):
        ends = op6_substring.cuts(np.frombuffer(raw, np.uint8))
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    assert b"".join(pieces(data)) == data
    moved = pieces(data[:1500] + b"inserted" + data[1500:])
    assert len(set(pieces(data)) - set(moved)) <= 4
    assert op6_substring.cuts(np.frombuffer(b"abc", np.uint8)) == [3]
    assert max(map(len, pieces(b"a" * 20000))) <= op6_substring.LONGEST


def test_repeated_passages(spark, tmp_path):
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passage = text(55)
    rows = [doc(i, f"{text(40)} {passage} {text(30)}") for i in range(1, 9)] + [doc(100 + i, text(150)) for i in range(20)]
    rows += [doc(200, None), doc(201, ""), doc(202, "short"), doc(300, rows[0][1]), doc(None, rows[1][1])]
    got = op6_substring.repeated_spans(saved(spark, tmp_path, rows, DOCS)).collect()
    assert {r.doc_id for r in got} == {2, 3, 4, 5, 6, 7, 8, 300, None}
    assert all(r.n_chunks > 0 for r in got)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        if r.doc_id not in (None, 300):
            assert r.first_doc_id == 1 and texts[r.doc_id].encode()[r.start : r.start + r.length].decode() in passage + " "
    assert op6_substring.repeated_spans(saved(spark, tmp_path, [], DOCS, 1)).count() == 0


def brute_spans(rows, inside, least=op6_substring.LEAST_BYTES):
    seen, out = {}, []
    for n, (doc_id, text, *_) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))):
        raw = (text or "").encode()
        ends = op6_substring.cuts(np.frombuffer(raw, np.uint8)) if raw else []
        runs, last = [], None
        for i, (a, b) in enumerate(zip([0, *ends], ends)):
            origin = seen.setdefault(raw[a:b], (n, doc_id))
            fresh = origin[0] == n and (not inside or raw[a:b] not in {raw[x:y] for x, y in zip([0, *ends][:i], ends[:i])})
            if not fresh:
                if last == i - 1:
                    runs[-1][1] += b - a
                    runs[-1][2] += 1
                else:
                    runs.append([a, b - a, 1, origin[1]])
                last = i
        out += [(doc_id, *r) for r in runs if r[1] >= least]
    return out


def test_repeats_against_brute_force(spark, tmp_path):
    rng = random.Random(21)
    text = lambda n: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passages = [text(50) for _ in range(4)]
    rows = [doc(i, " ".join(rng.choice(passages) if rng.random() < 0.4 else text(12) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [doc(99, None), doc(98, ""), doc(97, "spam " * 4000), doc(None, passages[0] + "é" * 900)]
    df = saved(spark, tmp_path, rows, DOCS)
    for inside in (False, True):
        got = [(r.doc_id, r.start, r.length, r.n_chunks, r.first_doc_id) for r in op6_substring.repeated_spans(df, inside=inside).collect()]
        assert sorted(got, key=str) == sorted(brute_spans(rows, inside), key=str)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/x">Menu one</a></li><li><a>two</a></li></ul></nav>
<div class="cookie-notice">We use cookies here</div><article><h1>Main  head</h1><p>First &amp; <b>bold</b>&nbsp;words of it<br>go on
here.</p><div class="ad">Buy this now</div><p>Second &lt;para&gt; é.</p><form><label>Name</label><input></form><div id="comments"><p>A comment that is long enough</p></div></article>
<aside>Other things to read</aside><footer>&copy; me</footer><script>var a = "</p>";</script></body></html>"""


def test_page_text(spark):
    want = "Main head\n\nFirst & bold words of it go on here.\n\nSecond <para> é."
    plain = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    rows = [(i, "u", PAGE) for i in range(6)] + [(10, None, plain), (11, "u", None), (12, "u", ""), (13, "u", "<p>unclosed <b>tags &bogus; & more words than tags"), (None, "u", "<nav>x y z</nav>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in op7_html.extract(df, op7_html.fit(df)).collect()}
    assert got[0].text == want and got[0].n_chars == len(want)
    assert "Second <para> é." in got[10].text and "Menu" not in got[10].text and "comment" not in got[10].text
    assert got[11].text == got[12].text == got[None].text == ""
    assert got[13].text == "unclosed tags &bogus; & more words than tags"
    assert op7_html.extract(df.limit(0), op7_html.fit(df.limit(0))).count() == 0
    twice = op7_html.extract(df.where("page_id = 0").union(df.where("page_id = 0")), op7_html.fit(df)).collect()
    assert [r.text for r in twice] == [want] * 2


def test_parts_by_name_are_learned_not_listed():
    weights = op7_html.log_odds(*op7_html.labels(PAGE))
    body = "<p>The first part of this story has many words in it.</p><p>And so has the second part of this same story here.</p>"
    want = "The first part of this story has many words in it.\n\nAnd so has the second part of this same story here."
    page = lambda inner: f"<html><body><nav><a>Menu</a></nav><article>{inner}</article><footer>f</footer></body></html>"
    text = lambda inner, w=weights: op7_html.main_text(page(inner), w)
    assert text(f'<section id="discussion">{body}</section>') == want
    assert text(f'<div class="entry-header"><h1>A title</h1></div>{body}') == "A title\n\n" + want
    assert text(f'<div class="search">{body}</div>') == want
    assert text(f'<div class="comments">{body}</div>') == want  # all there is
    assert text(f'{body}<div id="comments"><p>I liked this story</p></div><div class="ad-slot">Buy</div>') == want
    assert text(f"{body}<p>With <math><mi>x</mi> = 2</math> in it.</p>") == want + "\n\nWith x = 2 in it."
    # labelled pages teach names
    odd = '<div class="promo-x"><p>Buy some more of these things now</p></div>'
    pages = [f'<body>{odd}<article>{body}<div class="law"><p>A law that belongs to the story</p></div></article></body>'] * 30
    inside, outside = (sum(c, Counter()) for c in zip(*map(op7_html.labels, pages)))
    learned = op7_html.log_odds(inside, outside)
    assert text(body + odd, learned) == want and learned["@promo-x"] < -2
    assert text(body + '<div class="law">Words of law</div>', learned) == want + "\n\nWords of law"


def test_long_page_and_long_attributes():
    weights = op7_html.log_odds(*op7_html.labels(PAGE))
    para = "<p class='" + "c " * 50 + "'>words of a long page &amp; more of them</p>"
    got = op7_html.main_text("<article>" + para * 20_000 + "</article>", weights)
    assert got == "\n\n".join(["words of a long page & more of them"] * 20_000)


SF = "/root/testdata/sf0.01/pages.parquet"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_accuracy_on_pages_without_marks():
    """Weights of the one half of the pages find the articles of the other, whose marks are taken off."""
    import pyarrow.parquet as pq

    rows = pq.read_table(SF).to_pylist()
    found = [x for x in (op7_html.labels(r["html"]) for r in rows[::2]) if x]
    inside, outside = (sum(c, Counter()) for c in zip(*found))
    weights, scores = op7_html.log_odds(inside, outside), []
    for r in rows[1::2]:
        gold = Counter(w for t in op7_html.tokens(r["html"]) if t[0] == "text" and t[-1] for w in op7_html.entities.unescape(t[1]).split())
        plain = re.sub(r"<(/?)(article|main)\b", r"<\1div", r["html"])
        got = Counter(op7_html.main_text(plain, weights).split())
        both = (gold & got).total()
        scores.append(2 * both / (gold.total() + got.total()))
    assert sum(scores) / len(scores) > 0.98


def test_weights_have_every_name(spark):
    odd = "".join(f"<c{i:03d}>x y</c{i:03d}>" for i in range(600))
    pages = [(i, "u", f"<nav><a>some link</a></nav><article>{odd}</article><footer>f</footer>") for i in range(4)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    weights = op7_html.fit(df)
    assert {f"c{i:03d}" for i in range(600)} <= set(weights)
    assert weights == op7_html.fit(df.coalesce(1))
    whole = op7_html.labels(pages[0][2])
    assert weights == op7_html.log_odds(*[type(c)({k: 4 * n for k, n in c.items()}) for c in whole])


def test_page_text_is_the_run():
    weights = op7_html.log_odds(*op7_html.labels(PAGE))
    want = "Main head\n\nFirst & bold words of it go on here.\n\nSecond <para> é."
    for mark in ("div", "section", "main"):  # pages without an article or any marked element
        page = PAGE.replace("<article>", f"<{mark}>").replace("</article>", f"</{mark}>")
        assert op7_html.main_text(page, weights) == want
    links = "".join(f"<li><a href='{i}'>go{i}</a></li>" for i in range(40))
    page = f"<article><h1>Some head of it</h1><p>Many words are <b>in</b> this first part of the page.</p><ul>{links}</ul></article>"
    flat = {"text": 1.0, "p": -0.5, "h1": -0.5, "": -3.0}
    assert op7_html.main_text(page, flat) == "Some head of it\n\nMany words are in this first part of the page."
    assert op7_html.main_text("<p>all <b>of it</b> and more words here</p>", {"text": 1.0, "b": -6.0, "p": -0.5, "": -1.0}) == "all of it and more words here"


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op8_topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(op8_topk, "QUERY_ROWS", 4)
    rng = random.Random(4)
    rows = [(i - 20, [round(rng.uniform(-1, 1), 1) for _ in range(5)]) for i in range(90)]
    rows += [(7, rows[3][1]), (20, rows[9][1]), (20, rows[9][1]), (None, [1.0] * 5), (500, None), (501, [1.0, None, 0.0, 0.0, 0.0]), (502, [math.inf] * 5), (503, [math.nan] * 5), (520, [1.0, 2.0]), (521, [0.5, 0.5]), (540, []), (560, [3e9, -3e9, 1.0, 0.0, 1e9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).repartition(3)
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, (q, a) in enumerate(good):
        if q % 20 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(good) if m != n and len(b) == len(a))
            want += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -t))) for r, (t, i) in enumerate(s[:7])]
    got = op8_topk.top_k(df, k=7).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert op8_topk.top_k(df.limit(0)).count() == 0


def test_blocks_out_of_reach_are_not_visited(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op8_topk, "BLOCK_ROWS", 50)
    monkeypatch.setattr(op8_topk, "QUERY_ROWS", 4)
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(8, 16))
    rows = [(i, (m / np.linalg.norm(m) + rng.normal(size=16) * 0.03).tolist()) for i, m in enumerate(middle.repeat(50, axis=0))]  # a cluster after the other
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    blocks, q_blocks, visited = op8_topk.visiting(df, k=5, every=20)
    pairs = sum(len(r[0]) // 4 for r in visited.select("rows").collect())
    assert blocks.count() == 8 and q_blocks.agg(F.sum("q_n")).first()[0] == 20
    assert 20 <= pairs <= 40  # of 160
    cells = np.floor(64 * np.array([v for _, v in rows]))
    got = {(r.query_id, r["rank"]): r.score for r in op8_topk.top_k(df, k=5).collect()}
    for q in range(0, 400, 20):
        best = sorted((int(cells[q] @ cells[j]) for j in range(400) if j != q), reverse=True)[:5]
        assert [got[(q, n + 1)] for n in range(5)] == best


def test_targets():
    assert op9_mixing.targets([]) == []
    assert op9_mixing.targets([100, 100, 100]) == [200.0, 250 / 3, 500 / 3]
    t = op9_mixing.targets([10, 1000, 5, 0])
    assert t[0] == 20 and t[2] == 10 and t[3] == 0 and abs(sum(t) - 1.5 * 1015) < 1e-9
    assert all(x <= 2 * s + 1e-9 for x, s in zip(t, [10, 1000, 5, 0]))


def order_of(df):
    rows = df.groupBy("source").agg(F.sum(F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != ""))).alias("n")).collect()
    return sorted(rows, key=lambda r: (r.source is None, (r.source or "").encode()))


def test_mixing(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    rows = [doc(rng.randrange(900), "w " * rng.randrange(0, 60), "en", rng.choice(["b", "a", "é", None, "a", "a"])) for _ in range(1500)]
    rows += [doc(None, None, "en", "a"), doc(5, "", None, None), doc(7, "x " * 4000, "en", "b")]
    df = saved(spark, tmp_path, rows, DOCS)
    out = op9_mixing.mix(df).toPandas()
    assert len(out) == len(rows)
    assert sorted(out["size"]) == sorted(len((r[1] or "").split()) for r in rows)
    for (total, target), g in out.groupby(["source_size", "target"]):
        assert g["size"].sum() == total and abs(g["taken"].sum() - target) <= g["size"].max()
    assert ((out["taken"] == 0) | (out["taken"] % out["size"].clip(lower=1) == 0)).all() and (out["taken"] <= 2 * out["size"]).all()
    assert op9_mixing.targets([r.n for r in order_of(df)]) == pytest.approx([out[out["source_size"] == r.n]["target"].iloc[0] for r in order_of(df)])
    # another order, partitioning and file layout give the same mix
    key = ["doc_id", "size", "source_size", "target", "taken"]
    sort = lambda x: sorted(map(tuple, x[key].fillna(-1).values.tolist()))
    df.orderBy(F.desc("size"), F.rand(3)).repartition(7).write.parquet(str(tmp_path / "other"))
    monkeypatch.setattr(op9_mixing, "BUCKET_ROWS", 100)
    few = sort(op9_mixing.mix(df).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sort(op9_mixing.mix(spark.read.parquet(str(tmp_path / "other"))).toPandas()) == few
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for (total, target), g in op9_mixing.mix(df).toPandas().groupby(["source_size", "target"]):
        assert abs(g["taken"].sum() - target) <= g["size"].max()
    monkeypatch.undo()
    n = sum(t // s for s, t in zip(out["size"], out["taken"]) if s)
    assert op9_mixing.mixed_rows(df).count() == n and op9_mixing.mixed_rows(df).columns == df.columns
    assert op9_mixing.mix(saved(spark, tmp_path, [], DOCS, 1)).count() == 0


def test_flight_keeps_totals():
    rng = random.Random(0)
    rows = [(i, i, "s", rng.randrange(1, 50), i // 700, i, 0.37) for i in range(2000)]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=op9_mixing.NAMES)
    got = [r for b in op9_mixing._flight(False, 1)(iter([batch(rows[:900]), batch(rows[900:])])) for r in zip(*b.to_pydict().values())]
    open_ = [r for r in got if 0 < r[-1] < 1]
    assert len(got) == 2000 and len(open_) <= 6
    out = [r for r in got if r[-1] in (0.0, 1.0)] + [r for b in op9_mixing._flight(True, 1)(iter([batch(open_)])) for r in zip(*b.to_pydict().values())]
    assert {r[-1] for r in out} == {0.0, 1.0} and len(out) == 2000
    want = sum(0.37 * r[3] for r in rows)
    assert abs(sum(r[-1] * r[3] for r in out) - want) <= 50 and abs(sum(r[-1] for r in out) - 740) <= 2


def test_arrow_split_keeps_words():
    texts = pa.array(["a  b\tc\n", "", None, "é\x0bx"])
    from evidence_lake.llm.op3_minhash import shingle_sets

    assert [len(s) for s in shingle_sets(texts)] == [1, 0, 0, 1]


def letters(i):
    return "".join("abcdefghijklmnopqrst"[i // 20**k % 20] for k in range(4))


def brute_language(rows, texts):
    """(language, score, pieces known) of texts by a model of all rows (text, lang)."""
    runs = lambda t: regex.findall(r"\p{L}+", (t or "").lower())
    cut = lambda w, n: [w] if n == 0 else [x[i : i + n] for x in [w if n == 1 else f" {w} "] for i in range(len(x) - n + 1)]
    langs = sorted({x for _, x in rows})
    counts = [{x: Counter() for x in langs} for _ in range(5)]
    for text, lang in rows:
        for n in range(5):
            counts[n][lang].update(g for w in runs(text) for g in cut(w, n))
    known = [set().union(*c.values()) for c in counts]
    total = [{x: sum(c[x].values()) + 0.5 * (len(k) + 1) for x in langs} for c, k in zip(counts, known)]
    out = []
    for text in texts:
        sums = dict.fromkeys(langs, 0.0)
        for w in runs(text):
            for n in (0, 4, 3, 2, 1):
                if found := [g for g in cut(w, n) if g in known[n]]:
                    for x in langs:
                        sums[x] += sum(math.log((0.5 + counts[n][x][g]) / total[n][x]) for g in found) / len(found)
                    break
        best = max(langs, key=lambda x: sums[x])
        out.append((best, 1 / sum(math.exp(s - sums[best]) for s in sums.values()), sum(w in counts[0][best] for w in runs(text))) if runs(text) else ("und", 0.0, 0))
    return out


@pytest.mark.parametrize("held, hot", [(0, 1), (30, 3), (400_000, 4096)])
def test_words_held_or_joined_give_the_same_languages(spark, tmp_path, monkeypatch, held, hot):
    monkeypatch.setattr(op4_language, "HELD_PAIRS", held)
    monkeypatch.setattr(op4_language, "HOT", hot)
    rng = random.Random(3)
    vocab = {x: ["".join(rng.choice(abc) for _ in range(rng.randrange(1, 9))) for _ in range(25)] for x, abc in (("en", "abcdefgh"), ("fr", "efghijklé"), ("ru", "жзиклмнab"))}
    rows = [doc(i, " ".join(rng.choice(vocab[x]) + rng.choice(["", "", ".", "'" + rng.choice(vocab[x])]) for _ in range(rng.randrange(1, 25))), x) for i, x in enumerate(["en", "fr", "ru"] * 30)]
    rows += [doc(1000 + i, " ".join("".join(rng.choice("abefhiжз中文é") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 9))), None) for i in range(60)]
    rows += [doc(2000, None), doc(2001, "12 !"), doc(2002, "中 文", None), doc(2003, "a" * 3000, None)]
    df = saved(spark, tmp_path, rows, DOCS)
    learned = [(r.text, r.lang) for r in df.where(op4_language.learned(F.col("doc_id"), F.col("text"), F.col("lang"))).collect()]
    got = op4_language.identify(df.select("doc_id", "text"), op4_language.fit(df), counted=True).collect()
    assert len(got) == len(rows)
    for r, (lang, score, known) in zip(got, brute_language(learned, [r.text for r in got])):
        assert (r.lang_pred, r.n_known) == (lang, known) and abs(r.score - score) < 1e-3, r


def test_every_document_is_learned_from(spark, tmp_path):
    rows = [doc(i, f"{letters(i)}{letters(i + 7919)} qq", ["en", "fr"][i % 2]) for i in range(3000)]
    docs = saved(spark, tmp_path, rows, DOCS)
    model = op4_language.fit(docs)
    n_learned = docs.where(op4_language.learned(F.col("doc_id"), F.col("text"), F.col("lang"))).count()
    assert n_learned > 2100 and len(model.tables[0]) == n_learned + 1


def test_driver_makes_no_object_of_each_word(spark, tmp_path):
    word = F.concat(*[F.substring(F.lit("abcdefghijklmnopqrst"), (F.floor(F.col("id") / 20**k) % 20 + 1).cast("int"), F.lit(1)) for k in range(4)])
    spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(word, F.lit(" qq")).alias("text"), F.lit("en").alias("lang")).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    op4_language.fit(docs.limit(50))  # what Spark's Python side loads
    tracemalloc.start()
    try:
        model = op4_language.fit(docs)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    n_words = docs.where(op4_language.learned(F.col("doc_id"), F.col("text"), F.col("lang"))).count() + 1
    assert n_words > 40_000 and len(pickle.loads(pickle.dumps(model)).tables[0]) == n_words
    assert most < 150 * n_words, most / n_words
