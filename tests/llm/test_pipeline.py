import random

import corpus_pipeline


def test_stages_in_order(spark, tmp_path):
    names = ["language ID", "line dedup", "MinHash near-dedup", "mixing sources", "packing"]
    assert [n for n, _ in corpus_pipeline.STAGES] == names
    body = lambda seed, n: " ".join(f"the w{seed}x{i} and of" for i in range(n))
    rows = [(i, body(i, 30) + "\nshared line of the corpus that all have " + "ab" * 5, "en", f"s{i % 3}", 1) for i in range(30)]
    rows += [(100, body(1, 30).replace("w1x5 ", "changed "), "en", "s0", 1), (101, None, "en", "s1", 1), (102, "123 456", None, None, 1), (None, body(77, 20), "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    docs, sizes = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    cols = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        if i < 4:
            assert docs.columns == cols
        sizes.append(docs.count())
    ids = lambda i: {r[0] for r in spark.read.parquet(str(tmp_path / f"stage{i}")).select("doc_id").collect()}
    assert ids(0) == set(range(30)) | {100, None}
    assert ids(2) == set(range(30)) | {None}
    assert spark.read.parquet(str(tmp_path / "stage1")).where("text LIKE '%shared line%'").count() == 1
    assert sizes[4] > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[0] == "doc_id"


def test_language_id_rejects_gibberish_and_languages_not_learned(spark, tmp_path):
    rng = random.Random(6)
    vocab = {"en": "the house and with water of that stood by an old river".split(), "fr": "une maison avec été eau dans les rues du vieux port".split()}
    rows = [(i, " ".join(rng.choice(vocab[x]) for _ in range(rng.randrange(5, 80))), x) for i, x in enumerate(["en", "fr"] * 60)]
    rows += [(500, "water", "en"), (501, " ".join(["the river was wide and the water cold"] * 4), "en")]
    polish = "w roku tym spadło bardzo dużo śniegu i ludzie musieli długo czekać na pociąg do miasta".split()
    junk = [(600 + i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(50)), None) for i in range(20)]
    junk += [(700 + i, " ".join(rng.choice(polish) for _ in range(60)), None) for i in range(20)]
    spark.createDataFrame(rows + junk, "doc_id long, text string, lang string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in rows)


def test_one_row_of_each_near_duplicate_group_stays(spark, tmp_path):
    body = lambda seed, n=60: " ".join(f"w{seed}x{i}" for i in range(n))
    near = lambda seed: body(seed).replace(f"w{seed}x30", "changed")
    rows = [(None, body(1)), (None, near(1)), (None, body(1))]  # without ids
    rows += [(5, body(2)), (5, near(2)), (5, body(2)), (9, body(2)), (None, body(2))]  # the smallest id twice and more
    rows += [(7, body(3)), (6, near(3)), (None, body(4)), (7, body(5)), (None, None), (None, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    got = corpus_pipeline.near_dedup(spark, spark.read.parquet(str(tmp_path / "t")), str(tmp_path)).collect()
    found = [(r.doc_id, (r.text or "")[:3]) for r in got]
    assert sorted(found, key=str) == sorted([(None, "w1x"), (5, "w2x"), (6, "w3x"), (None, "w4x"), (7, "w5x"), (None, ""), (None, "")], key=str)


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_nulls_repeats_and_clashing_names(spark, tmp_path):
    text = " ".join(f"the w{i} and of" for i in range(40))
    rows = [(1, text, "en", "a", 1, 5, 6, "x", "y"), (1, text, "en", "a", 1, 5, 6, "x", "y"), (None, None, None, None, None, None, None, None, None), (2, "", "en", None, 0, 1, 1, "", ""), (3, "long " + text * 300, "en", None, 1, 2, 3, "p", "q")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_key long, class long, row string, digest string"
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"s{i}"))
        docs = spark.read.parquet(str(tmp_path / f"s{i}"))
        if i < 4:
            assert docs.columns == spark.read.parquet(str(tmp_path / "documents.parquet")).columns, name
    assert {r.doc_id for r in docs.select("doc_id").collect()} <= {1, 3}


def test_gibberish_is_rejected_though_it_was_learned_from(spark, tmp_path):
    rng = random.Random(8)
    vocab = "the house and with water of that stood by an old river".split()
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 80))), "en") for i in range(120)]
    junk = [(600 + i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 10))) for _ in range(50)), "en") for i in range(12)]
    spark.createDataFrame(rows + junk, "doc_id long, text string, lang string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.language_id(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == list(range(120))
