"""Titles against brute force; retries against a plain loop."""

import json
import random

from pyspark.sql import functions as F

from evidence_lake.operators import titles, turns


def brute(own, refs, least):
    import re

    toks = lambda t: set(re.findall(r"[a-z0-9]+", (t or "").lower()))
    out = {}
    for i, t in own:
        x, best = toks(t), None
        for doi, r in refs:
            y = toks(r)
            if not x or not y or doi is None or not x & y:
                continue
            both = len(x & y)
            score = 1.0 if both == min(len(x), len(y)) else round(2 * both / (len(x) + len(y)), 6)
            if score >= least and (best is None or (-score, doi) < best):
                best = (-score, doi)
        if best:
            out[i] = (best[1], -best[0])
    return out


def test_titles_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(25)]
    refs = [(f"10.1/{i}", " ".join(rng.sample(words, rng.randint(1, 14)))) for i in range(60)] + [(None, "w1 w2"), ("10.2/a", None), ("10.2/b", "")]
    own = [(i, " ".join(rng.sample(words, rng.randint(1, 14)))) for i in range(80)] + [(100 + i, f"{r[1]} extra") for i, r in enumerate(refs[:20])] + [(200, refs[0][1].upper()), (201, None), (202, "-"), (203, "w0 " * 3000)]
    for least in (0.9, 0.6):
        got = titles.matched(spark.createDataFrame(own, "title_id long, title string"), spark.createDataFrame(refs, "doi string, title string"), least)
        assert {r.title_id: (r.doi, r.score) for r in got.collect()} == brute(own, refs, least)
    none = spark.createDataFrame([], "doi string, title string")
    assert titles.matched(spark.createDataFrame(own, "title_id long, title string"), none).count() == 0


def test_rounds_keep_each_papers_history(spark):
    ok = json.dumps({"classification": ["A"]})
    answers = {"a": [ok], "b": ["bad", ok], "c": [None, "bad", ok], "d": ["x", "y", "z"], "e": [None, None, None], "f": ["x", None, "y"], "g": []}
    responses = spark.createDataFrame([(p, i + 1, r) for p, rs in answers.items() for i, r in enumerate(rs)], "paper_id string, attempt int, raw string")
    papers = spark.createDataFrame([(p, [("user", f"about {p}")]) for p in answers], "paper_id string, messages array<struct<role:string,content:string>>")
    got = {r.paper_id: r for r in turns.retried(papers, turns.canned(responses), 3).collect()}
    for p, rs in answers.items():
        history, samples, last, done = [("user", f"about {p}")], [], None, None
        for n, raw in enumerate((rs + [None] * 3)[:3], 1):
            if raw is None:
                continue
            last = raw
            samples.append((n, len(history), raw, raw == ok))
            if raw == ok:
                done = n
                break
            if n < 3:
                history += [("assistant", raw), ("user", turns.CORRECTION)]
        r = got[p]
        assert (r.attempt, r.raw, [tuple(m) for m in r.messages], [tuple(s) for s in r.samples]) == (done, last, history, samples)


def test_rounds_generate_once_and_see_the_history(spark, tmp_path):
    made = []

    def generate(open_, attempt):
        return open_.select("paper_id", F.when(F.size("messages") > 1, F.lit('{"classification": ["B"]}')).otherwise("no").alias("raw"))

    def keep(df, name):
        made.append(name)
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    papers = spark.createDataFrame([(i, [("user", "u")]) for i in range(3)], "paper_id long, messages array<struct<role:string,content:string>>")
    rows = turns.retried(papers, generate, 3, keep=keep).collect()
    assert made == ["round-1", "round-2", "round-3"] and [r.attempt for r in rows] == [2, 2, 2]


def test_titles_meet_references_without_copies_of_their_texts(spark, monkeypatch):
    """Long titles aren't shuffled once for each of their tokens; references too large to be sent around give the same."""
    rng = random.Random(4)
    refs = [(f"10.1/{i}", " ".join(f"w{rng.randint(0, 400)}" for _ in range(12))) for i in range(40)]
    own = [(i, " ".join(f"w{rng.randint(0, 4000)}" for _ in range(1500)) + " " + refs[i % 40][1]) for i in range(60)] + [(100 + i, r[1] + " more") for i, r in enumerate(refs)]
    frames = spark.createDataFrame(own, "title_id long, title string"), spark.createDataFrame(refs, "doi string, title string")
    found = titles.matched(*frames)
    plan = found._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert all("token" not in line for line in shuffles), shuffles
    want = brute(own, refs, 0.9)
    assert {r.title_id: (r.doi, r.score) for r in found.collect()} == want
    monkeypatch.setattr(titles, "BROADCAST_BYTES", 0)
    assert {r.title_id: (r.doi, r.score) for r in titles.matched(*frames).collect()} == want
