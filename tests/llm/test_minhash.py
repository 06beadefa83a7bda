import random
import re

import pytest

from evidence_lake.llm.components import components, merged
from evidence_lake.llm.op3_minhash import miss, near_duplicates


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i), d)) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + rng.choice("aeiou") + str(rng.randrange(30))
    passage = " ".join(word() for _ in range(60))
    base = [" ".join(word() for _ in range(rng.choice([8, 60, 120]))) for _ in range(30)]
    texts = list(base) + [None, "", "  \n", "One", "one", "one two three", "ONE two\tthree ", "five words are just enough", "été Été"]
    for b in base[:12]:
        for _ in range(12):  # copies of all degrees, around the threshold too
            w = b.split(" ")
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    texts += [passage + " " + " ".join(word() for _ in range(rng.choice([5, 15, 60]))) for _ in range(40)]
    texts += [base[0].upper(), base[0].replace(" ", "\n")]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[5] = ids[6] = 7
    ids[8] = None
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed", [3, 9])
def test_against_brute_force(spark, tmp_path, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, b"x", 1, "s") for d, t in rows], "doc_id long, text string, sig binary, n long, class string").repartition(5)
    df.write.parquet(str(tmp_path / "t"))
    got = near_duplicates(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert near_duplicates(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).where("kept").count() == 2


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (301, 300), (300, 301)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300}


def test_components_of_more_edges(spark):
    frame = lambda e: spark.createDataFrame(e, "u long, v long")
    parts = components(frame([(2, 1), (3, 2), (11, 10), (20, 21)]))
    got = {r.node: r.component for r in merged(parts, frame([(11, 3), (31, 30), (30, 21), (40, 41)])).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 20: 20, 21: 20, 30: 20, 31: 20, 40: 40, 41: 40}


def test_chance_of_a_miss():
    assert miss() < 1e-7 and miss(0.76) < miss()
