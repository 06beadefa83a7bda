"""Ranked lexical search against brute force; the index's order; visits that bounds spare."""

import math
import re
from collections import Counter

import numpy as np

from evidence_lake.llm import op11_lexical as lex

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    own = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_all = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in own:
            m = 50 + 50 * sum(c.values()) * n_docs // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r, None if absent else i, -s) for r, (s, absent, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def test_terms():
    text = "A b-C_d9'É ÉCOLE ß x\x85y 日本 İ \x00z\x7f{Q}"
    assert [t.decode() for t in lex.terms_of(text)] == terms(text)


def corpus(rng, n):
    words = ["w" + str(i) for i in range(60)]
    topics = [words[i : i + 12] for i in (0, 12, 24, 36)]
    texts = [" ".join(rng.choice(topics[i % 4], 9).tolist() + ["the"] * int(rng.integers(1, 3))) for i in range(n)]
    return [(i, t) for i, t in enumerate(texts)], topics


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    docs, topics = corpus(rng, 150)
    docs += [(i + 500, docs[3][1]) for i in range(40)] + [(7, docs[9][1]), (None, docs[3][1]), (None, None), (900, ""), (901, " -- "), (902, "The THE the. w1_w2"), (903, "w3 " * 4000)]
    items = [(1, "w1 w2 W3 w3 the"), (2, docs[3][1]), (2, "w40 nowhere"), (None, "w13"), (3, None), (4, ""), (5, "nowhere"), (6, "the")]
    d = spark.createDataFrame([(i, t, "z", 1) for i, t in docs], "doc_id long, text string, shard string, n int").repartition(4)
    q = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, item int")
    index = lex.indexed(d, block_docs=24, shard_docs=5)
    assert index.n_docs == len([1 for _, t in docs if terms(t)])
    got = lex.search(index, q, 12, most_items=3)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, 12)
    assert lex.ranked(d.limit(0), q).count() == 0 and lex.ranked(d, q.limit(0)).count() == 0


def test_bisection_brings_near_documents_together():
    rng = np.random.default_rng(4)
    docs, _ = corpus(rng, 256)
    doc, term, ids = lex._edges([b" ".join(lex.terms_of(t)) for _, t in docs])
    doc, term = np.unique(np.stack([doc, term]), axis=1)
    order = lex.reordered(doc, term, len(docs), len(ids))
    assert sorted(order.tolist()) == list(range(256))
    topic = order % 4  # in the order given each topic comes every fourth time
    assert (topic[1:] == topic[:-1]).mean() > 0.9
    tree = lex.fitted_tree([t.encode() for _, t in docs], 2)
    leaves = [tree.leaf(t.encode().split()) for _, t in docs]
    assert sum(Counter(zip(leaves, [i % 4 for i in range(256)])).most_common(4)[i][1] for i in range(4)) > 240


def test_shards_out_of_reach_are_not_visited(spark, monkeypatch):
    rng = np.random.default_rng(6)
    docs, topics = corpus(rng, 400)
    docs = docs[:-1] + [(399, "w59 w58")]  # `the` has some weight then
    items = [(i, " ".join([*topics[i], "the"])) for i in range(4)]
    index = lex.indexed(spark.createDataFrame(docs, "doc_id long, text string"), block_docs=400, shard_docs=20)
    q = spark.createDataFrame(items, "item_id long, text string")
    staged = {}
    keep = lex.staged
    monkeypatch.setattr(lex, "staged", lambda df, name, **more: staged.setdefault(name, []).append(keep(df, name, **more)) or staged[name][-1])
    got = sorted(map(tuple, lex.search(index, q, 5).collect()))
    assert got == brute(docs, items, 5)
    reach = staged["lexical-bounds"][0].collect()
    cut = min(s for _, _, _, s in got)
    assert len(reach) >= 76 and len([r for r in reach if r.place > 9 and r.bound < cut]) > 0.4 * len(reach)  # topics have shards of their own, so most others are out of reach
