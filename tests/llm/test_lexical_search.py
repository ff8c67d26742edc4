"""The two trees against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from attestra.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(items, docs, k=10):
    """{(item, rank): (doc, score)} of items and documents with ids."""
    terms = [(i, plain_terms(t)) for i, t in docs]
    terms = [(i, t) for i, t in terms if t]
    n, total = len(terms), sum(len(t) for _, t in terms)
    df = Counter(t for _, ts in terms for t in set(ts))
    out = {}
    for item, text in items:
        scored = []
        for i, ts in terms:
            tf, m = Counter(ts), 25 + 75 * len(ts) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in plain_terms(text) if tf[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1):
            out[item, rank] = (None if none else i, -s)
    return out


def found(df):
    rows = df.collect()
    out = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in rows}
    assert len(out) == len(rows)
    return out


def test_terms_are_the_contracts():
    for text in ["A-b_c{d}é~Ü\x7f\x80x\x00y 1a2B\tß z ŁŁ", "", "ÀÉ @[`", "日本 語a"]:
        assert [t.decode() for t in L.terms_of(text.encode())] == plain_terms(text)


@pytest.mark.parametrize(("seed", "k", "blocks"), [(1, 3, {}), (2, 10, {"max_items": 4}), (3, 1, {"max_bytes": 60})])
def test_search_equals_brute_force(spark, seed, k, blocks):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(400)]
    docs += [(1000 + i, docs[i % 7][1]) for i in range(40)] + [(2000, None), (2001, " - "), (2002, "w1")]  # ties, no text, no terms
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 12)))) for i in range(30)] + [(99, None), (98, "unseen"), (97, docs[3][1].upper())]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = found(L.ranked_search(spark.createDataFrame(items, "item_id long, text string"), df, k, **blocks))
    assert got == plain_search(items, docs, k)


def test_edges(spark, edge_documents, no_documents):
    items = [(1, "THE cat w3 É"), (2, None), (3, ""), (None, "one three"), (4, "w5 w6 end 'quoted'")]
    df = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS id", "2 AS no", "3 AS score", "4 AS rank")
    got = found(L.ranked_search(df, edge_documents, 10))
    assert got == plain_search(items, [(r.doc_id, r.text) for r in edge_documents.collect()])
    assert L.ranked_search(df, no_documents).collect() == [] == L.ranked_search(df.limit(0), edge_documents).collect()
    assert L.ranked_search(df, no_documents).columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_hold_and_pruning_drops_most_pairs():
    rng = np.random.default_rng(4)
    topics, per, n = 20, 50, 4000
    weights = rng.integers(500, 9000, topics * per).tolist()
    items = [Counter((rng.integers(0, per, 12) + per * (i % topics)).tolist()) for i in range(60)]
    tree = L.Items(items, weights)
    for below, above in zip(tree.levels, tree.levels[1:], strict=False):
        for i in range(len(below)):
            own = dict(zip(below.terms[below.starts[i] : below.starts[i + 1]], below.values[below.starts[i] : below.starts[i + 1]], strict=True))
            up = dict(zip(above.terms[above.starts[i // 8] : above.starts[i // 8 + 1]], above.values[above.starts[i // 8] : above.starts[i // 8 + 1]], strict=True))
            assert all(up[t] >= v for t, v in own.items())
    docs = [np.unique(rng.integers(0, per, rng.integers(3, 40)) + per * rng.integers(topics)) for _ in range(n)]
    impacts = [rng.integers(1, 1_000_000, len(d)) for d in docs]
    search = L.Search(tree, 5)
    for at in range(0, n, 1000):
        part = slice(at, at + 1000)
        search.add(L.Level(np.concatenate([[0], np.cumsum([len(d) for d in docs[part]])]), np.concatenate(docs[part]), np.concatenate(impacts[part])), np.arange(at, at + 1000))
    for item, best in zip(tree.order, search.best, strict=True):
        scores = [(-sum(int(x) * c * weights[t] for t, x in zip(d, v, strict=True) if (c := items[item].get(int(t)))), p) for p, (d, v) in enumerate(zip(docs, impacts, strict=True))]
        assert best == sorted(s for s in scores if s[0])[:5]
    assert search.pairs < 0.25 * n * len(items)
