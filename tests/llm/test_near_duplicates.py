import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestra.llm import near_duplicates as nd
from attestra.llm.components import connected_components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sets_of(texts):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def plain_components(ids, texts):
    sets, parent = sets_of(texts), list(range(len(ids)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(ids)):
        for j in range(i):
            x = len(sets[i] & sets[j])
            if x and 100 * x >= 75 * (len(sets[i]) + len(sets[j]) - x):
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(d, least.get(root(i), d))
    return {(d, len(s), least[root(i)]) for i, (d, s) in enumerate(zip(ids, sets, strict=True))}


def planted(seed):
    """Chains of edits, hubs whose spokes are not similar to each other, shared passages, tiny sets at the very threshold."""
    rng = random.Random(seed)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(6):
        base = [word() for _ in range(rng.choice([6, 9, 30, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([2, 5, 25])):
            w = base[:]
            for _ in range(rng.randrange(1, 1 + max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w).upper() if rng.random() < 0.3 else "\n".join(w))
            if rng.random() < 0.3:
                base = w
    texts += [" ".join(passage + [word() for _ in range(rng.randrange(5, 90))]) for _ in range(40)]
    texts += ["a b c d e f g", "a b c d e f g h", "a b c d e f", "a b c d", "A B C D", "a", "", None]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed, monkeypatch):
    texts = planted(seed)
    ids = [i * 7 % 100_003 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in nd.similar_components(df).collect()}
    assert got == plain_components(ids, texts)


def test_hot_blocks_and_lots(spark, monkeypatch):
    """The ways for very common blocks give the same components."""
    texts = planted(3)
    ids = list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    hot = nd._entries
    monkeypatch.setattr(nd, "HOT", 2)
    monkeypatch.setattr(nd, "_entries", lambda *a: hot(*a, slice_rows=30))
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in nd.similar_components(df, chunk=3).collect()}
    assert got == plain_components(ids, texts)


@settings(max_examples=60, deadline=None)
@given(st.integers(3, 900), st.integers(0, 10**9))
def test_similar_sets_share_a_block_and_sketches_bound_the_difference(size, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
    blocks = nd.Blocks(0.75)
    gone = rng.integers(0, max(1, len(a) // 7) + 1)
    new = np.unique(rng.integers(0, 2**63, gone, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    b = np.unique(np.concatenate([rng.permutation(a)[gone:], new]))
    both = len(np.intersect1d(a, b))
    x, y = nd.parity_sketch(a), nd.parity_sketch(b)
    n = min(len(x), len(y))
    assert np.bitwise_count(nd.folded(x, n) ^ nd.folded(y, n)).sum() <= len(a) + len(b) - 2 * both
    if 100 * both >= 75 * (len(a) + len(b) - both) and both < max(len(a), len(b)):
        assert set(blocks(a).tolist()) & set(blocks(b).tolist())


def test_one_document_of_each_group_stays(spark, edge_documents):
    kept = nd.drop_similar(edge_documents)
    assert kept.columns == edge_documents.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 5, 7, None], key=str)


def test_edges(spark, edge_documents, no_documents):
    rows = {(r.doc_id, r.component_id) for r in nd.similar_components(edge_documents).collect()}
    assert rows == {(1, 1), (2, 2), (3, 3), (4, 4), (None, None), (5, 5), (6, 5), (7, 7)}
    assert nd.similar_components(no_documents).collect() == []


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)] + [(500, 500)]
    parent = defaultdict(lambda: None)

    def root(a):
        while parent[a] is not None:
            a = parent[a]
        return a

    for u, v in edges:
        if root(u) != root(v):
            parent[max(root(u), root(v))] = min(root(u), root(v))
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: root(n) for e in edges if e[0] != e[1] for n in e}


def test_sets_with_too_few_blocks_are_compared_with_all(spark, monkeypatch):
    texts = planted(5)
    ids = list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    monkeypatch.setattr(nd.Blocks, "count", lambda self, band: 2**20 if band < 5 else 8 + 2**band // 4)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in nd.similar_components(df).collect()}
    assert got == plain_components(ids, texts)


def test_rows_grow_with_a_group_of_near_copies(spark, monkeypatch):
    """Twice the copies make about twice the rows in every table on the way, not four times."""
    old, most = nd.checkpointed, []

    def counted(df):
        out = old(df)
        most[-1] = max(most[-1], out.count() if "grp" in out.columns else 0)
        return out

    monkeypatch.setattr(nd, "checkpointed", counted)
    for m in (400, 800):
        rng = random.Random(5)
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts = []
        for i in range(m):
            w = base[:]
            for _ in range(rng.randrange(1, 6)):
                w[rng.randrange(200)] = f"x{rng.randrange(5000)}y{i}"
            texts.append((i, " ".join(w)))
        most.append(0)
        assert nd.similar_components(spark.createDataFrame(texts, "doc_id long, text string"), chunk=200).select("component_id").distinct().count() == 1
    assert most[1] < 3.2 * most[0]


def test_members_of_hot_blocks_are_joined_packed(spark):
    import numpy as np

    from attestra.llm.near_duplicates import _members

    pack = lambda *keys: np.array(keys, dtype=np.int64).tobytes()
    packed = spark.createDataFrame([(7, pack(5, 9)), (7, pack(9, -3, 4)), (8, pack(*range(1000)))], "block long, data binary")
    out = _members(packed)
    assert out.filter("block = 7").sort("key").collect() == [(7, -3, 5, k) for k in (-3, 4, 5, 9)]
    assert out.filter("block = 8").selectExpr("min(least)", "max(m)", "count(*)").first() == (0, 1000, 1000)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInPandas unpack") < plan.index("Join Inner")  # above the join: members come out after it


def test_hot_blocks_are_listed_by_group_and_class(spark):
    """A group's hot blocks are counted for each class, without repeats; the classes left out are those with blocks to spare."""
    from collections import Counter

    from pyspark.sql import functions as F

    rng = random.Random(6)
    blocks = {b: [b % 5 * 1000 - 3000, *rng.sample(range(-900, 900), 200)] for b in range(60)}
    rows = [(b, part) for b, keys in blocks.items() for part in (keys[:150], keys[100:])]  # some keys come twice
    packed = spark.createDataFrame([(b, np.array(keys, dtype=np.int64).tobytes()) for b, keys in rows], "block long, data binary")
    entries = {b: 251 for b in blocks}
    held = nd._held(packed, 7)
    plain = nd._members(packed).groupBy(F.col("least").alias("grp"), F.col("block").bitwiseAND(F.lit(1)).alias("odd"), "key").agg(F.count(F.lit(1)).alias("n"), F.max("m").alias("m"))
    want = Counter((min(keys), b & 1, k) for b, keys in blocks.items() for k in keys)
    assert {(r.grp, r.odd, r.key): r.n for r in held.collect()} == want
    assert sorted(held.collect()) == sorted(plain.select(held.columns).collect())
    assert {r.m for r in held.collect()} == set(entries.values())
    spare = {k: rng.randrange(12) << 15 | rng.randrange(12) for *_, k in want}
    looked = nd._looked_at(held, spark.createDataFrame(list(spare.items()), "key long, spare int"))
    order = sorted({(g, odd) for g, odd, _ in want}, reverse=True)  # all blocks have the same number of entries
    left = set()
    for k in spare:
        for odd in (0, 1):
            upto = 0
            for g in (g for g, o in order if o == odd and (g, o, k) in want):
                upto += want[g, odd, k]
                if upto > (spare[k] >> 15 if odd else spare[k] & (2**15 - 1)):
                    left.add((g, k))
    assert {tuple(r) for r in looked.collect()} == left


def test_no_step_lists_every_hot_block_of_every_document(spark, monkeypatch):
    """Texts that share a long passage have dozens of hot blocks each; what Python steps return stays at a few rows for each text."""
    made = {}
    frame = type(spark.range(1))
    grouped = type(spark.range(1).groupBy("id"))
    old_map, old_apply = frame.mapInPandas, grouped.applyInPandas

    def map_in_pandas(self, run, schema, *more, **named):
        rows = made[f"{len(made)} {run.__name__}"] = spark.sparkContext.accumulator(0)

        def counted(batches):
            for batch in run(batches):
                rows.add(len(batch))
                yield batch

        return old_map(self, counted, schema, *more, **named)

    def apply_in_pandas(self, run, schema):
        rows = made[f"{len(made)} {run.__name__}"] = spark.sparkContext.accumulator(0)

        def counted(group):
            out = run(group)
            rows.add(len(out))
            return out

        return old_apply(self, counted, schema)

    monkeypatch.setattr(frame, "mapInPandas", map_in_pandas)
    monkeypatch.setattr(grouped, "applyInPandas", apply_in_pandas)
    passage = " ".join(f"p{i}" for i in range(150))
    texts = [(i, passage + " " + " ".join(f"w{i}x{j}" for j in range(50))) for i in range(600)]
    assert nd.similar_components(spark.createDataFrame(texts, "doc_id long, text string")).filter("doc_id = component_id").count() == 600
    assert max(x.value for x in made.values()) < 10 * len(texts), {k: x.value for k, x in made.items()}
