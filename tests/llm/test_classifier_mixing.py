import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import mixing, quality_classifier


def test_held_out_accuracy(spark):
    """Labels of odd ids train; those of even ids, never seen, judge."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").limit(6000)
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = quality_classifier.quality_scores(docs, labels.filter("doc_id % 2 = 1"), sample=1500)
    rows = out.join(labels.filter("doc_id % 2 = 0"), "doc_id").select("kept", labels["quality"].alias("truth")).collect()
    good, bad = [r for r in rows if r.truth == 1], [r for r in rows if r.truth == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(not r.kept for r in bad) >= 0.95 * len(bad)


def test_views_exchange_verdicts():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400).astype(float)
    a = np.c_[y + rng.normal(0, 0.2, 400), rng.normal(0, 1, 400)]
    b = np.c_[y + rng.normal(0, 0.3, 400)]
    held = np.arange(400) % 4 == 0
    model = quality_classifier.co_train(a, b, y, held, lambda *w: quality_classifier.pseudo_sums(a, b, *w), rounds=2)
    assert all(n > 0 for pair in model.exchanged[:1] for n in pair)
    assert ((model.scores(a, b)[2] > 0.5) == (y == 1)).mean() > 0.98


def test_pool_covers_all_documents(spark):
    """Sums over the table equal a plain loop over every document, those of a language with three documents included."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "source", "n_chars", F.when(F.col("doc_id") < 3, "xx").otherwise(F.col("lang")).alias("lang"))
    text_view, meta_view = quality_classifier.TextView(), quality_classifier.MetadataView()
    rng = np.random.default_rng(1)
    wa, wb = rng.normal(0, 2, text_view.size + 1), rng.normal(0, 2, meta_view.size + 1)
    da, db = len(wa), len(wb)
    plain = np.zeros(2 * (da + 1) + 2 * (db + 1))
    for r in docs.collect():
        a = np.append(text_view(r.text.encode() if r.text is not None else None).astype(np.float16), 1).astype(float)
        b = np.append(meta_view(r.lang, r.source, r.n_chars).astype(np.float16), 1).astype(float)
        pa, pb = 1 / (1 + math.exp(-(a @ wa))), 1 / (1 + math.exp(-(b @ wb)))
        for x, own, other, at in ((a, pa, pb, 0), (b, pb, pa, 2 * (da + 1))):
            label = 1 if other > 0.9 else 0 if 1 - other > 0.9 else None
            if label is not None:
                start = at + label * (len(x) + 1)
                plain[start : start + len(x) + 1] += np.append(1, (own - label) * x)
    sums = quality_classifier.pool_sums(docs.select(F.col("text").cast("binary").alias("t"), "lang", "source", "n_chars"))
    got = sums(wa, wb, 0.9)
    assert plain[0] + plain[da + 1] > 0 and np.allclose(got, plain, atol=1e-4)


def test_classifier_edges(spark, edge_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 0)], "doc_id long, quality int")
    rows = quality_classifier.quality_scores(edge_documents, labels).collect()
    assert len(rows) == edge_documents.count() and all(r.kept for r in rows)
    assert quality_classifier.quality_scores(no_documents, labels).collect() == []
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_classifier.train_quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), known)
    scored = edge_documents.select("doc_id", quality_classifier.quality_column(edge_documents, model)["quality"].alias("q")).collect()
    assert len(scored) == edge_documents.count() and all(0 <= r.q <= 1 for r in scored)
    assert docs.limit(0).select(quality_classifier.quality_column(docs, model)).collect() == []


SOURCES = {"a": 5000, "b": 900, "c": 300, "d": 40}


def corpus(spark):
    rows = [(i, s, 1 + i % 9) for s, n in SOURCES.items() for i in range(n * (ord(s) - 96), n * (ord(s) - 96) + n)]
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long")


def plain_exponent(totals, budget, entropy_share=None, max_repetition=None):
    whole = sum(totals)

    def fine(x):
        p = [(t / whole) ** x for t in totals]
        z = sum(p)
        h = -sum(q / z * math.log(q / z) for q in p)
        return (entropy_share is None or h <= entropy_share * math.log(len(totals)) + 1e-12) and (max_repetition is None or max(q / z * budget / t for q, t in zip(p, totals, strict=True)) <= max_repetition + 1e-12)

    low, high = 0.0, 1.0
    if fine(low):
        return low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if fine(mid) else (mid, high)
    return high


@pytest.mark.parametrize("limits", [{"entropy_share": 0.8}, {"max_repetition": 2.5}, {"entropy_share": 0.9, "max_repetition": 3.0}, {"max_repetition": 1000.0}])
def test_exponent_equals_plain_bisection(spark, limits):
    df = corpus(spark).select(F.col("doc_id").alias("uid"), F.col("source").alias("src"), "tokens")
    sources = mixing.source_totals(df)
    totals = [r.total for r in sources.collect()]
    got = mixing.bisected_exponent(sources, sum(totals), 2 * sum(totals), **limits)
    assert got == pytest.approx(plain_exponent(totals, 2 * sum(totals), **limits), abs=1e-6)


def test_weights_are_realised_by_whole_epochs_and_a_prefix(spark):
    df = corpus(spark)
    total = df.agg(F.sum("tokens")).first()[0]
    draws = mixing.mixture(df, F.col("tokens"), entropy_share=0.9, max_repetition=6.0).collect()
    tokens = defaultdict(int)
    for r in df.collect():
        tokens[r.source] += r.tokens
    x = plain_exponent(list(tokens.values()), total, 0.9, 6.0)
    z = sum((t / total) ** x for t in tokens.values())
    used, times = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for r in draws:
        used[r.source] += r.tokens
        times[r.source][r.doc_id] += 1
    for s, t in tokens.items():
        budget = (t / total) ** x / z * total
        assert budget - 1.001 <= used[s] < budget + 10.001  # whole numbers of tokens, and the last document is taken whole
        most = math.ceil(budget / t)
        assert set(times[s].values()) <= {most, most - 1} and (most == 1 or len(times[s]) == SOURCES[s])
    again = mixing.mixture(df.repartition(7), F.col("tokens"), entropy_share=0.9, max_repetition=6.0).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, draws))


def entropy(weights):
    whole = sum(weights)
    return -sum(w / whole * math.log(w / whole) for w in weights if w)


@pytest.mark.parametrize(("totals", "share"), [([100, 101, 99, 98, 103], 0.8), ([500, 400, 450, 10], 0.5), ([10**12, 10**12 - 10**10], 0.3)])
def test_exponents_beyond_one_sharpen_to_the_target(spark, totals, share):
    sources = spark.createDataFrame([(str(i), t, 5) for i, t in enumerate(totals)], "src string, total long, docs long")
    x = mixing.bisected_exponent(sources, sum(totals), sum(totals), entropy_share=share)
    assert x > 1 and entropy([(t / max(totals)) ** x for t in totals]) == pytest.approx(share * math.log(len(totals)), abs=1e-4)
    weighted = mixing.whole_shares(mixing.temperature_weights(sources, sum(totals), x), 12345)
    shares = {r.src: r.share for r in weighted.collect()}
    z = sum((t / max(totals)) ** x for t in totals)
    assert sum(shares.values()) == 12345 and all(abs(shares[str(i)] - (t / max(totals)) ** x / z * 12345) < 1 for i, t in enumerate(totals))


def test_targets_out_of_reach_warn(spark):
    source = lambda *totals: spark.createDataFrame([(str(i), t, 5) for i, t in enumerate(totals)], "src string, total long, docs long")
    with pytest.warns(UserWarning, match="target"):
        assert mixing.bisected_exponent(source(7, 7, 7), 21, 21, entropy_share=0.5) == 1.0
    with pytest.warns(UserWarning, match="repeats every source"):
        assert mixing.bisected_exponent(source(7, 8), 15, 60, max_repetition=2.0) == 1.0
    with pytest.warns(UserWarning, match="repetition limit keeps"):
        x = mixing.bisected_exponent(source(100, 90, 80), 270, 270, entropy_share=0.3, max_repetition=1.5)
    p = [t**x for t in (100, 90, 80)]
    assert p[0] / sum(p) * 270 / 100 == pytest.approx(1.5, abs=1e-3)


def test_whole_budget_at_exponent_one_takes_every_document_once(spark):
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        draws = mixing.mixture(docs, mixing.word_count(F.col("text")), entropy_share=None, max_repetition=1.0)
        assert draws.count() == draws.select("doc_id").distinct().count() == docs.filter(mixing.word_count(F.col("text")) > 0).count()
        assert draws.filter("epoch > 0").isEmpty()


def test_query_meets_its_target(spark, recwarn):
    from attestra.llm import queries

    for sf in ("sf0.001", "sf0.1"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").withColumn("n", mixing.word_count(F.col("text")))
        before = {r.source: r.n for r in docs.groupBy("source").agg(F.sum("n").alias("n")).collect()}
        drawn = {r.source: r.n for r in queries.op5_temperature_mixing(spark, f"/root/testdata/{sf}").groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
        most = math.log(len(before))
        assert entropy(before.values()) / most > 0.96 and entropy(drawn.values()) / most == pytest.approx(0.95, abs=0.01)
        longest = docs.agg(F.max("n")).first()[0]
        assert all(n <= 4 * before[s] + longest for s, n in drawn.items())
        assert abs(sum(drawn.values()) - sum(before.values())) <= longest * len(before)
    assert not [w for w in recwarn if "mixture" in str(w.message) or "budget" in str(w.message)]


def test_mixing_edges(spark, edge_documents, no_documents):
    words = mixing.word_count(F.col("text"))
    draws = mixing.mixture(edge_documents, words)
    assert {r.source for r in draws.collect()} <= {"a", "b", None}
    out = mixing.mixed(edge_documents, words, max_repetition=1.0, entropy_share=None)
    assert out.columns == edge_documents.columns and out.count() >= 1
    assert mixing.mixture(no_documents, words).collect() == []
    assert mixing.mixed(no_documents, words).collect() == []


def test_mixed_keeps_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    from attestra.llm import mixing

    rows = [(i, f"word {i} text", f"s{i % 3}", "keep") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, k__ string")
    for name in ("own_source", "drawn_id", "drawn_source", "drawn_times", "drawn_at"):
        df = df.withColumn(name, F.lit("keep"))
    out = mixing.mixed(df, mixing.word_count(F.col("text")))
    assert out.columns == df.columns and out.filter("k__ <> 'keep' or drawn_id <> 'keep' or drawn_at <> 'keep'").isEmpty() and out.count() > 0
