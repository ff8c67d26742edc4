import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from attestra.llm import token_counts, url_filters
from attestra.llm.queries import URL_RULES

public_tokenizers = pytest.importorskip("public_tokenizers")


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fit = [(h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda r: len(r[0])) if fit else (None, None)


URLS = [
    "http://a.example.com/en/1", "https://WWW.Example.COM/en/x?y#z", "http://x.www.example.com/en/", "http://com/", "http://com", "http://notcom/", "http://b.net/es/1", "http://b.net/fr", "http://net/fr/", "ftp://h.org?x=/en/", "http://h.net#/es/", "no url", "://", "http://", None, "a://b://c.com/d", "http://xexample.com/en/1", "http://é.NET/es/ü", "http://h.com:80/en/", "http://b.net/es/\nnew",
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)], "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS salt", "3 AS r")
    got = {r.page_id: r for r in url_filters.url_verdicts(pages, URL_RULES).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = plain_url(u)
        rule, verdict = plain_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert verdict is None or got[i].verdict == verdict
    assert url_filters.url_verdicts(pages.limit(0), URL_RULES).collect() == []


def test_propagation_equals_power_iteration(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 3), ("d", "c", 1), ("b", "d", 1), ("c", "end", 2)]
    seeds = {"a": 3.0, "d": 1.0}
    score = {h: s / 4 for h, s in seeds.items()}
    for _ in range(200):
        new = defaultdict(float)
        lost = 0.85 * sum(s for h, s in score.items() if all(u != h for u, _, _ in edges))
        for u, v, n in edges:
            new[v] += 0.85 * score.get(u, 0) * n / sum(m for x, _, m in edges if x == u)
        for h, s in seeds.items():
            new[h] += (0.15 + lost) * s / 4
        score = new
    df = spark.createDataFrame([("trust", *e) for e in edges], "kind string, src string, dst string, n long")
    sd = spark.createDataFrame([("trust", h, s) for h, s in seeds.items()], "kind string, host string, seed double")
    got = {r.host: r.score for r in url_filters.propagated(df, sd, tolerance=1e-9).collect()}
    assert got.keys() == score.keys() and all(got[h] == pytest.approx(score[h], abs=1e-6) for h in score)
    assert sum(got.values()) == pytest.approx(1.0, abs=1e-6)


def plain_chain(host):
    """The host and what lies above it, down to one label before the public suffix (of the hosts in these tests)."""
    out = [host]
    while "." in out[-1].split(".", 1)[-1] and out[-1].split(".", 1)[1] not in ("co.uk", "org.uk", "github.io") and not re.fullmatch("[0-9.]+", host):
        out.append(out[-1].split(".", 1)[1])
    return out


def test_site_chains_end_at_the_registered_domain(spark):
    hosts = {"a.b.c.com": ["a.b.c.com", "b.c.com", "c.com"], "c.com": ["c.com"], "com": ["com"], "x.f.co.uk": ["x.f.co.uk", "f.co.uk"], "f.co.uk": ["f.co.uk"], "co.uk": ["co.uk"], "u.github.io": ["u.github.io"], "w.u.github.io": ["w.u.github.io", "u.github.io"], "10.0.0.1": ["10.0.0.1"], "10.0.0.1:80": ["10.0.0.1:80"], "a.h.com:80": ["a.h.com:80", "h.com:80"], "x.f.co.uk:8080": ["x.f.co.uk:8080", "f.co.uk:8080"], "": [""], "a.co.com": ["a.co.com", "co.com"]}
    got = {r.h: list(r.c) for r in spark.createDataFrame([(h,) for h in hosts], "h string").select("h", url_filters.site_chain(F.col("h")).alias("c")).collect()}
    assert got == hosts
    assert all(plain_chain(h) == c for h, c in hosts.items() if ":" not in h and h)


def test_verdicts_on_the_given_pages_equal_a_dense_computation(spark):
    """The given pages link within their hosts only; edges come from the domains above."""
    from attestra.llm import queries

    sf = "/root/testdata/sf0.1"
    got = [(r.host, r.rule, r.verdict) for r in queries.op8_url_link_graph(spark, sf).collect()]
    rows = [(i, r.url, r.html) for i, r in enumerate(spark.read.parquet(f"{sf}/pages.parquet").collect())]
    expected = plain_verdicts(rows)
    assert sorted((h, v) for h, _, v in got) == sorted((plain_url(u)[0], expected[i]) for i, u, _ in rows)
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(url_filters.host_and_path(F.col("url"))[0].alias("host"), "html")
    edges = url_filters.host_edges(pages)
    assert edges.count() > 100 and {"example.com", "example.net", "example.org"} <= {r.dst for r in edges.select("dst").distinct().collect()}


def test_unseeded_hosts_of_a_site_follow_its_other_hosts(spark):
    rows = [(1, "http://a.bad.net/es/1", ""), (2, "http://b.bad.net/x", ""), (3, "http://c.x.good.com/", ""), (4, "http://y.good.co.uk/", ""), (5, "http://z.other.co.uk/", ""), (6, "http://w.bad.net.evil.org/", "")]
    got = {r.page_id: r.verdict for r in url_filters.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow"}


def plain_verdicts(rows):
    """Dense: the whole way from urls and html to verdicts."""
    host = {i: plain_url(u)[0] for i, u, _ in rows}
    known, n = set(host.values()) - {""}, defaultdict(float)
    for i, _, html in rows:
        base = re.search(r'<base href="https?://([^/"]*)', html or "")
        for to in re.findall(r'<a[^>]* href="([^"]*)"', html or ""):
            absolute = re.match(r"(?:https?:)?//([^/?#]*)", to)
            dst = absolute[1].lower() if absolute else "" if re.match("[a-z]+:", to) else base[1].lower() if base else host[i]
            n[host[i], dst] += 1
    for below, up in {(x[i], x[i + 1]) for h in known for x in [plain_chain(h)] for i in range(len(x) - 1)}:
        n[below, up] += 1
        n[up, below] += 1
    edges = {e: w for e, w in n.items() if e[0] and e[1] and e[0] != e[1]}
    seeds = {"allow": defaultdict(float), "block": defaultdict(float)}
    ruled = {i: plain_rule(*plain_url(u))[1] for i, u, _ in rows}
    for i, v in ruled.items():
        if v:
            seeds[v][host[i]] += 1
    scores = {}
    for v, graph in (("allow", edges), ("block", {(b, a): w for (a, b), w in edges.items()})):
        total = sum(seeds[v].values())
        start = {h: s / total for h, s in seeds[v].items()} if total else {}
        score = dict(start)
        for _ in range(300):
            new = defaultdict(float)
            out = defaultdict(float)
            for (a, _), w in graph.items():
                out[a] += w
            for (a, b), w in graph.items():
                new[b] += 0.85 * score.get(a, 0) * w / out[a]
            back = 0.15 + 0.85 * sum(s for h, s in score.items() if not out.get(h))
            for h, s in start.items():
                new[h] += back * s
            score = new
        scores[v] = score
    return {i: ruled[i] or ("block" if scores["block"].get(host[i], 0) > scores["allow"].get(host[i], 0) else "allow") for i in host}


def test_verdicts_equal_a_dense_computation(spark):
    import random

    rng = random.Random(8)
    hosts = ["a.com", "b.net", "c.org", "x.c.org", "y.x.c.org", "d.org", "e.org", "f.co.uk", "g.co.uk", "h.de", "s.h.de"]
    rows = []
    for i in range(120):
        links = [rng.choice([f"http://{rng.choice(hosts)}/x", f"//{rng.choice(hosts).upper()}/y", "/own", "mailto:a@b.c", "page?q=1"]) for _ in range(rng.randrange(4))]
        base = f'<base href="https://{rng.choice(hosts)}/">' if rng.random() < 0.2 else ""
        path = rng.choice(["/es/1", "/fr/2", "/en/3", "/"])
        rows.append((i, f"http://{rng.choice(hosts)}{path}", base + "".join(f'<a class="k" href="{x}">t</a>' for x in links)))
    got = {r.page_id: r.verdict for r in url_filters.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES).collect()}
    assert got == plain_verdicts(rows) and "block" in got.values()


def test_links_carry_distrust_backwards_and_trust_forwards(spark):
    link = lambda to: f'<A class="x" href="{to}">t</A>'
    rows = [(1, "http://bad.net/es/1", ""), (2, "http://farm.org/1", link("http://bad.net/es/1") * 3), (3, "http://good.com/", link("//news.org/x") + link("/own")), (4, "http://news.org/x", ""), (5, "http://alone.org/", None)]
    got = {r.page_id: r.verdict for r in url_filters.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def plain_counts(word, scores, byte_score):
    """Every segmentation by recursion from the front."""
    best = {len(word): (0.0, 0, 0)}
    for at in range(len(word) - 1, -1, -1):
        n = len(word[at].encode())
        s, t, f = best[at + 1]
        options = [(s + n * byte_score, t - n, f + n)]
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in scores:
                s, t, f = best[end]
                options.append((s + scores[word[at:end]], t - 1, f))
        best[at] = max(options, key=lambda o: (o[0], o[1], -o[2]))
    return -best[0][1], best[0][2]


PIECES = {p: float(-i) for i, p in enumerate(["a", "b", "ab", "abc", "▁", "▁a", "ba", "cab", "é", "bca"])}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcé€", max_size=9), min_size=1, max_size=12))
def test_trie_counts_equal_plain_dynamic_programming(words):
    words = ["▁" + w for w in words]
    pieces, expected = token_counts.PieceTrie(PIECES), {w: plain_counts(w, PIECES, -50.0)[0] for w in words}
    trie, tight = token_counts.PrefixTrie(pieces, -50.0), token_counts.PrefixTrie(pieces, -50.0, max_nodes=14)
    for w in [*words, *words]:
        assert trie.insert(w)[0] == tight.insert(w)[0] == expected[w] and len(tight) <= 14
    assert len(trie) == len({w[:n] for w in words for n in range(len(w) + 1)})  # one forward score for each prefix


def test_counts_of_texts(spark, edge_documents, no_documents):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scores = token_counts.vocabulary_scores(path)
    floor = min(scores.values()) - 10
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in token_counts.token_counts(docs, path).limit(25).collect():
        words = texts[r.doc_id].split()
        assert r.n_pretokens == len(words)
        assert r.n_tokens == sum(plain_counts("▁" + w, scores, floor)[0] for w in words)
    assert token_counts.token_counts(edge_documents, path).count() == edge_documents.count()
    assert token_counts.token_counts(no_documents, path).collect() == []


def test_pipeline_equals_its_parts(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from attestra.llm import near_duplicates, pii

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near duplicates", "personal data", "source mixture", "packing"]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:4]:
        seen.append(stage(spark, seen[-1], d).cache())
        assert seen[-1].columns == docs.columns and seen[-1].dtypes == docs.dtypes
    good, single, clean, mixed = seen[1:]
    assert single.count() == near_duplicates.similar_components(good).filter("doc_id = component_id").count()
    assert clean.count() == single.count() and not any(pii.entities(r.text) and set(e for *_, e in pii.entities(r.text)) & set(e for *_, e in pii.entities(o.text)) for r, o in zip(clean.orderBy("doc_id").collect(), single.orderBy("doc_id").collect(), strict=True))
    assert all(r.n_chars == len(r.text) for r in clean.collect())
    assert mixed.join(clean, "doc_id", "left_anti").count() == 0
    out = corpus_pipeline.run(spark, d)
    drawn = sorted(r.doc_id for r in mixed.collect())
    assert sorted(r.doc_id for r in out.filter("piece = 0").collect()) == drawn
    assert out.groupBy("sequence_id").sum("length").filter("`sum(length)` > 4096").count() == 0


def test_pipeline_stages_take_odd_rows(spark, edge_documents):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = edge_documents.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() >= 1


def test_pipeline_of_an_empty_table(spark, no_documents, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    no_documents.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pages_with_names_that_clash(spark):
    rows = [(i, f"http://h{i % 3}.example.com/en/{i}", f"<p>{'x' * 1200}</p>" if i % 2 else None) for i in range(12)] + [(None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    plain = sorted(map(tuple, url_filters.url_verdicts(pages, URL_RULES).collect()), key=str)
    for name in ("id", "host", "path", "r", "salt", "trust", "distrust", "src", "dst", "n", "kind", "chain"):
        pages = pages.selectExpr("*", f"'clash' AS {name}")
    assert sorted(map(tuple, url_filters.url_verdicts(pages, URL_RULES).collect()), key=str) == plain
    renamed = pages.withColumnRenamed("url", "address").withColumnRenamed("html", "body").selectExpr("*", "'clash' AS url", "'clash' AS html")
    assert sorted(map(tuple, url_filters.url_verdicts(renamed, URL_RULES, url_col="address", html_col="body").collect()), key=str) == plain
