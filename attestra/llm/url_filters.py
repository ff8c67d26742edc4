"""URL filters by link-graph propagation (operator 8), in DataFrame and SQL functions only.

Rules decide the urls that they fit. The verdict on all others is their host's: personalised PageRank carries trust from
hosts whose pages rules allow along the host edges, and distrust from hosts whose pages rules block against them; a host
whose distrust exceeds its trust by a factor is blocked. Edges are the links between hosts, relative ones by the page's
base, and those between a host and the domains above it up to the one that was registered, with pages or without, which make
the hosts of a site neighbours even where pages link within their host only. Nothing leads on to a public suffix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased. Path: from there up to ``? #`` or the end.
    A null url or one without ``://`` has an empty host and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Of rules (verdict, host, path) the longest that fits, as struct (rule, verdict), or null. The list is part of the query."""
    fits = [
        (F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))))
        for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    ]
    return F.coalesce(*fits)


#: Labels under which registries of two-letter countries register, and suffixes under which hosting services do.
REGISTRY_LABELS = ["ac", "co", "com", "edu", "gen", "go", "gob", "gouv", "gov", "govt", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch"]
SHARED_SUFFIXES = ["appspot.com", "blogspot.com", "cloudfront.net", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "vercel.app", "web.app", "wordpress.com", "workers.dev"]


def site_chain(host: Column, shared: list[str] | None = None) -> Column:
    """The host and the domains above it, up to the registered one: the one label that stands before the public suffix. That is the
    last label, or the last two under a country's registry label or if they are of ``shared`` (default: SHARED_SUFFIXES).
    Addresses of digits, and hosts that are a public suffix, stand alone."""
    labels = F.split(host, "\\.")
    n = F.size(labels)
    last, second = F.element_at(labels, -1), F.when(n > 1, F.element_at(labels, -2)).otherwise("")
    two = (F.length(F.regexp_replace(last, ":.*", "")) == 2) & second.isin(REGISTRY_LABELS) | F.concat_ws(".", second, last).isin(SHARED_SUFFIXES if shared is None else shared)
    least = F.when(two, 3).otherwise(2)
    chain = F.transform(F.sequence(F.lit(1), n - least + 1), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    return F.when((n <= least) | host.rlike("^[0-9.]+(:[0-9]*)?$"), F.array(host)).otherwise(chain)


def _absolute_host(url: Column) -> Column:
    """The lower-cased host of an absolute http link, else an empty text."""
    return F.translate(F.regexp_extract(url, "(?i)^(?:https?:)?//([^/?#]*)", 1), UPPER, LOWER)


def host_edges(pages: DataFrame, html_col: str = "html", parent_weight: int = 1) -> DataFrame:
    """Edges (src, dst, n) between different hosts of pages (host, html): links, and host and parent both ways.

    Relative links lead to the host of the page's ``<base>``, else stay on its own. A step up to the domain above counts
    ``parent_weight`` links, both ways, as far as the registered domain (``site_chain``).
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    links = F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']?([^\s"'<>]+)"""), F.lit(1))
    base = _absolute_host(F.regexp_extract(html, r"""(?is)<base\s[^>]*?href\s*=\s*["']?([^\s"'<>]+)""", 1))
    linked = pages.select(F.col("host").alias("src"), base.alias("base"), F.explode(links).alias("to"))
    relative = ~F.col("to").rlike("(?i)^(?:[a-z][a-z0-9+.-]*:|//)")
    to = F.when(relative, F.when(F.col("base") != "", F.col("base")).otherwise(F.col("src"))).otherwise(_absolute_host(F.col("to")))
    linked = linked.select("src", to.alias("dst")).filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    chain = pages.select("host").distinct().select(site_chain(F.col("host")).alias("chain"))
    steps = F.transform(F.sequence(F.lit(1), F.size("chain") - 1), lambda i: F.struct(F.get(F.col("chain"), i - 1).alias("src"), F.get(F.col("chain"), i).alias("dst")))
    up = chain.filter(F.size("chain") > 1).select(F.explode(steps).alias("e")).select("e.*").distinct().withColumn("n", F.lit(parent_weight).cast("long"))
    both = linked.unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    return both.filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-3, edges_per_part: int = 200_000) -> DataFrame:
    """Personalised PageRank of seeds (kind, host, seed) over edges (kind, src, dst, n), each kind a graph of its own.

    Returns (kind, host, score); the scores of a kind sum to 1. Seeds and weights are normalised within their kind and
    source. The mass of hosts without edges goes back to the seeds, by way of an empty host that all of them lead to. Edges
    and scores are combined per host before each shuffle. The rounds end when five of them change the scores of a kind by no
    more than ``tolerance`` in all, as they do sooner or later because each shrinks the change by ``damping``.
    """
    parts = 1 + edges.count() // edges_per_part  # as many partitions in each round as the edges fill, not one for each task of the pages
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("out"))
    step = edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("out")).alias("w"))
    total = seeds.groupBy("kind").agg(F.sum("seed").alias("total"))
    start = checkpointed(seeds.join(total, "kind").select("kind", "host", (F.col("seed") / F.col("total")).alias("seed")).coalesce(parts))
    ends = edges.select("kind", F.col("dst").alias("host")).unionByName(start.select("kind", "host")).distinct().join(out.select("kind", F.col("src").alias("host")), ["kind", "host"], "left_anti")
    back = ends.select("kind", "host", F.lit("").alias("dst"), F.lit(1.0).alias("w"))
    step = checkpointed(step.unionByName(back).unionByName(start.select("kind", F.lit("").alias("host"), F.col("host").alias("dst"), (F.col("seed") / damping).alias("w"))).coalesce(parts))
    score, before, k = start.select("kind", "host", F.col("seed").alias("score")), start.select("kind", "host", F.col("seed").alias("score")), 0
    while True:
        moved = score.join(step, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (damping * F.col("score") * F.col("w")).alias("score"))
        again = start.select("kind", "host", ((1 - damping) * F.col("seed")).alias("score"))
        score = moved.unionByName(again).groupBy("kind", "host").agg(F.sum("score").alias("score")).coalesce(parts)
        k += 1
        if k % 5 == 0:
            score = checkpointed(score)
            change = score.select("*", F.lit(1).alias("sign")).unionByName(before.select("*", F.lit(-1).alias("sign"))).groupBy("kind", "host").agg(F.sum(F.col("sign") * F.col("score")).alias("by"))
            most = change.groupBy("kind").agg(F.sum(F.abs("by")).alias("by")).agg(F.max("by")).first()[0]
            if most is None or most <= tolerance:
                return score.filter("host <> ''")
            before = score


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", factor: float = 1.0, parent_weight: int = 1, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, host, path, rule, verdict, trust and distrust (of the host) of every page.

    Seeds are weighted by the pages that a rule decides. Hosts that neither score reaches are allowed, and so are null urls
    and those without a host. Scores are compared, and given, to 9 decimals, so that the order of sums decides nothing; ties are allowed. Repeated rows are judged alike; null html has no links; an empty table gives no rows; only
    id_col, url_col and html_col are read.
    """
    host, path = host_and_path(F.col(url_col))
    seen = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    ruled = seen.withColumn("r", best_rule(F.col("host"), F.col("path"), rules))
    edges = checkpointed(host_edges(seen, parent_weight=parent_weight))
    graph = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    judged = ruled.select("id", "host", "path", "r").filter("r is not null")
    seeds = judged.groupBy(F.when(F.col("r.verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count(F.lit(1)).cast("double").alias("seed"))
    score = propagated(graph, seeds)
    by_host = score.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")])
    salts = 32  # one host may have a third of the pages
    by_host = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = ruled.select("id", "host", "path", "r", F.pmod(F.xxhash64("id", "path"), F.lit(salts)).cast("int").alias("salt")).join(by_host, ["host", "salt"], "left")
    trust, distrust = (F.round(F.coalesce(F.col(c), F.lit(0.0)), 9) for c in ("trust", "distrust"))
    verdict = F.coalesce(F.col("r.verdict"), F.when(distrust > factor * trust, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))

