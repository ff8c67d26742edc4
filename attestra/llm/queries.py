"""The queries of the training-data operators, with the parameters they run with in production, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexical_search, merkle, mixing, near_duplicates, online_packing, packing, pii, quality_classifier, quality_rules, tiff, token_counts, url_filters, warc
from .common import written

def pii_key(spark: SparkSession) -> bytes:
    """The secret of the surrogates, from the session's ``attestra.pii.key`` (at most 64 bytes); unset, as in tests, a known one."""
    return spark.conf.get("attestra.pii.key", "attestra surrogates").encode()


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens; neither documents nor attention cost are limited further."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), max_tokens=4096, end_id=1)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and verdicts of every document."""
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op3_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to dictionary-compressed archives and read back."""
    return warc.read_back(warc.write_archives(_table(spark, sf_dir, "pages")))


def op4_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document under the 32k vocabulary."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op5_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws of all documents: entropy 0.95 of that of equal shares, at most 4 passes, a budget of the whole table's words."""
    return mixing.mixture(_table(spark, sf_dir, "documents"), mixing.word_count(F.col("text")))


def op6_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a TIFF and read back."""
    return tiff.text_media(_table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores and verdicts of every document."""
    return quality_classifier.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: Verdict, host and path of each url rule.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op8_url_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return url_filters.url_verdicts(_table(spark, sf_dir, "pages"), URL_RULES)


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with its personal data replaced."""
    return pii.pseudonymised(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of 5-word shingle similarity 0.75 or more."""
    return near_duplicates.similar_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and every leaf's proof checked, against a tampered leaf where 7 divides the CRC-32 of the id."""
    docs = _table(spark, sf_dir, "documents")
    fields = lambda n_chars: merkle.leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")])
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    offered = F.when(tampered, fields(F.col("n_chars") + 1)).otherwise(fields(F.col("n_chars")))
    manifest = merkle.write_manifest(docs, F.col("lang"), F.col("doc_id"), fields(F.col("n_chars")), {"offered": offered})
    root = F.lit(manifest.root)
    out = merkle.proofs(manifest).select(F.col("key").alias("doc_id"), "leaf", "subroot", root.alias("root"), merkle.sibling_digest(F.col("proof")).alias("proof_sha256"), merkle.folded(F.col("offered"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return lexical_search.ranked_search(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents"), k=10)


def op13_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens, 64 open windows in each task."""
    return online_packing.pack_online(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), max_tokens=4096, end_id=2, windows=64)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_warc_dictionary": op3_warc_dictionary,
    "op4_trie_token_counts": op4_trie_token_counts,
    "op5_temperature_mixing": op5_temperature_mixing,
    "op6_tiff_pages": op6_tiff_pages,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_url_link_graph": op8_url_link_graph,
    "op9_pii_surrogates": op9_pii_surrogates,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_dual_tree_search": op12_dual_tree_search,
    "op13_online_packing": op13_online_packing,
}

_OP3 = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages),
 g AS (SELECT d, octet_length(b) AS n, max(page_id) AS response FROM p WHERE octet_length(b) >= 1000 GROUP BY d, octet_length(b))
SELECT p.page_id, CAST(octet_length(p.b) AS BIGINT) AS payload_bytes, p.d AS payload_digest,
 CASE WHEN g.response <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN g.response <> p.page_id THEN g.response END AS refers_to
FROM p LEFT JOIN g ON g.d = p.d AND g.n = octet_length(p.b)"""

_OP10 = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
 l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 75 * (na.n + nb.n - x)),
 e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT doc_id AS u, doc_id AS v FROM n UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT u, min(v) AS c FROM r GROUP BY u) m ON m.u = d.doc_id"""

_FIELD = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
#: CRC-32 bit by bit: each byte is XORed in and shifted out eight times.
_CRC = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: list_prepend(CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT), list_transform(range(0, 8), lambda j: CAST(-1 AS BIGINT)))))), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"
_OP11 = f"""WITH RECURSIVE leaves AS (SELECT doc_id, lang, {_LEAF.format(n="n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_LEAF.format(n="(n_chars + 1)")} ELSE {_LEAF.format(n="n_chars")} END AS offered FROM documents),
 placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM leaves),
 tree AS (SELECT lang, 0 AS lev, i, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM placed
  UNION ALL SELECT lang, lev + 1, i, node, count(*) OVER (PARTITION BY lang) FROM (SELECT lang, lev, i // 2 AS i, sha256(string_agg(node, '' ORDER BY i)) AS node FROM tree WHERE n > 1 GROUP BY lang, lev, i // 2)),
 subs AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j FROM tree WHERE n = 1),
 top AS (SELECT 0 AS lev, j AS i, subroot AS node, count(*) OVER () AS n FROM subs
  UNION ALL SELECT lev + 1, i, node, count(*) OVER () FROM (SELECT lev, i // 2 AS i, sha256(string_agg(node, '' ORDER BY i)) AS node FROM top WHERE n > 1 GROUP BY lev, i // 2)),
 steps AS (SELECT p.doc_id, t.lev, p.i, s.node AS sib FROM placed p JOIN tree t ON t.lang IS NOT DISTINCT FROM p.lang AND t.i = p.i >> t.lev AND t.n > 1 LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM t.lang AND s.lev = t.lev AND s.i = xor(t.i, 1)
  UNION ALL SELECT p.doc_id, 100 + t.lev, s0.j, s.node FROM placed p JOIN subs s0 ON s0.lang IS NOT DISTINCT FROM p.lang JOIN top t ON t.i = s0.j >> t.lev AND t.n > 1 LEFT JOIN top s ON s.lev = t.lev AND s.i = xor(t.i, 1)),
 proof AS (SELECT doc_id, list(struct_pack(sib := coalesce(sib, ''), own_left := (i >> (lev % 100)) % 2 = 0) ORDER BY lev) AS p FROM steps GROUP BY doc_id),
 fold AS (SELECT l.doc_id, 1 AS k, l.offered AS h, coalesce(p.p, []) AS p FROM leaves l LEFT JOIN proof p ON p.doc_id = l.doc_id
  UNION ALL SELECT doc_id, k + 1, sha256(CASE WHEN p[k].own_left THEN h || p[k].sib ELSE p[k].sib || h END), p FROM fold WHERE k <= len(p)),
 root AS (SELECT node AS root FROM top WHERE n = 1)
SELECT l.doc_id, l.leaf, s.subroot, r.root, sha256(array_to_string(list_transform(f.p, lambda x: x.sib), '')) AS proof_sha256, f.h AS folded_root, f.h = r.root AS verified
FROM placed l JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang JOIN fold f ON f.doc_id = l.doc_id AND f.k = len(f.p) + 1, root r"""

_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_OP12 = f"""WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents), c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
 tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS t FROM d) GROUP BY doc_id, n, t), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
 q AS (SELECT item_id, t, count(*) AS many FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY item_id, t),
 s AS (SELECT q.item_id, tf.doc_id, CAST(sum(q.many * CAST(floor(1000 * ln((2 * c.n_docs + 2) / (2 * df.df + 1))) AS BIGINT) * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 75 + ((75 * tf.n * c.n_docs) // c.n_terms))))) AS BIGINT) AS score
  FROM q JOIN df ON df.t = q.t JOIN tf ON tf.t = q.t, c GROUP BY q.item_id, tf.doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""

#: DuckDB SQL by query; those that SQL cannot express are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {"op3_warc_dictionary": _OP3, "op10_ngram_jaccard_join": _OP10, "op11_merkle_manifest": _OP11, "op12_dual_tree_search": _OP12}
