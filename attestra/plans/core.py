"""Queries of the registry, similarity and credential operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import hashes as H
from attestra.operators import aggregates as A
from attestra.operators import joins as J
from attestra.operators import windows as W
from attestra.sources import registry as R

from . import fixtures as X
from .fixtures import with_tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query (spark, sf_dir) and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("src1_ingest_text", "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS sha256 FROM documents")
def src1(spark: SparkSession, d: str) -> DataFrame:
    return R.hashed_media(X.table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content")))


@query("src2_read_registry", "SELECT doc_id, lang, CAST(NULL AS VARCHAR) AS phash, CAST(NULL AS VARCHAR) AS audio_fingerprint FROM documents")
def src2(spark: SparkSession, d: str) -> DataFrame:
    return R.read_registry(spark, f"{d}/documents.parquet").select("doc_id", "lang", "phash", "audio_fingerprint")


@query(
    "src3_append_registry",
    with_tables("reg")
    + """SELECT fingerprint, original_filename, (SELECT max(id) FROM reg) + row_number() OVER (ORDER BY original_filename, fingerprint) AS id, 'sha256' AS fingerprint_algorithm, CAST(NULL AS VARCHAR) AS ip_address, 1735689600 AS upload_date
FROM reg WHERE media_kind = 'video'""",
)
def src3(spark: SparkSession, d: str) -> DataFrame:
    reg = X.reg(spark, d)
    new = reg.filter("media_kind = 'video'").select("fingerprint", "original_filename")
    return R.append_registry(new, reg, F.lit(1735689600), ["original_filename", "fingerprint"])


@query("src4_evolve_registry", with_tables("reg") + "SELECT id, fingerprint, CAST(NULL AS VARCHAR) AS phash, CAST(NULL AS VARCHAR) AS audio_fingerprint FROM reg")
def src4(spark: SparkSession, d: str) -> DataFrame:
    return R.evolve_registry(R.evolve_registry(X.reg(spark, d))).select("id", "fingerprint", "phash", "audio_fingerprint")


@query("src5_url_list", "SELECT trim(url) AS url, 'authentic' AS category FROM (SELECT CASE page_id % 5 WHEN 0 THEN '# ' || url WHEN 1 THEN '  ' || url || ' ' WHEN 2 THEN '   ' ELSE url END AS url FROM pages) WHERE trim(url) <> '' AND NOT starts_with(trim(url), '#')")
def src5(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 5
    lines = X.table(spark, d, "pages").select(F.when(k == 0, F.concat(F.lit("# "), "url")).when(k == 1, F.concat(F.lit("  "), "url", F.lit(" "))).when(k == 2, "   ").otherwise(F.col("url")).alias("value"))
    return R.read_url_list(lines, "authentic")


@query("src6_detector_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def src6(spark: SparkSession, d: str) -> DataFrame:
    out = R.read_detector_json(X.table(spark, d, "events"), "props", "k long, missing string", "p")
    return out.select("event_id", "p.k", "p.missing")


@query(
    "src7_batch_csv",
    """WITH r AS (SELECT 'b' || (doc_id // 100) AS batch_id, doc_id % 100 AS index, CASE WHEN doc_id % 4 = 1 THEN 'a, ' || source || '.png' WHEN doc_id % 4 = 2 THEN 'the "' || source || '".png' ELSE source || '.png' END AS filename, CASE WHEN doc_id % 7 = 0 THEN 'error' ELSE 'success' END AS status,
 CASE WHEN doc_id % 7 > 0 THEN 'file_' || doc_id END AS file_id, CASE WHEN doc_id % 5 > 0 THEN n_chars END AS size, doc_id % 3000 AS w, doc_id % 900 AS h, sha256(text) AS sha, CASE WHEN doc_id % 9 > 0 THEN substr(sha256(text), 20, 20) END AS ph, doc_id % 3 AS m, CASE WHEN doc_id % 7 = 0 THEN 'too large, sorry' END AS error FROM documents),
 c AS (SELECT batch_id, index, CAST(index + 1 AS VARCHAR) AS a, CASE WHEN filename LIKE '%"%' THEN '"' || replace(filename, '"', '""') || '"' WHEN filename LIKE '%,%' THEN '"' || filename || '"' ELSE filename END AS b, status AS c, coalesce(file_id, '—') AS d, CASE WHEN size > 0 THEN CAST(CAST(floor(size / 1024.0 + 0.5) AS BIGINT) AS VARCHAR) ELSE '—' END AS e,
 CASE WHEN w > 0 AND h > 0 THEN w || '×' || h ELSE '—' END AS f, CASE WHEN m = 0 THEN '—' ELSE 'PNG' END AS g, substr(sha, 1, 16) || '...' AS h, coalesce(substr(ph, 1, 16), 'undefined') || '...' AS i, CAST(m AS VARCHAR) AS j, CASE m WHEN 1 THEN 'a (87%)' WHEN 2 THEN 'a (87%); b (50%)' ELSE '' END AS k, CASE WHEN error IS NULL THEN '' ELSE '"too large, sorry"' END AS l FROM r)
SELECT batch_id, index, concat_ws(',', a, b, c, d, e, f, g, h, i, j, k, l, '12') AS line FROM c UNION ALL
SELECT DISTINCT batch_id, -1, '#,Filename,Status,File ID,Size (KB),Dimensions,Format,SHA-256,Perceptual Hash,Duplicates,Duplicate Details,Error,Processing Time (ms)' FROM c""",
)
def src7(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct(F.lit("a").alias("filename"), F.lit(0.874).alias("similarity"))
    two = F.struct(F.lit("b").alias("filename"), F.lit(0.5).alias("similarity"))
    i, src = F.col("doc_id"), F.concat("source", F.lit(".png"))
    name = F.when(i % 4 == 1, F.concat(F.lit("a, "), src)).when(i % 4 == 2, F.concat(F.lit('the "'), "source", F.lit('".png'))).otherwise(src)
    sha = F.sha2("text", 256)
    results = X.table(spark, d, "documents").select(
        F.concat(F.lit("b"), F.floor(i / 100)).alias("batch_id"), (i % 100).alias("index"), name.alias("filename"), F.when(i % 7 == 0, "error").otherwise("success").alias("status"), F.when(i % 7 > 0, F.concat(F.lit("file_"), i)).alias("file_id"), F.when(i % 5 > 0, F.col("n_chars")).alias("size"),
        (i % 3000).alias("width"), (i % 900).alias("height"), F.when(i % 3 > 0, "png").alias("format"), sha.alias("sha256"), F.when(i % 9 > 0, F.substring(sha, 20, 20)).alias("phash"), F.when(i % 3 == 1, F.array(one)).when(i % 3 == 2, F.array(one, two)).alias("matches"), F.when(i % 7 == 0, "too large, sorry").alias("error"), F.lit(12).alias("avg_ms"),
    )
    return R.export_batch_csv(results)


@query("src8_batch_json", "SELECT 'b' || (doc_id // 100) AS batch_id, '{\"batch_id\":\"b' || (doc_id // 100) || '\",\"results\":[' || string_agg('{\"doc_id\":' || doc_id || ',\"source\":\"' || source || '\"}', ',' ORDER BY doc_id) || ']}' AS json FROM documents GROUP BY doc_id // 100")
def src8(spark: SparkSession, d: str) -> DataFrame:
    docs = X.table(spark, d, "documents").withColumn("batch_id", F.concat(F.lit("b"), F.floor(F.col("doc_id") / 100)))
    return R.export_batch_json(docs, ["doc_id", "source"])


_SEEN = """, seen AS (SELECT fingerprint, count(*) AS total, min(upload_date) AS first_seen, arg_min(original_filename, upload_date) AS first_filename FROM reg WHERE media_kind <> 'audio' GROUP BY fingerprint)
SELECT q.id AS query_id, q.fingerprint, s.total IS NOT NULL AS found, s.total IS NULL AS is_first_verification, greatest(coalesce(s.total, 0), 1) AS times_verified, s.first_seen, s.first_filename, CASE WHEN s.total IS NULL THEN 'NEW_UPLOAD' ELSE 'PREVIOUSLY_VERIFIED' END AS status
FROM reg q LEFT JOIN seen s ON q.fingerprint = s.fingerprint"""


@query("join1_exact_lookup", with_tables("reg") + _SEEN)
def join1(spark: SparkSession, d: str) -> DataFrame:
    reg = X.reg(spark, d)
    return J.exact_lookup(reg.select(F.col("id").alias("query_id"), "fingerprint"), reg.filter("media_kind <> 'audio'"))


@query("join1_exact_matches", with_tables("reg") + "SELECT fingerprint, id, upload_date, original_filename FROM reg WHERE fingerprint IN (SELECT fingerprint FROM reg WHERE media_kind = 'audio')")
def join1m(spark: SparkSession, d: str) -> DataFrame:
    reg = X.reg(spark, d)
    return J.exact_matches(reg.filter("media_kind = 'audio'"), reg)


_D = "bit_count(xor(('0x' || q.query_hash)::UBIGINT, ('0x' || h.phash)::UBIGINT))"
_PAIRS = f""", pool AS (SELECT * FROM hashes ORDER BY upload_date DESC, vec_id DESC LIMIT 1000), pairs AS (SELECT q.vec_id AS query_id, h.vec_id AS id, CAST({_D} AS INT) AS distance FROM hashes q, pool h WHERE {_D} <= 10),
 sim AS (SELECT *, floor((64 - distance) * 100.0 / 64 * 100 + 0.5) / 100 AS similarity, CASE WHEN distance <= 0 THEN 'Identical' WHEN distance <= 5 THEN 'Nearly identical' WHEN distance <= 10 THEN 'Very similar' END AS interpretation FROM pairs)
"""


@query("join2_similar_images", with_tables("hashes") + _PAIRS + "SELECT * FROM sim")
def join2(spark: SparkSession, d: str, pool: int | None = 1000) -> DataFrame:
    h = X.hashes(spark, d)
    return J.similar_images(h.select(F.col("vec_id").alias("query_id"), "query_hash"), h.select(F.col("vec_id").alias("id"), "phash", "upload_date"), pool=pool)


@query("top2_top_matches", with_tables("hashes") + _PAIRS + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sim) WHERE rank <= 5")
def top2(spark: SparkSession, d: str) -> DataFrame:
    return J.top_matches(join2(spark, d))


#: The searches over all rows, beside those over the service's pool of the newest.
_ALL_PAIRS = _PAIRS.replace(" ORDER BY upload_date DESC, vec_id DESC LIMIT 1000", "")


@query("join2_similar_images_all", with_tables("hashes") + _ALL_PAIRS + "SELECT * FROM sim")
def join2_all(spark: SparkSession, d: str) -> DataFrame:
    return join2(spark, d, pool=None)


@query("top2_top_matches_all", with_tables("hashes") + _ALL_PAIRS + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sim) WHERE rank <= 5")
def top2_all(spark: SparkSession, d: str) -> DataFrame:
    h = X.hashes(spark, d)
    return J.nearest_images(h.select(F.col("vec_id").alias("query_id"), "query_hash"), h.select(F.col("vec_id").alias("id"), "phash"))


_LINKS = f""", kinds AS (SELECT query_hash AS a, phash AS b, count(*) AS n, bit_count(xor(('0x' || query_hash)::UBIGINT, ('0x' || phash)::UBIGINT)) AS distance FROM (SELECT DISTINCT query_hash FROM hashes), (SELECT phash FROM hashes) GROUP BY ALL)
SELECT q.vec_id AS query_id, q.query_hash AS class, coalesce(sum(k.n), 0)::BIGINT AS n_links, count(k.b) AS n_hashes, min(k.distance)::INT AS nearest FROM hashes q LEFT JOIN kinds k ON k.a = q.query_hash AND k.distance <= 10 GROUP BY q.vec_id, q.query_hash"""


@query("join2_image_links", with_tables("hashes") + _LINKS)
def join2_links(spark: SparkSession, d: str) -> DataFrame:
    h = X.hashes(spark, d)
    return J.image_links(h.select(F.col("vec_id").alias("query_id"), "query_hash"), h.select("phash"))


_AUDIO = """, fps AS (SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR)) || sha256(CAST(doc_id + 1 AS VARCHAR)), 1, CASE WHEN doc_id % 10 = 0 THEN 95 ELSE 100 END) AS fp, doc_id % 21 AS k FROM documents),
 pool AS (SELECT doc_id AS id, fp FROM fps ORDER BY doc_id DESC LIMIT 100), q AS (SELECT doc_id AS query_id, repeat('z', CAST(k AS INT)) || substr(fp, CAST(k AS INT) + 1) AS query_fp FROM fps),
 s AS (SELECT query_id, id, CAST(floor(len(list_filter(range(1, 101), lambda i: substr(query_fp, i, 1) = substr(fp, i, 1) AND substr(fp, i, 1) <> '')) * 100.0 / greatest(length(fp), length(query_fp)) + 0.5) AS BIGINT) AS similarity FROM q JOIN pool ON true)
SELECT query_id, id, similarity, CASE WHEN similarity >= 100 THEN 'Identical' WHEN similarity >= 95 THEN 'Nearly Identical' WHEN similarity >= 90 THEN 'Very Similar' ELSE 'Similar' END AS interpretation FROM s WHERE similarity >= 85"""


@query("join3_similar_audio", with_tables("reg") + _AUDIO)
def join3(spark: SparkSession, d: str, pool: int | None = 100) -> DataFrame:
    i = F.col("doc_id")
    whole = F.concat(F.sha2(i.cast("string"), 256), F.sha2((i + 1).cast("string"), 256))
    docs = X.table(spark, d, "documents").select("doc_id", F.substring(whole, F.lit(1), F.when(i % 10 == 0, 95).otherwise(100)).alias("fp"), (i % 21).cast("int").alias("k"))
    queries = docs.select(F.col("doc_id").alias("query_id"), F.concat(F.repeat(F.lit("z"), F.col("k")), F.substring("fp", F.col("k") + 1, F.lit(100))).alias("query_fp"))
    return J.similar_audio(queries, docs.select(F.col("doc_id").alias("id"), F.col("fp").alias("audio_fingerprint"), F.col("doc_id").alias("upload_date")), pool=pool)


@query("join3_similar_audio_all", with_tables("reg") + _AUDIO.replace(" ORDER BY doc_id DESC LIMIT 100", ""))
def join3_all(spark: SparkSession, d: str) -> DataFrame:
    return join3(spark, d, pool=None)


@query("join4_segment_match", with_tables("seg") + "SELECT * FROM seg_match")
def join4(spark: SparkSession, d: str) -> DataFrame:
    return J.segment_match(X.seg_cand(spark, d), X.seg_ref(spark, d))


@query("join5_segment_match_strict", with_tables("seg") + "SELECT r.video_id, r.seg_idx, coalesce(c.seg_hash = r.seg_hash, false) AS matched, r.seg_hash AS expected, coalesce(c.seg_hash, 'seg_' || r.seg_idx || ':missing') AS actual FROM seg_ref r LEFT JOIN seg_cand c ON c.video_id = r.video_id AND c.seg_idx = r.seg_idx")
def join5(spark: SparkSession, d: str) -> DataFrame:
    return J.segment_match_strict(X.seg_cand(spark, d), X.seg_ref(spark, d))


_CREDS = """, p AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'img:v2' ELSE 'img:v1' END AS canonicalization, CASE WHEN vec_id % 3 = 0 THEN 'x' ELSE phash END AS v2, phash AS cred_v2, CASE WHEN vec_id % 5 = 0 THEN phash ELSE 'y' END AS v1, phash AS cred_v1, query_hash AS phash, phash AS cred_phash FROM hashes),
 d AS (SELECT *, (canonicalization = 'img:v2' AND v2 = cred_v2) AS is2, v1 = cred_v1 AS is1, CAST(bit_count(xor(('0x' || phash)::UBIGINT, ('0x' || cred_phash)::UBIGINT)) AS INT) AS dist FROM p)
SELECT vec_id, CASE WHEN NOT (is2 OR is1) THEN dist END AS distance, CASE WHEN is2 OR is1 THEN 'PROVEN_EXACT' WHEN dist <= 10 THEN 'PROVEN_DERIVED' WHEN dist <= 15 THEN 'INCONCLUSIVE' ELSE 'NOT_PROVEN' END AS verdict, CASE WHEN is2 THEN 'v2' WHEN is1 THEN 'v1' ELSE 'phash' END AS matched_by FROM d"""


@query("join6_credential_cascade", with_tables("hashes") + _CREDS)
def join6(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    p = X.hashes(spark, d).select("vec_id", F.when(v % 2 == 0, "img:v2").otherwise("img:v1").alias("canonicalization"), F.when(v % 3 == 0, "x").otherwise(F.col("phash")).alias("v2"), F.col("phash").alias("cred_v2"), F.when(v % 5 == 0, F.col("phash")).otherwise("y").alias("v1"), F.col("phash").alias("cred_v1"), F.col("query_hash").alias("phash"), F.col("phash").alias("cred_phash"))
    return J.compare_credentials(p).select("vec_id", "distance", "verdict", "matched_by")


_CASCADE = """, cand AS (SELECT vec_id AS candidate_id, sha256('2' || (vec_id // 3)) AS v2, sha256('1' || (vec_id // 5)) AS v1, CASE WHEN vec_id % 17 > 0 THEN query_hash END AS phash FROM hashes),
 cred AS (SELECT vec_id AS credential_id, CASE WHEN vec_id % 9 = 0 THEN sha256('2' || (vec_id // 3)) END AS v2, CASE WHEN vec_id % 10 = 3 THEN sha256('1' || (vec_id // 5)) END AS v1, CASE WHEN vec_id % 4 > 0 THEN phash END AS phash FROM hashes),
 pairs AS (SELECT c.candidate_id, k.credential_id, CASE WHEN c.v2 = k.v2 THEN 0 WHEN c.v1 = k.v1 THEN 1 WHEN bit_count(xor(('0x' || c.phash)::UBIGINT, ('0x' || k.phash)::UBIGINT)) <= 15 THEN 2 ELSE 3 END AS stage, CAST(bit_count(xor(('0x' || c.phash)::UBIGINT, ('0x' || k.phash)::UBIGINT)) AS INT) AS d FROM cand c, cred k),
 best AS (SELECT candidate_id, min(struct_pack(stage := stage, d := CASE WHEN stage = 2 THEN d ELSE 0 END, k := credential_id)) AS b FROM pairs GROUP BY candidate_id)
SELECT candidate_id, CASE WHEN b.stage < 2 THEN 'PROVEN_EXACT' WHEN b.stage = 3 THEN 'NOT_PROVEN' WHEN b.d <= 10 THEN 'PROVEN_DERIVED' ELSE 'INCONCLUSIVE' END AS verdict, CASE b.stage WHEN 0 THEN 'v2' WHEN 1 THEN 'v1' WHEN 2 THEN 'phash' END AS matched_by, CASE WHEN b.stage < 3 THEN b.k END AS credential_id, CASE WHEN b.stage = 2 THEN b.d END AS distance FROM best"""


@query("join6_credential_search", with_tables("hashes") + _CASCADE)
def join6_search(spark: SparkSession, d: str) -> DataFrame:
    """Every embedding's hash as a candidate among all credentials: some share a canonical hash, others are near or far copies."""
    v, h = F.col("vec_id"), X.hashes(spark, d)
    of = lambda kind, n: F.sha2(F.concat(F.lit(kind), F.floor(v / n)), 256)
    candidates = h.select(v.alias("candidate_id"), of("2", 3).alias("v2"), of("1", 5).alias("v1"), F.when(v % 17 > 0, F.col("query_hash")).alias("phash"))
    alt = F.when(v % 10 == 3, F.create_map(F.lit("img:v1"), of("1", 5))).otherwise(F.create_map(F.lit("img:v0"), F.lit("-")))
    credentials = h.select(v.alias("credential_id"), F.when(v % 9 == 0, "img:v2|srgb").otherwise("img:v1").alias("canonicalization"), of("2", 3).alias("sha256_canonical"), alt.alias("alt_hashes"), F.when(v % 4 > 0, F.concat(F.lit("phash:"), "phash")).alias("perceptual_hash"))
    return J.credential_cascade(candidates, credentials)


@query("join7_legacy_bundle", with_tables("reg") + "SELECT id, CASE id % 4 WHEN 0 THEN 'alt' || id WHEN 1 THEN 'own' || id WHEN 2 THEN 'only' || id END AS v1_hash FROM reg")
def join7(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    alt = F.when(i % 4 == 0, F.create_map(F.lit("img:v1"), F.concat(F.lit("alt"), i))).otherwise(F.create_map(F.lit("other"), F.lit("-")))
    named = X.reg(spark, d).select("id", alt.alias("alt"), F.when(i % 4 <= 1, F.concat(F.lit("own"), i)).alias("v1"), F.concat(F.lit("only"), i).alias("c"), F.when(i % 4 == 3, "img:v2").alias("version"))
    return named.select("id", J.legacy_v1_hash(F.col("alt"), F.col("v1"), F.col("c"), F.col("version")).alias("v1_hash"))


@query("join8_pairwise", with_tables("hashes") + f"SELECT q.vec_id, q.query_hash = h.phash AS exact, CAST({_D} AS INT) AS distance, floor((64 - {_D}) * 100.0 / 64 * 100 + 0.5) / 100 AS similarity FROM hashes q JOIN hashes h ON q.vec_id = h.vec_id")
def join8(spark: SparkSession, d: str) -> DataFrame:
    h = X.hashes(spark, d)
    p = h.select("vec_id", F.col("query_hash").alias("sha_a"), F.col("phash").alias("sha_b"), F.col("query_hash").alias("phash_a"), F.col("phash").alias("phash_b"))
    return J.pairwise_compare(p).select("vec_id", "exact", "distance", "similarity")


@query("agg1_registry_stats", with_tables("reg") + "SELECT count(*) AS total, count(DISTINCT fingerprint) AS unique_files, min(upload_date) AS first_upload, max(upload_date) AS last_upload, count(*) - count(DISTINCT fingerprint) AS duplicates FROM reg")
def agg1(spark: SparkSession, d: str) -> DataFrame:
    return A.registry_stats(X.reg(spark, d))


@query("agg2_stats_by_kind", with_tables("reg") + "SELECT count(*) AS total, count(DISTINCT fingerprint) AS unique_files, count(*) FILTER (WHERE media_kind = 'image') AS images, count(*) FILTER (WHERE media_kind = 'video') AS videos, count(*) FILTER (WHERE media_kind = 'audio') AS audios FROM reg")
def agg2(spark: SparkSession, d: str) -> DataFrame:
    return A.registry_stats_by_kind(X.reg(spark, d))


@query("agg3_count", "SELECT count(*) AS total FROM documents")
def agg3(spark: SparkSession, d: str) -> DataFrame:
    return A.registry_count(X.reg(spark, d))


@query("win1_history", with_tables("reg") + "SELECT id, fingerprint, row_number() OVER (PARTITION BY fingerprint ORDER BY upload_date, id) AS ordinal, min(upload_date) OVER (PARTITION BY fingerprint) AS first_seen, row_number() OVER (PARTITION BY fingerprint ORDER BY upload_date, id) = 1 AS is_first FROM reg")
def win1(spark: SparkSession, d: str) -> DataFrame:
    return W.verification_history(X.reg(spark, d))


@query("top1_recent_pool", with_tables("reg") + "SELECT id, fingerprint FROM reg ORDER BY upload_date DESC, id DESC LIMIT 100")
def top1(spark: SparkSession, d: str) -> DataFrame:
    return J.recent_pool(X.reg(spark, d), 100).select("id", "fingerprint")


@query("fn1_hamming", with_tables("hashes") + f"SELECT q.vec_id, CAST({_D} AS INT) AS d64, CAST({_D} AS INT) * 4 AS d256 FROM hashes q JOIN hashes h ON q.vec_id = h.vec_id")
def fn1(spark: SparkSession, d: str) -> DataFrame:
    four = lambda c: F.repeat(F.col(c), F.lit(4))
    return X.hashes(spark, d).select("vec_id", H.hamming_hex(F.concat(F.lit("phash:"), "query_hash"), F.col("phash")).alias("d64"), H.hamming_hex(four("query_hash"), four("phash"), 256).alias("d256"))


@query(
    "fn2_6_ladders",
    """SELECT doc_id, floor((64 - doc_id % 65) * 100.0 / 64 * 100 + 0.5) / 100 AS pct,
 CASE WHEN d = 0 THEN 'Identical' WHEN d <= 5 THEN 'Nearly identical' WHEN d <= 10 THEN 'Very similar' WHEN d <= 15 THEN 'Similar' WHEN d <= 20 THEN 'Somewhat similar' ELSE 'Different' END AS image,
 CASE WHEN s = 100 THEN 'Identical' WHEN s >= 95 THEN 'Nearly Identical' WHEN s >= 90 THEN 'Very Similar' WHEN s >= 85 THEN 'Similar' WHEN s >= 70 THEN 'Somewhat Similar' ELSE 'Different' END AS audio,
 CASE WHEN doc_id % 20 <= 8 THEN 'match' WHEN doc_id % 20 <= 16 THEN 'weak' ELSE 'no-match' END AS frame,
 CASE WHEN s >= 95 THEN 'very-high' WHEN s >= 85 THEN 'high' WHEN s >= 75 THEN 'medium' ELSE 'low' END AS band,
 CASE WHEN s >= 98 THEN 'exact-duplicate' WHEN s >= 90 THEN 'near-duplicate' WHEN s >= 80 THEN 'similar' ELSE 'possible-match' END AS kind FROM (SELECT doc_id, doc_id % 30 AS d, doc_id % 101 AS s FROM documents)""",
)
def fn2(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    s = i % 101 / 100
    return X.table(spark, d, "documents").select("doc_id", H.similarity_pct(i % 65).alias("pct"), H.interpret_distance(i % 30).alias("image"), H.interpret_audio(i % 101).alias("audio"), H.frame_match(i % 20).alias("frame"), H.similarity_band(s).alias("band"), H.match_type(s).alias("kind"))


@query("fn7_positional_similarity", with_tables("hashes") + "SELECT vec_id, CAST(len(list_filter(range(1, 17), lambda i: substr(phash, i, 1) = substr(query_hash, i, 1))) AS INT) / 16.0 AS similarity, 0.0 AS unequal FROM hashes")
def fn7(spark: SparkSession, d: str) -> DataFrame:
    return X.hashes(spark, d).select("vec_id", H.positional_similarity(F.col("phash"), F.col("query_hash")).alias("similarity"), H.positional_similarity(F.col("phash"), F.lit("ab")).alias("unequal"))


@query("fn8_median_hash", with_tables("hashes") + "SELECT vec_id, phash FROM hashes")
def fn8(spark: SparkSession, d: str) -> DataFrame:
    return X.hashes(spark, d).select("vec_id", "phash")


_NIBBLES = "array_to_string(list_transform(range(0, 16), lambda i: substr('0123456789abcdef', CAST(1 + 8 * {b}[4*i+1] + 4 * {b}[4*i+2] + 2 * {b}[4*i+3] + {b}[4*i+4] AS INT), 1)), '')"


@query(
    "fn9_average_difference_hash",
    f"""WITH c AS (SELECT doc_id, list_transform(range(0, 72), lambda i: (doc_id * 31 + i * i * 7 + i * doc_id) % 256) AS c FROM documents),
 b AS (SELECT doc_id, list_transform(c[1:64], lambda x: CASE WHEN x > list_sum(c[1:64]) / 64.0 THEN 1 ELSE 0 END) AS a, list_transform(range(0, 64), lambda k: CASE WHEN c[CAST(k // 8 * 9 + k % 8 + 1 AS INT)] < c[CAST(k // 8 * 9 + k % 8 + 2 AS INT)] THEN 1 ELSE 0 END) AS d FROM c)
SELECT doc_id, {_NIBBLES.format(b="a")} AS ahash, {_NIBBLES.format(b="d")} AS dhash FROM b""",
)
def fn9(spark: SparkSession, d: str) -> DataFrame:
    cells = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: (F.col("doc_id") * 31 + i * i * 7 + i * F.col("doc_id")) % 256)
    return X.table(spark, d, "documents").select("doc_id", cells.alias("c")).select("doc_id", H.average_hash(F.slice("c", 1, 64)).alias("ahash"), H.difference_hash(F.col("c")).alias("dhash"))


_BY = "OVER (PARTITION BY video_id ORDER BY seg_idx)"
_RUNS = f""", runs AS (SELECT *, row_number() {_BY} - row_number() OVER (PARTITION BY video_id, matched ORDER BY seg_idx) AS run, min(CASE WHEN NOT matched THEN seg_idx END) OVER (PARTITION BY video_id ORDER BY seg_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_bad FROM seg_match),
 bad AS (SELECT video_id, max(n) AS longest FROM (SELECT video_id, run, count(*) AS n FROM runs WHERE NOT matched GROUP BY video_id, run) GROUP BY video_id),
 cov AS (SELECT m.video_id, count(*) FILTER (WHERE matched) AS n_matched, count(*) AS n_compared, coalesce(max(b.longest), 0) AS longest_run FROM seg_match m LEFT JOIN bad b ON b.video_id = m.video_id GROUP BY m.video_id)
"""


@query("win2_matched_ranges", with_tables("seg") + _RUNS + "SELECT video_id, min(seg_idx) AS range_start, coalesce(max(next_bad) - 1, max(seg_idx)) AS range_end FROM runs WHERE matched GROUP BY video_id, run")
def win2(spark: SparkSession, d: str) -> DataFrame:
    return W.matched_ranges(join4(spark, d))


@query("win3_mismatched_runs", with_tables("seg") + _RUNS + "SELECT video_id, longest_run, longest_run >= 3 AS has_run FROM cov")
def win3(spark: SparkSession, d: str) -> DataFrame:
    return W.mismatched_runs(join4(spark, d))


@query("win4_first_mismatches", with_tables("seg") + f"SELECT * FROM (SELECT video_id, row_number() {_BY} AS rank, seg_idx, expected, actual FROM seg_match WHERE NOT matched) WHERE rank <= 5")
def win4(spark: SparkSession, d: str) -> DataFrame:
    return W.first_mismatches(join4(spark, d))


@query(
    "agg6_segment_coverage",
    with_tables("seg") + _RUNS + """SELECT video_id, n_matched, n_compared, longest_run, floor(n_matched * 1.0 / n_compared * 10000 + 0.5) / 10000 AS coverage, CASE WHEN n_matched = n_compared THEN 'PROVEN_STRONG' WHEN n_matched * 1.0 / n_compared >= 0.98 AND longest_run < 3 THEN 'PROVEN_STRONG'
 WHEN n_matched * 1.0 / n_compared >= 0.80 THEN 'PROVEN_DERIVED' WHEN n_matched * 1.0 / n_compared >= 0.30 THEN 'INCONCLUSIVE' ELSE 'NOT_PROVEN' END AS verdict FROM cov""",
)
def agg6(spark: SparkSession, d: str) -> DataFrame:
    return W.segment_coverage(join4(spark, d))
