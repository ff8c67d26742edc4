"""Queries of the filters, functions, scores, sets, further joins and windowed log operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import geo as G
from attestra.functions import text as T
from attestra.operators import aggregates as A
from attestra.operators import filters as L
from attestra.operators import joins as J
from attestra.operators import scoring as S
from attestra.operators import sets as E
from attestra.operators import windows as W
from attestra.streaming import streams as R

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


def _pick(i, values: list):
    """The value of a list at an integer column modulo its length."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))


def _sql_pick(i: str, values: list) -> str:
    show = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return "CASE " + f"{i} % {len(values)} " + " ".join(f"WHEN {k} THEN {show(v)}" for k, v in enumerate(values)) + " END"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "documents")


MIMES, NAMES = ["image/png", "video/mp4", "audio/x", "text/plain", None], ["a.PNG", "b.mov", "c.flac", "d.txt", "e.webp", "f", None]


@query("flt1_media_kind", f"WITH f AS (SELECT doc_id, {_sql_pick('doc_id', MIMES)} AS m, {_sql_pick('doc_id', NAMES)} AS n FROM documents) SELECT doc_id, CASE WHEN m LIKE 'image/%' OR n IN ('a.PNG', 'e.webp') THEN 'image' WHEN m LIKE 'video/%' OR n = 'b.mov' THEN 'video' WHEN m LIKE 'audio/%' OR n = 'c.flac' THEN 'audio' ELSE 'unknown' END AS kind FROM f")
def flt1(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return docs(spark, d).select("doc_id", T.media_kind(_pick(i, MIMES), _pick(i, NAMES)).alias("kind"))


@query("flt2_admit_files", f"""WITH f AS (SELECT lang AS batch_id, doc_id AS index, {_sql_pick('doc_id', NAMES[:6])} AS name, {_sql_pick('doc_id', MIMES[:4])} AS mime, n_chars * 30000 AS size FROM documents)
SELECT * FROM (SELECT batch_id, index, row_number() OVER (PARTITION BY batch_id ORDER BY index) AS rank FROM f WHERE name IN ('a.PNG', 'e.webp') AND mime = 'image/png' AND size <= 52428800) WHERE rank <= 100""")
def flt2(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    f = docs(spark, d).select(F.col("lang").alias("batch_id"), i.alias("index"), _pick(i, NAMES[:6]).alias("name"), _pick(i, MIMES[:4]).alias("mime"), (F.col("n_chars") * 30000).alias("size"))
    return L.admit_batch_files(f).select("batch_id", "index", "rank")


HEADS = ["4D5A9000", "7F454C46", "CAFEBABE00", "23212F62", "89504E470D0A1A0A", "FFD8FFE0", "FFD800", "00000000"]
FILES = ["x.png", "x.JPG", "x.jpeg", "x.gif", "../x.gif", "x.PHP", "x.asp", "x.sh", "x.exe", "a|b.gif", "png", "a\tb.gif", "x.jsp"]
_EXPECT = """CASE WHEN h IN ('4D5A9000', '7F454C46', 'CAFEBABE00') THEN 'executable' WHEN h = '23212F62' THEN 'script' WHEN n IN ('x.png', 'png') AND h <> '89504E470D0A1A0A' THEN 'not a png'
 WHEN n IN ('x.JPG', 'x.jpeg') AND h NOT IN ('FFD8FFE0', 'FFD800') THEN 'not a jpeg' WHEN n IN ('../x.gif', 'a|b.gif') THEN 'bad name' WHEN n IN ('x.PHP', 'x.asp', 'x.jsp') THEN 'script name' END"""


@query("flt3_signatures", f"WITH f AS (SELECT doc_id, {_sql_pick('doc_id', HEADS)} AS h, {_sql_pick('(doc_id // 8)', FILES)} AS n FROM documents) SELECT doc_id, {_EXPECT} AS problem FROM f")
def flt3(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return docs(spark, d).select("doc_id", L.signature_problem(F.unhex(_pick(i, HEADS)), _pick(F.floor(i / 8), FILES)).alias("problem"))


BOXES, CODECS = ["mov,mp4,m4a", "avi", "webm", None], ["h264", "mpeg2", "vp9"]


@query("flt4_video_policy", f"WITH f AS (SELECT doc_id, {_sql_pick('doc_id', BOXES)} AS b, {_sql_pick('doc_id', CODECS)} AS c, n_chars / 10.0 AS s FROM documents) SELECT doc_id, CASE WHEN b IS NULL OR b = 'avi' THEN 'container' WHEN c = 'mpeg2' THEN 'codec' WHEN floor(s) > 300 THEN 'duration' END AS problem FROM f")
def flt4(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return docs(spark, d).select("doc_id", L.video_policy_problem(_pick(i, BOXES), _pick(i, CODECS), F.col("n_chars") / 10).alias("problem"))


ALGOS, SPECS = ["SHA256+segPhash", "sha256", None], ["vid:v1:x", "img:v2", None, "vid:v1"]


@query("flt5_credential", f"WITH f AS (SELECT doc_id, {_sql_pick('doc_id', ALGOS)} AS a, {_sql_pick('doc_id', SPECS)} AS s, doc_id % 5 AS k FROM documents) SELECT doc_id, CASE WHEN a IS NULL AND s IS NULL AND k = 4 THEN 'missing' WHEN a IS NULL OR a = 'sha256' THEN 'algorithm' WHEN s IS NULL OR s = 'img:v2' THEN 'canonicalization' WHEN k IN (0, 4) THEN 'segments' END AS problem FROM f")
def flt5(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    segments = F.when(i % 5 == 4, F.lit(None).cast("array<string>")).when(i % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("seg_0:00")))
    return docs(spark, d).select("doc_id", L.credential_problem(_pick(i, ALGOS), _pick(i, SPECS), segments).alias("problem"))


@query("flt6_segment_list", with_tables("seg") + "SELECT video_id, CASE WHEN video_id % 4 = 1 THEN 'format' WHEN min(seg_idx) > 0 THEN 'contiguous' END AS problem FROM seg_cand GROUP BY video_id")
def flt6(spark: SparkSession, d: str) -> DataFrame:
    bad = F.when(F.col("video_id") % 4 == 1, F.lit(":XY")).otherwise(F.lit(""))
    made = F.concat(F.lit("seg_"), F.col("seg_idx"), F.lit(":"), "seg_hash", bad)
    return X.seg_cand(spark, d).groupBy("video_id").agg(F.collect_list(made).alias("s")).select("video_id", L.segment_list_problem(F.col("s")).alias("problem"))


MESSAGES = ["Request TIMEOUT after 5 s", "file too large", "duration exceeds limit", "Invalid credential", "segments must be contiguous", "worker busy", "boom", "unsupported codec"]


@query("flt7_status", f"SELECT doc_id, {_sql_pick('doc_id', [504, 413, 413, 400, 400, 503, 500, 400])} AS status FROM documents")
def flt7(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.status_from_message(_pick(F.col("doc_id"), MESSAGES)).alias("status"))


FAULTS = ["Invalid size of format", "Image too small", "File too LARGE", "exceeds the limit", "Unsupported codec", "Timeout", "out of memory", "boom", None]


@query("flt8_error_code", f"""WITH m AS (SELECT doc_id, {_sql_pick('doc_id', FAULTS)} AS m, CASE WHEN doc_id % 8 = 2 THEN 'ENOENT' WHEN doc_id % 16 = 3 THEN 'OUT_OF_MEMORY' END AS given FROM documents),
 c AS (SELECT *, coalesce(given, CASE WHEN m ILIKE '%invalid%' OR m ILIKE '%corrupt%' THEN 'INVALID_IMAGE' WHEN m ILIKE '%size%' OR m ILIKE '%small%' THEN 'IMAGE_TOO_SMALL' WHEN m ILIKE '%large%' OR m ILIKE '%exceeds%' THEN 'IMAGE_TOO_LARGE' WHEN m ILIKE '%format%' OR m ILIKE '%unsupported%' THEN 'UNSUPPORTED_FORMAT' WHEN m ILIKE '%timeout%' THEN 'PROCESSING_TIMEOUT' WHEN m ILIKE '%memory%' THEN 'OUT_OF_MEMORY' ELSE 'PROCESSING_ERROR' END) AS code FROM m)
SELECT doc_id, code, CASE code WHEN 'INVALID_IMAGE' THEN 'File is corrupted or not a valid image format' WHEN 'IMAGE_TOO_SMALL' THEN 'Image dimensions are too small for reliable verification' WHEN 'IMAGE_TOO_LARGE' THEN 'Image file size exceeds the maximum allowed' WHEN 'UNSUPPORTED_FORMAT' THEN 'Image format is not supported' WHEN 'PROCESSING_TIMEOUT' THEN 'Image processing took too long and was cancelled' WHEN 'OUT_OF_MEMORY' THEN 'Image is too large to process' WHEN 'PROCESSING_ERROR' THEN 'An error occurred while processing the image' ELSE coalesce(m, 'Unknown error occurred') END AS shown FROM c""")
def flt8(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    message = _pick(i, FAULTS)
    code = L.error_code(F.when(i % 8 == 2, "ENOENT").when(i % 16 == 3, "OUT_OF_MEMORY"), message)
    return docs(spark, d).select("doc_id", code.alias("code"), L.error_text(code, message).alias("shown"))


@query("flt9_allowed_hosts", "SELECT page_id, url FROM pages WHERE regexp_matches(lower(url), '^https?://') AND split_part(split_part(split_part(split_part(lower(url), '://', 2), '/', 1), '?', 1), '#', 1) IN (SELECT DISTINCT split_part(split_part(split_part(split_part(lower(url), '://', 2), '/', 1), '?', 1), '#', 1) FROM pages WHERE page_id % 50 = 0)")
def flt9(spark: SparkSession, d: str) -> DataFrame:
    pages = X.table(spark, d, "pages").select("page_id", "url")
    hosts = pages.filter("page_id % 50 = 0").select(F.regexp_extract("url", "^[^:]+://([^/?#]*)", 1).alias("host"))
    return L.filter_allowed_hosts(pages, hosts).select("page_id", "url")


@query("flt10_search", with_tables("reg") + "SELECT id, original_filename FROM reg WHERE contains(lower(original_filename), 'rc1/')")
def flt10(spark: SparkSession, d: str) -> DataFrame:
    return L.search_results(X.reg(spark, d), "RC1/", "original_filename").select("id", "original_filename")


@query("flt11_media_records", with_tables("reg") + "SELECT id, media_kind FROM reg WHERE media_kind = 'image' AND ip_address IS NOT NULL")
def flt11(spark: SparkSession, d: str) -> DataFrame:
    return L.filter_media_records(X.reg(spark, d), "image", "ip_address").select("id", "media_kind")


@query("flt12_user_batches", "SELECT event_id, user_id FROM events WHERE user_id = 7")
def flt12(spark: SparkSession, d: str) -> DataFrame:
    return L.user_batches(X.table(spark, d, "events").select("event_id", "user_id"), 7)


_H = "6371 * 2 * atan2(sqrt({a}), sqrt(1 - ({a})))"
_A = "(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))"


def _km(a: str, c: str, b: str, d: str) -> str:
    return _H.format(a=_A.format(a=a, b=b, c=c, d=d))


_PHOTOS = "WITH p AS (SELECT doc_id AS photo_id, CASE WHEN doc_id % 9 <> 0 THEN CAST(doc_id % 120 - 60 AS DOUBLE) END AS plat, CAST(doc_id % 300 - 150 AS DOUBLE) AS plon FROM documents)"


def photos(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return docs(spark, d).select(i.alias("photo_id"), F.when(i % 9 != 0, (i % 120 - 60).cast("double")).alias("plat"), (i % 300 - 150).cast("double").alias("plon"))


@query("join9_landmark_distance", _PHOTOS + f", l AS (SELECT doc_id AS photo_id, 'L' || k AS name, doc_id % 120 - 60 + k * k * 0.01 AS lat, doc_id % 300 - 150 + k * 0.2 AS lon FROM documents, (VALUES (0), (1), (4)) AS n(k) WHERE doc_id % 3 > 0), j AS (SELECT p.photo_id, name, {_km('plat', 'plon', 'lat', 'lon')} AS km FROM p LEFT JOIN l ON p.photo_id = l.photo_id) SELECT photo_id, name, km, CASE WHEN km < 1 THEN 'exact' WHEN km < 10 THEN 'close' WHEN km IS NOT NULL THEN 'distant' ELSE 'unknown' END AS match, coalesce(km > 50, false) AS far FROM j")
def join9(spark: SparkSession, d: str) -> DataFrame:
    i, k = F.col("doc_id"), F.col("k")
    marks = docs(spark, d).filter("doc_id % 3 > 0").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(4))).alias("k"))
    marks = marks.select(i.alias("photo_id"), F.concat(F.lit("L"), k).alias("name"), (i % 120 - 60 + k * k * F.lit(0.01)).alias("lat"), (i % 300 - 150 + k * F.lit(0.2)).alias("lon"))
    return J.landmark_distance(marks, photos(spark, d))


MAKES, MODELS = ["Apple Inc.", "CANON", "Nokia"], ["iPhone 15 Pro", "EOS R5", "iPhone 4", "R5"]
CATALOGUE = [(0, "Apple", "iPhone 15", 2023), (1, "Apple", "iPhone 15 Pro", 2023), (2, "Canon", "EOS R5", 2020)]


@query("join10_camera_catalogue", f"""WITH c AS (SELECT * FROM (VALUES (0, 'Apple', 'iPhone 15', 2023), (1, 'Apple', 'iPhone 15 Pro', 2023), (2, 'Canon', 'EOS R5', 2020)) AS t(ord, maker, model, release_year)), e AS (SELECT doc_id AS photo_id, {_sql_pick('doc_id', MAKES)} AS make, {_sql_pick('(doc_id // 3)', MODELS)} AS m, 2015 + doc_id % 11 AS year FROM documents),
 f AS (SELECT photo_id, year, make, arg_min(c.model, c.ord) AS camera, arg_min(c.release_year, c.ord) AS released FROM e LEFT JOIN c ON contains(lower(make), lower(maker)) AND (contains(lower(m), lower(model)) OR contains(lower(model), lower(m))) GROUP BY photo_id, year, make)
SELECT photo_id, make <> 'Nokia' AS maker_known, camera, CASE WHEN camera IS NOT NULL THEN year >= released END AS year_valid FROM f""")
def join10(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    exif = docs(spark, d).select(i.alias("photo_id"), _pick(i, MAKES).alias("make"), _pick(F.floor(i / 3), MODELS).alias("exif_model"), (2015 + i % 11).alias("year"))
    return J.camera_catalogue(exif, spark.createDataFrame(CATALOGUE, "ord int, maker string, model string, release_year int"))


SKIES = ["Blue Sky", "Thunderstorm", "tree", "Clear water", "Clouds"]
CONDITIONS = ["sunny", "rain", "cloudy"]


@query("join11_weather", f"""WITH p AS (SELECT doc_id AS photo_id, doc_id % 40 AS place, doc_id % 5 AS day, {_sql_pick('doc_id', SKIES)} AS sky FROM documents), w AS (SELECT DISTINCT user_id % 40 AS place, user_id % 4 AS day, {_sql_pick('(user_id % 40)', CONDITIONS)} AS condition, (user_id % 40) % 2 = 1 AS rainy FROM events),
 j AS (SELECT p.*, condition, CASE WHEN sky IN ('Blue Sky', 'Clear water') AND rainy THEN 'Image appears sunny but weather was rainy - possible manipulation' WHEN sky IN ('Thunderstorm', 'Clouds') AND condition = 'sunny' THEN 'Image appears rainy but weather was sunny - possible manipulation' END AS warning FROM p LEFT JOIN w ON p.place = w.place AND p.day = w.day) SELECT photo_id, place, day, condition, warning, CASE WHEN condition IS NOT NULL THEN warning IS NULL END AS verified FROM j""")
def join11(spark: SparkSession, d: str) -> DataFrame:
    i, u = F.col("doc_id"), F.col("user_id")
    p = docs(spark, d).select(i.alias("photo_id"), (i % 40).alias("place"), (i % 5).alias("day"), F.array(_pick(i, SKIES)).alias("labels"))
    w = X.table(spark, d, "events").select((u % 40).alias("place"), (u % 4).alias("day"), _pick(u % 40, CONDITIONS).alias("condition"), (u % 40 % 2 == 1).alias("is_rainy")).withColumn("is_sunny", F.col("condition") == "sunny").distinct()
    return J.weather_check(p, w)


@query("join12_reputation", with_tables("reg") + ", t AS (SELECT fingerprint AS sha256, max(id % 4) AS malicious, min(id % 21 - 10) AS reputation, min(upload_date) AS first_seen FROM reg WHERE id % 3 = 0 GROUP BY fingerprint) SELECT r.id, r.fingerprint AS sha256, t.malicious IS NOT NULL AS found, t.malicious, t.reputation, t.first_seen FROM reg r LEFT JOIN t ON t.sha256 = r.fingerprint")
def join12(spark: SparkSession, d: str) -> DataFrame:
    reg = X.reg(spark, d).withColumnRenamed("fingerprint", "sha256")
    threats = reg.filter("id % 3 = 0").select("sha256", (F.col("id") % 4).alias("malicious"), (F.col("id") % 21 - 10).alias("reputation"), F.col("upload_date").alias("first_seen"))
    return J.reputation_lookup(reg.select("id", "sha256"), threats)


_BEST = "SELECT user_id AS fp_id, arg_max(event_id, (event_id * 7 % 101) * 1000000000 - event_id) AS recording_id, max(event_id * 7 % 101) AS score FROM events GROUP BY user_id"


def scored(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return X.table(spark, d, "events").select(F.col("user_id").alias("fp_id"), e.alias("ord"), (e * 7 % 101).alias("score"), e.alias("recording_id"))


@query("top5_best_by_score", _BEST)
def top5(spark: SparkSession, d: str) -> DataFrame:
    return J.best_by_score(scored(spark, d), ["fp_id"])


@query("join13_identify_recording", f"WITH b AS ({_BEST}) SELECT b.fp_id, b.recording_id, b.score, e.event_type AS genre FROM b LEFT JOIN events e ON e.event_id = b.recording_id AND e.event_type <> 'error'")
def join13(spark: SparkSession, d: str) -> DataFrame:
    recordings = X.table(spark, d, "events").filter("event_type <> 'error'").select(F.col("event_id").alias("recording_id"), F.col("event_type").alias("genre"))
    return J.identify_recording(scored(spark, d), recordings)


TIERS = ["free", "pro", "enterprise"]


@query("join14_hybrid", with_tables("reg") + f""", q AS (SELECT id AS query_id, fingerprint, {_sql_pick('id', TIERS)} AS tier, id % 2 = 0 AS always FROM reg), s AS (SELECT q.*, q.fingerprint IN (SELECT fingerprint FROM reg WHERE media_kind = 'audio') AS found FROM q), a AS (SELECT *, CASE tier WHEN 'free' THEN NOT found AND always WHEN 'pro' THEN always OR NOT found ELSE true END AS asked FROM s),
 x AS (SELECT fingerprint, sum(id % 3) AS m FROM reg WHERE id % 5 = 0 GROUP BY fingerprint), e AS (SELECT a.query_id, a.fingerprint, found, asked, CASE WHEN asked THEN CAST(coalesce(m, 0) AS BIGINT) END AS external_matches FROM a LEFT JOIN x ON x.fingerprint = a.fingerprint)
SELECT *, CASE WHEN found THEN 'File previously verified in our database' ELSE 'File appears to be original - first verification' END AS advice FROM e""")
def join14(spark: SparkSession, d: str) -> DataFrame:
    reg = X.reg(spark, d)
    q = reg.select(F.col("id").alias("query_id"), "fingerprint", _pick(F.col("id"), TIERS).alias("tier"), (F.col("id") % 2 == 0).alias("always"))
    return J.hybrid_search(q, reg.filter("media_kind = 'audio'"), reg.filter("id % 5 = 0").select("fingerprint", (F.col("id") % 3).alias("matches")))


@query("join15_inhibit", "WITH a AS (SELECT event_id AS alert_id, event_type AS name, user_id % 20 AS label FROM events WHERE event_type <> 'error' OR user_id % 3 = 0), r AS (SELECT * FROM (VALUES ('error', 'click'), ('purchase', 'view')) AS t(source, target)) SELECT name, label, alert_id FROM a WHERE NOT EXISTS (SELECT 1 FROM r JOIN a s ON s.name = r.source WHERE r.target = a.name AND s.label = a.label)")
def join15(spark: SparkSession, d: str) -> DataFrame:
    a = X.table(spark, d, "events").filter("event_type <> 'error' or user_id % 3 = 0").select(F.col("event_id").alias("alert_id"), F.col("event_type").alias("name"), (F.col("user_id") % 20).alias("label"))
    return J.inhibit_alerts(a, spark.createDataFrame([("error", "click"), ("purchase", "view")], "source string, target string"))


@query("top3_likely_generator", "SELECT doc_id, CASE WHEN greatest(doc_id % 7, doc_id % 5, doc_id % 3) = 0 THEN 'unknown' WHEN doc_id % 7 >= doc_id % 5 AND doc_id % 7 >= doc_id % 3 THEN 'x' WHEN doc_id % 5 >= doc_id % 3 THEN 'y' ELSE 'z' END AS generator FROM documents")
def top3(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return docs(spark, d).select("doc_id", J.likely_generator([("x", i % 7), ("y", i % 5), ("z", i % 3)]).alias("generator"))


@query("set1_union", "SELECT url, 'authentic' AS category FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url, 'manipulated' FROM pages WHERE page_id % 3 = 0")
def set1(spark: SparkSession, d: str) -> DataFrame:
    p = X.table(spark, d, "pages")
    return E.union_test_cases([p.filter(f"page_id % {k} = 0").select("url", F.lit(c).alias("category")) for k, c in ((2, "authentic"), (3, "manipulated"))])


_SNAP = "SELECT {s} AS doc_id, lang, source FROM documents"


@query("set3_snapshot_diff", f"SELECT *, 'actual' AS side FROM ({_SNAP.format(s='doc_id % 150')} EXCEPT ALL {_SNAP.format(s='doc_id')}) UNION ALL SELECT *, 'golden' AS side FROM ({_SNAP.format(s='doc_id')} EXCEPT ALL {_SNAP.format(s='doc_id % 150')})")
def set3(spark: SparkSession, d: str) -> DataFrame:
    base = docs(spark, d).select("doc_id", "lang", "source", F.col("n_chars").alias("processing_ms"))
    return E.snapshot_diff(base.withColumn("doc_id", F.col("doc_id") % 150), base.withColumn("processing_ms", F.lit(0)))


@query("set4_hash_drift", with_tables("hashes") + "SELECT vec_id AS asset_id, query_hash AS v1, phash AS v2, phash AS golden_v1, phash AS golden_v2 FROM hashes WHERE query_hash <> phash")
def set4(spark: SparkSession, d: str) -> DataFrame:
    h = X.hashes(spark, d)
    return E.hash_drift(h.select(F.col("vec_id").alias("asset_id"), F.col("query_hash").alias("v1"), F.col("phash").alias("v2")), h.select(F.col("vec_id").alias("asset_id"), F.col("phash").alias("v1"), F.col("phash").alias("v2")))


@query("set5_combine_indicators", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'JPEG Analysis: soft|' ELSE '' END || 'Local: ' || event_type AS indicators FROM events")
def set5(spark: SparkSession, d: str) -> DataFrame:
    e = X.table(spark, d, "events")
    parts = {"JPEG Analysis": F.when(F.col("event_type") == "click", F.array(F.lit("soft"))), "Local": F.array("event_type"), "Remote": F.array().cast("array<string>")}
    return e.select("event_id", F.array_join(E.combine_indicators(parts), "|").alias("indicators"))


@query("fn11_haversine", _PHOTOS + f" SELECT photo_id, round({_km('plat', 'plon', '48.0', '11.0')}, 6) AS km FROM p")
def fn11(spark: SparkSession, d: str) -> DataFrame:
    return photos(spark, d).select("photo_id", F.round(G.haversine_km(F.col("plat"), F.col("plon"), F.lit(48.0), F.lit(11.0)), 6).alias("km"))


@query("fn12_13_exif", "SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN CASE WHEN doc_id % 3 = 0 THEN -1 ELSE 1 END * (doc_id % 90 + (doc_id % 60) / 60.0 + (doc_id % 30) / 3600.0) END AS degrees, CASE WHEN doc_id % 2 = 0 THEN strftime(make_timestamp((1600000000 + doc_id * 86400) * 1000000), '%Y-%m-%d') WHEN doc_id % 3 > 0 THEN '2021-07-0' || (1 + doc_id % 9) END AS day, CASE WHEN doc_id % 3 > 0 THEN 2021 END AS year FROM documents")
def fn12(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    dms = F.when(i % 4 > 0, F.array((i % 90).cast("double"), (i % 60).cast("double"), (i % 30).cast("double"))).otherwise(F.array(F.lit(1.0)))
    text = F.when(i % 3 > 0, F.concat(F.lit("2021:07:0"), 1 + i % 9, F.lit(" 10:00:00"))).otherwise("unknown")
    return docs(spark, d).select("doc_id", G.dms_to_decimal(dms, F.when(i % 3 == 0, "S").otherwise("N")).alias("degrees"), G.exif_date(F.when(i % 2 == 0, 1600000000 + i * 86400), text).alias("day"), G.exif_year(text).alias("year"))


_JD = "(floor(epoch(date_trunc('day', ts)) / 86400) + 2440588 + (hour(ts) + minute(ts) / 60.0 + floor(second(ts)) / 3600.0 - 12) / 24)"
_SUN = f"""WITH a AS (SELECT event_id, ts, CAST(event_id % 160 - 80 AS DOUBLE) AS lat, CAST(event_id % 340 - 170 AS DOUBLE) AS lon, {_JD} - 2451545.0 AS n FROM events),
 b AS (SELECT *, (280.460 + 0.9856474 * n) - trunc((280.460 + 0.9856474 * n) / 360) * 360 AS ml, radians((357.528 + 0.9856003 * n) - trunc((357.528 + 0.9856003 * n) / 360) * 360) AS an, radians(23.439 - 0.0000004 * n) AS tilt, radians((280.460 + 360.9856474 * n) - trunc((280.460 + 360.9856474 * n) / 360) * 360 + lon) AS st FROM a),
 c AS (SELECT *, radians(ml + 1.915 * sin(an) + 0.020 * sin(2 * an)) AS ec FROM b), d AS (SELECT *, asin(sin(tilt) * sin(ec)) AS de, st - atan2(cos(tilt) * sin(ec), cos(ec)) AS ho, radians(lat) AS p FROM c),
 s AS (SELECT event_id, n, degrees(asin(sin(p) * sin(de) + cos(p) * cos(de) * cos(ho))) AS alt, degrees(atan2(-sin(ho), tan(de) * cos(p) - sin(p) * cos(ho))) + 360 AS az, degrees(de) AS de FROM d),
 z AS (SELECT event_id, alt, de, az - trunc(az / 360) * 360 AS az FROM s)
SELECT event_id, round(alt, 4) AS altitude, round(az, 4) AS azimuth, round(de, 4) AS declination, alt > 0 AS shadow, CASE WHEN alt > 0 THEN round((az + 180) - trunc((az + 180) / 360) * 360, 4) END AS direction FROM z"""


@query("fn14_16_sun", _SUN)
def fn14(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    s = X.table(spark, d, "events").select("event_id", G.sun_position((e % 160 - 80).cast("double"), (e % 340 - 170).cast("double"), F.col("ts")).alias("s"))
    w = s.withColumn("w", G.expected_shadow(F.col("s.altitude"), F.col("s.azimuth")))
    return w.select("event_id", F.round("s.altitude", 4).alias("altitude"), F.round("s.azimuth", 4).alias("azimuth"), F.round("s.declination", 4).alias("declination"), F.col("w.exists").alias("shadow"), F.round("w.direction", 4).alias("direction"))


@query("fn17_day_of_year", "SELECT event_id, dayofyear(ts) AS day FROM events")
def fn17(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "events").select("event_id", G.day_of_year(F.col("ts")).alias("day"))


RATES, TIMES = ["30000/1001", "25", "", "24/0", "24/1"], ["Duration: 00:03:25.50, start", "01:00:00", "none"]


@query("fn18_21_text", f"SELECT doc_id, {_sql_pick('doc_id', [30000 / 1001, 25.0, 0.0, 0.0, 24.0])} AS rate, {_sql_pick('doc_id', [205.5, 3600.0, None])} AS seconds, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', floor(n_chars / 1024.0 * 10 + 0.5) / 10) WHEN n_chars IS NOT NULL THEN printf('%.1f MB', floor(n_chars / 1048576.0 * 10 + 0.5) / 10) END AS size, {_sql_pick('doc_id', ['vid:v1', None, 'img:v2', None])} AS spec FROM documents")
def fn18(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return docs(spark, d).select("doc_id", T.parse_fraction(_pick(i, RATES)).alias("rate"), T.parse_duration(_pick(i, TIMES)).alias("seconds"), T.format_file_size(F.col("n_chars")).alias("size"), T.canonical_spec(_pick(i, ["vid:v1:15", "x", "img:v2", None])).alias("spec"))


LINKS = ["https://en.Wikipedia.org/x", "http://a.gov/1", "http://blog.example", "http://x.edu"]
LEVELS = ["VERY_UNLIKELY", "UNLIKELY", "POSSIBLE"]


@query("fn22_24_flags", f"SELECT doc_id, {_sql_pick('doc_id', [True, True, False, True])} AS reputable, doc_id % 3 < 2 AND (doc_id // 3) % 3 < 2 AS safe, abs((doc_id % 40 + 10) * 1.0 / 20 - 1.5) <= 0.02 AS wide, doc_id % 40 + 10 = 40 AS exact FROM documents")
def fn22(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    w = i % 40 + 10
    return docs(spark, d).select("doc_id", T.is_reputable(_pick(i, LINKS)).alias("reputable"), T.is_safe(_pick(i, LEVELS), _pick(F.floor(i / 3), LEVELS)).alias("safe"), T.ratio_matches(w, F.lit(20), 1.5).alias("wide"), T.resolution_matches(w, F.lit(20), 20, 40).alias("exact"))


_SCORES = """WITH a AS (SELECT doc_id AS i FROM documents), b AS (SELECT i,
 least(40, CASE WHEN i % 5 < 3 THEN 10 ELSE 0 END + CASE WHEN i % 2 = 0 THEN 8 ELSE 0 END + CASE WHEN i % 3000 > 1000 THEN 3 ELSE 0 END + CASE WHEN i % 5 = 0 AND (i % 3 = 0 OR i % 4 = 0 OR i % 3 > 0 OR i % 7 = 0) THEN 5 ELSE 0 END + CASE WHEN i % 4 = 0 THEN 4 ELSE 0 END + CASE WHEN i % 3 = 0 THEN 4 ELSE 0 END + CASE WHEN i % 6 = 0 THEN 3 ELSE 0 END + CASE WHEN i % 8 = 0 THEN 2 ELSE 0 END + CASE WHEN i % 3 > 0 THEN 1 ELSE 0 END + CASE WHEN i % 9 = 0 THEN 5 ELSE 0 END) AS metadata,
 greatest(0, least(30, CASE WHEN i % 4 = 0 THEN 10 WHEN i % 13 = 0 AND i % 3 = 0 THEN 10 WHEN i % 5 = 0 THEN 20 WHEN i % 13 > 10 THEN 8 WHEN i % 13 > 0 THEN 15 ELSE 12 END + CASE WHEN i % 2 = 0 THEN 5 ELSE CASE WHEN i % 6 = 1 THEN 5 ELSE -10 END + CASE WHEN i % 101 - 75 < -50 THEN -5 WHEN i % 101 - 75 > 0 THEN 5 ELSE 0 END END)) AS external,
 greatest(0, least(25, 10 + CASE i % 3 WHEN 0 THEN -5 WHEN 1 THEN 5 ELSE 0 END + CASE i % 4 WHEN 0 THEN 3 WHEN 1 THEN -3 ELSE 0 END + CASE i % 5 WHEN 0 THEN -5 WHEN 1 THEN 3 ELSE 0 END + CASE WHEN i % 2 = 0 THEN CASE i % 6 WHEN 0 THEN 2 WHEN 2 THEN -2 ELSE 0 END + CASE i % 4 WHEN 0 THEN 2 ELSE -2 END + CASE WHEN i % 50 < 5 THEN 2 WHEN i % 50 >= 30 THEN -3 ELSE 0 END ELSE 0 END + CASE WHEN i % 7 = 0 THEN 2 ELSE 0 END + CASE WHEN i % 9 > 5 THEN 2 ELSE 0 END + CASE WHEN i % 3 > 0 THEN 1 ELSE 0 END + CASE WHEN i % 11 > 0 THEN 2 ELSE 0 END)) AS forensic,
 CASE WHEN i % 2 = 0 THEN 0 ELSE 10 END + CASE WHEN i % 500 > 365 THEN 5 WHEN i % 500 > 30 THEN 3 ELSE 0 END AS temporal, 60 + i % 41 AS similarity FROM a),
 t AS (SELECT *, metadata + external + forensic + temporal AS total, CAST(floor((metadata + external + forensic + temporal) * 100.0 / 110 + 0.5) AS BIGINT) AS percentage, CASE WHEN similarity = 100 THEN 'identical' WHEN similarity >= 85 THEN 'modified_version' WHEN similarity >= 70 THEN 'heavily_modified' END AS modification FROM b)
"""


def score_rows(spark: SparkSession, d: str) -> DataFrame:
    """Factors of the confidence score from rules on the id."""
    i = F.col("i")
    yes = lambda c: F.when(c, True).otherwise(False)
    tri = lambda k: F.when(i % k == 0, True).when(i % k == 1, False)
    a = docs(spark, d).select(F.col("doc_id").alias("i"))
    kind = F.when(i % 5 == 0, "image").when(i % 5 == 1, "video").when(i % 5 == 2, "audio")
    meta = S.metadata_quality(kind, F.when(i % 2 == 0, "f"), i % 3000, yes(i % 3 == 0), yes(i % 4 == 0), i % 6 == 0, i % 8 == 0, i % 3, yes(i % 7 == 0), i % 9 == 0)
    external = S.external_verification(i % 4 != 0, i % 13, i % 3, i % 5 == 0, i % 2 == 1, F.when(i % 6 == 1, 0).otherwise(2), i % 101 - 75)
    forensic = S.forensic(tri(3), tri(4), tri(5), F.when(i % 6 == 0, "consistent").when(i % 6 == 2, "inconsistent"), i % 4 == 0, i % 50, i % 2 == 0, i % 7 == 0, i % 9, i % 3, i % 11)
    out = a.select("i", meta.alias("metadata"), external.alias("external"), forensic.alias("forensic"), S.temporal_trust(i % 2 == 0, i % 500).alias("temporal"), (60 + i % 41).alias("similarity"))
    return S.confidence_total(out).withColumn("modification", S.modification_status(F.col("similarity")))


@query("sc1_6_confidence", _SCORES + "SELECT i, metadata, external, forensic, temporal, total, percentage, modification, CASE WHEN similarity BETWEEN 95 AND 99 THEN 'Minor edits (compression, slight crop, or format change)' WHEN similarity BETWEEN 90 AND 94 THEN 'Moderate edits (cropping, resizing, or color adjustments)' WHEN similarity BETWEEN 85 AND 89 THEN 'Significant edits (substantial cropping, filters, or overlays)' END AS edits FROM t")
def sc1(spark: SparkSession, d: str) -> DataFrame:
    return score_rows(spark, d).select("i", *S.FACTORS, "total", "percentage", "modification", S.inferred_edits(F.col("similarity")).alias("edits"))


@query("sc8_warnings", _SCORES + """SELECT i, concat_ws('|', CASE WHEN metadata < 20 THEN 'Low metadata quality' END, CASE WHEN external < 15 THEN 'Low external verification' END, CASE WHEN forensic < 12.5 THEN 'Low forensic analysis' END, CASE WHEN temporal < 7.5 THEN 'Low temporal trust' END, CASE WHEN m THEN 'Content has been modified (' || similarity || '% similarity to original)' END, CASE WHEN percentage < 50 THEN 'Overall confidence below acceptable threshold' END) AS warnings,
 concat_ws('|', CASE WHEN percentage < 75 AND NOT m THEN 'Consider obtaining additional verification from original source' END, CASE WHEN m THEN 'Verify the source of modifications and original content provenance' END,
 CASE WHEN similarity BETWEEN 95 AND 99 THEN 'Detected modifications: Minor edits (compression, slight crop, or format change)' WHEN similarity BETWEEN 90 AND 94 THEN 'Detected modifications: Moderate edits (cropping, resizing, or color adjustments)' WHEN similarity BETWEEN 85 AND 89 THEN 'Detected modifications: Significant edits (substantial cropping, filters, or overlays)' END, CASE WHEN external < 15 THEN 'Verify chain of custody for this content' END) AS recommendations FROM (SELECT *, similarity BETWEEN 70 AND 99 AS m FROM t)""")
def sc8(spark: SparkSession, d: str) -> DataFrame:
    rows = score_rows(spark, d)
    return rows.select("i", F.array_join(S.warnings(F.col("similarity")), "|").alias("warnings"), F.array_join(S.recommendations(F.col("similarity")), "|").alias("recommendations"))


@query("sc10_23_points", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 15 WHEN doc_id % 2 = 0 THEN 0 ELSE 30 END AS ai, least(50, CASE WHEN doc_id % 2 = 0 THEN 40 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 5 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 10 ELSE 0 END + CASE WHEN doc_id % 4 > 0 THEN 5 ELSE 0 END) AS boost FROM documents")
def sc10(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return docs(spark, d).select("doc_id", S.ai_authenticity(i % 3 != 0, i % 2 == 0).alias("ai"), S.credential_boost(i % 2 == 0, i % 3 == 0, i % 5 == 0, i % 4).alias("boost"))


@query("sc9_legacy_confidence", """WITH f AS (SELECT doc_id, least(30, CASE WHEN doc_id % 4 < 3 THEN 15 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 10 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 5 ELSE 0 END + CASE WHEN doc_id % 9 > 5 THEN 5 ELSE 0 END) AS metadata,
 CASE WHEN doc_id % 5 = 0 THEN 15 WHEN doc_id % 7 < 3 THEN 5 ELSE 30 END AS external, CASE WHEN doc_id % 11 = 0 THEN 20 WHEN doc_id % 6 = 0 THEN 0 WHEN doc_id % 101 > 30 THEN 10 ELSE 20 END AS forensic, doc_id % 5 > 0 AND doc_id % 7 < 3 AS online,
 CASE WHEN doc_id % 13 = 0 THEN 10 WHEN (doc_id % 80) / 2.0 < 1 THEN 0 WHEN (doc_id % 80) / 2.0 < 7 THEN 5 WHEN (doc_id % 80) / 2.0 < 30 THEN 10 ELSE 15 END AS temporal, doc_id % 13 > 0 AND (doc_id % 80) / 2.0 < 1 AS fresh, doc_id % 17 = 0 AS disputed FROM documents),
 t AS (SELECT *, metadata + external + forensic + temporal AS score FROM f), l AS (SELECT *, CASE WHEN disputed THEN 'DISPUTED' WHEN score >= 75 THEN 'HIGH' WHEN score >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM t)
SELECT doc_id, metadata, external, forensic, temporal, score, level, CASE level WHEN 'DISPUTED' THEN 'DISPUTED' WHEN 'HIGH' THEN 'HIGH CONFIDENCE' WHEN 'MEDIUM' THEN 'MEDIUM CONFIDENCE' ELSE 'LOW CONFIDENCE' END AS label,
 concat_ws('|', CASE WHEN online THEN 'Content found online before upload' END, CASE WHEN floor(metadata / 30.0 * 100 + 0.5) < 50 THEN 'Low metadata quality' END, CASE WHEN floor(external / 30.0 * 100 + 0.5) < 50 THEN 'Low external verification' END, CASE WHEN floor(forensic / 25.0 * 100 + 0.5) < 50 THEN 'Low forensic analysis' END, CASE WHEN floor(temporal / 15.0 * 100 + 0.5) < 50 THEN 'Low temporal trust' END, CASE WHEN fresh THEN 'Recently uploaded - limited trust' END) AS warnings,
 CASE WHEN level IN ('LOW', 'MEDIUM') THEN 'Consider providing additional proof of ownership|Link to original publication sources' WHEN level = 'DISPUTED' THEN 'Review dispute details|Provide evidence of original creation' ELSE '' END AS recommendations FROM l""")
def sc9(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    kind = F.when(i % 4 == 0, "image").when(i % 4 == 1, "video").when(i % 4 == 2, "audio")
    s = S.legacy_confidence(kind, i % 2 == 0, i % 3 == 0, i % 9, F.when(i % 5 != 0, i % 7 < 3), F.when(i % 11 != 0, i % 6 == 0), i % 101, F.when(i % 13 != 0, i % 80 / 2), F.when(i % 17 == 0, 1).otherwise(0))
    out = docs(spark, d).select("doc_id", s.alias("s")).select("doc_id", "s.*")
    return out.withColumn("warnings", F.array_join("warnings", "|")).withColumn("recommendations", F.array_join("recommendations", "|"))


_ENS = """WITH d AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (event_id % 97)::DOUBLE / 97 END AS jf, event_id % 7 = 0 AS ji, CASE WHEN event_id % 3 <> 0 THEN event_id % 89 END AS a, event_id % 89 >= 60 AS ai, CASE WHEN event_id % 5 <> 0 THEN event_id % 83 END AS r FROM events),
 e AS (SELECT *, CASE WHEN jf > 0 THEN floor(jf * 100 + 0.5) END AS j FROM d),
 w AS (SELECT *, (j IS NOT NULL)::INT + (a IS NOT NULL)::INT + (r IS NOT NULL)::INT AS k, (j + a + r) / 3.0::DOUBLE AS mean,
  CASE WHEN j IS NOT NULL AND a IS NOT NULL AND r IS NOT NULL THEN j * 0.4::DOUBLE + a * 0.3::DOUBLE + r * 0.3::DOUBLE WHEN j IS NOT NULL AND a IS NOT NULL THEN j * 0.57::DOUBLE + a * 0.43::DOUBLE WHEN j IS NOT NULL AND r IS NOT NULL THEN j * 0.57::DOUBLE + r * 0.43::DOUBLE WHEN a IS NOT NULL AND r IS NOT NULL THEN a * 0.4::DOUBLE + r * 0.6::DOUBLE END AS w FROM e),
 x AS (SELECT *, greatest(abs(j - mean), abs(a - mean), abs(r - mean)) AS most FROM w)
SELECT event_id, CAST(CASE WHEN k >= 2 THEN floor(w + 0.5) WHEN j IS NOT NULL THEN j WHEN a IS NOT NULL THEN a ELSE 0 END AS BIGINT) AS ai_confidence, CASE WHEN k >= 2 THEN floor(w + 0.5) >= 50 WHEN j IS NOT NULL THEN ji WHEN a IS NOT NULL THEN ai ELSE false END AS likely_ai_generated,
 CASE WHEN k = 1 AND r IS NOT NULL THEN 0 ELSE k END AS detectors, CASE WHEN k = 3 THEN CASE WHEN most < 15 THEN 'high' WHEN most < 30 THEN 'medium' ELSE 'low' END END AS agreement, CASE WHEN k = 3 THEN CAST(floor(most + 0.5) AS BIGINT) END AS max_deviation, CASE WHEN k = 3 THEN CAST(floor(mean + 0.5) AS BIGINT) END AS average_confidence FROM x"""


@query("sc13_ensemble", _ENS)
def sc13(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    s = S.ensemble_verdict(F.when(e % 2 == 0, (e % 97).cast("double") / 97), e % 7 == 0, F.when(e % 3 != 0, e % 89), e % 89 >= 60, F.when(e % 5 != 0, e % 83))
    return X.table(spark, d, "events").select("event_id", s.alias("s")).select("event_id", "s.*")


@query("sc15_audio", """WITH f AS (SELECT event_id, CASE WHEN event_id % 7 > 0 THEN event_id % 60 - 70 END AS m, CASE WHEN event_id % 11 > 0 THEN -(event_id % 31) END AS x, event_id % 45 + 1 AS s, [22050, 24000, 44100, 48000, 16000][CAST(event_id % 5 + 1 AS INT)] AS rate, ['aac', 'mp3', 'opus', 'flac'][CAST(event_id % 4 + 1 AS INT)] AS codec FROM events)
SELECT event_id, least(100, CASE WHEN abs(x - m) < 15 THEN 25 WHEN abs(x - m) < 25 THEN 15 ELSE 0 END + CASE WHEN s > 10 AND event_id % 4 * 1.0 / s < 0.1 THEN 20 ELSE 0 END + CASE WHEN rate <> 16000 THEN 5 ELSE 0 END + CASE event_id % 3 WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END
 + CASE WHEN m IS NOT NULL AND x IS NOT NULL AND 100 - abs(x - m) > 85 THEN 20 ELSE 0 END + CASE WHEN codec <> 'flac' THEN 5 ELSE 0 END) AS score FROM f""")
def sc15(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    mean, most = F.when(e % 7 > 0, e % 60 - 70), F.when(e % 11 > 0, -(e % 31))
    return X.table(spark, d, "events").select("event_id", S.audio_score(mean, most, e % 4, e % 45 + 1, _pick(e, [22050, 24000, 44100, 48000, 16000]), e % 3, _pick(e, ["aac", "mp3", "opus", "flac"])).alias("score"))


@query("sc21_frame_rate", """WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 30.0::DOUBLE WHEN 1 THEN 24.0::DOUBLE ELSE 25.0::DOUBLE END AS n, 23.5::DOUBLE + (event_id % 80)::DOUBLE / 10 AS a FROM events), v AS (SELECT *, abs(n - a) / n AS v FROM r), p AS (SELECT *, floor(v * 10000 + 0.5) / 100 AS pct FROM v)
SELECT event_id, floor(n * 100 + 0.5) / 100 AS declared_fps, floor(a * 100 + 0.5) / 100 AS average_fps, pct AS variance_percent, v < 0.02 AS consistent, concat_ws('|', CASE WHEN v >= 0.02 THEN 'Frame rate inconsistency detected - possible editing or splicing' END, CASE WHEN v > 0.1 THEN 'High frame rate variance (' || regexp_replace(CAST(pct AS VARCHAR), '\\.0$', '') || '%) - likely edited' END, CASE WHEN abs(n - 30) < 0.1 AND abs(a - 24) < 0.1 THEN 'Mixed 30fps and 24fps content - indicates editing or format conversion' END) AS warnings FROM p""")
def sc21(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    n = F.when(e % 3 == 0, 30.0).when(e % 3 == 1, 24.0).otherwise(25.0)
    out = X.table(spark, d, "events").select("event_id", S.frame_rate_check(n, 23.5 + e % 80 / 10).alias("r")).select("event_id", "r.*")
    return out.withColumn("warnings", F.array_join("warnings", "|"))


_BATCH = """WITH b AS (SELECT event_id AS e, event_id % 101 AS c, event_id % 1800 + 100 AS w, event_id % 900 + 100 AS h, event_id % 4 < 3 AS likely FROM events),
 p AS (SELECT *, CASE WHEN w * h >= 2000000 THEN 3 WHEN w * h >= 500000 THEN 2 ELSE 1 END AS r, CASE WHEN e % 2 = 0 THEN CASE WHEN e % 5 >= 3 THEN 3 WHEN e % 5 = 2 THEN 2 ELSE 1 END END AS d, CASE WHEN e % 2 = 0 THEN CASE e % 7 WHEN 0 THEN NULL WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 2 ELSE 1 END END AS g FROM b),
 m AS (SELECT *, (r + coalesce(d, 0) + coalesce(g, 0)) * 1.0 / (1 + CASE WHEN d IS NULL THEN 0 ELSE 1 END + CASE WHEN g IS NULL THEN 0 ELSE 1 END) AS mean FROM p)
SELECT e AS event_id, CASE WHEN e % 29 = 0 THEN 'given' WHEN mean >= 2.5 THEN 'high' WHEN mean >= 1.5 THEN 'medium' ELSE 'low' END AS confidence,
 concat_ws('|', CASE WHEN likely THEN CASE WHEN c >= 80 THEN 'High confidence AI-generated content detected (' || c || '%)' WHEN c >= 60 THEN 'Likely AI-generated content detected (' || c || '%)' ELSE 'Possible AI-generated content detected (' || c || '%)' END END, CASE WHEN e % 3 > 0 THEN 'Possible duplicate detected' END, CASE WHEN w < 500 OR h < 500 THEN 'Low resolution image - may affect verification accuracy' END, CASE WHEN w < 200 OR h < 200 THEN 'Very low resolution - verification results may be unreliable' END,
 CASE WHEN e % 100 BETWEEN 1 AND 49 THEN 'Low quality/heavy compression detected' END, CASE WHEN w * 1.0 / h > 5 OR w * 1.0 / h < 0.2 THEN 'Unusual aspect ratio detected' END) AS warnings,
 CASE WHEN e % 6 = 0 THEN 'LIKELY_MANIPULATED' WHEN c >= 80 THEN 'LIKELY_MANIPULATED' WHEN c >= 50 THEN 'QUESTIONABLE' WHEN c >= 30 THEN 'LIKELY_AUTHENTIC' ELSE 'AUTHENTIC' END AS verdict, (e % 6 = 0 OR c >= 50) = (e % 2 = 0) AS correct FROM m"""


@query("sc24_26_batch", _BATCH)
def sc24(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    w, h, c = e % 1800 + 100, e % 900 + 100, e % 101
    agreement = F.when((e % 7).isin(1, 2), "high").when((e % 7).isin(3, 4), "medium").when(e % 7 != 0, "low")
    confidence = S.batch_confidence(F.when(e % 29 == 0, "given"), w, h, e % 2 == 0, e % 5, agreement)
    verdict = S.verdict_of_confidence(e % 6 == 0, c)
    expected = F.when(e % 2 == 0, "LIKELY_MANIPULATED").otherwise("AUTHENTIC")
    return X.table(spark, d, "events").select("event_id", confidence.alias("confidence"), F.array_join(S.batch_warnings(e % 4 < 3, c, e % 3, w, h, e % 100), "|").alias("warnings"), verdict.alias("verdict"), S.case_evaluation(expected, verdict).alias("correct"))


@query("sc19_video_deepfake", with_tables("frames", "faces") + """, b AS (SELECT video_id, count(DISTINCT frame_no) AS ff, count(*) FILTER (WHERE confidence < 0.7) AS lf, var_pop(confidence) AS v FROM faces GROUP BY video_id), j AS (SELECT video_id, count(*) AS n, count(*) FILTER (WHERE abs(x - px) > 100 OR abs(y - py) > 100) AS k FROM (SELECT *, lag(x) OVER (PARTITION BY video_id ORDER BY frame_no, face_idx) AS px, lag(y) OVER (PARTITION BY video_id ORDER BY frame_no, face_idx) AS py FROM faces) GROUP BY video_id)
SELECT b.video_id, least(95, CASE WHEN ff < 10 THEN 0 WHEN lf * 100.0 / ff < 2 THEN 25 WHEN lf * 100.0 / ff > 15 THEN 15 ELSE 0 END + CASE WHEN v > 0.05 THEN 15 ELSE 0 END + CASE WHEN n >= 5 AND k * 100.0 / n > 20 THEN 20 ELSE 0 END) AS score FROM b JOIN j ON b.video_id = j.video_id""")
def sc19(spark: SparkSession, d: str) -> DataFrame:
    f = X.faces(spark, d)
    parts = [A.blink_rate(f).select("video_id", F.col("points").alias("a")), A.face_confidence_variance(f).select("video_id", F.col("points").alias("b")), W.facial_jumps(f).select("video_id", F.col("points").alias("c"))]
    out = parts[0].join(parts[1], "video_id").join(parts[2], "video_id")
    return out.select("video_id", F.least(F.lit(95), F.col("a") + F.col("b") + F.col("c")).alias("score"))


def timed(spark: SparkSession, d: str) -> DataFrame:
    return X.requests(spark, d).withColumn("ts", F.timestamp_seconds("ts"))


_WIN = "SELECT CAST(floor(ts / {n}) * {n} AS BIGINT) AS start"


@query("str1_request_rate", with_tables("requests") + "SELECT w * 1800 AS start, count(*) AS requests, count(*) FILTER (WHERE status < 500) * 1.0 / count(*) AS success_rate, count(*) FILTER (WHERE status >= 500) * 1.0 / count(*) AS error_rate FROM (SELECT status, unnest([CAST(floor(ts / 1800) AS BIGINT), CAST(floor(ts / 1800) AS BIGINT) - 1]) AS w FROM requests) GROUP BY w")
def str1(spark: SparkSession, d: str) -> DataFrame:
    return R.request_rate(timed(spark, d), "1 hour", "30 minutes").withColumn("start", F.unix_timestamp("start"))


@query("str2_ip_window", with_tables("requests") + _WIN.format(n=900) + ", ip, count(*) AS requests, count(*) > 1 AS limited FROM requests GROUP BY 1, ip")
def str2(spark: SparkSession, d: str) -> DataFrame:
    return R.ip_window_limit(timed(spark, d), "15 minutes", 1).withColumn("start", F.unix_timestamp("start"))


@query("str3_key_quota", with_tables("requests", recursive=True) + """, s AS (SELECT api_key, min(ts) AS start FROM requests GROUP BY api_key UNION ALL SELECT s.api_key, min(r.ts) FROM s JOIN requests r ON r.api_key = s.api_key AND r.ts > s.start + 3600 GROUP BY s.api_key),
 p AS (SELECT r.*, s.start FROM requests r JOIN s ON s.api_key = r.api_key AND r.ts BETWEEN s.start AND s.start + 3600),
 u AS (SELECT *, row_number() OVER (PARTITION BY api_key, start ORDER BY ts, request_id) AS used FROM p)
SELECT api_key, request_id, make_timestamp(CAST(ts AS BIGINT) * 1000000) AS ts, used, used > 3 AS rejected, CASE WHEN used > 3 THEN start + 3600 - ts END AS retry_after FROM u""")
def str3(spark: SparkSession, d: str) -> DataFrame:
    return R.key_quota(timed(spark, d), 3, 3600)


@query("str4_abuse", with_tables("requests") + ", h AS (" + _WIN.format(n=3600) + ", ip, count(*) AS requests FROM requests GROUP BY 1, ip) SELECT start, ip, requests, requests > 1 AS suspicious, requests > 2 AS over, bool_or(requests > 2) OVER (PARTITION BY ip ORDER BY start) AS blocked FROM h")
def str4(spark: SparkSession, d: str) -> DataFrame:
    return R.abuse_detector(timed(spark, d), 1, 2).withColumn("start", F.unix_timestamp("start"))


@query("str5_daily_cap", with_tables("requests") + "SELECT * FROM (SELECT request_id, CAST(floor(ts / 86400) * 86400 AS BIGINT) AS day, row_number() OVER (PARTITION BY floor(ts / 86400) ORDER BY ts0, request_id) AS place FROM (SELECT r.*, e.ts AS ts0 FROM requests r JOIN events e ON e.event_id = r.request_id)) WHERE place > 20")
def str5(spark: SparkSession, d: str) -> DataFrame:
    log = X.table(spark, d, "events").select(F.col("event_id").alias("request_id"), "ts")
    return R.daily_cap(log, 20).withColumn("day", F.unix_timestamp("day"))


@query("str8_expired", f"SELECT event_id AS batch_id FROM events WHERE event_type = 'purchase' AND floor(epoch(ts)) + 86400 <= {1704067200 + 15 * 86400}")
def str8(spark: SparkSession, d: str) -> DataFrame:
    from .analytics import batches

    return R.expired(batches(spark, d), F.timestamp_seconds(F.lit(1704067200 + 15 * 86400))).select("batch_id")


@query("str9_alerts", with_tables("requests") + """, r AS (SELECT w * 1800 AS start, count(*) FILTER (WHERE status >= 500) * 1.0 / count(*) AS error_rate FROM (SELECT status, unnest([CAST(floor(ts / 1800) AS BIGINT), CAST(floor(ts / 1800) AS BIGINT) - 1]) AS w FROM requests) GROUP BY w),
 a AS (SELECT t.start, 'HighErrorRate' AS alert, min(b.error_rate) AS held FROM r t JOIN r b ON b.start BETWEEN t.start - 1800 AND t.start GROUP BY t.start HAVING count(*) = 2 AND min(b.error_rate) > 0.02 UNION ALL
 SELECT t.start, 'SevereErrorRate', min(b.error_rate) FROM r t JOIN r b ON b.start BETWEEN t.start - 3600 AND t.start GROUP BY t.start HAVING count(*) = 3 AND min(b.error_rate) > 0.05)
SELECT start, alert, held, CASE alert WHEN 'SevereErrorRate' THEN 'critical' ELSE 'warning' END AS severity, CASE alert WHEN 'SevereErrorRate' THEN 'pagerduty-critical' ELSE 'platform-slack' END AS receiver FROM a""")
def str9(spark: SparkSession, d: str) -> DataFrame:
    scaled = [("HighErrorRate", 0.02, 1800, "warning", "platform", "reliability"), ("SevereErrorRate", 0.05, 3600, "critical", "platform", "reliability")]
    return R.alert_stream(R.request_rate(timed(spark, d), "1 hour", "30 minutes"), 1800, scaled).withColumn("start", F.unix_timestamp("start"))
