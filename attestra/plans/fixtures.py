"""Media-shaped tables derived from the given tables by rules that Spark and DuckDB share.

Each table has a function for Spark and, under the same name in ``SQL``, the common table expression for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.functions.hashes import median_threshold_hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows from documents."""
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 4 < 2, "image").when(F.col("doc_id") % 4 == 2, "video").otherwise("audio")
    return d.select(
        F.col("doc_id").alias("id"),
        F.sha2("text", 256).alias("fingerprint"),
        F.lit("sha256").alias("fingerprint_algorithm"),
        F.concat("source", F.lit("/"), "doc_id", F.lit("."), kind).alias("original_filename"),
        F.col("n_chars").alias("file_size"),
        F.concat(kind, F.lit("/x")).alias("file_type"),
        kind.alias("media_kind"),
        (F.lit(1704067200) + F.col("doc_id") * 60).alias("upload_date"),
        F.concat(F.lit("10.0.0."), F.col("doc_id") % 7).alias("ip_address"),
    )


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perceptual hashes from embeddings, and a query copy with the lowest vec_id % 13 bits flipped."""
    e = table(spark, sf_dir, "embeddings")
    bits = median_threshold_hash(F.col("embedding"))
    k = (F.col("vec_id") % 13).cast("int")
    low = F.conv(F.substring("phash", 9, 8), 16, 10).cast("long").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1)
    out = e.select("vec_id", bits.alias("phash"))
    return out.withColumn("query_hash", F.concat(F.substring("phash", 1, 8), F.lpad(F.lower(F.hex(low)), 8, "0"))).withColumn("upload_date", F.lit(1704067200) + F.col("vec_id") * 60)


def seg_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference segments from events: one video per user."""
    e = table(spark, sf_dir, "events")
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("video_id"), (F.row_number().over(by) - 1).alias("seg_idx"), F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 32).alias("seg_hash"))


def seg_cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate segments: the reference with hashes changed and rows dropped by rule."""
    r = seg_ref(spark, sf_dir)
    v, i = F.col("video_id"), F.col("seg_idx")
    bad = ((v % 5 == 1) & (i == 3)) | ((v % 5 == 2) & i.between(10, 12)) | ((v % 5 == 3) & (i % 2 == 0)) | ((v % 5 == 4) & (i % 5 != 0))
    changed = F.when(bad, F.substring(F.sha2("seg_hash", 256), 1, 32)).otherwise(F.col("seg_hash"))
    return r.filter(~((v % 7 == 0) & (i < 2))).select("video_id", "seg_idx", changed.alias("seg_hash"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video frames from events."""
    e = table(spark, sf_dir, "events")
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    conf = F.least(F.lit(100), F.floor("value")).cast("long")
    t = F.col("event_type")
    tags = F.when(t == "click", F.array(F.lit("Smooth areas"), F.lit("texture"))).when(t == "view", F.array(F.lit("color distribution"))).when(t == "purchase", F.array(F.lit("saturation"))).when(t == "error", F.array(F.lit("face"))).otherwise(F.array().cast("array<string>"))
    out = e.select(
        F.col("user_id").alias("video_id"),
        F.row_number().over(by).alias("frame_no"),
        "event_id",
        conf.alias("ai_confidence"),
        (conf >= 60).alias("likely"),
        F.sha2((F.floor(F.col("event_id") / 3)).cast("string"), 256).alias("phash"),
        F.col("value").alias("mean_diff"),
        tags.alias("indicators"),
        F.lit("jpeg").alias("format"),
        F.concat((640 + F.col("user_id") % 2).cast("string"), F.lit("x480")).alias("dimensions"),
    )
    return out


def video_facts(frames: DataFrame) -> DataFrame:
    """Container facts and the frame rate's verdict of each video; none for some."""
    v = F.col("video_id")
    some = lambda c: F.when(v % 11 > 0, c)
    pick = lambda *values: F.element_at(F.array(*[F.lit(x) for x in values]), (v % len(values) + 1).cast("int"))
    return frames.select("video_id").distinct().select(
        "video_id", some((v % 130).cast("double")).alias("duration"), some(pick(1920, 1280, 3840, 640)).alias("width"), some(pick(1080, 720, 2160, 480)).alias("height"), some(pick("h264", "h265", "vp9")).alias("codec"), some(v * 1_000_000).alias("size"),
        some(v % 5 < 2).alias("rate_consistent"), some((v % 5).cast("double")).alias("variance_percent"), some(v % 2 == 1).alias("inconsistencies"),
    )


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected faces: one or two rows per frame."""
    f = frames(spark, sf_dir).withColumn("face_idx", F.explode(F.sequence(F.lit(0), F.when(F.col("event_id") % 3 == 0, 1).otherwise(0))))
    e = F.col("event_id") + F.col("face_idx")
    return f.select(
        "video_id", "frame_no", "event_id", "face_idx", (e % 100 / 100).alias("confidence"), (e % 9 - 4).alias("pan"), (e % 7 - 3).alias("tilt"), (e % 5 - 2).alias("roll"), (e * 37 % 500).alias("x"), (e * 53 % 500).alias("y"), (e % 11 == 0).alias("joy"), (e % 22 == 0).alias("sorrow"), (e % 6 == 0).alias("headwear"), (e % 17 != 0).alias("has_landmarks")
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request log from events."""
    e = table(spark, sf_dir, "events")
    m = F.col("event_id") % 4
    status = F.when(F.col("event_type") == "error", F.when(m == 0, 500).when(m == 1, 504).when(m == 2, 429).otherwise(400)).otherwise(200)
    verdict = F.when(m == 0, "PROVEN_STRONG").when(m == 1, "PROVEN_DERIVED").when(m == 2, "INCONCLUSIVE").otherwise("NOT_PROVEN")
    return e.select(
        F.col("event_id").alias("request_id"), F.unix_timestamp("ts").alias("ts"), F.col("event_type").alias("route"), status.alias("status"), F.concat(F.lit("k"), F.col("user_id") % 5).alias("api_key"), F.concat(F.lit("10.0.0."), F.col("user_id")).alias("ip"), F.floor(F.col("value") * 10).cast("long").alias("duration_ms"), verdict.alias("verdict")
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled test cases."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select(
        "doc_id", F.col("lang").alias("category"), (F.col("quality") == 0).alias("actually_fake"), F.when(F.col("toxic") == 1, "LIKELY_MANIPULATED").otherwise("AUTHENTIC").alias("verdict"), (F.col("doc_id") % 100).alias("confidence")
    )


SQL = {
    "reg": """reg AS (SELECT doc_id AS id, sha256(text) AS fingerprint, 'sha256' AS fingerprint_algorithm,
 source || '/' || doc_id || '.' || k AS original_filename, n_chars AS file_size, k || '/x' AS file_type, k AS media_kind,
 1704067200 + doc_id * 60 AS upload_date, '10.0.0.' || (doc_id % 7) AS ip_address
 FROM (SELECT *, CASE WHEN doc_id % 4 < 2 THEN 'image' WHEN doc_id % 4 = 2 THEN 'video' ELSE 'audio' END AS k FROM documents))""",
    "hashes": """hash_bits AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > list_sort(embedding[2:64])[32] THEN 1 ELSE 0 END) AS b FROM embeddings),
 hash_hex AS (SELECT vec_id, array_to_string(list_transform(range(0, 16), lambda i: substr('0123456789abcdef', CAST(1 + 8 * b[4*i+1] + 4 * b[4*i+2] + 2 * b[4*i+3] + b[4*i+4] AS INT), 1)), '') AS phash FROM hash_bits),
 hashes AS (SELECT vec_id, phash, substr(phash, 1, 8) || lpad(lower(printf('%x', xor(('0x' || substr(phash, 9, 8))::UBIGINT::BIGINT, (CAST(1 AS BIGINT) << CAST(vec_id % 13 AS INT)) - 1))), 8, '0') AS query_hash, 1704067200 + vec_id * 60 AS upload_date FROM hash_hex)""",
    "seg": """seg_ref AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seg_idx, substr(sha256(CAST(event_id AS VARCHAR)), 1, 32) AS seg_hash FROM events),
 seg_cand AS (SELECT video_id, seg_idx, CASE WHEN (video_id % 5 = 1 AND seg_idx = 3) OR (video_id % 5 = 2 AND seg_idx BETWEEN 10 AND 12) OR (video_id % 5 = 3 AND seg_idx % 2 = 0) OR (video_id % 5 = 4 AND seg_idx % 5 <> 0) THEN substr(sha256(seg_hash), 1, 32) ELSE seg_hash END AS seg_hash
 FROM seg_ref WHERE NOT (video_id % 7 = 0 AND seg_idx < 2)),
 seg_match AS (SELECT c.video_id, c.seg_idx, c.seg_hash = r.seg_hash AS matched, r.seg_hash AS expected, c.seg_hash AS actual FROM seg_cand c JOIN seg_ref r ON c.video_id = r.video_id AND c.seg_idx = r.seg_idx)""",
    "frames": """frames AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_no, event_id,
 CAST(least(100, floor(value)) AS BIGINT) AS ai_confidence, least(100, floor(value)) >= 60 AS likely, sha256(CAST(CAST(floor(event_id / 3) AS BIGINT) AS VARCHAR)) AS phash, value AS mean_diff, event_type,
 'jpeg' AS format, CAST(640 + user_id % 2 AS VARCHAR) || 'x480' AS dimensions FROM events)""",
    "faces": """faces AS (SELECT video_id, frame_no, event_id, face_idx, (event_id + face_idx) % 100 / 100.0 AS confidence, (event_id + face_idx) % 9 - 4 AS pan, (event_id + face_idx) % 7 - 3 AS tilt, (event_id + face_idx) % 5 - 2 AS roll,
 (event_id + face_idx) * 37 % 500 AS x, (event_id + face_idx) * 53 % 500 AS y, (event_id + face_idx) % 11 = 0 AS joy, (event_id + face_idx) % 22 = 0 AS sorrow, (event_id + face_idx) % 6 = 0 AS headwear, (event_id + face_idx) % 17 <> 0 AS has_landmarks
 FROM frames, (VALUES (0), (1)) AS n(face_idx) WHERE face_idx = 0 OR event_id % 3 = 0)""",
    "requests": """requests AS (SELECT event_id AS request_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type AS route,
 CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 500 WHEN 1 THEN 504 WHEN 2 THEN 429 ELSE 400 END ELSE 200 END AS status, 'k' || (user_id % 5) AS api_key, '10.0.0.' || user_id AS ip,
 CAST(floor(value * 10) AS BIGINT) AS duration_ms, CASE event_id % 4 WHEN 0 THEN 'PROVEN_STRONG' WHEN 1 THEN 'PROVEN_DERIVED' WHEN 2 THEN 'INCONCLUSIVE' ELSE 'NOT_PROVEN' END AS verdict FROM events)""",
    "cases": """cases AS (SELECT l.doc_id, d.lang AS category, l.quality = 0 AS actually_fake, CASE WHEN l.toxic = 1 THEN 'LIKELY_MANIPULATED' ELSE 'AUTHENTIC' END AS verdict, l.doc_id % 100 AS confidence FROM labels l JOIN documents d ON l.doc_id = d.doc_id)""",
}


def with_tables(*names: str, recursive: bool = False) -> str:
    """The WITH clause of the named tables, in order."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in names) + "\n"
