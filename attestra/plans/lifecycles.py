"""Queries of stateful log analyses (in their batch form), image facts and signature joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import pixels as P
from attestra.streaming import stateful as T

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


@query("str4_guarded_requests", with_tables("requests") + """, n AS (SELECT ip, request_id, ts, row_number() OVER (PARTITION BY ip, floor(ts / 3600) ORDER BY ts, request_id) AS n FROM requests),
 s AS (SELECT ip, min(struct_pack(t := ts, r := request_id)) AS since FROM n WHERE n = 3 GROUP BY ip), j AS (SELECT n.*, since IS NOT NULL AND (ts > since.t OR (ts = since.t AND request_id > since.r)) AS denied, since IS NOT NULL AND ts = since.t AND request_id = since.r AS last FROM n LEFT JOIN s ON s.ip = n.ip)
SELECT ip, request_id, CAST(ts AS BIGINT) AS ts, CASE WHEN NOT denied THEN n END AS n, CASE WHEN NOT denied THEN n > 1 END AS suspicious, denied OR last AS refused, CASE WHEN denied THEN 'Access denied' WHEN last THEN 'Too many requests. IP blocked.' END AS reason FROM j""")
def str4_guard(spark: SparkSession, d: str) -> DataFrame:
    log = X.requests(spark, d).withColumn("ts", F.timestamp_seconds("ts"))
    return T.guarded_requests(log, 1, 2).withColumn("ts", F.unix_timestamp("ts"))


#: What befalls the batch of each user, event by event, followed step by step.
_BATCHES = """WITH RECURSIVE ev AS (SELECT 'b' || user_id AS b, epoch_us(ts) AS t, event_type AS kind, CASE event_type WHEN 'click' THEN (event_id % 5) * 30000 - 20000 WHEN 'view' THEN event_id % 3 * 40000 END AS ttl, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 r AS (SELECT DISTINCT b, 0::BIGINT AS k, NULL::BIGINT AS s, NULL::BIGINT AS e, NULL::BIGINT AS xs, NULL::BIGINT AS xe FROM ev
  UNION ALL SELECT ev.b, ev.k, CASE WHEN kind = 'purchase' THEN t WHEN e >= t AND kind <> 'error' AND coalesce(ttl, 0) >= 0 THEN s END,
   CASE WHEN kind = 'purchase' THEN t + 86400000000 WHEN e >= t AND kind <> 'error' AND coalesce(ttl, 0) >= 0 THEN t + 1000000 * CASE WHEN coalesce(ttl, 0) = 0 THEN 86400 ELSE ttl END END,
   CASE WHEN e < t THEN s END, CASE WHEN e < t THEN e END FROM r JOIN ev ON ev.b = r.b AND ev.k = r.k + 1),
 l AS (SELECT b, max(k) AS k FROM ev GROUP BY b)
"""


def batch_events(spark: SparkSession, d: str) -> DataFrame:
    """One batch for each user: purchases store it, errors delete it, other events extend it by various times."""
    e, t = F.col("event_id"), F.col("event_type")
    kind = F.when(t == "purchase", "stored").when(t == "error", "deleted").otherwise("extended")
    ttl = F.when(t == "click", (e % 5) * 30000 - 20000).when(t == "view", e % 3 * 40000)
    return X.table(spark, d, "events").select(F.concat(F.lit("b"), "user_id").alias("batch_id"), "ts", kind.alias("event"), ttl.alias("ttl_seconds"))


@query("str8_batch_expiries", _BATCHES + "SELECT b AS batch_id, make_timestamp(xs) AS stored_at, make_timestamp(xe) AS expired_at FROM r WHERE xe IS NOT NULL UNION ALL SELECT r.b, make_timestamp(s), make_timestamp(e) FROM r JOIN l ON l.b = r.b AND l.k = r.k WHERE e IS NOT NULL")
def str8_expiries(spark: SparkSession, d: str) -> DataFrame:
    return T.batch_expiries(batch_events(spark, d))


_NOW = "epoch_us(TIMESTAMP '2024-01-16 00:00:00')"


@query("win11_batch_remaining", _BATCHES.replace("FROM events)", f"FROM events WHERE epoch_us(ts) <= {_NOW})") + f"SELECT r.b AS batch_id, make_timestamp(e) AS expires_at, CAST(floor((e - {_NOW}) / 1e6) AS BIGINT) AS seconds_left FROM r JOIN l ON l.b = r.b AND l.k = r.k WHERE e >= {_NOW}")
def win11_remaining(spark: SparkSession, d: str) -> DataFrame:
    return T.batch_remaining(batch_events(spark, d), F.lit("2024-01-16 00:00:00").cast("timestamp"))


@query("str6_registry_lookup", with_tables("reg") + """, known AS (SELECT fingerprint, count(*) AS n, min(upload_date) - 864000 AS first FROM reg WHERE media_kind = 'audio' GROUP BY fingerprint),
 a AS (SELECT id, fingerprint, upload_date, row_number() OVER (PARTITION BY fingerprint ORDER BY upload_date, id) - 1 AS before, min(upload_date) OVER (PARTITION BY fingerprint) AS own FROM reg)
SELECT a.id AS file_id, a.fingerprint, a.upload_date AS ts, coalesce(k.n, 0) + before > 0 AS found, coalesce(k.n, 0) + before AS seen_before, coalesce(k.first, own) AS first_seen FROM a LEFT JOIN known k ON k.fingerprint = a.fingerprint""")
def str6_lookup(spark: SparkSession, d: str) -> DataFrame:
    """All files as arrivals, on a registry that has had the audio files for ten days."""
    reg = X.reg(spark, d)
    known = reg.filter("media_kind = 'audio'").select("fingerprint", F.timestamp_seconds(F.col("upload_date") - 864000).alias("ts"))
    out = T.looked_up(reg.select(F.col("id").alias("file_id"), "fingerprint", F.timestamp_seconds("upload_date").alias("ts")), known)
    return out.withColumn("ts", F.unix_timestamp("ts")).withColumn("first_seen", F.unix_timestamp("first_seen"))


#: Width at which the bytes of a text are looked at as a picture.
_WIDTH = 48
#: Facts are rounded to 1/8192, which no sum over windows of 100 pixels falls between.
_UNITS = "CAST(floor({} * 8192 + 0.5) AS BIGINT)"
_IMAGE = f"""WITH p AS (SELECT doc_id, unnest(range(octet_length(encode(text)))) AS i, CAST('0x' || unnest(regexp_extract_all(hex(encode(text)), '..')) AS BIGINT) AS v FROM documents WHERE text <> ''),
 n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id), z AS (SELECT doc_id, least(10000, n - 100) AS z FROM n),
 win AS (SELECT p.doc_id, var_pop(v) AS v FROM p JOIN z ON z.doc_id = p.doc_id WHERE i < ceil(z / 100.0) * 100 GROUP BY p.doc_id, i // 100),
 noise AS (SELECT z.doc_id, CASE WHEN z < 0 THEN 0.0 WHEN z > 0 THEN sum(v) / (any_value(z) / 100.0) END AS noise FROM z LEFT JOIN win ON win.doc_id = z.doc_id GROUP BY z.doc_id, z),
 step AS (SELECT doc_id, sum(d) * 1.0 / count(*) AS step FROM (SELECT doc_id, coalesce(abs(v - lag(v) OVER (PARTITION BY doc_id ORDER BY i)), 0) AS d FROM p) GROUP BY doc_id),
 g AS (SELECT p.doc_id, i // {_WIDTH} AS y, i % {_WIDTH} AS x, v, n // {_WIDTH} AS h FROM p JOIN n ON n.doc_id = p.doc_id WHERE i < n // {_WIDTH} * {_WIDTH}),
 b3 AS (SELECT doc_id, y, x, v, coalesce(lag(v) OVER r, v) + v + coalesce(lead(v) OVER r, v) AS s FROM g WINDOW r AS (PARTITION BY doc_id, y ORDER BY x)),
 e AS (SELECT doc_id, greatest(0, least(255, 9 * v - (coalesce(lag(s) OVER c, s) + s + coalesce(lead(s) OVER c, s)))) AS e FROM b3 WINDOW c AS (PARTITION BY doc_id, x ORDER BY y)),
 edge AS (SELECT doc_id, avg(e) AS edge, count(*) FILTER (WHERE e > 100) * 1.0 / count(*) AS strong FROM e GROUP BY doc_id),
 tex AS (SELECT doc_id, var_pop(v) AS texture FROM (SELECT doc_id, var_pop(v) AS v FROM p WHERE i < 65536 GROUP BY doc_id, i // 4096, i % 256 // 16) GROUP BY doc_id),
 px AS (SELECT doc_id, i // 3 AS j, max(CASE WHEN i % 3 = 0 THEN v END) AS c0, max(CASE WHEN i % 3 = 1 THEN v END) AS c1, max(CASE WHEN i % 3 = 2 THEN v END) AS c2 FROM p GROUP BY doc_id, i // 3 HAVING count(*) = 3),
 col AS (SELECT px.doc_id, count(*) FILTER (WHERE abs(c1 - 128) > 100 OR abs(c2 - 128) > 100) / least(5000, any_value(n) / 3.0) AS ext, count(*) FILTER (WHERE (c1 - 128) * (c1 - 128) + (c2 - 128) * (c2 - 128) > 10000) / least(5000, any_value(n) / 3.0) AS sat FROM px JOIN n ON n.doc_id = px.doc_id WHERE j < least(5000, n / 3.0) GROUP BY px.doc_id),
 ch AS (SELECT doc_id, min(c0) AS low, max(c0) AS high, {_UNITS.format("avg(c0)")} AS mean_units, {_UNITS.format("stddev_pop(c0)")} AS sd_units FROM px GROUP BY doc_id)
SELECT d.doc_id, {_UNITS.format("noise")} AS noise_units, {_UNITS.format("step")} AS step_units, {_UNITS.format("edge")} AS edge_units, {_UNITS.format("strong")} AS strong_units, {_UNITS.format("texture")} AS texture_units, {_UNITS.format("coalesce(ext, CASE WHEN n.n > 0 THEN 0 END)")} AS extreme_units, {_UNITS.format("coalesce(sat, CASE WHEN n.n > 0 THEN 0 END)")} AS saturated_units, low, high, mean_units, sd_units
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN noise ON noise.doc_id = d.doc_id LEFT JOIN step ON step.doc_id = d.doc_id LEFT JOIN edge ON edge.doc_id = d.doc_id LEFT JOIN tex ON tex.doc_id = d.doc_id LEFT JOIN col ON col.doc_id = d.doc_id LEFT JOIN ch ON ch.doc_id = d.doc_id"""


@query("agg31_image_facts", _IMAGE)
def agg31_images(spark: SparkSession, d: str) -> DataFrame:
    """The bytes of every text as the planes of a picture."""
    raw = F.col("text").cast("binary")
    facts = P.image_facts(X.table(spark, d, "documents").select("doc_id", F.lit(_WIDTH).alias("width"), *[raw.alias(x) for x in ("gray", "texture", "rgb", "lab")]), "doc_id")
    units = lambda c: F.floor(F.col(c) * 8192 + 0.5).cast("long")
    named = {"noise_units": "window_noise", "step_units": "neighbour_noise", "edge_units": "edge_mean", "strong_units": "edge_share", "texture_units": "texture_spread", "extreme_units": "extreme_share", "saturated_units": "saturated_share"}
    first = F.get(F.col("channels"), 0)
    out = facts.withColumn("c", first).select("*", F.col("c.low").alias("low"), F.col("c.high").alias("high"), F.col("c.mean").alias("mean"), F.col("c.sd").alias("sd"))
    return out.select("doc_id", *[units(c).alias(n) for n, c in named.items()], "low", "high", units("mean").alias("mean_units"), units("sd").alias("sd_units"))


#: Sizes and ratios that generators commonly give, with their points.
SIZE_SIGNATURES = [
    (1920, 1080, ["sora", "runway", "kling"], 10), (1280, 720, ["sora", "pika", "runway"], 10), (3840, 2160, ["sora"], 15),
    (1024, 1024, ["midjourney", "dalle", "stableDiffusion"], 12), (1456, 816, ["midjourney"], 15), (1792, 1024, ["dalle"], 18),
    (1024, 1792, ["dalle"], 18), (512, 512, ["stableDiffusion"], 15), (768, 768, ["stableDiffusion"], 12),
]
RATIO_SIGNATURES = [(16, 9, ["sora", "runway", "kling"], 8), (9, 16, ["sora", "pika"], 8), (1, 1, ["midjourney", "dalle", "stableDiffusion"], 10), (21, 9, ["sora"], 12)]
_SIZES_SQL = ", ".join(f"({w}, {h}, '{g}', {p})" for w, h, gs, p in SIZE_SIGNATURES for g in gs)
_RATIOS_SQL = ", ".join(f"({a}.0::DOUBLE / {b}, '{g}', {p})" for a, b, gs, p in RATIO_SIGNATURES for g in gs)
_SHAPES = [(1920, 1080), (1080, 1920), (720, 1280), (1024, 1024), (1792, 1024), (1000, 1020), (1000, 1021), (512, 512), (2520, 1080), (1456, 816), (640, 480), (3840, 2160), (900, 500), (0, 7)]
_SHAPES_SQL = "[" + ", ".join(f"[{w}, {h}]" for w, h in _SHAPES) + "][CAST(doc_id % 14 + 1 AS INT)]"


@query("fn24_signature_points", f"""WITH i AS (SELECT doc_id, {_SHAPES_SQL}[1] + CASE WHEN doc_id % 5 = 4 THEN doc_id % 90 ELSE 0 END AS w, {_SHAPES_SQL}[2] AS h FROM documents), s(w, h, g, p) AS (VALUES {_SIZES_SQL}), r(r, g, p) AS (VALUES {_RATIOS_SQL}),
 m AS (SELECT doc_id, g, p FROM i, s WHERE (i.w = s.w AND i.h = s.h) OR (i.w = s.h AND i.h = s.w) UNION ALL SELECT doc_id, g, p FROM i, r WHERE w > 0 AND h > 0 AND abs(w::DOUBLE / h - r) < 0.02)
SELECT doc_id AS image_id, g AS generator, CAST(sum(p) AS BIGINT) AS points FROM m GROUP BY doc_id, g""")
def fn24_points(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of all documents' pictures, exact and off by some pixels, against the signatures as tables."""
    i = F.col("doc_id")
    shape = F.element_at(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in _SHAPES]), (i % 14 + 1).cast("int"))
    images = X.table(spark, d, "documents").select(i.alias("image_id"), (shape["w"] + F.when(i % 5 == 4, i % 90).otherwise(0)).alias("width"), shape["h"].cast("long").alias("height"))
    sizes = spark.createDataFrame([(w, h, g, p) for w, h, gs, p in SIZE_SIGNATURES for g in gs], "width long, height long, generator string, points long")
    ratios = spark.createDataFrame([(a / b, g, p) for a, b, gs, p in RATIO_SIGNATURES for g in gs], "ratio double, generator string, points long")
    return P.signature_points(images, sizes, ratios)
