"""Queries of the detector scores, manifests, quantisation tables and frame windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import dct
from attestra.functions import geo as G
from attestra.operators import aggregates as A
from attestra.operators import scoring as S
from attestra.operators import windows as W
from attestra.streaming import streams as R

from . import fixtures as X
from .analytics import _SIMS
from .fixtures import with_tables
from .rules import _SUN, docs

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


@query("sc7_label", """SELECT doc_id, CASE WHEN k = 1 AND v IS NOT NULL THEN CASE WHEN doc_id % 3 = 0 AND v > 30 THEN 'DEEPFAKE INDICATORS DETECTED' WHEN v >= 70 THEN 'PRIMARILY AI-GENERATED VIDEO' WHEN v >= 30 THEN 'SIGNIFICANT MIX OF VIDEO AND AI CONTENT' WHEN v >= 5 THEN 'AI-GENERATED CONTENT DETECTED' ELSE 'VERIFIED VIDEO' END
 WHEN k = 2 AND a IS NOT NULL THEN CASE WHEN a >= 70 THEN 'FULLY AI-GENERATED AUDIO' WHEN doc_id % 2 = 0 AND a >= 50 THEN 'SYNTHETIC VOICE DETECTED' ELSE 'VERIFIED AUDIO RECORDING' END
 WHEN k = 0 THEN CASE WHEN doc_id % 83 >= 60 THEN 'AI-GENERATED IMAGE' WHEN p >= 75 THEN 'VERIFIED PHOTOGRAPH' WHEN p >= 50 AND doc_id % 2 = 0 THEN 'MODIFIED VERSION DETECTED' WHEN p >= 50 THEN 'LIKELY CAMERA-CAPTURED' WHEN p >= 25 THEN 'MANIPULATION DETECTED' ELSE 'HEAVILY MANIPULATED' END
 ELSE CASE WHEN p >= 75 THEN 'HIGH INTEGRITY' WHEN p >= 50 THEN 'MEDIUM INTEGRITY' ELSE 'LOW INTEGRITY' END END AS label
 FROM (SELECT doc_id, doc_id % 4 AS k, doc_id % 101 AS p, CASE WHEN doc_id % 7 > 0 THEN doc_id % 97 END AS v, CASE WHEN doc_id % 5 > 0 THEN doc_id % 89 END AS a FROM documents)""")
def sc7(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    kind = F.when(i % 4 == 0, "image").when(i % 4 == 1, "video").when(i % 4 == 2, "audio").otherwise("other")
    label = S.confidence_label(kind, i % 101, i % 2 == 0, i % 83, F.when(i % 7 > 0, i % 97), i % 3 == 0, F.when(i % 5 > 0, i % 89), i % 2 == 0)
    return docs(spark, d).select("doc_id", label.alias("label"))


_SC11 = """WITH f AS (SELECT doc_id, doc_id % 4 = 0 AS size, doc_id % 3 = 0 AS bare, doc_id % 100 AS sd, doc_id % 53 = 0 AS sw, doc_id % 2 = 0 AS png, (doc_id % 101) / 100.0 AS r, doc_id % 700 AS no, doc_id % 75 AS ed, (doc_id % 9) / 100.0 AS es, (doc_id % 47) / 100.0 AS ex, (doc_id % 97) / 100.0 AS sa FROM documents),
 e AS (SELECT *, [CASE WHEN size THEN 25 END, CASE WHEN bare THEN 8 END, CASE WHEN sd < 15 THEN 20 WHEN sd < 25 OR sd > 80 THEN 12 END] AS early,
  [CASE WHEN png AND bare THEN 12 END, CASE WHEN NOT png AND r > 0.95 THEN 20 WHEN NOT png AND r < 0.3 THEN 10 END, CASE WHEN NOT png AND bare AND r > 0.85 THEN 15 END, CASE WHEN no < 15 THEN 25 WHEN no < 30 THEN 15 WHEN no BETWEEN 100 AND 600 THEN -10 END,
   CASE WHEN ed < 10 THEN 20 WHEN ed < 20 THEN 10 END, CASE WHEN ed > 60 THEN 12 END, CASE WHEN es < 0.02 AND ed < 20 THEN 15 WHEN es > 0.05 THEN -8 END, CASE WHEN ex > 0.35 THEN 10 END, CASE WHEN sa > 0.9 THEN 8 END, CASE WHEN ex < 0.01 AND sa < 0.05 THEN 15 END] AS late FROM f),
 t AS (SELECT doc_id, CASE WHEN sw THEN 100 ELSE coalesce(list_sum(early), 0) END + coalesce(list_sum(late), 0) AS s, list_count(early) + list_count(late) + CASE WHEN sw THEN 1 ELSE 0 END AS n FROM e),
 u AS (SELECT doc_id, n + CASE WHEN n >= 5 AND s >= 55 AND s < 60 THEN 1 ELSE 0 END AS n, greatest(0, s + CASE WHEN n >= 5 AND s >= 55 AND s < 60 THEN 10 ELSE 0 END) AS s FROM t)
SELECT doc_id, CAST(least(s, 100) AS INT) AS ai_confidence, s >= 60 AS likely_ai_generated, CAST(n AS INT) AS n_indicators FROM u"""


@query("sc11_local_image", _SC11)
def sc11(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    score = S.local_image_score(i % 4 == 0, i % 3 != 0, i % 100, i % 53 == 0, F.when(i % 2 == 0, "png").otherwise("jpeg"), i % 101 / 100, i % 700, i % 75, i % 9 / 100, i % 47 / 100, i % 97 / 100)
    return docs(spark, d).select("doc_id", score.alias("s")).select("doc_id", "s.*")


@query("sc14_portrait", """WITH p AS (SELECT doc_id, least(100, CASE WHEN m = 0 AND doc_id % 2 = 0 THEN 40 ELSE 0 END + CASE WHEN m = 0 AND doc_id % 3 = 0 THEN 30 ELSE 0 END + CASE WHEN m = 0 AND doc_id % 5 < 2 THEN 20 ELSE 0 END + CASE WHEN m = 1 AND doc_id % 3 = 0 THEN 35 ELSE 0 END + CASE WHEN m = 2 AND doc_id % 7 = 0 THEN 40 ELSE 0 END + CASE WHEN doc_id % 11 = 0 OR doc_id % 22 = 5 THEN 15 ELSE 0 END + CASE WHEN doc_id % 7 = 0 OR doc_id % 14 = 3 THEN 25 ELSE 0 END + CASE WHEN doc_id % 13 = 0 THEN 20 ELSE 0 END + CASE WHEN doc_id % 17 = 0 THEN 15 ELSE 0 END + CASE WHEN m < 3 AND doc_id % 6 > 0 AND (doc_id % 6) < 2.8 THEN 25 ELSE 0 END) AS score FROM (SELECT doc_id, doc_id % 4 AS m FROM documents))
SELECT doc_id, score, CASE WHEN score >= 40 THEN greatest(0, doc_id % 101 - CAST(floor(30 * score / 100.0 + 0.5) AS BIGINT)) ELSE doc_id % 101 END AS adjusted FROM p""")
def sc14(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    make = F.when(i % 4 == 0, "Apple").when(i % 4 == 1, "Google").when(i % 4 == 2, "SAMSUNG")
    score = S.portrait_score(make, F.when(i % 4 == 1, "Pixel 8"), F.when(i % 2 == 0, "Portrait lens"), F.lit("Apple"), F.when(i % 3 == 0, "portrait 1.0"), F.when(i % 5 == 0, 26).when(i % 5 == 1, 52), F.when(i % 3 == 0, "HDR+"), F.when(i % 14 == 0, "portrait").when(i % 14 == 3, "2"), F.when(i % 7 == 0, "Portrait"), F.when(i % 11 == 0, "Close view").when(i % 22 == 5, "2"), F.when(i % 13 == 0, "nice bokeh"), i % 17 == 0, i % 6)
    return docs(spark, d).select("doc_id", score.alias("score"), S.portrait_adjust(i % 101, score).alias("adjusted"))


_FACE = """, s AS (SELECT video_id AS image_id, CASE WHEN confidence < 0.8 THEN 15 ELSE 0 END + CASE WHEN joy AND sorrow THEN 20 ELSE 0 END + CASE WHEN event_id % 4 = 0 AND confidence > 0.95 THEN 10 ELSE 0 END + CASE WHEN headwear AND confidence > 0.9 THEN 5 ELSE 0 END + CASE WHEN pan <> 0 AND tilt <> 0 AND roll <> 0 AND abs(pan) + abs(tilt) + abs(roll) < 5 AND confidence > 0.95 THEN 8 ELSE 0 END
 + CASE WHEN NOT has_landmarks THEN 15 WHEN x % 10 > 50 * 0.15 AND y % 40 > 20 THEN 22 ELSE 0 END AS suspicion FROM faces)
SELECT image_id, faces, suspicious, suspicious > 0 AS is_deepfake, CASE WHEN suspicious > 0 THEN least(95, CAST(floor(suspicious * 100.0 / faces + 0.5) AS BIGINT)) ELSE 0 END AS confidence FROM (SELECT image_id, count(*) AS faces, count(*) FILTER (WHERE suspicion > 20) AS suspicious FROM s GROUP BY image_id)"""


@query("sc18_face_suspicion", with_tables("frames", "faces") + _FACE)
def sc18(spark: SparkSession, d: str) -> DataFrame:
    f = X.faces(spark, d)
    place = lambda c: F.when(F.col("has_landmarks"), c)
    marks = F.struct(F.lit(0).alias("left_x"), F.lit(0).alias("left_y"), F.lit(50).alias("right_x"), (F.col("x") % 10).alias("right_y"), place(F.lit(0)).alias("nose_x"), (F.col("y") % 40).alias("mouth_x"))
    s = S.face_suspicion(F.col("confidence"), F.col("joy"), F.col("sorrow"), F.col("event_id") % 4 == 0, F.col("headwear"), F.col("pan"), F.col("tilt"), F.col("roll"), marks)
    return S.image_deepfake(f.select(F.col("video_id").alias("image_id"), s.alias("suspicion")))


_SHADOW = _SUN[: _SUN.rindex("SELECT event_id, round(alt")] + """, y AS (SELECT z.event_id, alt, az, CAST(z.event_id % 160 - 80 AS DOUBLE) AS lat, dayofyear(ts) AS day, z.event_id % 2 = 0 AS seen, CAST(z.event_id % 360 AS DOUBLE) AS dir, (z.event_id % 30) / 10.0 AS ratio FROM z JOIN events e ON e.event_id = z.event_id),
 o AS (SELECT *, abs(dir - ((az + 180) - trunc((az + 180) / 360) * 360)) AS off, 1 / tan(radians(alt)) AS exp FROM y),
 w AS (SELECT event_id, CASE WHEN seen THEN CASE WHEN alt < 0 THEN 1 ELSE 0 END + CASE WHEN alt > 0 AND least(off, 360 - off) > 45 THEN 1 ELSE 0 END + CASE WHEN alt > 0 AND abs(ratio - exp) / exp > 0.5 THEN 1 ELSE 0 END ELSE 0 END AS mismatches,
 CASE WHEN alt > 90 - abs(lat) + 23.44 + 5 THEN 1 ELSE 0 END + CASE WHEN abs(lat) > 66.5 AND ((lat > 0 AND (day < 80 OR day > 265)) OR (lat < 0 AND day BETWEEN 80 AND 265)) AND alt > 0 THEN 1 ELSE 0 END AS impossible FROM o)
SELECT event_id, mismatches, impossible, greatest(0, 100 - 20 * mismatches - 30 * impossible) AS confidence, mismatches + impossible = 0 AS valid FROM w"""


@query("sc20_shadow", _SHADOW)
def sc20(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    lat = (e % 160 - 80).cast("double")
    rows = X.table(spark, d, "events").select("event_id", "ts", G.sun_position(lat, (e % 340 - 170).cast("double"), F.col("ts")).alias("sun"))
    return rows.select("event_id", S.shadow_check(F.col("sun"), lat, G.day_of_year(F.col("ts")), e % 2 == 0, (e % 360).cast("double"), e % 30 / 10).alias("s")).select("event_id", "s.*")


_REPORT = ["generator", "generator_info", "make", "model", "serial", "captured_at", "creator", "source_type", "software", "signed", "valid", "issuer", "signed_at", "ingredients", "actions", "has_edits", "anchored"]
#: Manifests, one for each branch, and what they say (in the order of _REPORT; what is not named is null, false or 0).
_MANIFESTS = [
    ('{"active_manifest":{"claim_generator":"gen","claim_generator_info":"v1","assertions":[{"label":"stds.exif","data":{"Make":"Cam","Model":"M1","SerialNumber":"7","DateTimeOriginal":"2024"}}],"signature_info":{"validated":true,"issuer":"CA","time":"t"}}}', {"generator": "gen", "generator_info": "v1", "make": "Cam", "model": "M1", "serial": "7", "captured_at": "2024", "signed": True, "valid": True, "issuer": "CA", "signed_at": "t"}),
    ('{"active_manifest":{"assertions":[{"label":"x.stds.exif.y","data":{"Make":"","exif:Make":"C2","exif:Model":"M2","CreateDate":"d"}},{"label":"blockchain.x"}],"signature_info":{"validated":false,"issuer":"CB"}}}', {"make": "C2", "model": "M2", "captured_at": "d", "issuer": "CB", "anchored": True}),
    ('{"active_manifest":{"assertions":[{"label":"stds.exif","data":{"Make":"A"}},{"label":"stds.exif","data":{"Model":"B"}}],"validation_status":[{"code":"ok"},{"code":"success"}]}}', {"model": "B", "valid": True}),
    ('{"claim_generator":"top","ingredients":[{"title":"a"},{"title":"b"}],"validation_status":[{"code":"ok"},{"code":"bad"}]}', {"generator": "top", "ingredients": 2, "has_edits": True}),
    ('{"active_manifest":{"assertions":[{"label":"c2pa.actions","data":{"actions":[{"action":"crop"},{"action":"blur"}]}},{"label":"c2pa.actions.v2","data":{"actions":[]}}],"ingredients":[]}}', {"actions": 0, "has_edits": True}),
    ('{"active_manifest":{"assertions":[{"label":"c2pa.actions","data":{"actions":[{"action":"crop"}]}},{"label":"c2pa.actions","data":{"actions":"none"}}]}}', {"actions": 1, "has_edits": True}),
    ('{"active_manifest":{"assertions":[{"label":"stds.schema-org.CreativeWork","data":{"author":"","creator":"Z"}},{"label":"c2pa.digital_source_type","data":{"value":"photo"}},{"label":"stds.schema-org.SoftwareApplication","data":{"name":"Ed"}}],"validation_status":[]}}', {"creator": "Z", "source_type": "photo", "software": "Ed", "valid": True}),
    ('{"active_manifest":{"assertions":[{"label":"stds.iptc.DigitalSourceType","data":{"kind":"k"}},{"label":"c2pa.software_agent","data":{}},{"label":"c2pa.hash.data","data":{}}],"hard_bindings":["h"]}}', {"source_type": '{"kind":"k"}', "software": "{}", "anchored": True}),
    ('{"active_manifest":{"assertions":[{"label":"c2pa.hash.data","data":{}},{"label":"com.truepic.x","data":{}}],"hard_bindings":[]}}', {"anchored": True}),
    ("{}", {}),
    ("{not json", {}),
]


def _said(report: dict, field: str) -> str:
    value = report.get(field, False if field in ("signed", "valid", "has_edits", "anchored") else 0 if field in ("ingredients", "actions") else None)
    return "CAST(NULL AS VARCHAR)" if value is None else f"'{value}'" if isinstance(value, str) else str(value).lower()


_SC22 = "WITH r AS (" + " UNION ALL ".join(f"SELECT {k} AS k, " + ", ".join(f"{_said(report, f)} AS {f}" for f in _REPORT) for k, (_, report) in enumerate(_MANIFESTS)) + f") SELECT e.event_id, {', '.join(f'r.{f}' for f in _REPORT)} FROM events e JOIN r ON r.k = e.event_id % {len(_MANIFESTS)}"


@query("sc22_provenance", _SC22)
def sc22(spark: SparkSession, d: str) -> DataFrame:
    from attestra.sources.registry import read_detector_json

    text = F.element_at(F.array(*[F.lit(m) for m, _ in _MANIFESTS]), (F.col("event_id") % len(_MANIFESTS) + 1).cast("int"))
    rows = X.table(spark, d, "events").select("event_id", text.alias("json"))
    return read_detector_json(rows, "json", S.MANIFEST_SCHEMA, "m").select("event_id", S.provenance_report(F.col("m")).alias("r")).select("event_id", "r.*")


#: Fixed value: the luminance table of ITU-T T.81, Annex K, row by row.
LUMINANCE = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]


def at_quality(q: int) -> list[int]:
    """The luminance table scaled to a quality over 50, as encoders do."""
    return [max(1, (v * (200 - 2 * q) + 50) // 100) for v in LUMINANCE]


STANDARDS = [(f"Q{q}", at_quality(q)) for q in (90, 92, 95)]


def _table_sql(values: list[int]) -> str:
    return "[" + ", ".join(map(str, values)) + "]"


#: Qualities whose tables the query varies: the standard ones, and some near to cameras' variances.
_QUALITIES = [90, 92, 95, 80, 76, 85]
_LIKE8 = "1 - list_sum(list_transform(range(1, 9), lambda i: abs(q[CAST(i AS INT)] - ({t})[CAST(i AS INT)]))) / (8 * 255.0) > 0.7 AND abs(v - {v}) < 50"
_AGG28 = (
    "WITH q AS (SELECT doc_id AS image_id, list_transform(range(1, 65), lambda i: ([" + ", ".join(_table_sql(at_quality(n)) for n in _QUALITIES) + "])[CAST(1 + doc_id % 6 AS INT)][CAST(i AS INT)] + (doc_id * i) % 5) AS q FROM documents), m AS (SELECT *, list_sum(q) / 64.0 AS mean FROM q),"
    " s AS (SELECT *, list_sum(list_transform(q, lambda x: (x - mean) * (x - mean))) / 64 AS v, " + ", ".join(f"1 - list_sum(list_transform(range(1, 65), lambda i: abs(q[CAST(i AS INT)] - ({_table_sql(t)})[CAST(i AS INT)]))) / (64 * 255.0) AS s{n}" for n, t in STANDARDS) + " FROM m)"
    " SELECT image_id, CAST(floor(mean * 1e4 + 0.5) AS BIGINT) AS mean_e4, CAST(floor(v * 1e4 + 0.5) AS BIGINT) AS variance_e4, CASE WHEN sQ90 >= sQ92 AND sQ90 >= sQ95 THEN 'Q90' WHEN sQ92 >= sQ95 THEN 'Q92' ELSE 'Q95' END AS standard, CAST(floor(greatest(sQ90, sQ92, sQ95) * 1e6 + 0.5) AS BIGINT) AS similarity_e6,"
    " CASE " + " ".join("WHEN " + _LIKE8.format(t=t, v=v) + f" THEN '{n}'" for n, t, v in [("canon", [8, 6, 5, 8, 12, 20, 26, 31], 150), ("nikon", [10, 7, 6, 10, 14, 24, 31, 37], 180), ("sony", [6, 4, 4, 6, 10, 16, 20, 24], 120)]) + " END AS camera FROM s"
)


@query("agg28_qtables", _AGG28)
def agg28(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    tables = F.array(*[F.array(*[F.lit(v) for v in at_quality(n)]) for n in _QUALITIES])
    base = F.element_at(tables, (i % 6 + 1).cast("int"))
    q = docs(spark, d).select(i.alias("image_id"), F.transform(base, lambda v, k: v + (i * (k + 1)) % 5).alias("q"))
    return A.qtable_stats(q, STANDARDS)


@query("fn10_dct_hash")
def fn10(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(dct.SIZE**2 - 1)), lambda k: (i * 31 + k * k * 7 + k * i) % 256)
    return dct.with_dct_hash(docs(spark, d).select("doc_id", pixels.alias("pixels")), F.col("pixels")).select("doc_id", "phash")


@query("str7_segment_windows", "WITH f AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events) SELECT video_id, CAST(k // 15 AS BIGINT) AS start, count(*) AS n FROM f GROUP BY video_id, k // 15 HAVING count(*) = 15")
def str7(spark: SparkSession, d: str) -> DataFrame:
    f = X.frames(spark, d)
    timed = f.select("video_id", F.timestamp_micros(((F.col("frame_no") - 1) * 1_000_000 / 15 + 100).cast("long")).alias("ts"))
    return R.segment_windows(timed).withColumn("start", F.unix_timestamp("start"))


@query("sc12_jpeg_artifacts", """WITH f AS (SELECT doc_id AS i, CASE WHEN doc_id % 6 > 0 THEN (doc_id % 101) / 100.0 END AS st, doc_id % 5 = 0 AS cam, doc_id % 211 AS va, CASE WHEN doc_id % 7 > 0 THEN (doc_id % 31) / 100.0 END AS hi, (doc_id % 97) / 96.0 AS un, CASE WHEN doc_id % 8 > 0 THEN doc_id % 17 END AS sp, (doc_id % 23) / 22.0 AS so,
 len(list_filter(range(2, 64), lambda k: abs((doc_id * k) % 19 - (doc_id * (k - 1)) % 19) > 5 AND abs((doc_id * (k + 1)) % 19 - (doc_id * k) % 19) > 5)) > 10 AS du FROM documents),
 p AS (SELECT i, CASE WHEN st IS NOT NULL THEN greatest(0.0, least(1.0, 0.5 + CASE WHEN st > 0.85 THEN 0.7 ELSE 0 END - CASE WHEN cam THEN 0.6 ELSE 0 END + CASE WHEN va < 100 THEN 0.3 ELSE 0 END)) END AS a, CASE WHEN hi IS NOT NULL THEN CASE WHEN hi < 0.15 THEN 0.4 ELSE 0 END + CASE WHEN un > 0.75 THEN 0.4 ELSE 0 END END AS b, CASE WHEN sp IS NOT NULL THEN CASE WHEN sp < 8 THEN 0.5 ELSE 0 END + CASE WHEN so > 0.7 THEN 0.3 ELSE 0 END END AS c, CASE WHEN du THEN 0.35 ELSE 0.65 END AS d FROM f)
SELECT i AS doc_id, round((coalesce(a, 0) * 0.35 + coalesce(b, 0) * 0.30 + coalesce(c, 0) * 0.20 + d * 0.15) / (CASE WHEN a IS NULL THEN 0 ELSE 0.35 END + CASE WHEN b IS NULL THEN 0 ELSE 0.30 END + CASE WHEN c IS NULL THEN 0 ELSE 0.20 END + 0.15), 6) AS score FROM p""")
def sc12(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    q = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: (i * k) % 19)
    score = S.jpeg_artifact_score(F.when(i % 6 > 0, i % 101 / 100), i % 5 == 0, i % 211, F.when(i % 7 > 0, i % 31 / 100), i % 97 / 96, F.when(i % 8 > 0, i % 17), i % 23 / 22, S.double_compressed(F.col("q")))
    return docs(spark, d).select("doc_id", q.alias("q")).select("doc_id", F.round(score, 6).alias("score"))


_IMAGE = """WITH f AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 1920 WHEN 1 THEN 1024 WHEN 2 THEN 1024 WHEN 3 THEN 512 WHEN 4 THEN 777 END AS w, CASE doc_id % 6 WHEN 0 THEN 1080 WHEN 1 THEN 1024 WHEN 2 THEN 1792 WHEN 3 THEN 512 WHEN 4 THEN 333 END AS h, doc_id % 25 AS lo, 200 + doc_id % 56 AS hi,
 CAST(doc_id % 256 AS DOUBLE) AS r, CAST((doc_id * 7) % 256 AS DOUBLE) AS g, CAST((doc_id * 3) % 256 AS DOUBLE) AS b, (doc_id % 130) / 10.0 AS noise, (doc_id % 35)::DOUBLE AS edge, (doc_id % 10) / 100.0 AS strong, (doc_id * 13 % 2500)::DOUBLE AS tex, doc_id % 3 = 0 AS exif, doc_id % 2 = 0 AS srgb, CASE WHEN doc_id % 5 > 0 THEN doc_id % 101 END AS ai, doc_id % 4 AS sm, doc_id % 3 AS sa FROM documents),
 m AS (SELECT *, greatest(r, g, b) AS top, least(r, g, b) AS low FROM f), s AS (SELECT *, CASE WHEN top > 0 THEN (top - low) / top ELSE 0 END AS sat FROM m),
 k AS (SELECT doc_id, unnest(list_filter([CASE WHEN w = 1920 THEN 'r1' END, CASE WHEN w = 1024 AND h = 1024 THEN 'r2' END, CASE WHEN h = 1792 THEN 'r3' END, CASE WHEN w = 512 THEN 'r4' END, CASE WHEN w = 1920 THEN 'a1' END, CASE WHEN abs(w * 1.0 / h - 9 / 16.0) < 0.02 THEN 'a2' END, CASE WHEN w = h THEN 'a3' END, CASE WHEN abs(w * 1.0 / h - 21 / 9.0) < 0.02 THEN 'a4' END, CASE WHEN lo > 10 AND hi < 250 THEN 'c1' END, CASE WHEN sat > 0.7 THEN 'c2' END, CASE WHEN sat < 0.4 AND sat > 0.2 THEN 'c3' END, CASE WHEN abs(r - g) + abs(g - b) < 20 THEN 'c4' END, CASE WHEN hi - lo > 200 THEN 'c5' END,
 CASE WHEN noise < 5 THEN 'n1' WHEN noise < 10 THEN 'n2' END, CASE WHEN noise > 3 AND noise < 8 THEN 'n3' END, CASE WHEN edge < 15 AND strong < 0.05 THEN 'e1' END, CASE WHEN edge > 10 AND edge < 25 THEN 'e2' END, CASE WHEN edge > 15 AND edge < 30 THEN 'e3' END, CASE WHEN tex < 100 THEN 't1' END, CASE WHEN tex > 500 AND tex < 2000 THEN 't2' END, CASE WHEN NOT exif THEN 'x1' END, CASE WHEN srgb THEN 'x2' END, CASE WHEN ai > 70 THEN 'd1' WHEN ai > 50 THEN 'd2' END], lambda z: z IS NOT NULL)) AS rule FROM s),
 p(rule, so, ru, pi, kl, mi, da, sd, fi) AS (VALUES ('r1', 10, 10, 0, 10, 0, 0, 0, 0), ('r2', 0, 0, 0, 0, 12, 12, 12, 0), ('r3', 0, 0, 0, 0, 0, 36, 0, 0), ('r4', 0, 0, 0, 0, 0, 0, 15, 0), ('a1', 8, 8, 0, 8, 0, 0, 0, 0), ('a2', 8, 0, 8, 0, 0, 0, 0, 0), ('a3', 0, 0, 0, 0, 10, 10, 10, 0), ('a4', 12, 0, 0, 0, 0, 0, 0, 0), ('c1', 12, 8, 0, 0, 0, 0, 0, 0), ('c2', 0, 0, 10, 0, 8, 0, 0, 0), ('c3', 0, 0, 0, 8, 0, 0, 0, 6), ('c4', 0, 0, 0, 0, 0, 8, 0, 0), ('c5', 0, 0, 0, 0, 10, 0, 0, 0),
 ('n1', 8, 6, 0, 0, 0, 10, 0, 0), ('n2', 0, 0, 6, 6, 8, 0, 0, 0), ('n3', 4, 0, 0, 0, 0, 0, 0, 0), ('e1', 0, 0, 0, 0, 0, 12, 0, 10), ('e2', 0, 0, 0, 0, 8, 0, 0, 0), ('e3', 6, 6, 0, 0, 0, 0, 0, 0), ('t1', 6, 0, 0, 0, 0, 8, 0, 0), ('t2', 0, 0, 0, 0, 10, 0, 0, 0), ('x1', 3, 3, 3, 3, 3, 3, 3, 3), ('x2', 0, 0, 0, 0, 3, 3, 0, 0), ('d1', 8, 8, 8, 8, 8, 8, 8, 8), ('d2', 4, 4, 4, 4, 4, 4, 4, 4)),
 q AS (SELECT doc_id, sum(so) AS so, sum(ru) AS ru, sum(pi) AS pi, sum(kl) AS kl, sum(mi) AS mi, sum(da) AS da, sum(sd) AS sd, sum(fi) AS fi FROM k JOIN p ON k.rule = p.rule GROUP BY doc_id),
 z AS (SELECT f.doc_id, [coalesce(so, 0), coalesce(ru, 0), coalesce(pi, 0) + x * 2 * sa, coalesce(kl, 0), coalesce(mi, 0) + x * 2 * (sm + sa), coalesce(da, 0) + x * 2 * sm, coalesce(sd, 0), coalesce(fi, 0)] AS v FROM (SELECT *, CASE WHEN ai > 0 THEN 1 ELSE 0 END AS x FROM f) f LEFT JOIN q ON q.doc_id = f.doc_id),
 y AS (SELECT doc_id, list_transform(v, lambda n: CAST(floor(n / greatest(1, list_sum(v)) * 100 + 0.5) AS BIGINT)) AS v FROM (SELECT doc_id, list_transform(v, lambda n: n::DOUBLE) AS v FROM z)),
 w AS (SELECT doc_id, list_max(v) AS confidence, CASE WHEN list_max(v) > 0 THEN (['sora', 'runway', 'pika', 'kling', 'midjourney', 'dalle', 'stableDiffusion', 'firefly'])[list_position(v, list_max(v))] ELSE 'unknown' END AS generator FROM y)
SELECT doc_id, generator, confidence, confidence > 50 AS is_ai, CASE WHEN confidence >= 80 THEN 'HIGHLY_LIKELY_' || upper(generator) WHEN confidence >= 65 THEN 'LIKELY_' || upper(generator) WHEN confidence >= 50 THEN 'PROBABLE_AI_IMAGE' WHEN confidence >= 35 THEN 'POSSIBLE_AI_GENERATED' WHEN confidence >= 20 THEN 'LOW_AI_INDICATORS' ELSE 'UNLIKELY_AI_GENERATED' END AS verdict FROM w"""


@query("sc16_generator_attribution", _IMAGE)
def sc16(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    low, high = i % 25, 200 + i % 56
    facts = {
        "width": F.when(i % 6 == 0, 1920).when((i % 6).isin(1, 2), 1024).when(i % 6 == 3, 512).when(i % 6 == 4, 777), "height": F.when(i % 6 == 0, 1080).when(i % 6 == 1, 1024).when(i % 6 == 2, 1792).when(i % 6 == 3, 512).when(i % 6 == 4, 333),
        **{f"{c}_{x}": v for c in "rgb" for x, v in (("min", low), ("max", high))}, "r_mean": (i % 256).cast("double"), "g_mean": (i * 7 % 256).cast("double"), "b_mean": (i * 3 % 256).cast("double"),
        "noise": i % 130 / 10, "edge": (i % 35).cast("double"), "strong_edges": i % 10 / 100, "texture": (i * 13 % 2500).cast("double"), "exif": i % 3 == 0, "space": F.when(i % 2 == 0, "srgb"), "ai_confidence": F.when(i % 5 > 0, i % 101), "smooth_marks": i % 4, "saturation_marks": i % 3,
    }
    return docs(spark, d).select("doc_id", S.attribute_generator(facts).alias("s")).select("doc_id", "s.*")


_SC17 = with_tables("frames") + _SIMS + """, g AS (SELECT video_id, count(*) AS n, avg(ai_confidence) AS m, stddev_pop(ai_confidence) AS s, max(ai_confidence) - min(ai_confidence) AS r, bool_and(ai_confidence > 70) AS h, count(DISTINCT substr(phash, 1, 8)) AS k, count(*) FILTER (WHERE event_type = 'click') AS sm, count(*) FILTER (WHERE event_type IN ('view', 'purchase')) AS lit FROM frames GROUP BY video_id),
 i AS (SELECT video_id, count(*) FILTER (WHERE sim > 0.98 AND sim < 1) AS mo, count(*) FILTER (WHERE sim > 0.995 AND sim < 1) AS mi, count(*) FILTER (WHERE sim < 0.7 AND next_sim > 0.9) AS ju, count(*) FILTER (WHERE sim > 0.95) AS al, count(sim_before) AS st, count(*) FILTER (WHERE abs(sim - sim_before) < 0.01) AS un FROM sims GROUP BY video_id),
 v AS (SELECT g.*, i.mo, i.mi, i.ju, i.al, i.st, i.un, g.video_id % 11 > 0 AS known, g.video_id % 130 AS du, (['1920', '1280', '3840', '640'])[CAST(g.video_id % 4 + 1 AS INT)]::INT AS wi, g.video_id % 3 AS co FROM g JOIN i ON i.video_id = g.video_id),
 p AS (SELECT video_id, CASE WHEN s < 2 AND m > 70 THEN 15 ELSE 0 END + CASE WHEN s < 1 AND m > 60 THEN 12 ELSE 0 END + CASE WHEN h THEN 10 ELSE 0 END + CASE WHEN r < 5 AND n > 5 THEN 8 ELSE 0 END AS physics, CASE WHEN n >= 5 AND 1 - k * 1.0 / n > 0.3 THEN 12 ELSE 0 END + CASE WHEN n >= 5 AND al * 1.0 / (n - 1) > 0.6 THEN 12 ELSE 0 END AS hashes, least(18, floor(sm * 24.0 / n + 0.5)) AS smooth, CASE WHEN n < 3 THEN 0 ELSE CASE WHEN lit * 1.0 / n > 0.9 THEN 12 ELSE 0 END + CASE WHEN lit = n THEN 8 ELSE 0 END END AS light, CASE WHEN n > 5 THEN 12 ELSE 0 END AS compression,
 least(25, floor((mo + 2 * ju) * 1.0 / n * 50 + 0.5)) + CASE WHEN mi * 1.0 / n > 0.5 THEN 8 ELSE 0 END AS morphing, CASE WHEN st + 2 > 5 AND un * 1.0 / st > 0.7 THEN 10 ELSE 0 END + CASE WHEN known AND video_id % 5 = 0 THEN 12 ELSE 0 END + CASE WHEN known AND video_id % 2 = 0 THEN 10 ELSE 0 END AS camera,
 CASE WHEN NOT known THEN 0 ELSE CASE WHEN du > 25 AND du <= 120 THEN 10 WHEN du > 0 AND du <= 20 THEN 8 ELSE 0 END + CASE wi WHEN 3840 THEN 12 WHEN 640 THEN 0 ELSE 8 END + CASE co WHEN 1 THEN 5 WHEN 0 THEN 3 ELSE 0 END + CASE WHEN du > 0 AND video_id * 1000000 * 8 / (du * 1000.0) > 10000 THEN 6 ELSE 0 END END AS format,
 CASE WHEN NOT known THEN 'unknown' WHEN CASE WHEN du > 25 THEN 3 ELSE 0 END + CASE wi WHEN 3840 THEN 4 WHEN 1920 THEN 1 ELSE 0 END + CASE WHEN co = 1 THEN 2 ELSE 0 END > CASE WHEN du <= 20 THEN 2 ELSE 0 END THEN 'sora2' WHEN CASE WHEN du > 25 THEN 3 ELSE 0 END + CASE wi WHEN 3840 THEN 4 WHEN 1920 THEN 1 ELSE 0 END + CASE WHEN co = 1 THEN 2 ELSE 0 END < CASE WHEN du <= 20 THEN 2 ELSE 0 END THEN 'sora1' ELSE 'unknown' END AS version FROM v),
 t AS (SELECT video_id, version, CAST(physics + hashes + smooth + light + compression + morphing + camera + format AS DOUBLE) AS total, greatest(physics, hashes, smooth, light, morphing, camera, format) > 10 AS strong FROM p), f AS (SELECT *, least(100, CAST(floor(total * 100.0 / 150 + 0.5) AS BIGINT)) AS confidence, CASE WHEN strong THEN 'sora' ELSE 'unknown' END AS generator FROM t)
SELECT video_id, total, confidence, confidence >= 50 AS is_ai, generator, CASE WHEN confidence >= 85 THEN 'HIGHLY_LIKELY_' || upper(generator) WHEN confidence >= 70 THEN 'LIKELY_' || upper(generator) WHEN confidence >= 55 THEN 'PROBABLE_AI_VIDEO' WHEN confidence >= 40 THEN 'POSSIBLE_AI_GENERATED' WHEN confidence >= 25 THEN 'LOW_AI_INDICATORS' ELSE 'UNLIKELY_AI_GENERATED' END AS verdict, CASE WHEN strong THEN 40 ELSE 0 END AS sora, CASE WHEN strong THEN 30 ELSE 0 END AS runway, CASE WHEN strong THEN 20 ELSE 0 END AS kling, CASE WHEN strong THEN 10 ELSE 0 END AS pika, version FROM f"""


@query("sc17_video_attribution", _SC17)
def sc17(spark: SparkSession, d: str) -> DataFrame:
    f = X.frames(spark, d)
    facts = X.video_facts(f)
    hashes = A.hash_repetition(f).select("video_id", "points").join(W.adjacent_smoothness(f).select("video_id", F.col("points").alias("more")), "video_id").select("video_id", (F.col("points") + F.col("more")).alias("points"))
    camera = W.uniform_motion(f, facts).select("video_id", (F.col("uniform_points") + F.col("constant_points") + F.col("steady_points")).alias("points"))
    container = facts.select("video_id", S.video_format_points(*[F.col(c) for c in ("duration", "width", "height", "codec", "size")]).alias("points"))
    parts = [W.temporal_morphing(f).withColumnRenamed("score", "points"), A.frame_confidence_stats(f), hashes, container, A.smoothness_ratio(f).withColumnRenamed("score", "points"), camera, A.lighting_ratio(f)]
    out = S.video_generator_attribution(parts, [A.compression_uniformity(f)])
    return out.join(facts.select("video_id", S.sora_version(F.col("duration"), F.col("width"), F.col("codec")).alias("version")), "video_id")
