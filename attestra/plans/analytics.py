"""Queries of the frame, face, log, case and batch operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import aggregates as A
from attestra.operators import windows as W

from . import fixtures as X
from .fixtures import with_tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
NOW = 1704067200 + 30 * 86400


def query(name: str, sql: str | None = None):
    """Registers a query (spark, sf_dir) and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _on(fixture, f):
    """A query that applies an operator to one derived table."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return f(fixture(spark, d))

    return run


def _registered(rows: list[tuple]) -> None:
    for name, fixture, f, sql in rows:
        QUERIES[name] = _on(fixture, f)
        ORACLE_SQL[name] = sql


def results(spark: SparkSession, d: str) -> DataFrame:
    """Batch results: one batch per source and language."""
    i = F.col("doc_id")
    return X.table(spark, d, "documents").select(F.concat_ws("-", "source", "lang").alias("batch_id"), "doc_id", F.when((i % 7 == 0) | (F.col("lang") == "es"), "failed").otherwise("success").alias("status"), (i % 3).alias("n_matches"), (i % 5 == 0).alias("ai_generated"), F.col("n_chars").alias("ms"))


def batches(spark: SparkSession, d: str) -> DataFrame:
    """Batch headers from orders-like events: one per event of type purchase."""
    e = X.table(spark, d, "events").filter("event_type = 'purchase'")
    return e.select(F.col("event_id").alias("batch_id"), F.col("user_id"), F.col("ts").alias("created_at"))


def sparse_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames of which some were not analysed, or one of a video only, and others alike."""
    v, c = F.col("video_id"), F.col("ai_confidence")
    own = F.when(v % 3 == 0, 75 + F.col("frame_no") % 2).otherwise(c)
    return X.frames(spark, d).withColumn("ai_confidence", F.when(v % 5 == 3, F.when(F.col("frame_no") == 1, c)).otherwise(F.when(F.col("event_id") % 4 > 0, own)))


_RESULTS = "WITH results AS (SELECT concat_ws('-', source, lang) AS batch_id, CASE WHEN doc_id % 7 = 0 OR lang = 'es' THEN 'failed' ELSE 'success' END AS status, doc_id % 3 AS n_matches, doc_id % 5 = 0 AS ai_generated, n_chars AS ms FROM documents)\n"
_SIM = "CAST(len(list_filter(range(1, 65), lambda i: substr(phash, i, 1) = substr(prev, i, 1))) AS INT) / 64.0"
_SIMS = f""", lagged AS (SELECT *, lag(phash) OVER (PARTITION BY video_id ORDER BY frame_no) AS prev FROM frames), s1 AS (SELECT video_id, frame_no, CASE WHEN prev IS NOT NULL THEN {_SIM} END AS sim FROM lagged),
 sims AS (SELECT *, lag(sim) OVER (PARTITION BY video_id ORDER BY frame_no) AS sim_before, lead(sim) OVER (PARTITION BY video_id ORDER BY frame_no) AS next_sim FROM s1)
"""
_Q = "floor({} * 1e6 / count(*) + 0.5) / 1e6"
_FRAMES, _FACES, _LOG, _CASES = with_tables("frames"), with_tables("frames", "faces"), with_tables("requests"), with_tables("cases")
_NTH = "(SELECT list_sort(list(duration_ms))[CAST(floor(count(*) * {q}) AS INT) + 1] FROM last) AS p{p}"

_registered([
    ("agg4_batch_summary", results, A.batch_summary, _RESULTS + """SELECT *, CASE WHEN failed = 0 THEN 'completed' WHEN successful = 0 THEN 'failed' ELSE 'completed_with_errors' END AS batch_status FROM (SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS successful, count(*) FILTER (WHERE status <> 'success') AS failed,
 count(*) FILTER (WHERE status = 'success' AND n_matches > 0) AS duplicates_found, count(*) FILTER (WHERE status = 'success' AND ai_generated) AS ai_detected, CAST(floor(sum(ms) * 1.0 / count(*) + 0.5) AS BIGINT) AS avg_ms FROM results GROUP BY batch_id)"""),
    ("agg7_video_verdict", X.frames, A.video_verdict, _FRAMES + """SELECT video_id, n_frames, n_ai, n_suspicious, CASE WHEN ai > 70 THEN 90 WHEN ai > 50 THEN 75 WHEN ai > 30 THEN 60 WHEN su > 50 THEN 50 WHEN su > 30 THEN 70 WHEN su > 10 THEN 85 ELSE 100 END AS confidence,
 CASE WHEN ai > 50 THEN 'LIKELY_AI_GENERATED' WHEN ai > 30 OR su > 50 THEN 'SUSPICIOUS' WHEN su > 10 THEN 'POSSIBLY_MANIPULATED' ELSE 'AUTHENTIC' END AS verdict
 FROM (SELECT *, n_ai * 100.0 / n_frames AS ai, n_suspicious * 100.0 / n_frames AS su FROM (SELECT video_id, count(*) AS n_frames, count(*) FILTER (WHERE likely) AS n_ai, count(*) FILTER (WHERE likely OR ai_confidence > 50) AS n_suspicious FROM frames GROUP BY video_id))"""),
    ("agg9_flagged_frames", X.frames, A.flagged_frame_rate, _FRAMES + "SELECT video_id, count(*) AS n_frames, count(*) FILTER (WHERE likely) AS flagged, count(*) FILTER (WHERE likely) > 0 AS suspicious, least(100, CAST(floor(count(*) FILTER (WHERE likely) * 100.0 / count(*) + 0.5) AS BIGINT)) AS confidence FROM frames GROUP BY video_id"),
    ("set2_distinct_indicators", X.frames, A.distinct_indicators, _FRAMES + "SELECT DISTINCT video_id, t.indicator FROM frames JOIN (VALUES ('click', 'Smooth areas'), ('click', 'texture'), ('view', 'color distribution'), ('purchase', 'saturation'), ('error', 'face')) AS t(k, indicator) ON t.k = frames.event_type"),
    ("agg10_blink_rate", X.faces, A.blink_rate, _FACES + """SELECT video_id, face_frames, low_faces, rate AS blink_rate, CASE WHEN rate < 2 THEN 25 WHEN rate > 15 THEN 15 ELSE 0 END AS points FROM (SELECT *, CASE WHEN face_frames >= 10 THEN low_faces * 100.0 / face_frames END AS rate FROM (SELECT video_id, count(DISTINCT frame_no) AS face_frames, count(*) FILTER (WHERE confidence < 0.7) AS low_faces FROM faces GROUP BY video_id))"""),
    ("agg11_face_variance", X.faces, A.face_confidence_variance, _FACES + "SELECT video_id, CAST(floor(var_pop(confidence) * 1e6 + 0.5) AS BIGINT) AS variance_e6, CASE WHEN var_pop(confidence) > 0.05 THEN 15 ELSE 0 END AS points FROM faces GROUP BY video_id"),
    ("agg12_frame_confidence", sparse_frames, A.frame_confidence_stats, _FRAMES + """, c AS (SELECT video_id, CASE WHEN video_id % 5 = 3 THEN CASE WHEN frame_no = 1 THEN ai_confidence END WHEN event_id % 4 > 0 THEN CASE WHEN video_id % 3 = 0 THEN 75 + frame_no % 2 ELSE ai_confidence END END AS c FROM frames),
 g AS (SELECT video_id, count(c) AS n, avg(c) AS m, stddev_pop(c) AS s, max(c) - min(c) AS range, bool_and(c > 70) AS all_high FROM c GROUP BY video_id)
SELECT video_id, n, CASE WHEN n >= 2 THEN range END AS range, CASE WHEN n >= 2 THEN all_high END AS all_high, CASE WHEN n >= 2 THEN CAST(floor(m * 1000 + 0.5) AS BIGINT) ELSE 0 END AS mean_e3, CASE WHEN n >= 2 THEN CAST(floor(s * 1000 + 0.5) AS BIGINT) ELSE 0 END AS sd_e3,
 CASE WHEN n < 2 THEN 0 ELSE CASE WHEN s < 2 AND m > 70 THEN 15 ELSE 0 END + CASE WHEN s < 1 AND m > 60 THEN 12 ELSE 0 END + CASE WHEN all_high THEN 10 ELSE 0 END + CASE WHEN range < 5 AND n > 5 THEN 8 ELSE 0 END END AS points FROM g"""),
    ("agg13_hash_repetition", X.frames, A.hash_repetition, _FRAMES + "SELECT *, CASE WHEN n >= 5 AND 1 - kinds * 1.0 / n > 0.3 THEN 12 ELSE 0 END AS points FROM (SELECT video_id, count(*) AS n, count(DISTINCT substr(phash, 1, 8)) AS kinds FROM frames GROUP BY video_id)"),
    ("agg14_smoothness", X.frames, A.smoothness_ratio, _FRAMES + "SELECT *, least(18, CAST(floor(smooth * 24.0 / n + 0.5) AS BIGINT)) AS score, smooth * 1.0 / n > 0.7 AS detected FROM (SELECT video_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS smooth FROM frames GROUP BY video_id)"),
    ("agg15_lighting", X.frames, A.lighting_ratio, _FRAMES + "SELECT *, CASE WHEN n < 3 THEN 0 ELSE CASE WHEN lit * 1.0 / n > 0.9 THEN 12 ELSE 0 END + CASE WHEN lit = n THEN 8 ELSE 0 END END AS points FROM (SELECT video_id, count(*) AS n, count(*) FILTER (WHERE event_type IN ('view', 'purchase')) AS lit FROM frames GROUP BY video_id)"),
    ("agg16_compression", X.frames, A.compression_uniformity, _FRAMES + "SELECT *, CASE WHEN n > 5 AND formats = 1 THEN 6 ELSE 0 END + CASE WHEN n > 5 AND sizes = 1 THEN 6 ELSE 0 END AS points FROM (SELECT video_id, count(*) AS n, count(DISTINCT format) AS formats, count(DISTINCT dimensions) AS sizes FROM frames GROUP BY video_id)"),
    ("agg17_confusion", X.cases, A.confusion_matrix, _CASES + "SELECT count(*) FILTER (WHERE actually_fake AND said) AS tp, count(*) FILTER (WHERE NOT actually_fake AND NOT said) AS tn, count(*) FILTER (WHERE NOT actually_fake AND said) AS fp, count(*) FILTER (WHERE actually_fake AND NOT said) AS fn FROM (SELECT *, verdict = 'LIKELY_MANIPULATED' AS said FROM cases)"),
    ("agg18_metrics", X.cases, lambda c: A.classification_metrics(A.confusion_matrix(c)), _CASES + """SELECT tp, tn, fp, fn, floor((tp + tn) * 10000.0 / (tp + tn + fp + fn) + 0.5) / 100 AS accuracy, CASE WHEN tp + fp > 0 THEN floor(tp * 10000.0 / (tp + fp) + 0.5) / 100 ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN floor(tp * 10000.0 / (tp + fn) + 0.5) / 100 ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN floor(2 * tp * 10000.0 / (2 * tp + fp + fn) + 0.5) / 100 ELSE 0 END AS f1
 FROM (SELECT count(*) FILTER (WHERE actually_fake AND said) AS tp, count(*) FILTER (WHERE NOT actually_fake AND NOT said) AS tn, count(*) FILTER (WHERE NOT actually_fake AND said) AS fp, count(*) FILTER (WHERE actually_fake AND NOT said) AS fn FROM (SELECT *, verdict = 'LIKELY_MANIPULATED' AS said FROM cases))"""),
    ("agg19_accuracy_by_category", X.cases, A.accuracy_by_category, _CASES + "SELECT category, count(*) AS total, count(*) FILTER (WHERE said = actually_fake) AS correct, count(*) FILTER (WHERE said <> actually_fake) AS incorrect, count(*) FILTER (WHERE verdict IS NULL) AS errors, count(*) FILTER (WHERE actually_fake AND NOT said) AS missed, count(*) FILTER (WHERE NOT actually_fake AND said) AS false_positives, floor(count(*) FILTER (WHERE said = actually_fake) * 10000.0 / count(*) + 0.5) / 100 AS accuracy FROM (SELECT *, verdict = 'LIKELY_MANIPULATED' AS said FROM cases) GROUP BY ROLLUP (category)"),
    ("agg20_latency_last_n", X.requests, A.latency_quantiles_last_n, _LOG + ", last AS (SELECT duration_ms FROM requests ORDER BY ts DESC, request_id DESC LIMIT 1000) SELECT " + ", ".join(_NTH.format(q=q, p=p) for q, p in ((0.5, 50), (0.95, 95), (0.99, 99)))),
    ("agg21_load_report", X.requests, A.load_report, _LOG + """SELECT route, count(*) AS requests, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms, floor(avg(duration_ms) * 1000 + 0.5) / 1000 AS avg_ms, count(*) FILTER (WHERE status = 200) AS ok, count(*) FILTER (WHERE status = 429) AS limited, count(*) FILTER (WHERE status NOT IN (200, 429)) AS other,
 list_sort(list(duration_ms))[CAST(floor(count(*) * 0.5) AS INT) + 1] AS p50, list_sort(list(duration_ms))[CAST(floor(count(*) * 0.95) AS INT) + 1] AS p95, list_sort(list(duration_ms))[CAST(floor(count(*) * 0.99) AS INT) + 1] AS p99, floor(count(*) FILTER (WHERE status = 200) * 10000.0 / count(*) + 0.5) / 100 AS success_pct FROM requests GROUP BY route"""),
    ("agg22_verdict_counts", X.requests, A.verdict_counts, _LOG + "SELECT verdict, count(*) AS requests, count(*) FILTER (WHERE status < 400) AS succeeded FROM requests GROUP BY verdict"),
    ("agg24_histogram_quantile", X.requests, lambda r: A.histogram_quantile(A.cumulative_buckets(r, [50, 100, 250, 500, 1000, 2500, 5000, 10000, 1e9], ["route"]), 0.95, ["route"]), _LOG + """, b AS (SELECT route, le, count(*) FILTER (WHERE duration_ms <= le) AS c FROM requests, (VALUES (50.0), (100.0), (250.0), (500.0), (1000.0), (2500.0), (5000.0), (10000.0), (1e9)) AS t(le) GROUP BY route, le),
 w AS (SELECT route, le, c, coalesce(lag(le) OVER (PARTITION BY route ORDER BY le), 0) AS low, coalesce(lag(c) OVER (PARTITION BY route ORDER BY le), 0) AS below, max(c) OVER (PARTITION BY route) AS whole FROM b)
SELECT route, floor((low + (le - low) * (0.95 * whole - below) / (c - below)) * 100000 + 0.5) / 100000 AS value FROM w WHERE c >= 0.95 * whole AND below < 0.95 * whole"""),
    ("agg25_service_ratios", X.requests, A.service_ratios, _LOG + "SELECT route, " + ", ".join(_Q.format(f"count(*) FILTER (WHERE {c})") + f" AS {n}" for c, n in (("status < 500", "success_rate"), ("status >= 500", "error_rate"), ("status = 504", "timeout_ratio"), ("status = 429", "limited_ratio"))) + " FROM requests GROUP BY route"),
    ("agg26_verdict_ratios", X.requests, A.verdict_ratios, _LOG + "SELECT " + _Q.format("count(*) FILTER (WHERE verdict = 'PROVEN_STRONG')") + " AS strong_ratio, " + _Q.format("count(*) FILTER (WHERE verdict IN ('NOT_PROVEN', 'INCONCLUSIVE'))") + " AS unproven_ratio, floor(avg(duration_ms) * 1000 + 0.5) / 1000 AS mean_ms FROM requests"),
    ("agg27_service_stats", X.requests, A.service_stats, _LOG + "SELECT route, succeeded, failed, floor(m * 1000 + 0.5) / 1000 AS avg_ok_ms, floor(failed * 100.0 / (failed + succeeded) * 1000 + 0.5) / 1000 AS error_pct, failed * 100.0 / (failed + succeeded) > 10 AS high_error FROM (SELECT route, count(*) FILTER (WHERE status < 400) AS succeeded, count(*) FILTER (WHERE status >= 400) AS failed, avg(CASE WHEN status < 400 THEN duration_ms END) AS m FROM requests GROUP BY route)"),
    ("agg32_store_stats", batches, lambda b: A.store_stats(b, F.timestamp_seconds(F.lit(NOW - 5 * 86400))), f"SELECT count(*) AS total, count(*) FILTER (WHERE floor(epoch(ts)) + 86400 > {NOW - 5 * 86400}) AS active FROM events WHERE event_type = 'purchase'"),
    ("top4_top_routes", X.requests, lambda r: A.top_rates(r, ["ip"]), _LOG + "SELECT ip, count(*) AS requests FROM requests GROUP BY ip ORDER BY requests DESC, ip LIMIT 10"),
    ("top4_top_errors", X.requests, lambda r: A.top_rates(r.filter("status >= 400"), ["route", "status"]), _LOG + "SELECT route, status, count(*) AS requests FROM requests WHERE status >= 400 GROUP BY route, status ORDER BY requests DESC, route, status LIMIT 10"),
    ("win5_morphing", X.frames, W.temporal_morphing, _FRAMES + _SIMS + """SELECT video_id, n_frames, morphs, micro, jumps, least(25, CAST(floor((morphs + 2 * jumps) * 1.0 / n_frames * 50 + 0.5) AS BIGINT)) + CASE WHEN micro * 1.0 / n_frames > 0.5 THEN 8 ELSE 0 END AS score
 FROM (SELECT video_id, count(*) AS n_frames, count(*) FILTER (WHERE sim > 0.98 AND sim < 1) AS morphs, count(*) FILTER (WHERE sim > 0.995 AND sim < 1) AS micro, count(*) FILTER (WHERE sim < 0.7 AND next_sim > 0.9) AS jumps FROM sims GROUP BY video_id)"""),
    ("win6_smoothness", X.frames, W.adjacent_smoothness, _FRAMES + _SIMS + "SELECT video_id, pairs, smooth, CASE WHEN pairs > 0 THEN smooth * 1.0 / pairs ELSE 0.0 END AS smoothness, CASE WHEN pairs >= 4 AND smooth * 1.0 / pairs > 0.6 THEN 12 ELSE 0 END AS points FROM (SELECT video_id, count(sim) AS pairs, count(*) FILTER (WHERE sim > 0.95) AS smooth FROM sims GROUP BY video_id)"),
    ("win8_facial_jumps", X.faces, W.facial_jumps, _FACES + """SELECT *, CASE WHEN positions >= 5 AND jumps * 100.0 / positions > 20 THEN 20 ELSE 0 END AS points FROM (SELECT video_id, count(*) AS positions, count(*) FILTER (WHERE abs(x - px) > 100 OR abs(y - py) > 100) AS jumps FROM (SELECT *, lag(x) OVER (PARTITION BY video_id ORDER BY frame_no, face_idx) AS px, lag(y) OVER (PARTITION BY video_id ORDER BY frame_no, face_idx) AS py FROM faces) GROUP BY video_id)"""),
    ("win9_frame_differences", X.frames, W.frame_differences, _FRAMES + "SELECT video_id, frame_no, CASE WHEN mean_diff > 50 THEN 'large_frame_jump' ELSE 'frozen_frame' END AS kind, CASE WHEN mean_diff > 50 THEN least(100, CAST(floor(mean_diff + 0.5) AS BIGINT)) ELSE 40 END AS severity FROM frames WHERE frame_no > 1 AND (mean_diff > 50 OR mean_diff < 1)"),
    ("win10_segment_hashes", X.frames, W.segment_hashes, _FRAMES + "SELECT video_id, seg_idx, 'seg_' || seg_idx || ':' || substr(sha256(string_agg(phash, '' ORDER BY frame_no)), 1, 32) AS segment FROM (SELECT *, CAST(floor((frame_no - 1) / 15) AS INT) AS seg_idx FROM frames) GROUP BY video_id, seg_idx HAVING count(*) = 15"),
    ("win12_alert_for", X.requests, lambda r: W.alert_for(r.withColumn("ts", F.timestamp_seconds("ts")), F.col("duration_ms") < 500, 7200, ["ip"]).select("ip", F.unix_timestamp("since").alias("since"), F.unix_timestamp("until").alias("until"), "samples"), _LOG + """, r AS (SELECT ip, ts, duration_ms < 500 AS ok, row_number() OVER (PARTITION BY ip ORDER BY ts) - row_number() OVER (PARTITION BY ip, duration_ms < 500 ORDER BY ts) AS run FROM requests)
SELECT ip, min(ts) AS since, max(ts) AS until, count(*) AS samples FROM r WHERE ok GROUP BY ip, run HAVING max(ts) - min(ts) >= 7200"""),
    ("win13_at_capacity", X.requests, lambda r: W.at_capacity(r.select("ip", "request_id", F.timestamp_seconds("ts").alias("ts"), F.col("duration_ms").alias("value")), 500, ["ip"]).select("ip", F.unix_timestamp("ts").alias("ts"), "value", "trailing_max", "at_capacity"), _LOG + "SELECT ip, ts, duration_ms AS value, max(duration_ms) OVER w AS trailing_max, duration_ms >= max(duration_ms) OVER w AND duration_ms >= 500 AS at_capacity FROM requests WINDOW w AS (PARTITION BY ip ORDER BY ts RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)"),
])


@query("win7_uniform_motion", _FRAMES + _SIMS + """SELECT video_id, steps, uniform, CASE WHEN steps + 2 > 5 AND uniform * 1.0 / steps > 0.7 THEN 10 ELSE 0 END AS uniform_points, CASE WHEN video_id % 11 > 0 AND video_id % 5 = 0 THEN 12 ELSE 0 END AS constant_points, CASE WHEN video_id % 11 > 0 AND video_id % 2 = 0 THEN 10 ELSE 0 END AS steady_points
 FROM (SELECT video_id, count(sim_before) AS steps, count(*) FILTER (WHERE abs(sim - sim_before) < 0.01) AS uniform FROM sims GROUP BY video_id)""")
def win7(spark: SparkSession, d: str) -> DataFrame:
    f = X.frames(spark, d)
    return W.uniform_motion(f, X.video_facts(f))


@query("agg8_temporal_summary", _FRAMES + """, d AS (SELECT video_id, count(*) AS found, avg(CASE WHEN mean_diff > 50 THEN least(100, floor(mean_diff + 0.5)) ELSE 40 END) AS m FROM frames WHERE frame_no > 1 AND (mean_diff > 50 OR mean_diff < 1) GROUP BY video_id), t AS (SELECT video_id, count(*) AS n_frames FROM frames GROUP BY video_id)
SELECT video_id, n_frames, coalesce(found, 0) AS found, coalesce(m, 0.0) AS mean_severity, conf AS confidence, CASE WHEN conf > 70 THEN 'high' WHEN conf > 40 THEN 'medium' ELSE 'low' END AS level FROM (SELECT t.video_id, n_frames, found, m, CASE WHEN found > 0 THEN least(100, CAST(floor(found * 1.0 / n_frames * 50 + m * 0.5 + 0.5) AS BIGINT)) ELSE 0 END AS conf FROM t LEFT JOIN d ON t.video_id = d.video_id)""")
def agg8(spark: SparkSession, d: str) -> DataFrame:
    frames = X.frames(spark, d)
    return A.temporal_summary(W.frame_differences(frames), frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_frames")))


@query("agg23_external_summary", """WITH r AS (SELECT user_id AS q, event_id % 6 <> 5 AS enabled, event_id % 7 = 6 AS failed, CASE WHEN event_id % 2 = 0 THEN event_id % 4 END AS f, CASE WHEN event_id % 3 > 0 THEN event_id % 5 END AS t FROM events)
SELECT q AS query_id, CAST(sum(CASE WHEN NOT enabled OR failed THEN 0 WHEN f IS NOT NULL THEN f WHEN t IS NOT NULL THEN t ELSE 0 END) AS BIGINT) AS total_matches, count(*) FILTER (WHERE enabled) AS engines_searched, count(*) FILTER (WHERE enabled AND NOT failed) AS engines_with_results FROM r GROUP BY q""")
def agg23(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return A.external_summary(X.table(spark, d, "events").select(F.col("user_id").alias("query_id"), (e % 6 != 5).alias("enabled"), F.when(e % 7 == 6, "timeout").alias("error"), F.when(e % 2 == 0, e % 4).alias("full_matches"), F.when(e % 3 > 0, e % 5).alias("total_matches")))


@query("win11_batch_ttl", f"SELECT event_id AS batch_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) + 86400 - {NOW - 5 * 86400} AS seconds_left FROM events WHERE event_type = 'purchase' AND floor(epoch(ts)) + 86400 - {NOW - 5 * 86400} > 0")
def win11(spark: SparkSession, d: str) -> DataFrame:
    return W.batch_ttl(batches(spark, d), F.timestamp_seconds(F.lit(NOW - 5 * 86400))).select("batch_id", "user_id", "seconds_left")


@query("win14_coverage_drift", with_tables("seg") + """, c AS (SELECT video_id % 10 AS asset_id, video_id // 10 AS run_no, count(*) FILTER (WHERE matched) * 1.0 / count(*) AS coverage FROM seg_match GROUP BY video_id), l AS (SELECT *, abs(coverage - lag(coverage) OVER (PARTITION BY asset_id ORDER BY run_no)) AS drift FROM c)
SELECT asset_id, run_no, coverage, drift, coalesce(drift <= 0.05, true) AS stable, coverage >= 0.95 AS passes FROM l""")
def win14(spark: SparkSession, d: str) -> DataFrame:
    from attestra.operators.joins import segment_match

    m = segment_match(X.seg_cand(spark, d), X.seg_ref(spark, d)).groupBy("video_id").agg((F.count_if("matched") / F.count(F.lit(1))).alias("coverage"))
    return W.coverage_drift(m.select((F.col("video_id") % 10).alias("asset_id"), F.floor(F.col("video_id") / 10).alias("run_no"), "coverage"))


@query("agg29_block_stats", """WITH v AS (SELECT label AS image_id, list_transform(embedding, lambda x: floor(x * 1000) / 4) AS v FROM embeddings), s AS (SELECT image_id, list_sum(list_transform(v[33:64], lambda x: abs(x))) / 32 / 255 AS high, sqrt(list_sum(list_transform(v, lambda x: (x - list_sum(v) / 64) * (x - list_sum(v) / 64))) / 64) AS sd FROM v)
SELECT image_id, count(*) AS blocks, CAST(floor(avg(high) * 1e6 + 0.5) AS BIGINT) AS high_e6, CAST(floor(avg(1 - least(1.0, sd / 128)) * 1e6 + 0.5) AS BIGINT) AS smooth_e6 FROM s GROUP BY image_id""")
def agg29(spark: SparkSession, d: str) -> DataFrame:
    e = X.table(spark, d, "embeddings")
    return A.block_stats(e.select(F.col("label").alias("image_id"), F.transform("embedding", lambda x: F.floor(x * F.lit(1000).cast("float")) / 4).alias("v")))


@query("agg30_boundary_stats", "SELECT image_id, count(*) AS boundaries, CAST(floor(avg(d) * 1e5 + 0.5) AS BIGINT) AS mean_e5, CAST(floor(avg(CASE WHEN d < 5 THEN 1 ELSE 0 END) * 1e6 + 0.5) AS BIGINT) AS soft_e6 FROM (SELECT user_id AS image_id, event_id % 20 AS boundary, avg(abs(event_id * 7 % 13 - event_id * 5 % 11)) AS d FROM events GROUP BY user_id, event_id % 20) GROUP BY image_id")
def agg30(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return A.boundary_stats(X.table(spark, d, "events").select(F.col("user_id").alias("image_id"), (e % 20).alias("boundary"), (e * 7 % 13).alias("l"), (e * 5 % 11).alias("r")))


@query("agg31_pixel_stats", """WITH p AS (SELECT user_id AS image_id, event_id % 3 AS channel, event_id AS pos, event_id * event_id % 251 AS value FROM events), n AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY image_id, channel ORDER BY pos)) AS d FROM p),
 w AS (SELECT image_id, channel, avg(v) AS wv FROM (SELECT image_id, channel, pos // 100 AS w, var_pop(value) AS v FROM p GROUP BY image_id, channel, pos // 100) GROUP BY image_id, channel)
SELECT n.image_id, n.channel, count(*) AS n, min(value) AS low, max(value) AS high, CAST(floor(avg(value) * 1e4 + 0.5) AS BIGINT) AS mean_e4, CAST(floor(stddev_pop(value) * 1e4 + 0.5) AS BIGINT) AS sd_e4, CAST(floor(avg(d) * 1e4 + 0.5) AS BIGINT) AS noise_e4, count(*) FILTER (WHERE d > 100) AS edges, CAST(floor(max(wv) * 1e2 + 0.5) AS BIGINT) AS window_variance_e2 FROM n JOIN w ON n.image_id = w.image_id AND n.channel = w.channel GROUP BY n.image_id, n.channel""")
def agg31(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return A.pixel_stats(X.table(spark, d, "events").select(F.col("user_id").alias("image_id"), (e % 3).alias("channel"), e.alias("pos"), (e * e % 251).alias("value")))
