"""Aggregates over registry rows, batches, frames, faces, pixels, labelled cases and request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _n() -> Column:
    return F.count(F.lit(1))


def js_round(c: Column) -> Column:
    """Half up, also below zero, as whole numbers."""
    return F.floor(c + 0.5)


def js_round_sum(c: Column) -> Column:
    """``js_round`` of a value that sums of doubles make: of halves, the last bits of the sum, hence its order, decide nothing."""
    return js_round(F.round(c, 6))


def registry_stats(reg: DataFrame) -> DataFrame:
    """Rows, distinct fingerprints, their difference, first and last upload (AGG-1)."""
    out = reg.agg(_n().alias("total"), F.count_distinct("fingerprint").alias("unique_files"), F.min("upload_date").alias("first_upload"), F.max("upload_date").alias("last_upload"))
    return out.withColumn("duplicates", F.col("total") - F.col("unique_files"))


def registry_stats_by_kind(reg: DataFrame) -> DataFrame:
    """AGG-1 with the number of images, videos and audio files (AGG-2)."""
    kinds = [F.count_if(F.col("media_kind") == k).alias(f"{k}s") for k in ("image", "video", "audio")]
    return reg.agg(_n().alias("total"), F.count_distinct("fingerprint").alias("unique_files"), *kinds)


def registry_count(reg: DataFrame) -> DataFrame:
    """AGG-3."""
    return reg.agg(_n().alias("total"))


def batch_summary(results: DataFrame) -> DataFrame:
    """Per batch: counts of outcomes and the rounded mean time (AGG-4), and its status (AGG-5).

    Expects batch_id, status ('success' or other), n_matches, ai_generated, ms.
    """
    ok = F.col("status") == "success"
    out = results.groupBy("batch_id").agg(
        _n().alias("total"),
        F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("failed"),
        F.count_if(ok & (F.col("n_matches") > 0)).alias("duplicates_found"),
        F.count_if(ok & F.col("ai_generated")).alias("ai_detected"),
        js_round(F.sum("ms") / _n()).alias("avg_ms"),
    )
    return out.withColumn("batch_status", batch_status(F.col("successful"), F.col("failed")))


def batch_status(successful: Column, failed: Column) -> Column:
    """AGG-5."""
    return F.when(failed == 0, "completed").when(successful == 0, "failed").otherwise("completed_with_errors")


def video_verdict(frames: DataFrame) -> DataFrame:
    """Per video: shares of AI-like and suspicious frames, confidence and verdict (AGG-7). The ladder."""
    suspicious = F.col("likely") | (F.col("ai_confidence") > 50)
    out = frames.groupBy("video_id").agg(_n().alias("n_frames"), F.count_if("likely").alias("n_ai"), F.count_if(suspicious).alias("n_suspicious"))
    ai, su = F.col("n_ai") * 100 / F.col("n_frames"), F.col("n_suspicious") * 100 / F.col("n_frames")
    steps = [(ai > 70, 90, "LIKELY_AI_GENERATED"), (ai > 50, 75, "LIKELY_AI_GENERATED"), (ai > 30, 60, "SUSPICIOUS"), (su > 50, 50, "SUSPICIOUS"), (su > 30, 70, "POSSIBLY_MANIPULATED"), (su > 10, 85, "POSSIBLY_MANIPULATED")]
    conf = verdict = None
    for test, c, v in steps:
        conf = F.when(test, c) if conf is None else conf.when(test, c)
        verdict = F.when(test, v) if verdict is None else verdict.when(test, v)
    return out.withColumn("confidence", conf.otherwise(100)).withColumn("verdict", verdict.otherwise("AUTHENTIC"))


def temporal_summary(diffs: DataFrame, totals: DataFrame) -> DataFrame:
    """Per video: inconsistencies, mean severity, confidence and level (AGG-8). ``totals``: video_id, n_frames."""
    found = diffs.groupBy("video_id").agg(_n().alias("found"), F.avg("severity").alias("mean_severity"))
    out = totals.join(found, "video_id", "left").withColumn("found", F.coalesce("found", F.lit(0))).withColumn("mean_severity", F.coalesce("mean_severity", F.lit(0.0)))
    conf = F.when(F.col("found") > 0, F.least(F.lit(100), js_round(F.col("found") / F.col("n_frames") * 50 + F.col("mean_severity") * 0.5))).otherwise(0)
    level = F.when(F.col("confidence") > 70, "high").when(F.col("confidence") > 40, "medium").otherwise("low")
    return out.withColumn("confidence", conf).withColumn("level", level)


def first_inconsistencies(diffs: DataFrame, n: int = 5) -> DataFrame:
    """The first n inconsistencies of each video (AGG-8, details)."""
    order = Window.partitionBy("video_id").orderBy("frame_no")
    return diffs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def flagged_frame_rate(frames: DataFrame) -> DataFrame:
    """Per video: flagged frames, whether any, and the confidence (AGG-9)."""
    out = frames.groupBy("video_id").agg(_n().alias("n_frames"), F.count_if("likely").alias("flagged"))
    return out.withColumn("suspicious", F.col("flagged") > 0).withColumn("confidence", F.least(F.lit(100), js_round(F.col("flagged") / F.col("n_frames") * 100)))


def distinct_indicators(frames: DataFrame) -> DataFrame:
    """Distinct indicator strings of each video, one row each (SET-2, AGG-9)."""
    return frames.select("video_id", F.explode("indicators").alias("indicator")).distinct()


def blink_rate(faces: DataFrame) -> DataFrame:
    """Per video with 10 frames with faces or more: share of faces below .7 confidence and its points (AGG-10)."""
    out = faces.groupBy("video_id").agg(F.count_distinct("frame_no").alias("face_frames"), F.count_if(F.col("confidence") < 0.7).alias("low_faces"))
    rate = F.when(F.col("face_frames") >= 10, F.col("low_faces") * 100 / F.col("face_frames"))
    return out.withColumn("blink_rate", rate).withColumn("points", F.when(rate < 2, 25).when(rate > 15, 15).otherwise(0))


def face_confidence_variance(faces: DataFrame) -> DataFrame:
    """Per video: population variance of the faces' confidence; over .05 gives 15 points (AGG-11)."""
    out = faces.groupBy("video_id").agg(F.var_pop("confidence").alias("v"))
    return out.select("video_id", js_round_sum(F.col("v") * 1e6).alias("variance_e6"), F.when(F.col("v") > 0.05, 15).otherwise(0).alias("points"))


def frame_confidence_stats(frames: DataFrame) -> DataFrame:
    """Per video: spread of the AI confidence of its analysed frames, and the points for it (AGG-12).

    Frames without a detection (null confidence) do not count; with less than two analysed ones there are no statistics (mean and
    deviation 0) and no points.
    """
    c = F.col("ai_confidence")
    out = frames.groupBy("video_id").agg(F.count(c).alias("n"), F.avg(c).alias("m"), F.stddev_pop(c).alias("s"), (F.max(c) - F.min(c)).alias("range"), F.bool_and(c > 70).alias("all_high"))
    enough = F.col("n") >= 2
    out = out.select("video_id", "n", *[F.when(enough, F.col(x)).alias(x) for x in ("m", "s", "range", "all_high")])
    points = F.when((F.col("s") < 2) & (F.col("m") > 70), 15).otherwise(0) + F.when((F.col("s") < 1) & (F.col("m") > 60), 12).otherwise(0)
    points = points + F.when(F.col("all_high"), 10).otherwise(0) + F.when((F.col("range") < 5) & (F.col("n") > 5), 8).otherwise(0)
    rounded = lambda x: js_round(F.coalesce(F.col(x), F.lit(0.0)) * 1000)
    return out.select("video_id", "n", "range", "all_high", rounded("m").alias("mean_e3"), rounded("s").alias("sd_e3"), points.alias("points"))


def hash_repetition(frames: DataFrame) -> DataFrame:
    """Per video of 5 frames or more: share of repeated 8-digit hash prefixes; over .3 gives 12 points (AGG-13)."""
    out = frames.groupBy("video_id").agg(_n().alias("n"), F.count_distinct(F.substring("phash", 1, 8)).alias("kinds"))
    return out.withColumn("points", F.when((F.col("n") >= 5) & (1 - F.col("kinds") / F.col("n") > 0.3), 12).otherwise(0))


def _mentions(words: list[str]) -> Column:
    return F.filter("indicators", lambda x: F.lower(x).rlike("|".join(words)))


def smoothness_ratio(frames: DataFrame) -> DataFrame:
    """Per video: share of frames with two or more smoothness indicators, its score and flag (AGG-14)."""
    smooth = F.size(_mentions(["smooth", "low noise", "texture"])) >= 2
    out = frames.groupBy("video_id").agg(_n().alias("n"), F.count_if(smooth).alias("smooth"))
    ratio = F.col("smooth") / F.col("n")
    return out.withColumn("score", F.least(F.lit(18), js_round(ratio * 24))).withColumn("detected", ratio > 0.7)


def lighting_ratio(frames: DataFrame) -> DataFrame:
    """Per video of 3 frames or more: share of frames with colour indicators and its points (AGG-15)."""
    out = frames.groupBy("video_id").agg(_n().alias("n"), F.count_if(F.size(_mentions(["color distribution", "saturation"])) > 0).alias("lit"))
    ratio = F.col("lit") / F.col("n")
    return out.withColumn("points", F.when(F.col("n") < 3, 0).otherwise(F.when(ratio > 0.9, 12).otherwise(0) + F.when(ratio == 1, 8).otherwise(0)))


def compression_uniformity(frames: DataFrame) -> DataFrame:
    """Per video of over 5 frames: 6 points for a single format, 6 for single dimensions (AGG-16)."""
    out = frames.groupBy("video_id").agg(_n().alias("n"), F.count_distinct("format").alias("formats"), F.count_distinct("dimensions").alias("sizes"))
    long = F.col("n") > 5
    return out.withColumn("points", F.when(long & (F.col("formats") == 1), 6).otherwise(0) + F.when(long & (F.col("sizes") == 1), 6).otherwise(0))


def confusion_matrix(cases: DataFrame) -> DataFrame:
    """TP, TN, FP, FN of cases (actually_fake, verdict) (AGG-17)."""
    said = F.col("verdict").isin("QUESTIONABLE", "LIKELY_MANIPULATED")
    fake = F.col("actually_fake")
    return cases.agg(F.count_if(fake & said).alias("tp"), F.count_if(~fake & ~said).alias("tn"), F.count_if(~fake & said).alias("fp"), F.count_if(fake & ~said).alias("fn"))


def classification_metrics(cm: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 in per cent, two decimals, 0 on an empty denominator (AGG-18)."""
    pct = lambda a, b: F.when(b > 0, js_round(a * 10000 / b) / 100).otherwise(0.0)
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return cm.select("tp", "tn", "fp", "fn", pct(tp + tn, tp + tn + fp + fn).alias("accuracy"), pct(tp, tp + fp).alias("precision"), pct(tp, tp + fn).alias("recall"), pct(2 * tp, 2 * tp + fp + fn).alias("f1"))


def accuracy_by_category(cases: DataFrame) -> DataFrame:
    """Totals, correct and wrong cases per category and overall (category null) (AGG-19)."""
    said = F.col("verdict").isin("QUESTIONABLE", "LIKELY_MANIPULATED")
    right = said == F.col("actually_fake")
    out = cases.rollup("category").agg(_n().alias("total"), F.count_if(right).alias("correct"), F.count_if(~right).alias("incorrect"), F.count_if(F.col("verdict").isNull()).alias("errors"), F.count_if(F.col("actually_fake") & ~said).alias("missed"), F.count_if(~F.col("actually_fake") & said).alias("false_positives"))
    return out.withColumn("accuracy", js_round(F.col("correct") * 10000 / F.col("total")) / 100)


def latency_quantiles_last_n(log: DataFrame, n: int = 1000) -> DataFrame:
    """Element floor(len*q) of the newest n durations, in order, for q .5, .95, .99 (AGG-20)."""
    last = log.orderBy(F.desc("ts"), F.desc("request_id")).limit(n)
    return indexed_quantiles(last, "duration_ms", [0.5, 0.95, 0.99], [])


def indexed_quantiles(df: DataFrame, col: str, qs: list[float], keys: list[str]) -> DataFrame:
    """The value at zero-based place floor(n*q) of each group's ordered values, without gathering the values.

    Values are first counted; the place is found by the running count over distinct values.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("v")).agg(_n().alias("c"))
    by = Window.partitionBy(*keys).orderBy("v")
    run = counts.withColumn("upto", F.sum("c").over(by)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    at = [F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col("v"))).alias(f"p{int(q * 100)}") for q in qs]
    return (run.groupBy(*keys) if keys else run).agg(*at)


def load_report(log: DataFrame) -> DataFrame:
    """Per route: minimum, p50, mean, p95, p99, maximum of the durations, counts by status and success rate (AGG-21)."""
    q = indexed_quantiles(log, "duration_ms", [0.5, 0.95, 0.99], ["route"])
    s = F.col("status")
    sums = log.groupBy("route").agg(
        _n().alias("requests"),
        F.min("duration_ms").alias("min_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.avg("duration_ms").alias("avg_ms"),
        F.count_if(s == 200).alias("ok"),
        F.count_if(s == 429).alias("limited"),
        F.count_if(~s.isin(200, 429)).alias("other"),
    )
    return sums.join(q, "route").withColumn("avg_ms", js_round(F.col("avg_ms") * 1000) / 1000).withColumn("success_pct", js_round(F.col("ok") * 10000 / F.col("requests")) / 100)


def verdict_counts(log: DataFrame) -> DataFrame:
    """Requests by verdict (AGG-22)."""
    return log.groupBy("verdict").agg(_n().alias("requests"), F.count_if(F.col("status") < 400).alias("succeeded"))


def external_summary(results: DataFrame) -> DataFrame:
    """Per query: matches (full matches where they were listed, else the total), engines searched, which are all that are not disabled,
    and engines with results, which are those that answered without error (AGG-23).

    ``results``: query_id, enabled, error, full_matches (how many were listed), total_matches; a row for each engine.
    """
    on = F.coalesce("enabled", F.lit(True))
    answered = on & F.col("error").isNull()
    matches = F.when(answered, F.coalesce("full_matches", "total_matches")).otherwise(0)
    return results.groupBy("query_id").agg(F.sum(F.coalesce(matches, F.lit(0))).alias("total_matches"), F.count_if(on).alias("engines_searched"), F.count_if(answered).alias("engines_with_results"))


def histogram_quantile(buckets: DataFrame, q: float, keys: list[str]) -> DataFrame:
    """Quantile by linear interpolation in the first cumulative bucket (keys, le, count) that reaches q of the total (AGG-24)."""
    by = Window.partitionBy(*keys).orderBy("le")
    low = F.lag("le", 1, 0.0).over(by)
    below = F.lag("count", 1, 0).over(by)
    run = buckets.withColumn("low", low).withColumn("below", below).withColumn("whole", F.max("count").over(Window.partitionBy(*keys)))
    hit = run.filter((F.col("count") >= q * F.col("whole")) & (F.col("below") < q * F.col("whole")))
    value = F.col("low") + (F.col("le") - F.col("low")) * (q * F.col("whole") - F.col("below")) / (F.col("count") - F.col("below"))
    return hit.select(*keys, (js_round(value * 100000) / 100000).alias("value"))


def cumulative_buckets(log: DataFrame, bounds: list[float], keys: list[str]) -> DataFrame:
    """Cumulative histogram of durations as (keys, le, count)."""
    counts = [F.struct(F.lit(float(b)).alias("le"), F.count_if(F.col("duration_ms") <= b).alias("count")) for b in bounds]
    return log.groupBy(*keys).agg(F.array(*counts).alias("bs")).select(*keys, F.inline("bs"))


def service_ratios(log: DataFrame) -> DataFrame:
    """Per route: shares of requests that are not 5xx, 5xx, 504 and 429 (AGG-25)."""
    s = F.col("status")
    share = lambda c: js_round(F.count_if(c) * 1e6 / _n()) / 1e6
    return log.groupBy("route").agg(share(s < 500).alias("success_rate"), share(s >= 500).alias("error_rate"), share(s == 504).alias("timeout_ratio"), share(s == 429).alias("limited_ratio"))


def verdict_ratios(log: DataFrame) -> DataFrame:
    """Share of proven and unproven verdicts and the mean duration (AGG-26)."""
    v = F.col("verdict")
    share = lambda c: js_round(F.count_if(c) * 1e6 / _n()) / 1e6
    return log.agg(share(v == "PROVEN_STRONG").alias("strong_ratio"), share(v.isin("NOT_PROVEN", "INCONCLUSIVE")).alias("unproven_ratio"), (js_round(F.avg("duration_ms") * 1000) / 1000).alias("mean_ms"))


def service_stats(log: DataFrame) -> DataFrame:
    """Per media kind: successes, failures, mean time of successes, error rate and its flag (AGG-27)."""
    ok = F.col("status") < 400
    out = log.groupBy("route").agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.avg(F.when(ok, F.col("duration_ms"))).alias("m"))
    rate = F.col("failed") * 100 / (F.col("failed") + F.col("succeeded"))
    return out.select("route", "succeeded", "failed", (js_round(F.col("m") * 1000) / 1000).alias("avg_ok_ms"), (js_round(rate * 1000) / 1000).alias("error_pct"), (rate > 10).alias("high_error"))


#: First row of cameras' quantisation tables and their variance, in the order in which they are tried.
CAMERA_TABLES = [
    ("canon", [8, 6, 5, 8, 12, 20, 26, 31], 150.0),
    ("nikon", [10, 7, 6, 10, 14, 24, 31, 37], 180.0),
    ("sony", [6, 4, 4, 6, 10, 16, 20, 24], 120.0),
]


def qtable_stats(tables: DataFrame, standards: list[tuple[str, list[int]]], camera: list[tuple[str, list[int], float]] = CAMERA_TABLES) -> DataFrame:
    """Per quantisation table (image_id, q array of 64): mean, variance, likeness to standard tables, camera pattern (AGG-28)."""
    q = F.col("q")
    mean = F.aggregate(q, F.lit(0.0), lambda s, x: s + x) / 64
    out = tables.withColumn("mean", mean).withColumn("variance", F.aggregate(q, F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean"))) / 64)
    like = lambda t, n: 1 - F.aggregate(F.zip_with(F.slice(q, 1, n), F.array(*[F.lit(v) for v in t[:n]]), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / (n * 255)
    best = F.array_max(F.array(*[F.struct(like(t, 64).alias("similarity"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, t) in enumerate(standards)]))
    pattern = F.coalesce(*[F.when((like(t, 8) > 0.7) & (F.abs(F.col("variance") - v) < 50), name) for name, t, v in camera], F.lit(None).cast("string"))
    return out.withColumn("b", best).select("image_id", js_round(F.col("mean") * 1e4).alias("mean_e4"), js_round(F.col("variance") * 1e4).alias("variance_e4"), F.col("b.name").alias("standard"), js_round(F.col("b.similarity") * 1e6).alias("similarity_e6"), pattern.alias("camera"))


def block_stats(blocks: DataFrame) -> DataFrame:
    """Per image: mean high-frequency energy and smoothness of its 8x8 blocks (image_id, v array of 64) (AGG-29)."""
    v = F.col("v")
    high = F.aggregate(F.slice(v, 33, 32), F.lit(0.0), lambda s, x: s + F.abs(x)) / 32 / 255
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / 64
    out = blocks.withColumn("high", high).withColumn("m", mean).withColumn("sd", F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - F.col("m")) * (x - F.col("m"))) / 64))
    return out.groupBy("image_id").agg(_n().alias("blocks"), js_round_sum(F.avg("high") * 1e6).alias("high_e6"), js_round_sum(F.avg(1 - F.least(F.lit(1.0), F.col("sd") / 128)) * 1e6).alias("smooth_e6"))


def boundary_stats(pairs: DataFrame) -> DataFrame:
    """Per image: mean step across block boundaries and the share of soft ones (AGG-30). ``pairs``: image_id, boundary, l, r."""
    each = pairs.groupBy("image_id", "boundary").agg(F.avg(F.abs(F.col("l") - F.col("r"))).alias("d"))
    return each.groupBy("image_id").agg(_n().alias("boundaries"), js_round_sum(F.avg("d") * 1e5).alias("mean_e5"), js_round_sum(F.avg((F.col("d") < 5).cast("int")) * 1e6).alias("soft_e6"))


def pixel_stats(pixels: DataFrame, window: int = 100) -> DataFrame:
    """Per image and channel: range, mean, deviation, neighbour difference, spread of the window variances (AGG-31).

    ``pixels``: image_id, channel, pos, value. Edges are neighbours more than 100 apart.
    """
    by = Window.partitionBy("image_id", "channel").orderBy("pos")
    near = pixels.withColumn("d", F.abs(F.col("value") - F.lag("value").over(by)))
    sums = near.groupBy("image_id", "channel").agg(_n().alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), js_round(F.avg("value") * 1e4).alias("mean_e4"), js_round(F.stddev_pop("value") * 1e4).alias("sd_e4"), js_round(F.avg("d") * 1e4).alias("noise_e4"), F.count_if(F.col("d") > 100).alias("edges"))
    parts = pixels.groupBy("image_id", "channel", F.floor(F.col("pos") / window).alias("w")).agg(F.var_pop("value").alias("v"))
    spread = parts.groupBy("image_id", "channel").agg(js_round(F.avg("v") * 1e2).alias("window_variance_e2"))
    return sums.join(spread, ["image_id", "channel"])


def store_stats(batches: DataFrame, now: Column, ttl_seconds: int = 86400) -> DataFrame:
    """All batches and those not expired at ``now`` (AGG-32)."""
    return batches.agg(_n().alias("total"), F.count_if(F.unix_timestamp("created_at") + ttl_seconds > F.unix_timestamp(now)).alias("active"))


def top_rates(log: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """The n most frequent groups (TOP-4)."""
    return log.groupBy(*keys).agg(_n().alias("requests")).orderBy(F.desc("requests"), *keys).limit(n)
