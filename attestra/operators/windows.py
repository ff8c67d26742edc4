"""Ordered analyses: runs and ranges of segments, frame to frame changes, time to live, alert hold times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.hashes import positional_similarity


#: Digits of a segment's hash that are kept.
SEGMENT_DIGITS = 32


def placed(df: DataFrame, keys: list[str], part: Column, order: list[str], name: str) -> DataFrame:
    """Adds the place (from 1) of a row among those of its keys, in the order of ``order``, of which ``part`` is a rounding.

    Rows are numbered within their part, and parts start after the rows of those before, so a key of any size is spread over
    as many tasks as it has parts. Null keys are a key of their own.
    """
    rows = df.withColumn("part__", part)
    before = rows.groupBy(*keys, "part__").agg(F.count(F.lit(1)).alias("n__"))
    sums = F.sum("n__").over(Window.partitionBy(*keys).orderBy("part__")) - F.col("n__")
    before = before.select(*[F.col(k).alias(f"key{i}__") for i, k in enumerate([*keys, "part__"])], sums.alias("before__"))
    within = F.row_number().over(Window.partitionBy(*keys, "part__").orderBy(*order))
    met = [F.col(k).eqNullSafe(F.col(f"key{i}__")) for i, k in enumerate([*keys, "part__"])]
    return rows.withColumn("within__", within).join(before, met).select(*[F.col(c) for c in df.columns], (F.col("within__") + F.col("before__")).alias(name))


def verification_history(reg: DataFrame) -> DataFrame:
    """Per registry row: its ordinal among those of its fingerprint, whether it is the first, and when that was (WIN-1).

    Rows are numbered within the days of their fingerprint, and days added up, so a fingerprint of many rows is spread.
    """
    rows = placed(reg.select("id", "fingerprint", "upload_date"), ["fingerprint"], F.floor(F.col("upload_date") / 86400), ["upload_date", "id"], "ordinal")
    first = reg.groupBy(F.col("fingerprint").alias("own")).agg(F.min("upload_date").alias("first_seen"))
    out = rows.join(first, F.col("fingerprint").eqNullSafe(F.col("own")))
    return out.select("id", "fingerprint", "ordinal", "first_seen", (F.col("ordinal") == 1).alias("is_first"))


def _islands(match: DataFrame) -> DataFrame:
    """Adds ``run``: equal for neighbours in index order with equal ``matched``."""
    by = Window.partitionBy("video_id").orderBy("seg_idx")
    own = Window.partitionBy("video_id", "matched").orderBy("seg_idx")
    return match.withColumn("run", F.row_number().over(by) - F.row_number().over(own))


def matched_ranges(match: DataFrame) -> DataFrame:
    """Contiguous matched segments as (video_id, range_start, range_end) (WIN-2).

    A range ends before the next mismatch's index, across gaps of indices too; the last one at its last segment.
    """
    by = Window.partitionBy("video_id").orderBy("seg_idx").rowsBetween(1, Window.unboundedFollowing)
    next_bad = F.min(F.when(~F.col("matched"), F.col("seg_idx"))).over(by)
    runs = _islands(match.withColumn("next_bad", next_bad)).filter("matched")
    out = runs.groupBy("video_id", "run").agg(F.min("seg_idx").alias("range_start"), F.max("seg_idx").alias("last"), F.max("next_bad").alias("next_bad"))
    return out.select("video_id", "range_start", F.coalesce(F.col("next_bad") - 1, F.col("last")).alias("range_end"))


def mismatched_runs(match: DataFrame, k: int = 3) -> DataFrame:
    """Per video the longest run of consecutive mismatches in row order, and whether it reaches k (WIN-3)."""
    runs = _islands(match).filter(~F.col("matched")).groupBy("video_id", "run").agg(F.count(F.lit(1)).alias("n"))
    longest = runs.groupBy("video_id").agg(F.max("n").alias("longest_run"))
    videos = match.select("video_id").distinct()
    out = videos.join(longest, "video_id", "left").select("video_id", F.coalesce("longest_run", F.lit(0)).alias("longest_run"))
    return out.withColumn("has_run", F.col("longest_run") >= k)


def first_mismatches(match: DataFrame, n: int = 5) -> DataFrame:
    """The first n mismatches of each video, with what was expected and found (WIN-4)."""
    order = Window.partitionBy("video_id").orderBy("seg_idx")
    bad = match.filter(~F.col("matched")).withColumn("rank", F.row_number().over(order))
    return bad.filter(F.col("rank") <= n).select("video_id", "rank", "seg_idx", "expected", "actual")


def segment_coverage(match: DataFrame, k: int = 3) -> DataFrame:
    """Per video: matched, compared, coverage, longest mismatch run and the verdict (AGG-6 with WIN-3)."""
    sums = match.groupBy("video_id").agg(F.sum(F.col("matched").cast("int")).alias("n_matched"), F.count(F.lit(1)).alias("n_compared"))
    out = sums.join(mismatched_runs(match, k), "video_id")
    raw = F.col("n_matched") / F.col("n_compared")
    return out.withColumn("coverage", F.floor(raw * 10000 + 0.5) / 10000).withColumn("verdict", coverage_verdict(raw, F.col("has_run"))).drop("has_run")


def coverage_verdict(coverage: Column, has_run: Column) -> Column:
    """The coverage ladder."""
    return F.when(coverage == 1, "PROVEN_STRONG").when((coverage >= 0.98) & ~has_run, "PROVEN_STRONG").when(coverage >= 0.80, "PROVEN_DERIVED").when(coverage >= 0.30, "INCONCLUSIVE").otherwise("NOT_PROVEN")


def with_previous(frames: DataFrame, steps: int = 1) -> DataFrame:
    """Adds ``sim``, the hash similarity with the previous frame, and with ``steps`` 2 also ``sim_before``, that of the two before."""
    by = Window.partitionBy("video_id").orderBy("frame_no")
    out = frames.withColumn("prev", F.lag("phash").over(by))
    out = out.withColumn("sim", F.when(F.col("prev").isNotNull(), positional_similarity(F.col("prev"), F.col("phash")))).drop("prev")
    return out.withColumn("sim_before", F.lag("sim").over(by)) if steps > 1 else out


def temporal_morphing(frames: DataFrame) -> DataFrame:
    """Per video: morphs, micro morphs, jumps with recovery, and the capped score (WIN-5)."""
    by = Window.partitionBy("video_id").orderBy("frame_no")
    sims = with_previous(frames).withColumn("next_sim", F.lead("sim").over(by))
    morph = (F.col("sim") > 0.98) & (F.col("sim") < 1)
    micro = (F.col("sim") > 0.995) & (F.col("sim") < 1)
    jump = (F.col("sim") < 0.7) & (F.col("next_sim") > 0.9)
    n = F.count(F.lit(1))
    out = sims.groupBy("video_id").agg(n.alias("n_frames"), F.count_if(morph).alias("morphs"), F.count_if(micro).alias("micro"), F.count_if(jump).alias("jumps"))
    ratio = (F.col("morphs") + 2 * F.col("jumps")) / F.col("n_frames")
    score = F.least(F.lit(25), F.floor(ratio * 50 + 0.5)) + F.when(F.col("micro") / F.col("n_frames") > 0.5, 8).otherwise(0)
    return out.withColumn("score", score)


def adjacent_smoothness(frames: DataFrame) -> DataFrame:
    """Per video: share of neighbours more than .95 alike; over .6 gives videos of 5 frames or more 12 points (WIN-6)."""
    out = with_previous(frames).groupBy("video_id").agg(F.count("sim").alias("pairs"), F.count_if(F.col("sim") > 0.95).alias("smooth"))
    ratio = F.when(F.col("pairs") > 0, F.col("smooth") / F.col("pairs")).otherwise(0.0)
    return out.withColumn("smoothness", ratio).withColumn("points", F.when((F.col("pairs") >= 4) & (ratio > 0.6), 12).otherwise(0))


def uniform_motion(frames: DataFrame, facts: DataFrame) -> DataFrame:
    """Per video: share of steps whose similarity differs by under .01 from the one before, over .7 with more than 5 frames 10
    points; a consistent frame rate without any variance 12; no temporal inconsistencies 10 (WIN-7).

    ``facts``: video_id, rate_consistent, variance_percent, inconsistencies; null where a video was not analysed for them.
    """
    sims = with_previous(frames, 2)
    out = sims.groupBy("video_id").agg(F.count("sim_before").alias("steps"), F.count_if(F.abs(F.col("sim") - F.col("sim_before")) < 0.01).alias("uniform"))
    enough, ratio = F.col("steps") + 2 > 5, F.col("uniform") / F.nullif(F.col("steps"), F.lit(0))
    out = out.join(facts.select("video_id", "rate_consistent", "variance_percent", "inconsistencies"), "video_id", "left")
    points = lambda test, n: F.when(test, n).otherwise(0)
    return out.select("video_id", "steps", "uniform", points(enough & (ratio > 0.7), 10).alias("uniform_points"), points(F.col("rate_consistent") & (F.col("variance_percent") == 0), 12).alias("constant_points"), points(~F.col("inconsistencies"), 10).alias("steady_points"))


def facial_jumps(faces: DataFrame, limit: int = 100) -> DataFrame:
    """Per video with 5 face positions or more: moves over ``limit`` pixels; over 20 % of them gives 20 points (WIN-8)."""
    by = Window.partitionBy("video_id").orderBy("frame_no", "face_idx")
    jump = (F.abs(F.col("x") - F.lag("x").over(by)) > limit) | (F.abs(F.col("y") - F.lag("y").over(by)) > limit)
    out = faces.withColumn("jump", F.coalesce(jump, F.lit(False))).groupBy("video_id").agg(F.count(F.lit(1)).alias("positions"), F.count_if("jump").alias("jumps"))
    return out.withColumn("points", F.when((F.col("positions") >= 5) & (F.col("jumps") * 100 / F.col("positions") > 20), 20).otherwise(0))


def frame_differences(frames: DataFrame, diff_col: str = "mean_diff") -> DataFrame:
    """Frames whose difference to the one before is a jump (over 50) or frozen (under 1), with a severity (WIN-9)."""
    d = F.col(diff_col)
    kind = F.when(d > 50, "large_frame_jump").when(d < 1, "frozen_frame")
    severity = F.when(d > 50, F.least(F.lit(100), F.floor(d + 0.5))).when(d < 1, 40)
    by = Window.partitionBy("video_id").orderBy("frame_no")
    return frames.withColumn("n", F.row_number().over(by)).filter("n > 1").select("video_id", "frame_no", kind.alias("kind"), severity.cast("long").alias("severity")).filter("kind is not null")


def segment_hashes(frames: DataFrame, n: int = 15) -> DataFrame:
    """``seg_i`` of every n frames of a video: SHA-256 of their hashes in order, 32 digits; an incomplete tail is dropped (WIN-10)."""
    order = F.row_number().over(Window.partitionBy("video_id").orderBy("frame_no")) - 1
    parts = frames.withColumn("rn", order).withColumn("seg_idx", F.floor(F.col("rn") / n).cast("int"))
    grouped = parts.groupBy("video_id", "seg_idx").agg(F.count(F.lit(1)).alias("c"), F.sort_array(F.collect_list(F.struct("rn", "phash"))).alias("hs"))  # n rows a group
    joined = F.array_join(F.transform("hs", lambda x: x["phash"]), "")
    return grouped.filter(F.col("c") == n).select("video_id", "seg_idx", F.concat(F.lit("seg_"), F.col("seg_idx"), F.lit(":"), F.substring(F.sha2(joined, 256), 1, SEGMENT_DIGITS)).alias("segment"))


def batch_ttl(batches: DataFrame, now: Column, ttl_seconds: int = 86400) -> DataFrame:
    """Batches that have not expired at ``now``, with their expiry and the whole seconds left (WIN-11)."""
    left = F.unix_timestamp("created_at") + ttl_seconds - F.unix_timestamp(now)
    return batches.withColumn("seconds_left", F.greatest(F.lit(0), left)).withColumn("expires_at", F.timestamp_seconds(F.unix_timestamp("created_at") + ttl_seconds)).filter(left > 0)


def alert_for(series: DataFrame, condition: Column, seconds: int, keys: list[str]) -> DataFrame:
    """Spans of samples over which ``condition`` held without a break for at least ``seconds`` (WIN-12).

    Samples of one instant have no order: one that fails ends the span before all of them. ``series``: keys and ts. Returns keys, since, until, samples.
    """
    by = Window.partitionBy(*keys).orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    runs = series.withColumn("ok", F.coalesce(condition, F.lit(False))).withColumn("run", F.count_if(~F.col("ok")).over(by)).filter("ok")
    out = runs.groupBy(*keys, "run").agg(F.min("ts").alias("since"), F.max("ts").alias("until"), F.count(F.lit(1)).alias("samples"))
    return out.filter(F.unix_timestamp("until") - F.unix_timestamp("since") >= seconds).drop("run")


def at_capacity(series: DataFrame, limit: float, keys: list[str], seconds: int = 3600) -> DataFrame:
    """Samples whose value reaches ``limit`` at the trailing maximum of the window (WIN-13)."""
    by = Window.partitionBy(*keys).orderBy(F.unix_timestamp("ts")).rangeBetween(-seconds, 0)
    top = F.max("value").over(by)
    return series.select(*keys, "ts", "value", top.alias("trailing_max")).withColumn("at_capacity", (F.col("value") >= F.col("trailing_max")) & (F.col("value") >= limit))


def coverage_drift(runs: DataFrame, tolerance: float = 0.05, gate: float = 0.95) -> DataFrame:
    """Per asset and run: the change of coverage since the run before, whether within tolerance, and the coverage gate (WIN-14)."""
    before = F.lag("coverage").over(Window.partitionBy("asset_id").orderBy("run_no"))
    out = runs.withColumn("drift", F.abs(F.col("coverage") - before))
    return out.withColumn("stable", F.coalesce(F.col("drift") <= tolerance, F.lit(True))).withColumn("passes", F.col("coverage") >= gate)
