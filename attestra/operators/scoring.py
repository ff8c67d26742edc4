"""Rule scores over detector records: nullable columns in, points and labels out."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.operators.aggregates import js_round


def points(*rules: tuple[Column, float]) -> Column:
    """Sum of the points of the rules that hold; a null condition does not hold."""
    return reduce(lambda a, b: a + b, [F.when(test, p).otherwise(0) for test, p in rules])


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def metadata_quality(kind: Column, fingerprint: Column, size: Column, camera: Column, gps: Column, timestamp: Column, weather_ok: Column, landmarks: Column, sun: Column, c2pa_valid: Column) -> Column:
    """SC-1, out of 40."""
    known = kind.isin("image", "video", "audio")
    exif = (kind == "image") & (F.coalesce(camera, F.lit(False)) | F.coalesce(gps, F.lit(False)) | F.coalesce(landmarks > 0, F.lit(False)) | F.coalesce(sun, F.lit(False)))
    rules = [(known, 10), (fingerprint.isNotNull(), 8), (size > 1000, 3), (exif, 5), (gps, 4), (camera, 4), (timestamp, 3), (weather_ok, 2), (landmarks > 0, 1), (c2pa_valid, 5)]
    return F.least(F.lit(40), points(*rules))


def external_verification(web: Column, full: Column, partial: Column, reputable: Column, listed: Column, malicious: Column, reputation: Column) -> Column:
    """SC-2, 0 to 30."""
    full, partial = F.coalesce(full, F.lit(0)), F.coalesce(partial, F.lit(0))
    found = F.when((full == 0) & (partial == 0), 10).when(reputable, 20).when(full > 10, 8).when(full > 0, 15).otherwise(12)
    seen = points((malicious == 0, 5), (malicious > 0, -10), (reputation < -50, -5), (reputation > 0, 5))
    return clamp(F.when(web, found).otherwise(10) + F.when(listed, seen).otherwise(5), 0, 30)


def forensic(ai_likely: Column, shadow_ok: Column, deepfake: Column, temporal: Column, rate_ok: Column, ai_pct: Column, video: Column, safe: Column, labels: Column, faces: Column, similar: Column) -> Column:
    """SC-3, 0 to 25."""
    analysed = F.coalesce(video, F.lit(False))
    share = F.coalesce(ai_pct, F.lit(0))
    rules = [
        (ai_likely, -5), (~ai_likely, 5), (shadow_ok, 3), (~shadow_ok, -3), (deepfake, -5), (~deepfake, 3),
        (analysed & (temporal == "consistent"), 2), (analysed & (temporal == "inconsistent"), -2), (analysed & rate_ok, 2), (analysed & ~rate_ok, -2), (analysed & (share < 5), 2), (analysed & (share >= 30), -3),
        (safe, 2), (labels > 5, 2), (faces > 0, 1), (similar > 0, 2),
    ]
    return clamp(F.lit(10) + points(*rules), 0, 25)


def temporal_trust(is_first: Column, days_old: Column) -> Column:
    """SC-4, out of 15. ``days_old``: since an external first sighting, at a stated day."""
    return F.when(F.coalesce(is_first, F.lit(False)), 0).otherwise(10) + F.when(days_old > 365, 5).when(days_old > 30, 3).otherwise(0)


#: The factors' maxima and names.
FACTORS = {"metadata": 40, "external": 30, "forensic": 25, "temporal": 15}
FACTOR_NAMES = {"metadata": "metadata quality", "external": "external verification", "forensic": "forensic analysis", "temporal": "temporal trust"}


def confidence_total(df: DataFrame) -> DataFrame:
    """SC-5 on the columns of ``FACTORS``: total, percentage, and each factor's percentage."""
    out = df.withColumn("total", reduce(lambda a, b: a + b, [F.col(c) for c in FACTORS]))
    out = out.withColumn("percentage", js_round(F.col("total") * 100 / sum(FACTORS.values())))
    return out.withColumns({f"{c}_pct": js_round(F.col(c) * 100 / m) for c, m in FACTORS.items()})


def modification_status(similarity: Column) -> Column:
    """SC-6: identical, modified_version or heavily_modified; null where nothing similar was found."""
    return F.when(similarity == 100, "identical").when((similarity >= 85) & (similarity < 100), "modified_version").when((similarity >= 70) & (similarity < 85), "heavily_modified")


def inferred_edits(similarity: Column) -> Column:
    """SC-6: what edits a modified version (similarity 85 to below 100) shows. The texts."""
    edits = (
        F.when(similarity >= 95, "Minor edits (compression, slight crop, or format change)")
        .when(similarity >= 90, "Moderate edits (cropping, resizing, or color adjustments)")
        .when(similarity >= 85, "Significant edits (substantial cropping, filters, or overlays)")
    )
    return F.when(similarity < 100, edits)


def number_text(c: Column) -> Column:
    """A number without a trailing ``.0``."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def _is_modified(similarity: Column) -> Column:
    return F.coalesce((similarity >= 70) & (similarity < 100), F.lit(False))


def warnings(similarity: Column) -> Column:
    """SC-8: factors under half, modification, low total; an array without nulls. Expects the columns of ``FACTORS`` and
    percentage. Fixed values: the texts."""
    low = [F.when(F.col(c) * 100 / m < 50, f"Low {FACTOR_NAMES[c]}") for c, m in FACTORS.items()]
    modified = F.when(_is_modified(similarity), F.concat(F.lit("Content has been modified ("), number_text(similarity), F.lit("% similarity to original)")))
    return F.array_compact(F.array(*low, modified, F.when(F.col("percentage") < 50, "Overall confidence below acceptable threshold")))


def recommendations(similarity: Column) -> Column:
    """SC-8: what to do next. The texts."""
    modified = _is_modified(similarity)
    return F.array_compact(
        F.array(
            F.when((F.col("percentage") < 75) & ~modified, "Consider obtaining additional verification from original source"),
            F.when(modified, "Verify the source of modifications and original content provenance"),
            F.concat(F.lit("Detected modifications: "), inferred_edits(similarity)),
            F.when(F.col("external") / FACTORS["external"] < 0.5, "Verify chain of custody for this content"),
        )
    )


def ensemble_verdict(jpeg: Column, jpeg_ai: Column, local: Column, local_ai: Column, remote: Column) -> Column:
    """SC-13 as struct (ai_confidence, likely_ai_generated, detectors, agreement, max_deviation, average_confidence).

    ``jpeg`` is a share from 0 to 1, which counts only above 0; the others are per cent, null where a detector did not answer. Two or
    three answers are weighted and likely from 50 on; a single one stands as it is, with its own verdict (``jpeg_ai``, ``local_ai``),
    but the remote one alone does not count. Only three answers have an agreement. Fixed values: weights and limits.
    """
    has_j, has_a, has_r = F.coalesce(jpeg > 0, F.lit(False)), local.isNotNull(), remote.isNotNull()
    j = js_round(jpeg * 100)
    three = has_j & has_a & has_r
    weighted = (
        F.when(three, js_round(j * 0.40 + local * 0.30 + remote * 0.30))
        .when(has_j & has_a, js_round(j * 0.57 + local * 0.43))
        .when(has_j & has_r, js_round(j * 0.57 + remote * 0.43))
        .when(has_a & has_r, js_round(local * 0.40 + remote * 0.60))
    )
    confidence = F.coalesce(weighted, F.when(has_j, j), F.when(has_a, local.cast("long")), F.lit(0).cast("long"))
    likely = F.when(weighted.isNotNull(), weighted >= 50).when(has_j, jpeg_ai).when(has_a, local_ai)
    mean = (j + local + remote) / 3
    most = F.greatest(F.abs(j - mean), F.abs(local - mean), F.abs(remote - mean))
    many = F.when(has_r & ~has_j & ~has_a, 0).otherwise(has_j.cast("int") + has_a.cast("int") + has_r.cast("int"))
    level = F.when(most < 15, "high").when(most < 30, "medium").otherwise("low")
    return F.struct(
        confidence.alias("ai_confidence"),
        F.coalesce(likely, F.lit(False)).alias("likely_ai_generated"),
        many.alias("detectors"),
        F.when(three, level).alias("agreement"),
        F.when(three, js_round(most)).alias("max_deviation"),
        F.when(three, js_round(mean)).alias("average_confidence"),
    )


#: Sample rates and codecs that generators commonly use.
AUDIO_RATES, AUDIO_CODECS = [22050, 24000, 44100, 48000], ["aac", "mp3", "opus"]


def audio_score(mean_volume: Column, max_volume: Column, silences: Column, seconds: Column, rate: Column, channels: Column, codec: Column) -> Column:
    """SC-15, capped at 100. The dynamic range is the distance of the two volumes, null where either was not measured; then its
    points and those for even levels are not given."""
    span = F.abs(max_volume - mean_volume)
    rules = [(span < 15, 25), ((span >= 15) & (span < 25), 15), ((seconds > 10) & (silences / seconds < 0.1), 20), (rate.isin(AUDIO_RATES), 5), (channels == 1, 10), (channels == 2, 5), (100 - span > 85, 20), (codec.isin(AUDIO_CODECS), 5)]
    return F.least(F.lit(100), points(*rules))


def frame_rate_check(nominal: Column, average: Column) -> Column:
    """SC-21 as struct (declared_fps, average_fps, variance_percent, consistent, warnings). The texts."""
    v = F.abs(nominal - average) / nominal
    percent = js_round(v * 10000) / 100
    said = F.array(
        F.when(v >= 0.02, "Frame rate inconsistency detected - possible editing or splicing"),
        F.when(v > 0.1, F.concat(F.lit("High frame rate variance ("), number_text(percent), F.lit("%) - likely edited"))),
        F.when((F.abs(nominal - 30) < 0.1) & (F.abs(average - 24) < 0.1), "Mixed 30fps and 24fps content - indicates editing or format conversion"),
    )
    return F.struct((js_round(nominal * 100) / 100).alias("declared_fps"), (js_round(average * 100) / 100).alias("average_fps"), percent.alias("variance_percent"), (v < 0.02).alias("consistent"), F.array_compact(said).alias("warnings"))


def batch_confidence(given: Column, width: Column, height: Column, ensemble: Column, detectors: Column, agreement: Column) -> Column:
    """SC-24: a given level, else high, medium or low by the mean of the factors at hand: resolution always, the number of
    detectors where an ensemble was used, and their agreement where that is known."""
    pixels = F.coalesce(width, F.lit(0)) * F.coalesce(height, F.lit(0))
    resolution = F.when(pixels >= 2_000_000, 3).when(pixels >= 500_000, 2).otherwise(1)
    many = F.when(ensemble, F.when(detectors >= 3, 3).when(detectors >= 2, 2).otherwise(1))
    level = F.when(ensemble & agreement.isNotNull(), F.when(agreement == "high", 3).when(agreement == "medium", 2).otherwise(1))
    here = F.array_compact(F.array(resolution, many, level))
    mean = F.aggregate(here, F.lit(0), lambda a, x: a + x) / F.size(here)
    return F.coalesce(given, F.when(mean >= 2.5, "high").when(mean >= 1.5, "medium").otherwise("low"))


def batch_warnings(likely_ai: Column, ai_confidence: Column, duplicates: Column, width: Column, height: Column, quality: Column) -> Column:
    """SC-25. The texts."""
    kind = F.when(ai_confidence >= 80, "High confidence").when(ai_confidence >= 60, "Likely").otherwise("Possible")
    ai = F.concat(kind, F.lit(" AI-generated content detected ("), number_text(ai_confidence), F.lit("%)"))
    sized = (width > 0) & (height > 0)
    ratio = width / height
    return F.array_compact(
        F.array(
            F.when(likely_ai, ai),
            F.when(duplicates > 0, "Possible duplicate detected"),
            F.when(sized & (F.least(width, height) < 500), "Low resolution image - may affect verification accuracy"),
            F.when(sized & (F.least(width, height) < 200), "Very low resolution - verification results may be unreliable"),
            F.when((quality != 0) & (quality < 50), "Low quality/heavy compression detected"),
            F.when(sized & ((ratio > 5) | (ratio < 0.2)), "Unusual aspect ratio detected"),
        )
    )


def case_evaluation(expected: Column, verdict: Column) -> Column:
    """SC-26: right if the verdict is the expected one or of the same class (fake or real)."""
    fake = lambda c: c.isin("QUESTIONABLE", "LIKELY_MANIPULATED")
    return (expected == verdict) | (fake(expected) == fake(verdict))


def verdict_of_confidence(likely_ai: Column, confidence: Column) -> Column:
    """SC-26: the verdict ladder; a detector that says so settles it."""
    ladder = F.when(confidence >= 80, "LIKELY_MANIPULATED").when(confidence >= 50, "QUESTIONABLE").when(confidence >= 30, "LIKELY_AUTHENTIC").otherwise("AUTHENTIC")
    return F.when(likely_ai, "LIKELY_MANIPULATED").otherwise(ladder)


def credential_boost(valid: Column, device: Column, anchored: Column, actions: Column) -> Column:
    """SC-23, capped at 50."""
    return F.least(F.lit(50), points((valid, 40), (device, 5), (anchored, 10), (actions > 0, 5)))


def legacy_confidence(kind: Column, described: Column, has_format: Column, exif_fields: Column, found_online: Column, ai_likely: Column, ai_confidence: Column, age_days: Column, disputes: Column) -> Column:
    """SC-9, the earlier score, as struct (metadata, external, forensic, temporal, score, level, label, warnings, recommendations).

    ``found_online`` is null where no search was made, ``ai_likely`` where no detector ran, ``age_days`` where no date is known
    (at a stated day). Fixed values: the points and texts.
    """
    metadata = F.least(F.lit(30), points((kind.isin("image", "video", "audio"), 15), (described, 10), (has_format, 5), (exif_fields > 5, 5)))
    external = F.when(found_online.isNull(), 15).when(found_online, 5).otherwise(30)
    forensic = F.when(ai_likely.isNull(), 20).when(ai_likely, 0).when(ai_confidence > 30, 10).otherwise(20)
    temporal = F.when(age_days.isNull(), 10).when(age_days < 1, 0).when(age_days < 7, 5).when(age_days < 30, 10).otherwise(15)
    score = metadata + external + forensic + temporal
    level = F.when(disputes > 0, "DISPUTED").when(score >= 75, "HIGH").when(score >= 50, "MEDIUM").otherwise("LOW")
    label = F.when(level == "DISPUTED", level).otherwise(F.concat(level, F.lit(" CONFIDENCE")))
    each = zip((metadata, external, forensic, temporal), (30, 30, 25, 15), FACTOR_NAMES.values(), strict=True)
    low = [F.when(js_round(c / most * 100) < 50, f"Low {name}") for c, most, name in each]
    said = F.array(F.when(found_online, "Content found online before upload"), *low, F.when(age_days < 1, "Recently uploaded - limited trust"))
    next_ = F.when(level.isin("LOW", "MEDIUM"), F.array(F.lit("Consider providing additional proof of ownership"), F.lit("Link to original publication sources"))).when(level == "DISPUTED", F.array(F.lit("Review dispute details"), F.lit("Provide evidence of original creation"))).otherwise(F.array().cast("array<string>"))
    return F.struct(metadata.alias("metadata"), external.alias("external"), forensic.alias("forensic"), temporal.alias("temporal"), score.alias("score"), level.alias("level"), label.alias("label"), F.array_compact(said).alias("warnings"), next_.alias("recommendations"))


def ai_authenticity(present: Column, is_ai: Column) -> Column:
    """SC-10, out of 30."""
    return F.when(~F.coalesce(present, F.lit(False)), 15).when(is_ai, 0).otherwise(30)


def confidence_label(kind: Column, percentage: Column, modified: Column, image_ai: Column, video_pct: Column, video_faces: Column, audio_ai: Column, audio_likely: Column) -> Column:
    """SC-7: the label of a file by its kind. ``video_pct`` and ``audio_ai`` are null where there was no analysis."""
    video = (
        F.when(video_faces & (video_pct > 30), "DEEPFAKE INDICATORS DETECTED")
        .when(video_pct >= 70, "PRIMARILY AI-GENERATED VIDEO")
        .when(video_pct >= 30, "SIGNIFICANT MIX OF VIDEO AND AI CONTENT")
        .when(video_pct >= 5, "AI-GENERATED CONTENT DETECTED")
        .otherwise("VERIFIED VIDEO")
    )
    audio = F.when(audio_ai >= 70, "FULLY AI-GENERATED AUDIO").when(F.coalesce(audio_likely, F.lit(False)) & (audio_ai >= 50), "SYNTHETIC VOICE DETECTED").otherwise("VERIFIED AUDIO RECORDING")
    image = (
        F.when(image_ai >= 60, "AI-GENERATED IMAGE")
        .when(percentage >= 75, "VERIFIED PHOTOGRAPH")
        .when((percentage >= 50) & modified, "MODIFIED VERSION DETECTED")
        .when(percentage >= 50, "LIKELY CAMERA-CAPTURED")
        .when(percentage >= 25, "MANIPULATION DETECTED")
        .otherwise("HEAVILY MANIPULATED")
    )
    rest = F.when(percentage >= 75, "HIGH INTEGRITY").when(percentage >= 50, "MEDIUM INTEGRITY").otherwise("LOW INTEGRITY")
    return F.when((kind == "video") & video_pct.isNotNull(), video).when((kind == "audio") & audio_ai.isNotNull(), audio).when(kind == "image", image).otherwise(rest)


def local_image_score(common_size: Column, exif: Column, sd: Column, ai_software: Column, fmt: Column, jpeg_ratio: Column, noise: Column, edge: Column, edge_share: Column, extreme: Column, saturated: Column) -> Column:
    """SC-11 as struct (ai_confidence, likely_ai_generated, n_indicators).

    Software that names a generator sets the score to 100, whatever came before it; the later checks still add and subtract. Five
    indicators or more lift 55 to 59 by 10. From 60 on the image is likely generated; the confidence is capped at 100.
    """
    bare = ~F.coalesce(exif, F.lit(False))
    jpeg = fmt.isin("jpeg", "jpg")
    smooth = (edge_share < 0.02) & (edge < 20)
    early = [(common_size, 25), (bare, 8), (sd < 15, 20), ((sd >= 15) & ((sd < 25) | (sd > 80)), 12)]
    late = [
        ((fmt == "png") & bare, 12),
        (jpeg & (jpeg_ratio > 0.95), 20), (jpeg & (jpeg_ratio < 0.3), 10), (jpeg & bare & (jpeg_ratio > 0.85), 15),
        (noise < 15, 25), ((noise >= 15) & (noise < 30), 15), ((noise >= 100) & (noise <= 600), -10),
        (edge < 10, 20), ((edge >= 10) & (edge < 20), 10), (edge > 60, 12), (smooth, 15), ((edge_share > 0.05) & ~smooth, -8),
        (extreme > 0.35, 10), (saturated > 0.90, 8), ((extreme < 0.01) & (saturated < 0.05), 15),
    ]
    named = F.coalesce(ai_software, F.lit(False))
    plain = F.when(named, 100).otherwise(points(*early)) + points(*late)
    many = points(*[(test, 1) for test, _ in [*early, *late]], (named, 1))
    lifted = (many >= 5) & plain.between(55, 59)
    score = F.greatest(F.lit(0), plain + F.when(lifted, 10).otherwise(0))
    return F.struct(F.least(score, F.lit(100)).alias("ai_confidence"), (score >= 60).alias("likely_ai_generated"), (many + F.when(lifted, 1).otherwise(0)).alias("n_indicators"))


def portrait_score(make: Column, model: Column, lens: Column, lens_make: Column, software: Column, focal: Column, processing: Column, capture: Column, scene: Column, distance: Column, description: Column, bracket: Column, f_number: Column) -> Column:
    """SC-14: how sure EXIF makes it that a photo was taken in portrait mode, capped at 100. ``capture`` is the scene capture type,
    ``scene`` the scene type; capture type and subject distance may be names or the number 2, as text."""
    says = lambda c, *words: F.coalesce(F.lower(c).rlike("|".join(words)), F.lit(False))
    apple, google, samsung = says(make, "apple"), says(make, "google"), says(make, "samsung")
    rules = [
        (apple & says(lens, "portrait"), 40), (apple & says(software, "portrait"), 30), (apple & says(lens_make, "apple") & focal.isin(26, 52), 20),
        (google & says(model, "pixel") & processing.contains("HDR"), 35), (samsung & (says(capture, "portrait") | says(scene, "portrait")), 40), (distance.isin("2", "Close view"), 15),
        (F.coalesce(capture == "2", F.lit(False)) | F.coalesce(scene == "Portrait", F.lit(False)), 25),
        (says(description, "portrait", "bokeh", "depth"), 20), (bracket, 15), ((apple | google | samsung) & (f_number > 0) & (f_number < 2.8), 25),
    ]
    return F.least(F.lit(100), points(*rules))


def portrait_adjust(ai_confidence: Column, score: Column) -> Column:
    """SC-14: AI confidence lowered for portrait mode (from a score of 40), not below 0."""
    return F.when(score >= 40, F.greatest(F.lit(0), F.coalesce(ai_confidence, F.lit(0)) - js_round(30 * score / 100))).otherwise(ai_confidence)


def face_suspicion(confidence: Column, joy: Column, sorrow: Column, sharp: Column, headwear: Column, pan: Column, tilt: Column, roll: Column, landmarks: Column) -> Column:
    """SC-18: points of a face; over 20 is suspicious. ``landmarks``: struct of eye, nose and mouth places, or null.

    An angle of 0 counts as missing. Landmarks add their points only where they are suspicious on their own (over 15).
    """
    turned = (pan != 0) & (tilt != 0) & (roll != 0)
    angle = F.abs(pan) + F.abs(tilt) + F.abs(roll)
    lm = landmarks
    known = lm["left_x"].isNotNull() & lm["right_x"].isNotNull() & lm["nose_x"].isNotNull() & lm["mouth_x"].isNotNull()
    tilted = F.abs(lm["left_y"] - lm["right_y"]) > F.abs(lm["left_x"] - lm["right_x"]) * 0.15
    own = F.when(~known, 15).otherwise(points((tilted, 12), (F.abs(lm["nose_x"] - lm["mouth_x"]) > 20, 10)))
    marks = F.when(lm.isNull(), 0).when(~known | (own > 15), own).otherwise(0)
    return points((confidence < 0.8, 15), (joy & sorrow, 20), (sharp & (confidence > 0.95), 10), (headwear & (confidence > 0.9), 5), (turned & (angle < 5) & (confidence > 0.95), 8)) + marks


def image_deepfake(faces: DataFrame) -> DataFrame:
    """SC-18: per image, faces, suspicious ones (column suspicion) and the confidence."""
    bad = F.col("suspicion") > 20
    out = faces.groupBy("image_id").agg(F.count(F.lit(1)).alias("faces"), F.count_if(bad).alias("suspicious"))
    conf = F.when(F.col("suspicious") > 0, F.least(F.lit(95), js_round(F.col("suspicious") * 100 / F.col("faces")))).otherwise(0)
    return out.withColumn("is_deepfake", F.col("suspicious") > 0).withColumn("confidence", conf)


def shadow_check(sun: Column, lat: Column, day: Column, detected: Column, direction: Column, ratio: Column) -> Column:
    """SC-20 as struct (mismatches, impossible, confidence, valid) from the sun's place (FN-15) and a shadow.

    Each mismatch of an existing shadow costs 20 points, each impossible condition 30. Without a place or a date (null) there is no
    verdict and no confidence.
    """
    alt = sun["altitude"]
    up = alt > 0
    off = F.abs(direction - (sun["azimuth"] + 180) % 360)
    off = F.least(off, 360 - off)
    expected = 1 / F.tan(F.radians(alt))
    one = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    seen = F.coalesce(detected, F.lit(False))
    mismatches = F.when(seen, one(alt < 0) + one(up & (off > 45)) + one(up & (F.abs(ratio - expected) / expected > 0.5))).otherwise(0)
    winter = ((lat > 0) & ((day < 80) | (day > 265))) | ((lat < 0) & day.between(80, 265))
    impossible = one(alt > 90 - F.abs(lat) + 23.44 + 5) + one((F.abs(lat) > 66.5) & winter & up)
    first = F.when(mismatches > 0, F.greatest(F.lit(0), 100 - mismatches * 20)).otherwise(100)
    confidence = F.when(impossible > 0, F.greatest(F.lit(0), first - impossible * 30)).otherwise(first)
    known = alt.isNotNull() & lat.isNotNull()
    return F.struct(mismatches.alias("mismatches"), impossible.alias("impossible"), F.when(known, confidence).otherwise(0).alias("confidence"), F.when(known, mismatches + impossible == 0).alias("valid"))


_MANIFEST = {
    "claim_generator": "string",
    "claim_generator_info": "string",
    "assertions": "array<struct<label:string,data:map<string,string>>>",
    "ingredients": "array<struct<title:string,format:string,relationship:string,document_id:string,instance_id:string>>",
    "signature_info": "struct<validated:boolean,issuer:string,time:string,cert_chain:array<string>>",
    "validation_status": "array<struct<code:string>>",
    "hard_bindings": "array<string>",
}
#: What SC-22 reads of a manifest: the active one, else what stands at the top.
MANIFEST_SCHEMA = "active_manifest struct<" + ",".join(f"{n}:{t}" for n, t in _MANIFEST.items()) + ">, " + ", ".join(f"{n} {t}" for n, t in _MANIFEST.items())
#: Labels of assertions by what they tell, and codes of validations that passed.
CREATIVE_WORK, EXIF, ACTIONS = ["stds.schema-org.CreativeWork"], ["stds.exif"], ["c2pa.actions"]
SOURCE_TYPE, SOFTWARE = ["c2pa.digital_source_type", "stds.iptc.DigitalSourceType"], ["c2pa.software_agent", "stds.schema-org.SoftwareApplication"]
ANCHORS, PASSED = ["blockchain", "timestamping", "numbers.protocol", "starling", "truepic"], ["ok", "success"]


def provenance_report(manifest: Column) -> Column:
    """SC-22 as struct: who made the credentials, device and time of capture, creator, digital source type, software, the signature and
    whether the credentials are valid, ingredients, actions, edits, and whether they are anchored elsewhere.

    Of several assertions of one kind the last counts; an empty text is none. Credentials without a signature are valid if all their
    validations passed.
    """
    m = F.coalesce(manifest["active_manifest"], F.struct(*[manifest[n].alias(n) for n in _MANIFEST]))
    assertions = F.coalesce(m["assertions"], F.array().cast("array<struct<label:string,data:map<string,string>>>"))
    has = lambda a, words: F.coalesce(reduce(lambda x, y: x | y, [a["label"].contains(w) for w in words]), F.lit(False))
    of = lambda words: F.filter(assertions, lambda a: has(a, words))
    last = lambda words: F.try_element_at(of(words), F.lit(-1))["data"]
    first = lambda data, *keys: F.coalesce(*[F.nullif(F.try_element_at(data, F.lit(k)), F.lit("")) for k in keys])
    whole = lambda data, key: F.coalesce(first(data, key), F.to_json(data))
    exif = last(EXIF)
    ingredients = F.coalesce(F.size(m["ingredients"]), F.lit(0))
    listed = F.transform(of(ACTIONS), lambda a: F.try_element_at(a["data"], F.lit("actions")))
    counts = F.transform(F.filter(listed, lambda t: F.startswith(t, F.lit("["))), lambda t: F.json_array_length(t))
    actions = F.coalesce(F.try_element_at(counts, F.lit(-1)), F.lit(0))
    signature = m["signature_info"]
    passed = F.forall(m["validation_status"], lambda v: F.coalesce(v["code"].isin(PASSED), F.lit(False)))
    return F.struct(
        F.nullif(m["claim_generator"], F.lit("")).alias("generator"),
        F.nullif(m["claim_generator_info"], F.lit("")).alias("generator_info"),
        first(exif, "Make", "exif:Make").alias("make"),
        first(exif, "Model", "exif:Model").alias("model"),
        first(exif, "SerialNumber", "exif:SerialNumber").alias("serial"),
        first(exif, "DateTimeOriginal", "exif:DateTimeOriginal", "CreateDate").alias("captured_at"),
        first(last(CREATIVE_WORK), "author", "creator").alias("creator"),
        whole(last(SOURCE_TYPE), "value").alias("source_type"),
        whole(last(SOFTWARE), "name").alias("software"),
        F.coalesce(signature["validated"], F.lit(False)).alias("signed"),
        F.when(signature.isNotNull(), F.coalesce(signature["validated"], F.lit(False))).otherwise(F.coalesce(passed, F.lit(False))).alias("valid"),
        signature["issuer"].alias("issuer"),
        signature["time"].alias("signed_at"),
        ingredients.alias("ingredients"),
        actions.alias("actions"),
        ((ingredients > 0) | F.exists(counts, lambda n: n > 0)).alias("has_edits"),
        (F.exists(assertions, lambda a: has(a, ANCHORS)) | F.coalesce(F.size(m["hard_bindings"]) > 0, F.lit(False))).alias("anchored"),
    )


def double_compressed(q: Column) -> Column:
    """SC-12: over 10 entries of a quantisation table that differ from both neighbours by more than 5."""
    inner = F.sequence(F.lit(1), F.size(q) - 2)
    jump = lambda i: (F.abs(F.get(q, i) - F.get(q, i - 1)) > 5) & (F.abs(F.get(q, i + 1) - F.get(q, i)) > 5)
    return F.size(F.filter(inner, jump)) > 10


def jpeg_artifact_score(standard: Column, camera: Column, variance: Column, high: Column, uniform: Column, step: Column, soft: Column, doubled: Column) -> Column:
    """SC-12: weighted mean of the four analyses, 0 to 1; over 0.65 speaks for a generator. Null where none was made.

    ``standard``: likeness to standard tables, ``camera``: whether a camera's table, ``high`` and ``uniform``: block energies,
    ``step`` and ``soft``: boundary statistics. Fixed values: thresholds and weights.
    """
    table = clamp(F.lit(0.5) + points((standard > 0.85, 0.7), (camera, -0.6), (variance < 100, 0.3)), 0.0, 1.0)
    parts = [
        (F.when(standard.isNotNull(), table), 0.35),
        (F.when(high.isNotNull(), F.least(F.lit(1.0), points((high < 0.15, 0.4), (uniform > 0.75, 0.4)))), 0.30),
        (F.when(step.isNotNull(), F.least(F.lit(1.0), points((step < 8, 0.5), (soft > 0.7, 0.3)))), 0.20),
        (F.when(doubled.isNotNull(), F.when(doubled, 0.35).otherwise(0.65)), 0.15),
    ]
    total = reduce(lambda a, b: a + b, [F.coalesce(s * w, F.lit(0.0)) for s, w in parts])
    weight = reduce(lambda a, b: a + b, [F.when(s.isNotNull(), w).otherwise(0.0) for s, w in parts])
    return F.when(weight > 0, total / weight).otherwise(0.5)


#: The generators, in the order that breaks ties.
GENERATORS = ["sora", "runway", "pika", "kling", "midjourney", "dalle", "stableDiffusion", "firefly"]
#: Resolutions (either way round) and aspect ratios with the points of the generators that they speak for.
RESOLUTIONS = [
    (1920, 1080, 10, "sora runway kling"), (1280, 720, 10, "sora pika runway"), (3840, 2160, 15, "sora"), (1024, 1024, 12, "midjourney dalle stableDiffusion"), (1456, 816, 15, "midjourney"),
    (1792, 1024, 18, "dalle"), (1024, 1792, 18, "dalle"), (512, 512, 15, "stableDiffusion"), (768, 768, 12, "stableDiffusion"),
]
RATIOS = [(16 / 9, 8, "sora runway kling"), (9 / 16, 8, "sora pika"), (1.0, 10, "midjourney dalle stableDiffusion"), (21 / 9, 12, "sora")]
#: Verdicts from a confidence on; {} is the generator.
IMAGE_VERDICTS = [(80, "HIGHLY_LIKELY_{}"), (65, "LIKELY_{}"), (50, "PROBABLE_AI_IMAGE"), (35, "POSSIBLE_AI_GENERATED"), (20, "LOW_AI_INDICATORS")]
VIDEO_VERDICTS = [(85, "HIGHLY_LIKELY_{}"), (70, "LIKELY_{}"), (55, "PROBABLE_AI_VIDEO"), (40, "POSSIBLE_AI_GENERATED"), (25, "LOW_AI_INDICATORS")]


def _verdict(confidence: Column, generator: Column, steps: list[tuple[int, str]]) -> Column:
    out = F.when(F.lit(False), "")
    for least, text in steps:
        out = out.when(confidence >= least, F.concat(F.lit(text.replace("{}", "")), F.upper(generator)) if "{}" in text else F.lit(text))
    return out.otherwise("UNLIKELY_AI_GENERATED")


def _shares(scores: dict[str, Column]) -> dict[str, Column]:
    """Whole per cents of each generator's score in the sum."""
    total = reduce(lambda a, b: a + b, scores.values())
    return {g: js_round(c / F.when(total == 0, 1).otherwise(total) * 100) for g, c in scores.items()}


def image_evidence(f: dict[str, Column]) -> list[tuple[Column, dict[str, float]]]:
    """SC-16: conditions on an image and the points that each gives to generators.

    ``f``: width, height; {r,g,b}_{min,max,mean} of the channels; noise (mean neighbour difference), edge and strong_edges
    (mean and share over 100 of the edge picture), texture (variance of block variances), exif, space, ai_confidence, and the
    numbers of smooth or texture and of saturation indicators. Null facts give no points. Fixed values: all numbers.
    """
    of = lambda names, n: dict.fromkeys(names.split(), n)
    w, h, noise, edge, texture = (f[c] for c in ("width", "height", "noise", "edge", "texture"))
    sized = (w > 0) & (h > 0)
    out = [(((w == a) & (h == b)) | ((w == b) & (h == a)), of(gens, n)) for a, b, n, gens in RESOLUTIONS]
    out += [(sized & (F.abs(w / h - ratio) < 0.02), of(gens, n)) for ratio, n, gens in RATIOS]
    means, lows, highs = ([f[f"{c}_{x}"] for c in "rgb"] for x in ("mean", "min", "max"))
    top, low = F.greatest(*means), F.least(*means)
    saturation = F.when(top > 0, (top - low) / top).otherwise(F.when(top.isNotNull(), 0.0))
    contrast = sum((b - a for a, b in zip(lows, highs, strict=True)), F.lit(0)) / 3
    out += [
        ((F.least(*lows) > 10) & (F.greatest(*highs) < 250), {"sora": 12, "runway": 8}),
        (saturation > 0.7, {"pika": 10, "midjourney": 8}),
        ((saturation < 0.4) & (saturation > 0.2), {"kling": 8, "firefly": 6}),
        (F.abs(means[0] - means[1]) + F.abs(means[1] - means[2]) < 20, {"dalle": 8}),
        (contrast > 200, {"midjourney": 10}),
        (noise < 5, {"sora": 8, "dalle": 10, "runway": 6}),
        ((noise >= 5) & (noise < 10), {"midjourney": 8, "pika": 6, "kling": 6}),
        ((noise > 3) & (noise < 8), {"sora": 4}),
        ((edge < 15) & (f["strong_edges"] < 0.05), {"dalle": 12, "firefly": 10}),
        ((edge > 10) & (edge < 25), {"midjourney": 8}),
        ((edge > 15) & (edge < 30), {"sora": 6, "runway": 6}),
        (texture < 100, {"dalle": 8, "sora": 6}),
        ((texture > 500) & (texture < 2000), {"midjourney": 10}),
        (~F.coalesce(f["exif"], F.lit(False)), dict.fromkeys(GENERATORS, 3)),
        (f["space"] == "srgb", {"dalle": 3, "midjourney": 3}),
        (f["ai_confidence"] > 70, dict.fromkeys(GENERATORS, 8)),
        ((f["ai_confidence"] > 50) & (f["ai_confidence"] <= 70), dict.fromkeys(GENERATORS, 4)),
    ]
    return out


def attribute_generator(f: dict[str, Column]) -> Column:
    """SC-16 as struct (generator, confidence, is_ai, verdict) from the facts of ``image_evidence``; of equal shares the first
    generator wins, without any points it is unknown."""
    evidence = image_evidence(f)
    known = F.coalesce(f["ai_confidence"] > 0, F.lit(False))  # indicators count only beside a detector's confidence
    extra = {"dalle": 2 * f["smooth_marks"], "midjourney": 2 * f["smooth_marks"] + 2 * f["saturation_marks"], "pika": 2 * f["saturation_marks"]}
    scores = {}
    for g in GENERATORS:
        rules = [(test, n[g]) for test, n in evidence if g in n]
        scores[g] = points(*rules) + F.when(known, F.coalesce(extra[g], F.lit(0)) if g in extra else F.lit(0)).otherwise(0)
    return _bound(F.array(*scores.values()), lambda v: _bound(_largest_share(v), _attributed))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is referred to: its expression stands in the plan once."""
    return F.get(F.transform(F.array(value), use), 0)


def _largest_share(scores: Column) -> Column:
    """The struct (share, o, g) of the generator with the largest share of ``scores``, an array in the order of GENERATORS."""
    own = {g: F.get(scores, i) for i, g in enumerate(GENERATORS)}
    shares = _shares(own)
    return F.array_max(F.array(*[F.struct(c.alias("share"), F.lit(-i).alias("o"), F.lit(g).alias("g")) for i, (g, c) in enumerate(shares.items())]))


def _attributed(best: Column) -> Column:
    generator = F.when(best["share"] > 0, best["g"]).otherwise("unknown")
    return F.struct(generator.alias("generator"), best["share"].alias("confidence"), (best["share"] > 50).alias("is_ai"), _verdict(best["share"], generator, IMAGE_VERDICTS).alias("verdict"))


#: The part of a strong sub-score that speaks for each generator, and the sum of all maxima.
SPREAD = [("sora", 0.4), ("runway", 0.3), ("kling", 0.2), ("pika", 0.1)]
VIDEO_MAXIMUM = 150


def video_format_points(duration: Column, width: Column, height: Column, codec: Column, size: Column) -> Column:
    """SC-17: the score of a video's container; null facts give none. The ladder."""
    tall = (width >= 3840) | (height >= 2160)
    common = ((width == 1920) & (height == 1080)) | ((width == 1280) & (height == 720))
    rate = size * 8 / F.when(duration > 0, duration * 1000)
    return points(((duration > 25) & (duration <= 120), 10), ((duration > 0) & (duration <= 20), 8), (tall, 12), (~tall & common, 8), (codec == "h265", 5), (codec == "h264", 3), (rate > 10000, 6))


def sora_version(duration: Column, width: Column, codec: Column) -> Column:
    """SC-17: which version the container speaks for; unknown without facts. The points."""
    first = points((F.coalesce(duration, F.lit(0)) <= 20, 2))
    second = points((duration > 25, 3), (width >= 3840, 4), ((width >= 1920) & (width < 3840), 1), (codec == "h265", 2))
    return F.when(duration.isNull() & width.isNull() & codec.isNull(), "unknown").when(second > first, "sora2").when(first > second, "sora1").otherwise("unknown")


def video_generator_attribution(parts: list[DataFrame], unspread: list[DataFrame]) -> DataFrame:
    """SC-17: per video the sum of the sub-scores (each video_id, points; one row a video) as a percentage, each generator's
    share, the likely generator and the verdict.

    Only sub-scores of ``parts`` over 10 speak for a generator; those of ``unspread`` count in the sum alone. Sub-scores are
    stacked and summed, which needs one shuffle for all.
    """
    spread = [p.select("video_id", F.col("points").cast("double").alias("points"), F.lit(True).alias("own")) for p in parts]
    rows = reduce(lambda a, b: a.unionByName(b), spread + [p.select("video_id", F.col("points").cast("double").alias("points"), F.lit(False).alias("own")) for p in unspread])
    strong = F.sum(F.when(F.col("own") & (F.col("points") > 10), F.col("points")).otherwise(0.0))
    out = rows.groupBy("video_id").agg(F.sum("points").alias("total"), strong.alias("strong"))
    pct = F.least(F.lit(100), js_round(F.col("total") * 100 / VIDEO_MAXIMUM))
    shares = _shares({g: F.col("strong") * w for g, w in SPREAD})
    generator = F.when(shares["sora"] > 0, "sora").otherwise("unknown")  # its part is the largest of each sub-score
    return out.select("video_id", "total", pct.alias("confidence"), (pct >= 50).alias("is_ai"), generator.alias("generator"), _verdict(pct, generator, VIDEO_VERDICTS).alias("verdict"), *[c.alias(g) for g, c in shares.items()])
