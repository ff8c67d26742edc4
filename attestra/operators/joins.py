"""Lookup, similarity and credential joins over media tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.hashes import bare_hex, hamming_hex, interpret_audio, interpret_distance, positional_equal, similarity_pct

from . import hamming


def exact_lookup(queries: DataFrame, reg: DataFrame) -> DataFrame:
    """Per query fingerprint: found, how often and when it was seen first, and its status (JOIN-1).

    The registry is reduced to one row per fingerprint before the join, so copies cost no more than their first task. The
    matches themselves are rows of ``exact_matches``.
    """
    seen = reg.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("total"),
        F.min("upload_date").alias("first_seen"),
        F.min_by("original_filename", F.struct("upload_date", "id")).alias("first_filename"),
    )
    total = F.coalesce("total", F.lit(0))
    return queries.join(seen, "fingerprint", "left").select(
        *queries.columns,
        (total > 0).alias("found"),
        (total == 0).alias("is_first_verification"),
        F.greatest(total, F.lit(1)).alias("times_verified"),
        "first_seen",
        "first_filename",
        F.when(total > 0, "PREVIOUSLY_VERIFIED").otherwise("NEW_UPLOAD").alias("status"),
    )


def exact_matches(queries: DataFrame, reg: DataFrame) -> DataFrame:
    """The registry rows behind each query, one row each (JOIN-1, matches)."""
    return queries.select("fingerprint").distinct().join(reg.select("fingerprint", "id", "upload_date", "original_filename"), "fingerprint")


def recent_pool(reg: DataFrame, n: int) -> DataFrame:
    """The newest n rows; of equal dates the larger ids (TOP-1)."""
    return reg.orderBy(F.desc("upload_date"), F.desc("id")).limit(n)


def similar_images(queries: DataFrame, reg: DataFrame, threshold: int = 10, pool: int | None = 1000, bits: int = 64) -> DataFrame:
    """Registry images within ``threshold`` bits of each query's hash (JOIN-2). ``queries``: query_id, query_hash; ``reg``: id,
    phash, upload_date. ``pool`` limits to the newest rows, as the service does; None searches all."""
    known = reg.filter("phash is not null")
    known = recent_pool(known, pool) if pool else known
    met = hamming.near_rows(queries, known.select("id", "phash"), "query_hash", "phash", threshold, bits)
    return met.select("query_id", "id", "distance", similarity_pct(F.col("distance"), bits).alias("similarity"), interpret_distance(F.col("distance")).alias("interpretation"))


def top_matches(matches: DataFrame, k: int = 5) -> DataFrame:
    """The k most similar matches of each query; ties by id (TOP-2)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return matches.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def image_links(queries: DataFrame, reg: DataFrame, threshold: int = 10, bits: int = 64) -> DataFrame:
    """Per query: its hash as the class of its copies, and how many registry images and distinct hashes lie within ``threshold`` bits,
    the nearest at which distance (JOIN-2 over all rows, without one row for each pair of copies)."""
    links = hamming.similarity_links(queries, reg, threshold, bits)
    sums = links.groupBy(F.col("query_hash").alias("class")).agg(F.sum("n_images").alias("n_links"), F.count(F.lit(1)).alias("n_hashes"), F.min("distance").alias("nearest"))
    out = queries.select("query_id", bare_hex(F.col("query_hash")).alias("class")).join(sums, "class", "left")
    return out.select("query_id", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_hashes", F.lit(0)).alias("n_hashes"), "nearest")


def nearest_images(queries: DataFrame, reg: DataFrame, k: int = 5, threshold: int = 10, bits: int = 64) -> DataFrame:
    """The k most similar registry images of each query, ties by id, from all rows (TOP-2): of each class of copies its k least ids
    compete, once for each distinct query hash, so copies on either side cost no pairs."""
    pairs = hamming.near_classes(queries, reg, "query_hash", "phash", threshold, bits)
    copies = reg.select(bare_hex(F.col("phash")).alias("b_key"), "id").withColumn("n", F.row_number().over(Window.partitionBy("b_key").orderBy("id")))
    order = Window.partitionBy("a_key").orderBy("distance", "id")
    best = pairs.join(copies.filter(F.col("n") <= k).drop("n"), "b_key").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    out = queries.select("query_id", bare_hex(F.col("query_hash")).alias("a_key")).join(best, "a_key")
    return out.select("query_id", "id", "distance", similarity_pct(F.col("distance"), bits).alias("similarity"), interpret_distance(F.col("distance")).alias("interpretation"), "rank")


def _audio_candidates(queries: DataFrame, known: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a__, b__) of fingerprints, by their 64-bit hashes, whose similarity can reach the threshold, each once.

    A pair whose longer text has n characters may differ at m = n * (100.5 - threshold) / 100 places, so of m + 1 blocks of
    n div (m + 1) characters one is equal (pigeonhole). Each side is cut for every n that its own length allows. Only hashes are
    shipped: the fingerprint's, and one of each block with its width and place; those that meet by chance are told apart by the
    fingerprints themselves.
    """

    def width(n: str) -> str:
        return f"CAST({n} div (({n} * {201 - 2 * threshold}) div 200 + 1) AS INT)"

    def blocks(df: DataFrame, col: str, name: str) -> DataFrame:
        n = f"length({col})"
        widths = f"array_distinct(transform(sequence({n}, CAST(({n} * 200) div {2 * threshold - 1} AS INT)), n -> {width('n')}))"
        cut = df.filter(F.length(col) > 0).select(col).distinct().withColumn("w__", F.explode(F.expr(widths))).filter(f"{n} >= w__")
        keys = F.expr(f"transform(sequence(0, CAST(length({col}) div w__ AS INT) - 1), i -> xxhash64(w__, i, substring({col}, i * w__ + 1, w__)))")
        return cut.select(F.xxhash64(col).alias(name), F.explode(keys).alias("key__"))

    met = blocks(queries, "query_fp", "a__").join(blocks(known, "audio_fingerprint", "b__"), "key__")
    return met.select("a__", "b__").distinct()


def similar_audio(queries: DataFrame, reg: DataFrame, threshold: int = 85, pool: int | None = 100) -> DataFrame:
    """Registry rows whose audio fingerprint agrees position by position (JOIN-3).

    ``queries``: query_id, query_fp; ``reg``: id, audio_fingerprint, upload_date. A length gap counts as mismatches. The pool
    of newest rows bounds the other side, as the service does, so it is sent to the tasks of the queries; None searches all,
    by an equi join of block hashes to which the fingerprints are joined back (``threshold`` at least 1).
    """
    known = reg.filter("audio_fingerprint is not null")
    if pool:
        known = recent_pool(known, pool).select("id", "audio_fingerprint")
        met = queries.join(F.broadcast(known), F.length("query_fp") > 0)  # at most ``pool`` rows
    else:
        known = known.select("id", "audio_fingerprint")
        met = queries.withColumn("a__", F.xxhash64("query_fp")).join(_audio_candidates(queries, known, threshold), "a__")
        met = met.join(known.withColumn("b__", F.xxhash64("audio_fingerprint")), "b__").filter(F.length("query_fp") > 0).drop("a__", "b__")
    longest = F.greatest(F.length("query_fp"), F.length("audio_fingerprint"))
    similarity = F.floor(positional_equal(F.col("query_fp"), F.col("audio_fingerprint")) * 100 / longest + 0.5)
    out = met.withColumn("similarity", similarity).filter(F.col("similarity") >= threshold)
    return out.select("query_id", "id", "similarity", interpret_audio(F.col("similarity")).alias("interpretation"))


def exploded_segments(df: DataFrame, id_col: str, array_col: str) -> DataFrame:
    """Segments ``seg_<i>:<hex>`` of an array column as (video_id, seg_idx, seg_hash)."""
    out = df.select(F.col(id_col).alias("video_id"), F.explode(array_col).alias("s"))
    return out.select("video_id", F.regexp_extract("s", r"^seg_(\d+):", 1).cast("int").alias("seg_idx"), F.regexp_extract("s", ":([a-f0-9]+)$", 1).alias("seg_hash"))


def segment_match(candidate: DataFrame, reference: DataFrame) -> DataFrame:
    """Segments that both sides have, with ``matched`` (JOIN-4)."""
    ref = reference.select("video_id", "seg_idx", F.col("seg_hash").alias("expected"))
    return candidate.join(ref, ["video_id", "seg_idx"]).select("video_id", "seg_idx", (F.col("seg_hash") == F.col("expected")).alias("matched"), "expected", F.col("seg_hash").alias("actual"))


def segment_match_strict(candidate: DataFrame, reference: DataFrame) -> DataFrame:
    """All reference segments; one that the candidate lacks is a mismatch ``seg_i:missing`` (JOIN-5)."""
    ref = reference.select("video_id", "seg_idx", F.col("seg_hash").alias("expected"))
    out = ref.join(candidate, ["video_id", "seg_idx"], "left")
    missing = F.concat(F.lit("seg_"), F.col("seg_idx"), F.lit(":missing"))
    return out.select("video_id", "seg_idx", F.coalesce(F.col("seg_hash") == F.col("expected"), F.lit(False)).alias("matched"), "expected", F.coalesce("seg_hash", missing).alias("actual"))


def compare_credentials(pairs: DataFrame, threshold: int = 10, weak: int = 15) -> DataFrame:
    """Verdict of given pairs of asset and credential: exact by v2 or v1, else by perceptual distance (JOIN-6, pair by pair).

    Expects canonicalization, v2, v1, phash and cred_v2, cred_v1, cred_phash.
    """
    d = hamming_hex(F.col("phash"), F.col("cred_phash"))
    is_v2 = F.coalesce(F.col("canonicalization").startswith("img:v2") & (F.col("v2") == F.col("cred_v2")), F.lit(False))
    is_v1 = F.coalesce(F.col("v1") == F.col("cred_v1"), F.lit(False))
    verdict = F.when(is_v2 | is_v1, "PROVEN_EXACT").when(d <= threshold, "PROVEN_DERIVED").when(d <= weak, "INCONCLUSIVE").otherwise("NOT_PROVEN")
    return pairs.withColumn("distance", F.when(~(is_v2 | is_v1), d)).withColumn("verdict", verdict).withColumn("matched_by", F.when(is_v2, "v2").when(is_v1, "v1").when(d.isNotNull(), "phash"))


def picked_hashes(credentials: DataFrame) -> DataFrame:
    """The hashes of a credential that count: its canonical hash where that is of v2, its alternative hash of v1, its perceptual hash.

    ``credentials``: credential_id, canonicalization, sha256_canonical, alt_hashes (map), perceptual_hash.
    """
    v2 = F.when(F.col("canonicalization").startswith("img:v2"), F.nullif(F.col("sha256_canonical"), F.lit("")))
    return credentials.select("credential_id", v2.alias("v2"), F.nullif(F.try_element_at("alt_hashes", F.lit("img:v1")), F.lit("")).alias("v1"), F.nullif(F.col("perceptual_hash"), F.lit("")).alias("phash"))


def credential_cascade(candidates: DataFrame, credentials: DataFrame, threshold: int = 10, bits: int = 64) -> DataFrame:
    """The best credential of each candidate among all of them, and the verdict it gives (JOIN-6).

    ``candidates``: candidate_id, v2, v1, phash; ``credentials`` as in ``picked_hashes``. Three joins, each over the candidates that
    the ones before left open: equal v2 and equal v1 hashes (PROVEN_EXACT), then the nearest perceptual hash (PROVEN_DERIVED within
    ``threshold`` bits, INCONCLUSIVE within half as many more); who is left is NOT_PROVEN. Of equally good credentials the least id
    counts. Each hash is one row of the credentials' side, so a hash that many credentials share costs no pairs. Null hashes match
    nothing; repeated candidates are judged alike.
    """
    known = picked_hashes(credentials)
    left = candidates.select("candidate_id", "v2", "v1", "phash")
    found = []
    for name in ("v2", "v1"):
        first = known.filter(F.col(name).isNotNull()).groupBy(name).agg(F.min("credential_id").alias("credential_id"))
        found.append(left.join(first, name).select("candidate_id", F.lit("PROVEN_EXACT").alias("verdict"), F.lit(name).alias("matched_by"), "credential_id", F.lit(None).cast("int").alias("distance")))
        left = left.join(first.select(name), name, "left_anti")
    first = known.select(bare_hex(F.col("phash")).alias("b_key"), "credential_id").filter("b_key is not null").groupBy("b_key").agg(F.min("credential_id").alias("credential_id"))
    pairs = hamming.near_classes(left, first, "phash", "b_key", threshold * 3 // 2, bits)
    best = pairs.join(first, "b_key").groupBy("a_key").agg(F.min(F.struct("distance", "credential_id")).alias("best"))
    near = left.withColumn("a_key", bare_hex(F.col("phash"))).join(best, "a_key", "left")
    d = F.col("best.distance")
    verdict = F.when(d <= threshold, "PROVEN_DERIVED").when(d.isNotNull(), "INCONCLUSIVE").otherwise("NOT_PROVEN")
    found.append(near.select("candidate_id", verdict.alias("verdict"), F.when(d.isNotNull(), "phash").alias("matched_by"), F.col("best.credential_id").alias("credential_id"), d.cast("int").alias("distance")))
    return found[0].unionByName(found[1]).unionByName(found[2])


def legacy_v1_hash(alt: Column, v1: Column, canonical: Column, version: Column) -> Column:
    """Where a credential keeps its v1 hash: alternatives map, own field, or the only hash where no version is named (JOIN-7)."""
    return F.coalesce(F.try_element_at(alt, F.lit("img:v1")), v1, F.when(version.isNull(), canonical))


def pairwise_compare(pairs: DataFrame) -> DataFrame:
    """Exact and perceptual comparison of asset pairs (sha_a, sha_b, phash_a, phash_b) (JOIN-8)."""
    d = hamming_hex(F.col("phash_a"), F.col("phash_b"))
    return pairs.withColumn("exact", F.col("sha_a") == F.col("sha_b")).withColumn("distance", d).withColumn("similarity", similarity_pct(d))


def landmark_distance(landmarks: DataFrame, photos: DataFrame) -> DataFrame:
    """Distance of each detected landmark (photo_id, name, lat, lon) to the photo's place (photo_id, plat, plon) (JOIN-9)."""
    from attestra.functions.geo import haversine_km, landmark_class

    out = photos.join(landmarks, "photo_id", "left")
    km = haversine_km(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon"))
    return out.select("photo_id", "name", km.alias("km"), landmark_class(km).alias("match"), F.coalesce(km > 50, F.lit(False)).alias("far"))


def camera_catalogue(exif: DataFrame, catalogue: DataFrame) -> DataFrame:
    """First catalogue entry (ord, maker, model, release_year) that fits make and model; too early a year is invalid (JOIN-10).

    A make meets the makers that it contains by an equi join on its parts, once per make; photos join by make, entries by maker.
    """
    part = F.expr("explode(flatten(transform(sequence(1, length(make)), i -> transform(sequence(1, length(make) - i + 1), n -> lower(substring(make, i, n))))))")
    makers = catalogue.select("maker", F.lower("maker").alias("part")).distinct()
    makes = exif.select("make").distinct().filter("length(make) > 0").select("make", part.alias("part")).distinct()
    named = exif.join(makes.join(makers, "part").select("make", "maker"), "make", "left")
    met = named.join(catalogue, "maker", "left").withColumn("fits", F.lower("exif_model").contains(F.lower("model")) | F.lower("model").contains(F.lower("exif_model")))
    hit = F.when(F.col("fits"), F.struct("ord", "maker", "model", "release_year"))
    best = met.groupBy("photo_id", "year").agg(F.min(hit).alias("m"), F.max("maker").alias("known_maker"))
    return best.select("photo_id", F.col("known_maker").isNotNull().alias("maker_known"), F.col("m.model").alias("camera"), F.when(F.col("m").isNotNull(), F.col("year") >= F.col("m.release_year")).alias("year_valid"))


def weather_check(photos: DataFrame, weather: DataFrame) -> DataFrame:
    """Daily weather (place, day, condition, is_rainy, is_sunny) at a photo's place against what its labels show (JOIN-11). Words and texts."""
    out = photos.join(weather, ["place", "day"], "left")
    sunny = F.exists("labels", lambda x: F.lower(x).rlike("sun|clear|sky"))
    rainy = F.exists("labels", lambda x: F.lower(x).rlike("rain|storm|cloud"))
    warn = F.when(sunny & F.col("is_rainy"), "Image appears sunny but weather was rainy - possible manipulation")
    warn = warn.when(rainy & F.col("is_sunny"), "Image appears rainy but weather was sunny - possible manipulation")
    return out.select("photo_id", "place", "day", "condition", warn.alias("warning"), F.when(F.col("condition").isNotNull(), warn.isNull()).alias("verified"))


def reputation_lookup(files: DataFrame, threats: DataFrame) -> DataFrame:
    """Landed reputation (sha256, malicious, reputation, first_seen epoch) of files (JOIN-12)."""
    t = threats.groupBy("sha256").agg(F.max("malicious").alias("malicious"), F.min("reputation").alias("reputation"), F.min("first_seen").alias("first_seen"))
    return files.join(t, "sha256", "left").select(*files.columns, F.col("malicious").isNotNull().alias("found"), "malicious", "reputation", "first_seen")


def best_by_score(matches: DataFrame, keys: list[str]) -> DataFrame:
    """The highest-scored match (ord, score, recording_id) of each key; of equal scores the first (TOP-5)."""
    return matches.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("ord")).alias("o"), "recording_id")).alias("m")).select(*keys, F.col("m.score").alias("score"), F.col("m.recording_id").alias("recording_id"))


def identify_recording(matches: DataFrame, recordings: DataFrame) -> DataFrame:
    """Best match of each fingerprint with the recording's metadata (JOIN-13)."""
    return best_by_score(matches, ["fp_id"]).join(recordings, "recording_id", "left")


def hybrid_search(queries: DataFrame, reg: DataFrame, external: DataFrame) -> DataFrame:
    """Internal lookup, and external results where the tier (and ``always``) asks for them (JOIN-14)."""
    found = exact_lookup(queries, reg)
    ask = F.when(F.col("tier") == "free", ~F.col("found") & F.col("always")).when(F.col("tier") == "pro", F.col("always") | ~F.col("found")).otherwise(F.lit(True))
    ext = external.groupBy("fingerprint").agg(F.sum("matches").alias("external_matches"))
    out = found.withColumn("asked", ask).join(ext, "fingerprint", "left")
    shown = F.when(F.col("asked"), F.coalesce("external_matches", F.lit(0)))
    # fixed values: the recommendations
    advice = F.when(F.col("found"), "File previously verified in our database").otherwise("File appears to be original - first verification")
    return out.select("query_id", "fingerprint", "found", "asked", shown.alias("external_matches"), advice.alias("advice"))


def inhibit_alerts(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """Alerts (name, label) without those whose source alert fires with an equal label; rules: source, target (JOIN-15)."""
    firing = alerts.select(F.col("name").alias("source"), "label").distinct().join(rules, "source").select(F.col("target").alias("name"), "label").distinct()
    return alerts.join(firing, ["name", "label"], "left_anti")


def likely_generator(scores: list[tuple[str, Column]]) -> Column:
    """Name with the largest score, of equal ones the first; unknown where all are 0 or null (TOP-3)."""
    each = F.array(*[F.struct(F.coalesce(c.cast("double"), F.lit(0.0)).alias("s"), F.lit(-i).alias("o"), F.lit(n).alias("n")) for i, (n, c) in enumerate(scores)])
    best = F.array_max(each)
    return F.when(best["s"] > 0, best["n"]).otherwise("unknown")
