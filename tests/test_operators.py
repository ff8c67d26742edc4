"""Invariants, boundaries and edge inputs of the operators, and the streams against their batch forms."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from attestra.functions import dct
from attestra.functions import hashes as H
from attestra.operators import aggregates as A
from attestra.operators import hamming
from attestra.operators import joins as J
from attestra.operators import scoring as S
from attestra.operators import windows as W
from attestra.sources import registry as R
from attestra.streaming import streams


def test_hamming_of_both_widths_and_bad_hashes(spark):
    rng = random.Random(1)
    rows = [(f"{rng.getrandbits(256):064x}", f"{rng.getrandbits(256):064x}") for _ in range(50)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", H.hamming_hex(F.col("a"), F.col("b"), 256).alias("d"), H.hamming_hex(F.substring("a", 1, 16), F.substring("b", 1, 16)).alias("e")).collect()
    for r in got:
        assert r.d == bin(int(r.a, 16) ^ int(r.b, 16)).count("1") and r.e == bin(int(r.a[:16], 16) ^ int(r.b[:16], 16)).count("1")
    bad = spark.createDataFrame([("xyz", "00" * 8), (None, "00" * 8), ("00" * 4, "00" * 8)], "a string, b string")
    assert [r.d for r in bad.select(H.hamming_hex(F.col("a"), F.col("b")).alias("d")).collect()] == [None] * 3


@pytest.mark.parametrize("bits", [64, 256])
def test_banded_join_equals_brute_force(spark, bits):
    rng = random.Random(bits)
    base = [rng.getrandbits(bits) for _ in range(40)]
    flipped = []
    for x in base:
        for k in (0, 3, 9, 10, 11):
            y = x
            for b in rng.sample(range(bits), k):
                y ^= 1 << b
            flipped.append(y)
    width = bits // 4
    a = spark.createDataFrame([(i, f"{x:0{width}x}") for i, x in enumerate(base)], "query_id long, query_hash string")
    b = spark.createDataFrame([(i, f"{x:0{width}x}") for i, x in enumerate(flipped)], "id long, phash string")
    got = sorted((r.query_id, r.id, r.distance) for r in hamming.near_rows(a, b, "query_hash", "phash", 10, bits).collect())
    expected = sorted((i, j, d) for i, x in enumerate(base) for j, y in enumerate(flipped) if (d := bin(x ^ y).count("1")) <= 10)
    assert got == expected


@pytest.mark.parametrize("threshold", [70, 85, 100])
def test_audio_search_of_all_rows_equals_brute_force(spark, threshold):
    rng = random.Random(threshold)
    base = ["".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (1, 2, 3, 5, 7, 12, 40, 95, 99, 100, 100, 131)]
    near = []
    for x in base:
        for k in (0, 0.05, 0.1, 0.14, 0.15, 0.16, 0.2, 0.29, 0.31):
            y = list(x)
            for at in rng.sample(range(len(x)), round(k * len(x))):
                y[at] = "z"
            near += ["".join(y), "".join(y)[: max(1, round(len(x) * 0.96))], "".join(y) + "q" * round(len(x) * 0.05)]
    a = spark.createDataFrame([*enumerate(base), (-1, ""), (-2, None)], "query_id long, query_fp string")
    b = spark.createDataFrame([(i, x, i) for i, x in enumerate(near)] + [(-1, "", -1), (-2, None, -2)], "id long, audio_fingerprint string, upload_date long")
    got = sorted((r.query_id, r.id, r.similarity) for r in J.similar_audio(a, b, threshold, pool=None).collect())
    score = lambda x, y: int(sum(p == q for p, q in zip(x, y)) * 100 / max(len(x), len(y)) + 0.5)  # noqa: B905, E731
    expected = sorted((i, j, s) for i, x in enumerate(base) for j, y in enumerate(near) if (s := score(x, y)) >= threshold)
    assert got == expected and len(got) > 20


def test_registered_searches_over_all_rows_find_old_copies(spark):
    """sf0.1 has more rows than the pools; each query's own row is a copy of it within 12 bits or 80 %."""
    from attestra.plans import registry

    sf = "/root/testdata/sf0.1"
    images, audio = (registry.QUERIES[n](spark, sf).filter("query_id = id").count() for n in ("join2_similar_images_all", "join3_similar_audio_all"))
    n_images, n_audio = (spark.read.parquet(f"{sf}/{t}.parquet").filter(c).count() for t, c in (("embeddings", "vec_id % 13 <= 10"), ("documents", "doc_id % 21 <= 14")))
    assert images == n_images > 1000 and audio >= n_audio > 100


def test_ranges_partition_the_matched_segments(spark):
    rng = random.Random(3)
    rows = [(v, i, rng.random() < 0.7, "e", "a") for v in range(20) for i in range(rng.randrange(1, 40))]
    match = spark.createDataFrame(rows, "video_id long, seg_idx int, matched boolean, expected string, actual string")
    covered = {(r.video_id, i) for r in W.matched_ranges(match).collect() for i in range(r.range_start, r.range_end + 1)}
    assert covered == {(v, i) for v, i, m, _, _ in rows if m}
    cov = {r.video_id: r for r in W.segment_coverage(match).collect()}
    for v in range(20):
        own = [m for x, _, m, _, _ in rows if x == v]
        longest = max((len(s) for s in "".join("." if m else "x" for m in own).split(".")), default=0)
        assert (cov[v].n_matched, cov[v].n_compared, cov[v].longest_run) == (sum(own), len(own), longest)


@pytest.mark.parametrize(("coverage", "run", "verdict"), [(1.0, True, "PROVEN_STRONG"), (0.98, False, "PROVEN_STRONG"), (0.98, True, "PROVEN_DERIVED"), (0.9799, False, "PROVEN_DERIVED"), (0.8, True, "PROVEN_DERIVED"), (0.7999, False, "INCONCLUSIVE"), (0.3, False, "INCONCLUSIVE"), (0.2999, False, "NOT_PROVEN"), (0.0, True, "NOT_PROVEN")])
def test_coverage_ladder(spark, coverage, run, verdict):
    assert spark.range(1).select(W.coverage_verdict(F.lit(coverage), F.lit(run)).alias("v")).first().v == verdict


def test_quantile_rule_is_by_index(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(23)], "k long, v double")
    r = A.indexed_quantiles(df, "v", [0.5, 0.95, 0.99], []).first()
    ordered = sorted(i % 7 for i in range(23))
    assert (r.p50, r.p95, r.p99) == tuple(ordered[int(23 * q)] for q in (0.5, 0.95, 0.99))


def test_ensemble_of_all_null_patterns(spark):
    weights = {"jar": (40 * 0.4 + 60 * 0.3 + 80 * 0.3, True), "ja": (40 * 0.57 + 60 * 0.43, False), "jr": (40 * 0.57 + 80 * 0.43, True), "ar": (60 * 0.4 + 80 * 0.6, True), "j": (40, True), "a": (60, False), "r": (0, False), "": (0, False)}
    rows = [(j, a, r) for j in (None, 0.0, 0.4) for a in (None, 60) for r in (None, 80)]
    df = spark.createDataFrame(rows, "j double, a int, r int")
    for row in df.select("j", "a", "r", S.ensemble_verdict(F.col("j"), F.lit(True), F.col("a"), F.lit(False), F.col("r")).alias("s")).collect():
        who = ("j" if row.j else "") + ("a" if row.a else "") + ("r" if row.r else "")
        score, likely = weights[who]
        assert (row.s.ai_confidence, row.s.likely_ai_generated) == (int(score + 0.5), likely), who
        assert (row.s.agreement, row.s.max_deviation, row.s.average_confidence) == (("medium", 20, 60) if who == "jar" else (None,) * 3)
        assert row.s.detectors == (0 if who == "r" else len(who))


def test_later_checks_still_move_a_score_that_software_set(spark):
    kinds = {"size": "boolean", "exif": "boolean", "sd": "double", "software": "boolean", "fmt": "string", "ratio": "double", "noise": "double", "edge": "double", "share": "double", "extreme": "double", "saturated": "double"}
    score = lambda **k: spark.range(1).select(S.local_image_score(*[F.lit(k.get(x)).cast(t) for x, t in kinds.items()]).alias("s")).first().s
    assert tuple(score(software=True, exif=True, noise=300, edge=30, share=0.06)) == (82, True, 3)  # 100 - 10 - 8
    assert tuple(score(size=True, exif=False, sd=20, noise=300, edge=15, share=0.03, extreme=0.4, saturated=0.5)) == (65, True, 7)  # 25 + 8 + 12 - 10 + 10 + 10 = 55, lifted
    assert tuple(score(size=True, exif=False, sd=20, edge=15, share=0.03)) == (55, False, 4)
    assert tuple(score(exif=True, sd=50, noise=300, edge=30, share=0.06)) == (0, False, 2)


def test_empty_and_null_inputs(spark):
    reg = spark.createDataFrame([], "id long, fingerprint string, upload_date long, original_filename string, media_kind string")
    assert A.registry_stats(reg).first().total == 0
    assert J.exact_lookup(spark.createDataFrame([(1, None), (2, "x")], "query_id long, fingerprint string"), reg).filter("found").count() == 0
    frames = spark.createDataFrame([(1, 1, None)], "video_id long, frame_no int, phash string")
    assert W.temporal_morphing(frames).first().morphs == 0 and W.segment_hashes(frames).count() == 0
    nulls = spark.range(1).select(S.forensic(*[F.lit(None).cast("boolean")] * 3, F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.lit(None).cast("int"), F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), *[F.lit(None).cast("int")] * 3).alias("s"))
    assert nulls.first().s == 10


def test_files_are_hashed_where_they_lie(spark, tmp_path):
    import hashlib

    (tmp_path / "a.bin").write_bytes(b"\0\1\2" * 1000)
    row = R.ingest_media(spark, str(tmp_path)).first()
    assert (row.size, row.sha256) == (3000, hashlib.sha256(b"\0\1\2" * 1000).hexdigest())


LOG = "request_id long, ts timestamp, api_key string, ip string, status int"


def log_rows():
    from datetime import datetime, timedelta, timezone

    rng = random.Random(9)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    return [(i, start + timedelta(seconds=37 * i), f"k{rng.randrange(3)}", f"ip{rng.randrange(4)}", rng.choice([200, 200, 500])) for i in range(400)]


def plain_quota(rows, most, seconds):
    state, out = {}, set()
    for i, ts, key, _, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        now = int(ts.timestamp())
        start, used = state.get(key, (None, 0))
        if start is None or now - start > seconds:
            start, used = now, 0
        used += 1
        state[key] = (start, used)
        out.add((i, used, used > most, start + seconds - now if used > most else None))
    return out


def streamed(spark, tmp_path, f, name, mode="append"):
    """Result of a streaming query over the log in three files."""
    rows = log_rows()
    for k in range(3):
        spark.createDataFrame(rows[k * 134 : (k + 1) * 134], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = f(source).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    return spark.table(name)


def test_quota_stream_and_batch_equal_a_plain_loop(spark, tmp_path):
    expected = plain_quota(log_rows(), 10, 1800)
    read = lambda df: {(r.request_id, r.used, r.rejected, r.retry_after) for r in df.collect()}
    assert read(streams.key_quota(spark.createDataFrame(log_rows(), LOG), 10, 1800)) == expected


@pytest.mark.parametrize(("most", "seconds", "gap"), [(3, 60, 40), (1, 60, 61), (5, 600, 7000), (2, 7, 30)])
def test_quota_over_many_slices_equals_a_plain_loop(spark, most, seconds, gap):
    rng, rows, at = random.Random(seconds + gap), [], {"a": 1_700_000_000, "b": 1_700_000_017, "c": 1_700_003_600}
    for i in range(1500):
        key = rng.choice("aaab") if i < 1490 else "c"
        at[key] += rng.choice([0, 0, 1, rng.randrange(gap), seconds, seconds + 1, gap * 50 if i % 97 == 0 else 2])
        rows.append((i, datetime.datetime.fromtimestamp(at[key], datetime.UTC), key, None, None))
    log = spark.createDataFrame([r[:3] for r in rows] + [(-1, None, "a"), (-2, rows[0][1], None)], "request_id long, ts timestamp, api_key string")
    got = {(r.request_id, r.used, r.rejected, r.retry_after) for r in streams.key_quota(log, most, seconds).collect()}
    assert got == plain_quota(rows, most, seconds)


def test_quota_stream_continues_over_batches(spark, tmp_path):
    live = streamed(spark, tmp_path, lambda log: streams.key_quota(log, 10, 1800), "quota")
    assert {(r.request_id, r.used, r.rejected, r.retry_after) for r in live.collect()} == plain_quota(log_rows(), 10, 1800)


def test_dct_coefficients_equal_the_double_sum(spark):
    import math

    rng = random.Random(2)
    pixels = [rng.randrange(256) for _ in range(1024)]
    got = spark.createDataFrame([(pixels,), ([1, 2],), (None,)], "p array<int>")
    got = dct.with_dct_hash(got.select("p", dct.dct_coefficients(F.col("p")).alias("c")), F.col("p"), "h").collect()
    c = [
        sum(pixels[y * 32 + x] * math.cos((2 * y + 1) * u * math.pi / 64) * math.cos((2 * x + 1) * v * math.pi / 64) for y in range(32) for x in range(32)) * (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4
        for u in range(8)
        for v in range(8)
    ]
    assert got[0].c == pytest.approx(c, abs=1e-5) and got[1].c is None and got[2].h is None
    middle = sorted(c[1:])[31]
    assert got[0].h == f"{int(''.join('1' if x > middle else '0' for x in c), 2):016x}"


def test_window_streams_equal_batch(spark, tmp_path):
    batch = spark.createDataFrame(log_rows(), LOG)
    live = streamed(spark, tmp_path, streams.request_rate, "rates", "complete")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, streams.request_rate(batch).collect()))


@pytest.mark.parametrize(("bits", "threshold"), [(64, 0), (64, 3), (64, 15), (64, 22), (256, 10), (256, 2), (16, 2)])
def test_every_layout_of_bands_finds_all_pairs(spark, bits, threshold):
    """Radii come out differently by size and skew; whichever are taken, the pairs are those of brute force, each once."""
    rng = random.Random(bits + threshold)
    base = [rng.getrandbits(bits) for _ in range(20)] + [0, (1 << bits) - 1, 1 << (bits - 1)]
    near = []
    for x in base:
        for k in {0, 1, threshold // 2, threshold, threshold + 1}:
            y = x
            for b in rng.sample(range(bits), k):
                y ^= 1 << b
            near.append(y)
    text = lambda x: f"{x:0{bits // 4}x}"
    a = spark.createDataFrame([(text(x),) for x in [*base, *base]] + [(None,), ("zz",)], "h string")
    b = spark.createDataFrame([("phash:" + text(x).upper(),) for x in near] + [("ab",)], "g string")
    expected = sorted({(text(x), text(y), bin(x ^ y).count("1")) for x in base for y in near if bin(x ^ y).count("1") <= threshold})
    for m in range(1, 9):
        bands = hamming.even_bands(bits, m)
        if len(bands) > threshold + 1:
            continue
        for meeting in ([1.0] * len(bands), [1e9] + [1.0] * (len(bands) - 1)):
            found, cost = hamming.radii(bands, threshold, 1.0, meeting)
            if cost < 1e30 and sum(hamming.probes(x.width, r) for x, r in zip(bands, found) if r >= 0) < 3000:
                used = [(x, r) for x, r in zip(bands, found) if r >= 0]
                got = sorted(map(tuple, hamming.near_classes(a, b, "h", "g", threshold, bits, used).collect()))
                assert got == expected, (m, found)
    assert sorted(map(tuple, hamming.near_classes(b, a, "g", "h", threshold, bits).select("b_key", "a_key", "distance").collect())) == expected


def test_wider_bands_pay_as_rows_grow_and_common_values_lose_their_radius(spark):
    cost = []
    for n in (1e3, 1e5, 1e7, 1e9):  # as ROW_COST weighs rows against pairs
        options = [(hamming.radii(o, 10, hamming.ROW_COST * n, [n * n * 2.0**-b.width for b in o])[1] + hamming.ROW_COST * n * len(o), o[0].width) for o in hamming.layouts(64, 10)]
        cost.append(min(options))
    widths = [w for _, w in cost]
    assert widths == sorted(widths) and widths[-1] > widths[0]
    bands = hamming.even_bands(64, 4)
    plain, hot = (hamming.radii(bands, 10, 50.0, m)[0] for m in ([1.0] * 4, [1e6, 1.0, 1.0, 1.0]))
    assert sum(plain) == sum(hot) == 7 and hot[0] == -1 < min(plain)


def test_candidates_grow_slower_than_pairs(spark):
    """Rows probed and pairs met grow by a power below 2 of the rows: measured on the given tables, and as planned for larger ones."""
    from math import log

    from attestra.plans import fixtures

    found = []
    for sf in ("sf0.001", "sf0.1"):
        h = fixtures.hashes(spark, f"/root/testdata/{sf}")
        probed, met = hamming.meeting_rows(h, h, "query_hash", "phash", 10)
        found.append((h.count(), probed + met))
    (n, a), (m, b) = found
    assert m > 2 * n and log(b / a) / log(m / n) < 1.85

    def planned(n):
        plans = []
        for bands in hamming.layouts(64, 10):
            r, cost = hamming.radii(bands, 10, hamming.ROW_COST * n, [n * n * 2.0**-x.width for x in bands])
            plans.append((cost + hamming.ROW_COST * n * sum(x >= 0 for x in r), n * sum(hamming.probes(x.width, k) * (1 + n * 2.0**-x.width) for x, k in zip(bands, r) if k >= 0)))
        return min(plans)[1]

    assert log(planned(1e7) / planned(500)) / log(1e7 / 500) < 1.6


def test_credential_cascade_over_all_pairs(spark):
    rng = random.Random(12)
    hashes = [f"{rng.getrandbits(64):016x}" for _ in range(25)]
    flip = lambda x, k: f"{int(x, 16) ^ sum(1 << b for b in rng.sample(range(64), k)):016x}"
    creds = [(i, rng.choice(["img:v2", "img:v2|x", "img:v1", None, ""]), rng.choice(["a", "b", "c", "", None]), rng.choice([{}, {"img:v1": "p"}, {"img:v1": "q", "z": "r"}, {"img:v1": ""}, None]), rng.choice([h, None, "", "bad"])) for i, h in enumerate(hashes)]
    cands = [(i, rng.choice(["a", "d", "", None]), rng.choice(["p", "s", None]), rng.choice([flip(h, rng.choice([0, 4, 10, 11, 15, 16])), None])) for i, h in enumerate(hashes * 3)]

    def plain(c):
        out = []
        for k in creds:
            if k[2] and (k[1] or "").startswith("img:v2") and c[1] == k[2]:
                out.append((0, 0, k[0], "PROVEN_EXACT", "v2"))
            elif k[3] and k[3].get("img:v1") and c[2] == k[3]["img:v1"]:
                out.append((1, 0, k[0], "PROVEN_EXACT", "v1"))
            elif k[4] and k[4] != "bad" and c[3] and (d := bin(int(c[3], 16) ^ int(k[4], 16)).count("1")) <= 15:
                out.append((2, d, k[0], "PROVEN_DERIVED" if d <= 10 else "INCONCLUSIVE", "phash"))
        stage, d, key, verdict, by = min(out, default=(3, 0, None, "NOT_PROVEN", None))
        return c[0], verdict, by, key, d if stage == 2 else None

    a = spark.createDataFrame([*cands, *cands[:3]], "candidate_id long, v2 string, v1 string, phash string")
    b = spark.createDataFrame(creds, "credential_id long, canonicalization string, sha256_canonical string, alt_hashes map<string,string>, perceptual_hash string")
    got = J.credential_cascade(a, b).collect()
    key = lambda r: [str(x) for x in r]
    assert sorted(map(tuple, got), key=key) == sorted(map(plain, [*cands, *cands[:3]]), key=key)
    assert {r.verdict for r in got} == {"PROVEN_EXACT", "PROVEN_DERIVED", "INCONCLUSIVE", "NOT_PROVEN"}
    assert {r.verdict for r in J.credential_cascade(a, b.limit(0)).collect()} == {"NOT_PROVEN"} and J.credential_cascade(a.limit(0), b).collect() == []


def plain_facts(data, width):
    """Facts of one plane of bytes, pixel by pixel."""
    n, var = len(data), lambda xs: sum((x - sum(xs) / len(xs)) ** 2 for x in xs) / len(xs)
    size = min(10000, n - 100)
    noise = None if size == 0 else 0.0 if size < 0 else sum(var(data[i : i + 100]) for i in range(0, size, 100)) / (size / 100)
    step = sum(abs(b - a) for a, b in zip(data, data[1:])) / n
    height = n // width
    at = lambda y, x: data[max(0, min(height - 1, y)) * width + max(0, min(width - 1, x))]
    edges = [max(0, min(255, 9 * at(y, x) - sum(at(y + j, x + i) for j in (-1, 0, 1) for i in (-1, 0, 1)))) for y in range(height) for x in range(width)]
    blocks = [[data[(y + j) * 256 + x + i] for j in range(16) for i in range(16) if (y + j) * 256 + x + i < n] for y in range(0, 256, 16) for x in range(0, 256, 16)]
    sample = min(5000, n / 3)
    colours = [(data[i + 1] - 128, data[i + 2] - 128) for i in range(0, n - 2, 3) if i / 3 < sample]
    out = [noise, step, sum(edges) / len(edges) if edges else None, sum(e > 100 for e in edges) / len(edges) if edges else None, var([var(b) for b in blocks if b])]
    return [*out, sum(abs(a) > 100 or abs(b) > 100 for a, b in colours) / sample, sum((a * a + b * b) ** 0.5 > 100 for a, b in colours) / sample]


def test_image_facts_equal_a_loop_over_pixels(spark):
    from attestra.operators import pixels

    rng = random.Random(6)
    images = [(i, w, bytes(rng.choice([rng.randrange(256), 120]) for _ in range(n))) for i, (w, n) in enumerate([(7, 50), (10, 100), (10, 101), (16, 256), (33, 700), (9, 12345), (40, 20001), (300, 70000), (5, 3)])]
    df = spark.createDataFrame([*images, (90, 4, b""), (91, None, None), (92, None, b"\x01\x02\x03")], "image_id long, width int, b binary")
    got = {r.image_id: r for r in pixels.image_facts(df.select("image_id", "width", *[F.col("b").alias(x) for x in ("gray", "texture", "rgb", "lab")])).collect()}
    fields = ["window_noise", "neighbour_noise", "edge_mean", "edge_share", "texture_spread", "extreme_share", "saturated_share"]
    for i, w, data in images:
        assert [got[i][f] for f in fields] == [x if x is None else pytest.approx(x, rel=1e-9, abs=1e-9) for x in plain_facts(list(data), w)], i
        first = data[0 : len(data) // 3 * 3 : 3]
        assert (got[i].channels[0].low, got[i].channels[0].high, got[i].channels[0].mean) == (min(first), max(first), pytest.approx(sum(first) / len(first)))
    assert all(got[k][f] is None for k in (90, 91) for f in [*fields, "channels"]) and got[92].edge_mean is None


def test_signatures_meet_either_way_up_and_within_the_tolerance(spark):
    from attestra.operators import pixels

    rng = random.Random(8)
    images = [(i, rng.choice([100, 150, 200, 300, 0, None]), rng.choice([100, 149, 151, 200, 300])) for i in range(60)]
    sizes = [(100, 200, "a", 3), (200, 100, "a", 4), (300, 300, "b", 5), (150, 149, "c", 6)]
    ratios = [(1.0, "a", 1), (0.5, "b", 2), (1.0201, "d", 7), (2.0, "b", 8)]
    expected = {}
    for i, w, h in images:
        for sw, sh, g, p in sizes:
            if w and ((w, h) == (sw, sh) or (h, w) == (sw, sh)):
                expected[i, g] = expected.get((i, g), 0) + p
        for r, g, p in ratios:
            if w and abs(w / h - r) < 0.02:
                expected[i, g] = expected.get((i, g), 0) + p
    got = pixels.signature_points(spark.createDataFrame(images, "image_id long, width long, height long"), spark.createDataFrame(sizes, "width long, height long, generator string, points long"), spark.createDataFrame(ratios, "ratio double, generator string, points long"))
    assert {(r.image_id, r.generator): r.points for r in got.collect()} == expected and len(expected) > 20


def test_all_row_links_of_copies_are_counted_not_paired(spark):
    rows = [(i, "00000000000000ff" if i < 50 else f"{i:016x}") for i in range(80)]
    df = spark.createDataFrame([*rows, (99, None)], "id long, phash string")
    queries = df.select(F.col("id").alias("query_id"), F.col("phash").alias("query_hash"))
    links = {r.query_id: r for r in J.image_links(queries, df, 4).collect()}
    dist = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    for i, h in rows:
        near = [dist(h, g) for _, g in rows if dist(h, g) <= 4]
        assert (links[i].n_links, links[i].n_hashes, links[i].nearest) == (len(near), len({g for _, g in rows if dist(h, g) <= 4}), min(near))
    assert (links[99].n_links, links[99].nearest) == (0, None)
    best = {}
    for r in J.nearest_images(queries, df, 5, 4).collect():
        best.setdefault(r.query_id, []).append((r["rank"], r.distance, r.id))
    for i, h in rows:
        expected = sorted((dist(h, g), j) for j, g in rows if dist(h, g) <= 4)[:5]
        assert [(d, j) for _, d, j in sorted(best[i])] == expected


def test_generator_scores_stand_in_the_plan_once(spark):
    from attestra.plans import registry

    plan = registry.QUERIES["sc16_generator_attribution"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert len(plan) < 200_000


def test_probed_values_are_whole_and_not_in_the_plan(spark):
    from itertools import combinations

    from attestra.operators import hamming

    got = spark.range(1).select(hamming._masks(F.col("id"), 9, 3).alias("m")).first()["m"]
    assert sorted(got) == sorted(sum(1 << i for i in at) for r in range(4) for at in combinations(range(9), r))
    top = spark.range(1).select(hamming._masks(F.col("id"), 64, 1).alias("m")).first()["m"]
    assert sorted(top) == sorted([0, -(1 << 63), *(1 << i for i in range(63))])
    hashes = spark.createDataFrame([("00000000000000ff",), ("00000000000000fe",), ("ffffffff00000000",)], "h string")
    pairs = hamming.near_classes(hashes, hashes, "h", "h", 10, bands=[(hamming.Band(0, 0, 32), 4), (hamming.Band(0, 32, 32), 5)])
    assert len(pairs._jdf.queryExecution().optimizedPlan().toString()) < 50_000
    assert {(r["a_key"][-2:], r["b_key"][-2:]) for r in pairs.collect()} == {("ff", "ff"), ("fe", "fe"), ("00", "00"), ("ff", "fe"), ("fe", "ff")}


def test_probing_is_dealt_by_the_values_probed(spark):
    from attestra.operators import hamming

    classes = hamming.hash_classes(spark.createDataFrame([("00000000000000ff",)], "h string"), "h")
    bands = [(hamming.Band(0, 0, 32), 3)]
    assert hamming._probing(classes, bands, 10_000).rdd.getNumPartitions() == -(-10_000 * hamming.probes(32, 3) // hamming.VALUES_PER_TASK)


def test_sums_that_fall_on_halves_are_rounded_up(spark):
    v = spark.sql("select 57072.499999999985D v union all select 57072.4999D union all select 57072.5D").select(A.js_round_sum(F.col("v")).alias("v"))
    assert sorted(r["v"] for r in v.collect()) == [57072, 57073, 57073]


def test_block_values_are_multiplied_as_floats(spark, tmp_path):
    import struct

    from attestra.plans import registry

    f32 = lambda v: struct.unpack("f", struct.pack("f", v))[0]
    x = next(v for v in (f32(k / 1000) for k in range(1, 1000)) if int(f32(v * 1000)) != int(v * 1000))
    spark.createDataFrame([(0, [0.0] * 32 + [x] * 32, 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES["agg29_block_stats"](spark, str(tmp_path)).first()
    assert got["high_e6"] == int(int(f32(x * 1000)) / 4 / 255 * 1e6 + 0.5)


def test_alert_spans_do_not_hang_on_the_order_of_one_instant(spark):
    from attestra.operators import windows as W

    rows = [("a", s, s != 20 or k > 0) for s in (0, 10, 20, 30, 40) for k in range(3)]
    for order in (rows, rows[::-1]):
        series = spark.createDataFrame(order, "k string, s long, ok boolean").select("k", F.timestamp_seconds("s").alias("ts"), "ok")
        got = W.alert_for(series.withColumnRenamed("ok", "fine"), F.col("fine"), 0, ["k"]).select(F.unix_timestamp("since").alias("a"), F.unix_timestamp("until").alias("b"), "samples").sort("a").collect()
        assert got == [(0, 10, 6), (20, 40, 8)]
