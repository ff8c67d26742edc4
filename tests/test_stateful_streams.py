"""Streams with state of their own against plain loops and against their batch forms, over restarts and out-of-order arrivals."""

import os
import random
from datetime import UTC, datetime, timedelta
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from attestra.operators import windows as W
from attestra.streaming import stateful

START = datetime(2024, 1, 1, tzinfo=UTC)
at = lambda s: START + timedelta(seconds=s)
NEVER = (10 * 365) * 86400  # of a row that moves the watermark past all others


@pytest.fixture
def stream(spark, tmp_path):
    """Runs a stream over batches of rows, a file each, restarted after every ``restarts`` of them; returns what it yielded."""
    for k, v in stateful.STATE_STORE.items():
        spark.conf.set(k, v)

    def run(batches, schema, f, restart_every=2):
        for k, rows in enumerate(batches):
            folder = tmp_path / f"in{k}"
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder))
            part = next(folder.glob("part-*"))
            os.makedirs(tmp_path / "in", exist_ok=True)
            os.utime(part, (1_700_000_000 + k, 1_700_000_000 + k))
            part.rename(tmp_path / "in" / f"{k:04}.parquet")
            if (k + 1) % restart_every == 0 or k + 1 == len(batches):
                source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
                out = f(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
                out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    yield run
    for k in stateful.STATE_STORE:
        spark.conf.unset(k)


LOG = "request_id long, ts timestamp, ip string"


def log_of(seed):
    rng = random.Random(seed)
    rows = [(i, at(20 * i + rng.randrange(20)), rng.choice(["a", "a", "a", "b", "c"])) for i in range(900)]
    return rng, rows


def plain_guard(batches, suspicious, most):
    counts, blocked, out = {}, set(), set()
    for rows in batches:
        for i, ts, ip in sorted(rows, key=lambda r: (r[1], r[0])):
            if ip in blocked:
                out.add((ip, i, None, None, True, stateful.DENIED))
                continue
            hour = (ip, int(ts.timestamp()) // 3600)
            n = counts[hour] = counts.get(hour, 0) + 1
            over = n > most
            blocked |= {ip} if over else set()
            out.add((ip, i, n, n > suspicious, over, stateful.TOO_MANY if over else None))
    return out


READ = lambda df: {(r.ip, r.request_id, r.n, r.suspicious, r.refused, r.reason) for r in df.collect()}


def test_guard_stream_keeps_blocks_over_hours_and_restarts(spark, stream):
    rng, rows = log_of(1)
    # arrivals are disordered by up to 8 minutes, less than the watermark
    order = sorted(rows, key=lambda r: r[1].timestamp() + rng.randrange(480))
    batches = [order[k : k + 150] for k in range(0, len(order), 150)]
    got = READ(stream(batches, LOG, lambda s: stateful.guarded_requests(s, 60, 100)))
    assert got == plain_guard(batches, 60, 100)
    blocked = {ip for ip, *_, reason in got if reason == stateful.DENIED}
    assert blocked == {"a"} and any(r[2] is not None and r[0] == "b" for r in got)


def test_guard_table_equals_a_plain_loop(spark):
    for seed, most in ((2, 100), (3, 5), (4, 10**6)):
        _, rows = log_of(seed)
        rows += [(5000 + i, rows[10][1], "b") for i in range(9)]  # ties
        df = spark.createDataFrame([*rows, (-1, None, "a"), (-2, at(0), None)], LOG)
        assert READ(stateful.guarded_requests(df, 60, most)) == plain_guard([rows], 60, most)
    assert stateful.guarded_requests(df.limit(0)).collect() == []


EVENTS = "batch_id string, ts timestamp, event string, ttl_seconds long"


def events_of(seed, many=400):
    rng = random.Random(seed)
    rows = []
    for i in range(many):
        kind = rng.choice(["stored", "extended", "extended", "extended", "deleted"])
        ttl = rng.choice([None, 0, 60, 300, 1000, -1]) if kind == "extended" else None
        rows.append((f"b{rng.randrange(12)}", at(i * 30 + rng.randrange(30)), kind, ttl))
    rows += [(b, t, "extended", 60) for b, t, _, _ in rng.sample(rows, 20)]  # ties
    return rng, rows


def plain_expiries(rows, standard):
    out, life = [], {}
    for b, t, kind, ttl in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3] is not None, r[3] or 0)):
        if b in life and life[b][1] < t:
            out.append((b, *life.pop(b)))
        if kind == "stored":
            life[b] = (t, t + timedelta(seconds=standard))
        elif b in life and (kind == "deleted" or (ttl or 0) < 0):
            del life[b]
        elif b in life:
            life[b] = (life[b][0], t + timedelta(seconds=ttl or standard))
    return sorted(out + [(b, *x) for b, x in life.items()])


def naive(rows):
    return sorted((b, a.replace(tzinfo=None), e.replace(tzinfo=None)) for b, a, e in rows)


def test_expiry_stream_moves_timers_and_fires_once(spark, stream):
    rng, rows = events_of(5)
    order = sorted(rows, key=lambda r: r[1].timestamp() + rng.randrange(500))
    batches = [order[k : k + 70] for k in range(0, len(order), 70)] + [[("end", at(NEVER), "deleted", None)]]
    got = stream(batches, EVENTS, lambda s: stateful.batch_expiries(s, 600))
    assert sorted(map(tuple, got.collect())) == naive(plain_expiries(rows, 600))


@pytest.mark.parametrize("seed", [6, 7, 8])
def test_expiries_and_lives_of_a_table(spark, seed):
    _, rows = events_of(seed, 900)
    df = spark.createDataFrame([*rows, (None, at(0), "stored", None)], EVENTS)
    got = stateful.batch_expiries(df, 600)
    expected = naive(plain_expiries(rows, 600))
    assert sorted(map(tuple, got.collect())) == expected
    now = at(9000)
    assert sorted(map(tuple, stateful.batch_expiries(df, 600, now=F.lit(now)).collect())) == [r for r in expected if r[2] <= now.replace(tzinfo=None)]
    lives = stateful.batch_lives(df, 600)
    assert lives.count() >= len(expected) and {r.ended_by for r in lives.collect()} == {"expired", "deleted", "stored"}


def test_segment_stream_equals_the_batch(spark, stream):
    rng = random.Random(11)
    frames = [(v, k + 1, sha256(f"{v}.{k}".encode()).hexdigest(), at(k // 5 + 3 * v)) for v, n in enumerate([15, 44, 60, 14, 31]) for k in range(n)]
    order = sorted(frames, key=lambda r: r[3].timestamp() + rng.randrange(9))
    order += rng.sample(order, 12)  # sent again
    batches = [order[k : k + 40] for k in range(0, len(order), 40)]
    schema = "video_id long, frame_no int, phash string, ts timestamp"
    got = stream(batches, schema, lambda s: stateful.segment_hash_stream(s))
    expected = W.segment_hashes(spark.createDataFrame(frames, schema))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.select("video_id", "seg_idx", "segment").collect()))
    assert got.count() == 1 + 2 + 4 + 0 + 2


def test_segments_that_stay_incomplete_are_dropped(spark, stream):
    schema = "video_id long, frame_no int, phash string, ts timestamp"
    first = [(1, k, f"h{k}", at(k)) for k in range(1, 15)]
    batches = [first, [(2, 1, "x", at(5000))], [(1, 15, "h15", at(5001))]]  # the fifteenth comes after the watermark has dropped the rest
    assert stream(batches, schema, stateful.segment_hash_stream, 1).count() == 0


FILES = "file_id long, fingerprint string, ts timestamp"


def plain_lookup(batches, known):
    seen, out = {}, set()
    for f, t in known:
        n, first = seen.get(f, (0, t))
        seen[f] = n + 1, min(first, t)
    for rows in batches:
        for i, f, t in sorted(rows, key=lambda r: (r[2], r[0])):
            n, first = seen.get(f, (0, t))
            out.add((i, f, n > 0, n, first.replace(tzinfo=None)))
            seen[f] = n + 1, first
    return out


ANSWERS = lambda df: {(r.file_id, r.fingerprint, r.found, r.seen_before, r.first_seen) for r in df.collect()}


@pytest.mark.parametrize("with_known", [True, False])
def test_registry_stream_looks_up_then_appends_once(spark, tmp_path, with_known):
    for k, v in stateful.STATE_STORE.items():
        spark.conf.set(k, v)
    rng = random.Random(3)
    known = [(f"h{rng.randrange(8)}", at(-100 - i)) for i in range(20)] if with_known else []
    rows = [(i, f"h{rng.randrange(20)}", at(i * 10)) for i in range(90)] + [(100, "h1", at(5)), (101, "h1", at(5))]
    batches = [rows[:40], rows[40:70], rows[70:]]
    table = spark.createDataFrame(known, "fingerprint string, ts timestamp") if with_known else None
    try:
        for k, part in enumerate(batches):
            spark.createDataFrame(part, FILES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            for _ in range(2):  # the second run finds nothing new
                source = spark.readStream.schema(FILES).parquet(str(tmp_path / "in"))
                stateful.upsert_registry(source, str(tmp_path / "reg"), str(tmp_path / "ck"), table).awaitTermination()
            reg = spark.read.parquet(str(tmp_path / "reg"))
            assert reg.count() == sum(map(len, batches[: k + 1]))
        assert ANSWERS(reg) == plain_lookup(batches, known)
    finally:
        for k in stateful.STATE_STORE:
            spark.conf.unset(k)
    df = spark.createDataFrame([*rows, (-1, None, at(0))], FILES)
    assert ANSWERS(stateful.looked_up(df, table)) == plain_lookup([rows], known)
    assert stateful.looked_up(df.limit(0), table).collect() == []


def test_places_of_a_hot_key_equal_plain_ranks(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "x", None]), rng.randrange(300), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t long, i long")
    got = {r.i: r.place for r in W.placed(df, ["k"], F.floor(F.col("t") / 50), ["t", "i"], "place").collect()}
    for k in {r[0] for r in rows}:
        assert [got[i] for _, _, i in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:])] == list(range(1, sum(r[0] == k for r in rows) + 1))
