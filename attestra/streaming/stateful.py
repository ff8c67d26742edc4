"""Streams that keep state of their own for each key, with event-time timers, and the batch forms that they equal.

They need the RocksDB state store (``STATE_STORE`` among the session's settings): state lies on the executors' disks, is kept with the
query's checkpoint, and a batch touches only the keys that it has. Rows later than the watermark are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from attestra.operators.windows import SEGMENT_DIGITS, placed

#: Setting that the streams of this module need.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
HOUR = 3600


def _sorted(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """A key's rows of one micro-batch, which the source's rate limit bounds."""
    return pd.concat(list(batches)).sort_values(by, kind="stable")


_ABUSE = "ip string, request_id long, ts timestamp, n long, suspicious boolean, refused boolean, reason string"
#: Why a request is refused.
DENIED, TOO_MANY = "Access denied", "Too many requests. IP blocked."


class AbuseGuard(StatefulProcessor):
    """Hourly counts of an address, which timers clear, and its block, which stays for good."""

    def __init__(self, suspicious: int, blocked: int):
        self._suspicious, self._most = suspicious, blocked

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._hours = handle.getMapState("hours", "hour long", "n long")
        self._blocked = handle.getValueState("blocked", "since_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, counts, is_blocked = [], {}, self._blocked.exists()
        for request, ts, ms in _sorted(rows, ["ts", "request_id"])[["request_id", "ts", "ms"]].itertuples(index=False):
            if is_blocked:
                out.append((key[0], request, ts, None, None, True, DENIED))
                continue
            hour = ms // 1000 // HOUR
            if hour not in counts:
                counts[hour] = self._hours.getValue((hour,))[0] if self._hours.containsKey((hour,)) else 0
                if not counts[hour]:
                    self._handle.registerTimer((hour + 1) * HOUR * 1000)
            counts[hour] += 1
            n = counts[hour]
            is_blocked = n > self._most
            if is_blocked:
                self._blocked.update((int(ms),))
            out.append((key[0], request, ts, n, n > self._suspicious, is_blocked, TOO_MANY if is_blocked else None))
        for hour, n in counts.items():
            self._hours.updateValue((hour,), (n,))
        frame = pd.DataFrame(out, columns=[x.split()[0] for x in _ABUSE.split(", ")])
        yield frame.astype({"n": "Int64", "suspicious": "boolean"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        hour = expiredTimerInfo.getExpiryTimeInMs() // 1000 // HOUR - 1
        if self._hours.containsKey((hour,)):
            self._hours.removeKey((hour,))
        return iter([])

    def close(self) -> None:
        pass


def guarded_requests(log: DataFrame, suspicious: int = 500, blocked: int = 1000, watermark: str = "10 minutes") -> DataFrame:
    """Each request (ip, request_id, ts) with its number ``n`` in its address's hour, whether that is suspicious, and whether and
    why it is refused (STR-4): the request beyond ``blocked`` blocks its address, whose later requests are refused and not counted,
    in later hours too. Requests without address or time are left out.

    A stream takes requests as they arrive, those of one micro-batch in the order of time; a table in the order of time
    throughout. There, requests are numbered within minutes and minutes added up, so an address of any size is spread.
    """
    log = log.select("ip", "request_id", "ts").filter("ip is not null and ts is not null")
    if log.isStreaming:
        keyed = log.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", watermark).groupBy("ip")
        return keyed.transformWithStateInPandas(AbuseGuard(suspicious, blocked), _ABUSE, "append", "EventTime")
    hours = log.withColumn("hour", F.floor(F.unix_timestamp("ts") / HOUR))
    numbered = placed(hours, ["ip", "hour"], F.floor(F.unix_timestamp("ts") / 60), ["ts", "request_id"], "n")
    since = numbered.filter(F.col("n") == blocked + 1).groupBy("ip").agg(F.min(F.struct("ts", "request_id")).alias("since"))
    out = numbered.join(since, "ip", "left")
    own = F.struct("ts", "request_id")
    denied = F.coalesce(own > F.col("since"), F.lit(False))
    reason = F.when(denied, DENIED).when(own == F.col("since"), TOO_MANY)
    counted = lambda c: F.when(~denied, c)
    return out.select("ip", "request_id", "ts", counted(F.col("n")).alias("n"), counted(F.col("n") > suspicious).alias("suspicious"), reason.isNotNull().alias("refused"), reason.alias("reason"))


_EXPIRY = "batch_id string, stored_ms long, expired_ms long"
TTL = 86400


class BatchKeeper(StatefulProcessor):
    """A batch's expiry as an event-time timer. Events wait until the watermark has passed them, so their order of arrival does not matter."""

    def __init__(self, ttl_seconds: int):
        self._ttl = ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._pending = handle.getListState("pending", "at long, event string, ttl long")
        self._life = handle.getValueState("life", "stored long, expires long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for ms, event, ttl in batch[["ms", "event", "ttl_seconds"]].itertuples(index=False):
                self._pending.appendValue((int(ms), event, None if pd.isna(ttl) else int(ttl)))
                self._handle.registerTimer(int(ms))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, ended = timerValues.getCurrentWatermarkInMs(), []  # all events up to here have come
        pending = sorted(self._pending.get(), key=lambda e: (e[0], e[1], e[2] is not None, e[2] or 0))
        due = [e for e in pending if e[0] <= now]
        life = self._life.get() if self._life.exists() else None
        before = life
        for at, event, ttl in due:
            if life and life[1] < at:
                ended.append(life)
                life = None
            life = _after(life, at, event, ttl, self._ttl)
        if life and life[1] <= now:
            ended.append(life)
            life = None
        if due:
            self._pending.put(rest) if (rest := pending[len(due) :]) else self._pending.clear()
        if life != before:
            self._life.update(life) if life else self._life.clear()
            if life:
                self._handle.registerTimer(life[1])
        if ended:
            yield pd.DataFrame([(key[0], *life) for life in ended], columns=["batch_id", "stored_ms", "expired_ms"])

    def close(self) -> None:
        pass


def _after(life: tuple | None, at: int, event: str, ttl: int | None, standard: int) -> tuple | None:
    """A batch's life (stored, expires in ms) after an event."""
    if event == "stored":
        return at, at + standard * 1000
    if life is None or event == "deleted" or (ttl or 0) < 0:
        return None
    return life[0], at + (ttl or standard) * 1000


def batch_lives(events: DataFrame, ttl_seconds: int = TTL) -> DataFrame:
    """The lives of batches: batch_id, stored_at, expires_at, extensions, and ended_by: ``deleted``, ``stored`` (anew) or ``expired``.

    ``events``: batch_id, ts, event (``stored``, ``extended``, ``deleted``) and ttl_seconds of an extension, which counts from its time;
    none or 0 is the standard time, less deletes. An extension of a batch that has expired, or was never stored, does nothing. At
    equal times deletions come first, then extensions, then storing.
    """
    by = Window.partitionBy("batch_id").orderBy("ts", "event", F.col("ttl_seconds").asc_nulls_first())
    ttl = F.coalesce(F.nullif("ttl_seconds", F.lit(0)), F.lit(ttl_seconds)) if "ttl_seconds" in events.columns else F.lit(ttl_seconds)
    stored, gone = F.col("event") == "stored", (F.col("event") == "deleted") | ((F.col("event") == "extended") & (F.col("ttl") < 0))
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).filter("batch_id is not null and ts is not null").withColumn("ttl", F.when(F.col("event") == "stored", ttl_seconds).otherwise(ttl))
    out = out.withColumn("gone", gone).withColumn("until", F.when(~gone, F.col("ts") + F.make_dt_interval(secs=F.col("ttl"))))
    out = out.withColumn("life", F.sum(stored.cast("int")).over(by)).withColumn("before", F.lag("until").over(by)).withColumn("next", F.lead("ts").over(by))
    # within a life, the first event after its expiry or deletion finds no batch, nor does any later one
    missed = ~stored & ~F.coalesce(F.col("ts") <= F.col("before"), F.lit(False))
    inside = Window.partitionBy("batch_id", "life").orderBy("ts", "event", F.col("ttl_seconds").asc_nulls_first())
    out = out.filter("life > 0").withColumn("missed", F.sum(missed.cast("int")).over(inside)).filter("missed = 0")
    last = F.max_by(F.struct("until", "next", "gone"), F.struct("ts", "event", F.coalesce("ttl_seconds", F.lit(-(1 << 62)))))
    lives = out.groupBy("batch_id", "life").agg(F.min("ts").alias("stored_at"), last.alias("last"), (F.count_if(~F.col("gone")) - 1).alias("extensions"))
    ended = F.when(F.col("last.gone"), "deleted").when(F.col("last.next") <= F.col("last.until"), "stored").otherwise("expired")
    return lives.select("batch_id", "stored_at", F.col("last.until").alias("expires_at"), "extensions", ended.alias("ended_by"))


def batch_expiries(events: DataFrame, ttl_seconds: int = TTL, watermark: str = "10 minutes", now: Column | None = None) -> DataFrame:
    """One row (batch_id, stored_at, expired_at) for each batch that expires, at the time that its last extension gave it (STR-8).

    A stream yields it once the watermark has passed that time; a table yields all, or those up to ``now``. Both agree whatever the
    order of arrival, as long as no event is later than the watermark; a stream rounds times down to milliseconds.
    """
    if events.isStreaming:
        named = events.select(F.col("batch_id").cast("string").alias("batch_id"), "ts", "event", "ttl_seconds", F.unix_millis("ts").alias("ms")).filter("batch_id is not null")
        out = named.withWatermark("ts", watermark).groupBy("batch_id").transformWithStateInPandas(BatchKeeper(ttl_seconds), _EXPIRY, "append", "EventTime")
        return out.select("batch_id", F.timestamp_millis("stored_ms").alias("stored_at"), F.timestamp_millis("expired_ms").alias("expired_at"))
    out = batch_lives(events, ttl_seconds).filter("ended_by = 'expired'")
    out = out if now is None else out.filter(F.col("expires_at") <= now)
    return out.select(F.col("batch_id").cast("string").alias("batch_id"), "stored_at", F.col("expires_at").alias("expired_at"))


def batch_remaining(events: DataFrame, now: Column, ttl_seconds: int = TTL) -> DataFrame:
    """Batches that are alive at ``now``, extensions so far included: batch_id, expires_at and the whole seconds left (WIN-11)."""
    alive = batch_lives(events.filter(F.col("ts") <= now), ttl_seconds).filter("ended_by = 'expired'").filter(F.col("expires_at") >= now)
    left = F.expr("unix_micros(expires_at)") - F.unix_micros(now)
    return alive.select("batch_id", "expires_at", F.floor(left / 1_000_000).alias("seconds_left"))


_SEGMENT = "video_id long, seg_idx int, segment string"


class SegmentBuffer(StatefulProcessor):
    """Frames of one segment, until all are there or the watermark has passed."""

    def __init__(self, size: int, wait_ms: int):
        self._size, self._wait = size, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._frames = handle.getMapState("frames", "place int", "phash string")
        self._done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self._done.exists():
            return
        frames = {p[0]: h[0] for p, h in self._frames.iterator()}
        new, last = {}, 0
        for batch in rows:
            for place, phash, ms in batch[["place", "phash", "ms"]].itertuples(index=False):
                if place not in frames and (place not in new or phash < new[place]):
                    new[int(place)] = phash
                last = max(last, int(ms))
        self._handle.registerTimer(last + self._wait)
        if len(frames | new) == self._size:
            joined = "".join(h for _, h in sorted((frames | new).items()))
            self._frames.clear()
            self._done.update((True,))
            yield pd.DataFrame([(key[0], key[1], f"seg_{key[1]}:{sha256(joined.encode()).hexdigest()[:SEGMENT_DIGITS]}")], columns=["video_id", "seg_idx", "segment"])
        else:
            for place, phash in new.items():
                self._frames.updateValue((place,), (phash,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._frames.clear()
        self._done.clear()
        return iter([])

    def close(self) -> None:
        pass


def segment_hash_stream(frames: DataFrame, size: int = 15, first: int = 1, wait_seconds: int = 60, watermark: str = "10 minutes") -> DataFrame:
    """Segment hashes (video_id, seg_idx, segment) as frames arrive in any order (STR-7): emitted with the last of ``size`` frames,
    dropped where that does not come by ``wait_seconds`` and the watermark after the frames so far. ``frames``: video_id, frame_no
    (numbered from ``first`` without gaps), phash, ts. A frame that arrives again is ignored. Equal to ``windows.segment_hashes``
    over the same frames."""
    at = F.col("frame_no") - first
    keyed = frames.select(F.col("video_id").cast("long").alias("video_id"), F.floor(at / size).cast("int").alias("seg_idx"), (at % size).cast("int").alias("place"), "phash", "ts", F.unix_millis("ts").alias("ms"))
    keyed = keyed.filter("video_id is not null and place >= 0 and phash is not null").withWatermark("ts", watermark).groupBy("video_id", "seg_idx")
    return keyed.transformWithStateInPandas(SegmentBuffer(size, wait_seconds * 1000), _SEGMENT, "append", "EventTime")


class FingerprintLedger(StatefulProcessor):
    """How often a fingerprint was seen and when first, for as long as the registry lasts."""

    def __init__(self, fields: list[str]):
        self._fields = fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", "n long, first_us long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._seen.update((int(initialState["n"].iloc[0]), int(initialState["first_us"].iloc[0])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, first = self._seen.get() if self._seen.exists() else (0, None)
        out = _sorted(rows, ["ts", "file_id"])
        first = int(out["us"].iloc[0]) if first is None else first
        out = out.assign(found=[n + i > 0 for i in range(len(out))], seen_before=range(n, n + len(out)), first_us=first)
        self._seen.update((n + len(out), first))
        yield out[self._fields]

    def close(self) -> None:
        pass


def looked_up(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Each arriving file (file_id, fingerprint, ts) with found, seen_before and first_seen, among the registry ``known`` (fingerprint,
    ts) and the files that arrived before it (STR-6). Files without fingerprint or time are left out.

    A stream keeps count and first date of each fingerprint as state that starts from ``known``, so a batch reads no registry; files of
    one micro-batch follow each other by time. In a table, files are numbered within hours and hours added up, so a fingerprint
    that very many files share is spread.
    """
    files = files.select("file_id", "fingerprint", "ts").filter("fingerprint is not null and ts is not null")
    seen = None if known is None else known.filter("fingerprint is not null and ts is not null").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"))
    if files.isStreaming:
        fields = ["file_id", "fingerprint", "ts", "found", "seen_before", "first_us"]
        schema = f"file_id {dict(files.dtypes)['file_id']}, fingerprint string, ts timestamp, found boolean, seen_before long, first_us long"
        initial = None if seen is None else seen.select("fingerprint", "n", F.unix_micros("first_seen").alias("first_us")).groupBy("fingerprint")
        keyed = files.withColumn("us", F.unix_micros("ts")).groupBy("fingerprint")
        out = keyed.transformWithStateInPandas(FingerprintLedger(fields), schema, "append", "None", initial)
        return out.select(*fields[:-1], F.timestamp_micros("first_us").alias("first_seen"))
    out = placed(files, ["fingerprint"], F.floor(F.unix_timestamp("ts") / HOUR), ["ts", "file_id"], "place")
    first = files.groupBy("fingerprint").agg(F.min("ts").alias("first_file"))
    out = out.join(first, "fingerprint")
    out = out.join(seen, "fingerprint", "left") if seen is not None else out.withColumn("n", F.lit(0).cast("long")).withColumn("first_seen", F.lit(None).cast("timestamp"))
    before = F.coalesce("n", F.lit(0)) + F.col("place") - 1
    return out.select("file_id", "fingerprint", "ts", (before > 0).alias("found"), before.alias("seen_before"), F.coalesce("first_seen", "first_file").alias("first_seen"))


def upsert_registry(files: DataFrame, registry_path: str, checkpoint: str, known: DataFrame | None = None):
    """Looks each arriving file up and appends it with the answer to the registry at ``registry_path`` (STR-6); returns the query, which
    ends with the files at hand. State and sink follow one checkpoint, so a file is looked up and appended once, restarts
    included; ``known`` counts in the first run only."""
    return looked_up(files, known).writeStream.format("parquet").option("path", registry_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
