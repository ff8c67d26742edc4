"""Streaming twins of the operational analytics, and the batch forms they are held against.

Event time is ``ts`` (timestamp). The watermark bounds state; later rows are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WATERMARK = "10 minutes"


def _timed(log: DataFrame) -> DataFrame:
    return log.withWatermark("ts", WATERMARK) if log.isStreaming else log


def request_rate(log: DataFrame, size: str = "5 minutes", step: str = "30 seconds") -> DataFrame:
    """Requests and their success and error shares in sliding windows (STR-1)."""
    s = F.col("status")
    out = _timed(log).groupBy(F.window("ts", size, step)).agg(F.count(F.lit(1)).alias("requests"), F.count_if(s < 500).alias("ok"), F.count_if(s >= 500).alias("errors"))
    return out.select(F.col("window.start").alias("start"), "requests", (F.col("ok") / F.col("requests")).alias("success_rate"), (F.col("errors") / F.col("requests")).alias("error_rate"))


def ip_window_limit(log: DataFrame, size: str = "1 minute", most: int = 60) -> DataFrame:
    """Requests of each address in tumbling windows, and whether they exceed the limit (STR-2)."""
    out = _timed(log).groupBy(F.window("ts", size), "ip").agg(F.count(F.lit(1)).alias("requests"))
    return out.select(F.col("window.start").alias("start"), "ip", "requests", (F.col("requests") > most).alias("limited"))


_QUOTA = "api_key string, request_id long, ts timestamp, used long, rejected boolean, retry_after long"


def _quota_rows(key: str, rows: pd.DataFrame, start: int | None, used: int, most: int, seconds: int) -> tuple[pd.DataFrame, int | None, int]:
    """Verdicts of a key's requests in order, from the state (window start, used) and to the next."""
    out = []
    for request, ts in zip(rows["request_id"], rows["ts"], strict=True):
        now = int(ts.timestamp())
        if start is None or now - start > seconds:
            start, used = now, 0
        used += 1
        rejected = used > most
        out.append((key, request, ts, used, rejected, start + seconds - now if rejected else None))
    frame = pd.DataFrame(out, columns=[x.split()[0] for x in _QUOTA.split(", ")])
    return frame.astype({"retry_after": "Int64"}), start, used


#: Quota windows whose seconds one group holds at most, however many requests fall on them.
_SLICE = 168


def _slice_steps(t: np.ndarray, begin: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """How a slice that begins at ``begin`` is passed: where no window may start before x, with x at most ``upto``, the first after
    the slice starts at ``leave`` or later. ``t``: its seconds with requests, sorted; ``width``: seconds between two starts."""
    end = begin + _SLICE * width
    after = np.searchsorted(t, t + width)  # index of the next start
    last = np.where(after < len(t), after, np.arange(len(t)))  # the last start of a slice stays where it is
    for _ in range(_SLICE.bit_length()):
        last = last[last]
    many = min(len(t), int(np.searchsorted(t, begin + width - 1)) + 1)
    leave = np.maximum(t[last[:many]] + width, end)
    keep = np.append(leave[1:] != leave[:-1], True)
    return t[:many][keep], leave[keep]


def _quota_windows(seconds_: DataFrame, width: int) -> DataFrame:
    """Adds ``start``, that of its quota window, to the seconds (api_key, second, n) with requests.

    Two starts are ``width`` seconds apart or more, so time is cut in slices of a few windows. Each slice yields its passage as
    a few steps, a key's passages are followed in order, and each slice is then cut into windows from where it was entered.
    Groups are bounded by time, not by requests: the seconds of a slice, and the steps of a key.
    """
    span = _SLICE * width
    sliced = seconds_.withColumn("slice", F.floor(F.col("second") / span))

    def steps(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        upto, leave = _slice_steps(np.sort(rows["second"].to_numpy()), int(key[1]) * span, width)
        return pd.DataFrame({"api_key": key[0], "slice": key[1], "upto": upto, "leave": leave})

    def entered(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out, bound = [], None
        for at, part in rows.sort_values(["slice", "upto"]).groupby("slice"):
            bound = int(at) * span if bound is None else max(bound, int(at) * span)
            out.append((key[0], at, bound))
            first = int(np.searchsorted(part["upto"].to_numpy(), bound))
            if first < len(part):
                bound = int(part["leave"].iloc[first])
        return pd.DataFrame(out, columns=["api_key", "slice", "bound"])

    def windows(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("second")
        t, bound = rows["second"].to_numpy(), int(rows["bound"].iloc[0])
        starts, at = [bound - width], int(np.searchsorted(t, bound))  # what lies before the bound is of the window before
        while at < len(t):
            starts.append(int(t[at]))
            at = int(np.searchsorted(t, t[at] + width))
        start = np.array(starts)[np.searchsorted(starts, t, side="right") - 1]
        return pd.DataFrame({"api_key": key[0], "second": t, "n": rows["n"].to_numpy(), "start": start})

    bounds = sliced.groupBy("api_key", "slice").applyInPandas(steps, "api_key string, slice long, upto long, leave long")
    bounds = bounds.groupBy("api_key").applyInPandas(entered, "api_key string, slice long, bound long")
    return sliced.join(bounds, ["api_key", "slice"]).groupBy("api_key", "slice").applyInPandas(windows, "api_key string, second long, n long, start long")


def key_quota(log: DataFrame, most: int = 1000, seconds: int = 3600) -> DataFrame:
    """Each request with its place in its key's quota window, which starts at the key's first request and again at the first
    later than ``seconds`` after that (STR-3). Requests without key or time have no window and are left out.

    Over a table, windows are found on the seconds that have requests, and requests are ranked within their second, so a key of
    any size is spread. A stream keeps (start, used) of each key as state.
    """
    log = log.select("api_key", "request_id", "ts")
    if not log.isStreaming:
        timed = log.filter("api_key is not null and ts is not null").withColumn("second", F.unix_timestamp("ts"))
        known = _quota_windows(timed.groupBy("api_key", "second").agg(F.count(F.lit(1)).alias("n")), seconds + 1)
        before = F.sum("n").over(Window.partitionBy("api_key", "start").orderBy("second")) - F.col("n")
        within = F.row_number().over(Window.partitionBy("api_key", "second").orderBy("ts", "request_id"))
        out = timed.join(known.withColumn("before", before).drop("n"), ["api_key", "second"]).withColumn("used", within + F.col("before"))
        rejected = F.col("used") > most
        return out.select("api_key", "request_id", "ts", "used", rejected.alias("rejected"), F.when(rejected, F.col("start") + seconds - F.col("second")).alias("retry_after"))

    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "request_id"])
        out, start, used = _quota_rows(key[0], rows, start, used, most, seconds)
        state.update((start, used))
        yield out

    return log.groupBy("api_key").applyInPandasWithState(step, _QUOTA, "start long, used long", "append", GroupStateTimeout.NoTimeout)


def abuse_detector(log: DataFrame, suspicious: int = 500, blocked: int = 1000) -> DataFrame:
    """Hourly requests of each address; over the second limit it is blocked from then on (STR-4). ``stateful.guarded_requests`` refuses
    the single requests of a blocked address, in a stream too."""
    out = _timed(log).groupBy(F.window("ts", "1 hour"), "ip").agg(F.count(F.lit(1)).alias("requests"))
    out = out.select(F.col("window.start").alias("start"), "ip", "requests", (F.col("requests") > suspicious).alias("suspicious"), (F.col("requests") > blocked).alias("over"))
    if log.isStreaming:
        return out  # of the hours alone; ``blocked_addresses`` gathers those that were ever over
    by = Window.partitionBy("ip").orderBy("start")
    return out.withColumn("blocked", F.max("over").over(by))


def blocked_addresses(hours: DataFrame) -> DataFrame:
    """Addresses and the first hour in which they went over (STR-4, kept for good)."""
    return hours.filter("over").groupBy("ip").agg(F.min("start").alias("since"))


def daily_cap(log: DataFrame, most: int = 10_000) -> DataFrame:
    """Requests of each day beyond the cap, in time order (STR-5). Requests are ranked within their second; a day adds up the
    counts of its seconds."""
    timed = log.withColumn("day", F.date_trunc("day", "ts")).withColumn("second", F.unix_timestamp("ts"))
    per = timed.groupBy("day", "second").agg(F.count(F.lit(1)).alias("n"))
    per = per.select("day", "second", (F.sum("n").over(Window.partitionBy("day").orderBy("second")) - F.col("n")).alias("before"), "n")
    late = per.filter(F.col("before") + F.col("n") > most).drop("n")  # seconds that lie within the cap need no ranks
    rank = F.row_number().over(Window.partitionBy("day", "second").orderBy("ts", "request_id")) + F.col("before")
    return timed.join(late, ["day", "second"]).withColumn("place", rank).filter(F.col("place") > most).select("request_id", "day", "place")


def segment_windows(frames: DataFrame, rate: int = 15) -> DataFrame:
    """Frames by second of their video, complete seconds only (STR-7); ``stateful.segment_hash_stream`` hashes them as they arrive."""
    out = _timed(frames).groupBy(F.window("ts", "1 second"), "video_id").agg(F.count(F.lit(1)).alias("n"))
    return out.filter(F.col("n") == rate).select("video_id", F.col("window.start").alias("start"), "n")


def expired(batches: DataFrame, now: Column, ttl_seconds: int = 86400) -> DataFrame:
    """Batches past their time to live, none of which was extended (STR-8); ``stateful.batch_expiries`` follows extensions."""
    return batches.filter(F.unix_timestamp("created_at") + ttl_seconds <= F.unix_timestamp(now))


#: Alerts on the share of server errors: name, threshold, hold time in seconds, severity, team, category.
ERROR_ALERTS = [("HighErrorRate", 0.02, 300, "warning", "platform", "reliability"), ("SevereErrorRate", 0.05, 600, "critical", "platform", "reliability")]


def receiver_of(severity: str, team: str, category: str) -> str:
    """Who hears of an alert: the first route that fits. The routes."""
    if severity == "critical":
        return "pagerduty-critical"
    if team == "platform" and severity in ("warning", "info"):
        return "platform-slack"
    if team == "trust-safety":
        return "trust-safety-slack"
    if severity == "warning" and category in ("reliability", "performance"):
        return "platform-slack-urgent"
    return "platform-email" if severity == "info" else "default"


def alert_stream(rates: DataFrame, step: int = 30, alerts: list[tuple] | None = None) -> DataFrame:
    """Alerts (start, alert, held, severity, receiver) that fire at a window: the error rate of every window since the hold time
    before was over the threshold; ``held`` is the least of them (STR-9).

    ``rates``: start (every ``step`` seconds) and error_rate. A window counts towards those that end a hold time with it, so
    each alert is one grouped aggregate, over streams too.
    """
    out = None
    for name, threshold, hold, severity, team, category in ERROR_ALERTS if alerts is None else alerts:
        many = hold // step + 1
        ends = F.explode(F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda k: F.timestamp_seconds(F.unix_timestamp("start") + k * step)))
        held = rates.select(ends.alias("at"), "error_rate", (F.col("start")).alias("own")).groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.min("error_rate").alias("held"), F.max("own").alias("last"))
        fired = held.filter((F.col("n") == many) & (F.col("held") > threshold) & (F.col("last") == F.col("at")))
        fired = fired.select(F.col("at").alias("start"), F.lit(name).alias("alert"), "held", F.lit(severity).alias("severity"), F.lit(receiver_of(severity, team, category)).alias("receiver"))
        out = fired if out is None else out.unionByName(fired)
    return out
