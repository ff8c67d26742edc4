"""Column functions on names, messages, fractions and urls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_fraction(c: Column) -> Column:
    """'30000/1001' as a number; a bare number as itself; 0 where empty or divided by 0 (FN-18)."""
    num = F.split(c, "/")
    top, low = F.get(num, 0).try_cast("double"), F.get(num, 1).try_cast("double")
    return F.coalesce(F.when(low.isNull(), top).when(low != 0, top / low), F.lit(0.0))


def parse_duration(c: Column) -> Column:
    """Seconds of the first ``hh:mm:ss.ff`` in a text (FN-19)."""
    part = lambda i: F.regexp_extract(c, r"(\d+):(\d{2}):(\d{2}(?:\.\d+)?)", i)
    return F.when(part(1) != "", part(1).try_cast("double") * 3600 + part(2).try_cast("double") * 60 + part(3).try_cast("double"))


def canonical_spec(c: Column) -> Column:
    """Specification and version that a canonicalisation names (FN-20)."""
    found = F.regexp_extract(c, r"^(img:v1|img:v2|vid:v1)", 1)
    return F.when(found != "", found)


def format_file_size(c: Column) -> Column:
    """B, KB or MB with one decimal (FN-21)."""
    return F.when(c < 1024, F.format_string("%d B", c.cast("long"))).when(c < 1 << 20, F.format_string("%.1f KB", c / 1024)).otherwise(F.format_string("%.1f MB", c / (1 << 20)))


def is_reputable(url: Column) -> Column:
    """FN-22. The names."""
    return F.lower(url).rlike(r"wikipedia|getty|shutterstock|news|\.gov|\.edu")


def is_safe(adult: Column, violence: Column) -> Column:
    """FN-23."""
    fine = ("VERY_UNLIKELY", "UNLIKELY")
    return adult.isin(*fine) & violence.isin(*fine)


def ratio_matches(width: Column, height: Column, ratio: float, tolerance: float = 0.02) -> Column:
    """FN-24: whether the aspect ratio is within the tolerance."""
    return F.abs(width / height - ratio) <= tolerance


def resolution_matches(width: Column, height: Column, w: int, h: int) -> Column:
    """FN-24: exact size in either orientation."""
    return ((width == w) & (height == h)) | ((width == h) & (height == w))


def first_rule(text: Column, rules: list[tuple[str, object]], rest: object) -> Column:
    """The value of the first pattern that occurs, without regard to case."""
    out = None
    for pattern, value in rules:
        hit = text.rlike(f"(?i){pattern}")
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(rest)


#: Messages and their status codes.
STATUS_RULES = [("timeout", 504), ("too large|too long|exceeds", 413), ("validation|invalid|not allowed|missing|mismatch|contiguous|unsupported", 400), ("busy", 503)]


def status_from_message(c: Column) -> Column:
    """FLT-7."""
    return first_rule(c, STATUS_RULES, 500)


#: File names, types and their kinds.
KIND_RULES = [("image", r"\.(png|jpe?g|gif|webp)$"), ("video", r"\.(mp4|mov|avi|mkv)$"), ("audio", r"\.(mp3|wav|m4a|flac)$")]


def media_kind(mime: Column, name: Column) -> Column:
    """FLT-1: by MIME type or extension; images first."""
    out = None
    for kind, ext in KIND_RULES:
        hit = F.coalesce(mime.rlike(f"(?i)^{kind}/"), F.lit(False)) | F.coalesce(name.rlike(f"(?i){ext}"), F.lit(False))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("unknown")
