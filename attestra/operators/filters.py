"""Filters and validation predicates over files, probes, credentials and messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a batch admits, and what a video may be.
IMAGE_TYPES = "jpeg|jpg|png|gif|webp"
CONTAINERS, CODECS, MOST_SECONDS = ["mp4", "mov", "mkv", "webm"], ["h264", "hevc", "vp9", "av1"], 300
MOST_BYTES, MOST_FILES = 50 * 1024 * 1024, 100


def admit_batch_files(files: DataFrame) -> DataFrame:
    """The first 100 files of each batch that are images by extension and MIME type and not over 50 MB (FLT-2)."""
    ext = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    fine = ext.rlike(IMAGE_TYPES) & F.lower("mime").rlike(IMAGE_TYPES) & (F.col("size") <= MOST_BYTES)
    order = Window.partitionBy("batch_id").orderBy("index")
    return files.filter(fine).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= MOST_FILES)


#: First bytes of executables, of scripts, and of the two image kinds that are checked; endings of server scripts.
EXECUTABLES, SHEBANG, PNG_HEAD, JPEG_HEAD, SERVER_SCRIPTS = ["4D5A", "7F454C46", "CAFEBABE"], "2321", "89504E470D0A1A0A", "FFD8", [".php", ".asp", ".jsp"]


def signature_problem(content: Column, name: Column) -> Column:
    """Why a file is refused by its first bytes or its name, or null (FLT-3). The extension is what follows the last dot, or the
    whole name where it has none; content is looked at before the name."""
    head, small = F.hex(F.substring(content, 1, 8)), F.lower(name)
    ext = F.element_at(F.split(small, r"\."), -1)
    starts = lambda heads: reduce(lambda a, b: a | b, [head.startswith(h) for h in heads])
    ends = reduce(lambda a, b: a | b, [small.endswith(x) for x in SERVER_SCRIPTS])
    return F.coalesce(
        F.when(starts(EXECUTABLES), "executable"),
        F.when(head.startswith(SHEBANG), "script"),
        F.when((ext == "png") & ~head.startswith(PNG_HEAD), "not a png"),
        F.when(ext.isin("jpg", "jpeg") & ~head.startswith(JPEG_HEAD), "not a jpeg"),
        F.when(name.contains("..") | name.rlike(r'[<>:"|?*\x00]'), "bad name"),
        F.when(ends, "script name"),
    )


def video_policy_problem(container: Column, codec: Column, duration: Column) -> Column:
    """The first rule of the video policy that fails, or null (FLT-4)."""
    tokens = F.transform(F.split(F.lower(container), ","), lambda t: F.trim(t))
    known = F.arrays_overlap(tokens, F.array(*[F.lit(c) for c in CONTAINERS]))
    return F.coalesce(F.when(~F.coalesce(known, F.lit(False)), "container"), F.when(~F.coalesce(F.lower(codec).isin(CODECS), F.lit(False)), "codec"), F.when(F.floor(duration) > MOST_SECONDS, "duration"))


def credential_problem(algorithm: Column, canonicalization: Column, segments: Column) -> Column:
    """What is wrong with a segment credential, or null (FLT-5)."""
    return (
        F.when(algorithm.isNull() & canonicalization.isNull() & segments.isNull(), "missing")
        .when(~F.coalesce(F.lower(algorithm) == "sha256+segphash", F.lit(False)), "algorithm")
        .when(~F.coalesce(canonicalization.startswith("vid:v1"), F.lit(False)), "canonicalization")
        .when(~F.coalesce(F.size(segments) > 0, F.lit(False)), "segments")
    )


def segment_list_problem(segments: Column) -> Column:
    """Bad form, or indices that are not 0..N-1 (duplicates are tolerated), or null (FLT-6)."""
    idx = F.array_distinct(F.transform(segments, lambda s: F.regexp_extract(s, r"^seg_([0-9]+):", 1).try_cast("bigint")))  # null: too large for any list
    bad = F.exists(segments, lambda s: ~s.rlike(r"^seg_[0-9]+:[a-f0-9]{16,64}\z"))
    return F.when(bad, "format").when(F.array_max(idx) + 1 != F.size(idx), "contiguous")


#: Error codes by message, in this order, and what users are told.
ERROR_RULES = [
    ("invalid|corrupt", "INVALID_IMAGE"),
    ("size|small", "IMAGE_TOO_SMALL"),
    ("large|exceeds", "IMAGE_TOO_LARGE"),
    ("format|unsupported", "UNSUPPORTED_FORMAT"),
    ("timeout", "PROCESSING_TIMEOUT"),
    ("memory", "OUT_OF_MEMORY"),
]
ERROR_TEXT = {
    "INVALID_IMAGE": "File is corrupted or not a valid image format",
    "IMAGE_TOO_SMALL": "Image dimensions are too small for reliable verification",
    "IMAGE_TOO_LARGE": "Image file size exceeds the maximum allowed",
    "UNSUPPORTED_FORMAT": "Image format is not supported",
    "PROCESSING_TIMEOUT": "Image processing took too long and was cancelled",
    "OUT_OF_MEMORY": "Image is too large to process",
    "PROCESSING_ERROR": "An error occurred while processing the image",
}


def error_code(code: Column, message: Column) -> Column:
    """A given code, else by message (FLT-8)."""
    from attestra.functions.text import first_rule

    return F.coalesce(code, first_rule(message, ERROR_RULES, "PROCESSING_ERROR"))


def error_text(code: Column, message: Column) -> Column:
    """What users are told (FLT-8): the text of the code, else the message itself."""
    table = F.create_map(*[F.lit(x) for pair in ERROR_TEXT.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), message, F.lit("Unknown error occurred"))


def filter_allowed_hosts(urls: DataFrame, hosts: DataFrame) -> DataFrame:
    """http and https urls whose host is listed; an empty list allows all (FLT-9)."""
    web = urls.filter(F.lower("url").rlike("^https?://"))
    if hosts.isEmpty():
        return web
    return web.withColumn("host", F.lower(F.regexp_extract("url", "^[^:]+://([^/?#]*)", 1))).join(hosts.select(F.lower("host").alias("host")).distinct(), "host", "left_semi")


def search_results(results: DataFrame, term: str, col: str = "filename") -> DataFrame:
    """Rows whose name contains the term, without regard to case (FLT-10)."""
    return results.filter(F.lower(col).contains(term.lower()))


def filter_media_records(reg: DataFrame, kind: str | None = None, has: str | None = None) -> DataFrame:
    """Rows of a kind, and with a hash column filled; both filters reach the scan (FLT-11)."""
    reg = reg.filter(F.col("media_kind") == kind) if kind else reg
    return reg.filter(F.col(has).isNotNull()) if has else reg


def user_batches(batches: DataFrame, user_id: object) -> DataFrame:
    """FLT-12."""
    return batches.filter(F.col("user_id") == user_id)
