"""The registry of verified media: reading, appending, schema evolution, and the other file sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REGISTRY_COLUMNS = ["id", "fingerprint", "fingerprint_algorithm", "original_filename", "file_size", "file_type", "media_kind", "upload_date", "ip_address"]


def ingest_media(spark: SparkSession, paths: str) -> DataFrame:
    """Files as (path, size, sha256), read where they lie (SRC-1)."""
    return hashed_media(spark.read.format("binaryFile").load(paths).select("path", "content"))


def hashed_media(files: DataFrame) -> DataFrame:
    """The size in bytes and the SHA-256 of each row's ``content``, beside its other columns (SRC-1)."""
    kept = [c for c in files.columns if c != "content"]
    return files.select(*kept, F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry's columns of a Parquet table; columns that an older table lacks are null (SRC-2, SRC-4)."""
    return evolve_registry(spark.read.option("mergeSchema", "true").parquet(path))


def evolve_registry(reg: DataFrame) -> DataFrame:
    """Adds the columns ``phash`` and ``audio_fingerprint`` where they are missing; harmless when repeated (SRC-4)."""
    for name in ("phash", "audio_fingerprint"):
        if name not in reg.columns:
            reg = reg.withColumn(name, F.lit(None).cast("string"))
    return reg


def append_registry(rows: DataFrame, reg: DataFrame, now: Column, order: list[str], chunks: int = 64) -> DataFrame:
    """The rows to append, with the next ids in the order of ``order``, and defaults for what they lack (SRC-3).

    Ids are dealt by range: rows are numbered within ranges and each range starts after those before it, so no task
    numbers them all.
    """
    top = reg.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    placed = rows.repartitionByRange(chunks, *order).withColumn("part__", F.spark_partition_id()).sortWithinPartitions(*order)
    per = placed.groupBy("part__").agg(F.count(F.lit(1)).alias("n__"))
    per = per.select("part__", (F.sum("n__").over(Window.orderBy("part__")) - F.col("n__")).alias("before__"))  # one row a range
    local = F.row_number().over(Window.partitionBy("part__").orderBy(*order))
    out = placed.withColumn("local__", local).join(per, "part__").withColumn("id", F.lit(top) + F.col("before__") + F.col("local__"))
    given = set(rows.columns)
    defaults = {"fingerprint_algorithm": F.lit("sha256"), "ip_address": F.lit(None).cast("string"), "upload_date": now}
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(F.col(name), value) if name in given else value)
    return out.drop("part__", "local__", "before__")


def read_url_list(lines: DataFrame, category: str, line_col: str = "value") -> DataFrame:
    """Urls of a list, trimmed, without blank lines and ``#`` comments (SRC-5)."""
    url = F.trim(F.col(line_col))
    return lines.select(url.alias("url")).filter((F.col("url") != "") & ~F.col("url").startswith("#")).withColumn("category", F.lit(category))


#: What is read of a detector's JSON; missing fields are null, malformed text gives nulls throughout.
VISION_SCHEMA = (
    "web_detection struct<full_matching_images:array<struct<url:string>>,partial_matching_images:array<struct<url:string>>,pages_with_matching_images:array<struct<url:string>>>,"
    "safe_search struct<adult:string,violence:string>,labels array<struct<description:string,score:double>>,faces struct<count:int>"
)


def read_detector_json(df: DataFrame, json_col: str, schema: str, into: str) -> DataFrame:
    """Parses a JSON column by an explicit schema, as DDL (SRC-6)."""
    return df.withColumn(into, F.from_json(json_col, schema, {"mode": "PERMISSIVE"}))


def csv_cell(c: Column) -> Column:
    """A value quoted as CSV wants it where it holds a comma, a quote or a line break."""
    return F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


#: The header of a batch's CSV.
CSV_HEADER = ["#", "Filename", "Status", "File ID", "Size (KB)", "Dimensions", "Format", "SHA-256", "Perceptual Hash", "Duplicates", "Duplicate Details", "Error", "Processing Time (ms)"]


def export_batch_csv(results: DataFrame) -> DataFrame:
    """The lines of each batch's CSV (SRC-7): the header at index -1, then one for each result.

    Expects batch_id, index, filename, status, file_id, size, width, height, format, sha256, phash, matches
    array<struct<filename,similarity>>, error and avg_ms (of the batch). What is missing prints as an em dash, a missing hash
    as ``undefined...``, and missing details and errors as nothing.
    """
    dash, none = F.lit("—"), F.lit("")
    percent = lambda m: F.floor(m["similarity"] * 100 + 0.5)
    many = F.coalesce(F.size("matches"), F.lit(0))
    short = lambda c: F.concat(F.coalesce(F.substring(c, 1, 16), F.lit("undefined")), F.lit("..."))
    cells = [
        (F.col("index") + 1).cast("string"),
        F.coalesce("filename", F.lit("undefined")),
        F.coalesce("status", F.lit("undefined")),
        F.coalesce("file_id", dash),
        F.when(F.col("size") > 0, F.floor(F.col("size") / 1024 + 0.5).cast("string")).otherwise(dash),
        F.when((F.col("width") > 0) & (F.col("height") > 0), F.concat("width", F.lit("×"), "height")).otherwise(dash),
        F.coalesce(F.upper("format"), dash),
        short("sha256"),
        short("phash"),
        many.cast("string"),
        F.when(many > 0, F.array_join(F.transform("matches", lambda m: F.format_string("%s (%d%%)", m["filename"], percent(m))), "; ")).otherwise(none),
        F.coalesce("error", none),
        F.coalesce(F.col("avg_ms").cast("string"), F.lit("undefined")),
    ]
    lines = results.select("batch_id", F.col("index").cast("long").alias("index"), F.concat_ws(",", *[csv_cell(c) for c in cells]).alias("line"))
    heads = results.select("batch_id").distinct().select("batch_id", F.lit(-1).cast("long").alias("index"), F.lit(",".join(CSV_HEADER)).alias("line"))
    return heads.unionByName(lines)


def export_batch_json(df: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON document per batch with its results in the order of ``columns`` (SRC-8). A batch admits 100 files at most
    (FLT-2), which bounds what is gathered."""
    rows = df.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("results"))
    return rows.select("batch_id", F.to_json(F.struct("batch_id", "results")).alias("json"))
