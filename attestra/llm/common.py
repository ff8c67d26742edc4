"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The characters that separate words in the query contracts: space and 0x09-0x0D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_PATTERN = "[ \\t\\n\\x0B\\f\\r]+"


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null and blank texts give an empty array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_PATTERN))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode only, a temporary one where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="attestra-")
        spark.sparkContext.setCheckpointDir(named)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder; a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/attestra-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``, the place of each row in the given order, from 0; rows that the order does not tell apart take turns in any way.

    Rows are dealt to ranges and numbered within them, and each range starts after those before it, so no task numbers them all.
    """
    at, rng = free_name(rows, "at"), free_name(rows, "rng")
    placed = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    placed = placed.withColumn(rng, F.shiftright(at, 33))
    spans = placed.groupBy(F.col(rng).alias("of")).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("many"))
    spans = spans.select("of", (F.sum("many").over(Window.orderBy("of")) - F.col("many") - F.col("first")).alias("shift"))  # a row for each range
    return placed.join(spans, F.col(rng) == F.col("of")).select(*[F.col(f"`{c}`") for c in rows.columns], (F.col(at) + F.col("shift")).alias(name))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has it (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def give_back() -> None:
    """Hands freed memory back to the system. Python workers live on between tasks, and an executor's limit counts what they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function of a task's batches, that ends by giving freed memory back."""

    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
