"""WARC archives compressed with a dictionary of their own records (operator 3).

Layout of an archive (as in the public draft for Zstandard-compressed WARC): a leading skippable frame of magic number
0x184D2A5D holds the dictionary; every record is then one Zstandard frame that uses it, so a record can be read alone.
Archives are built by the tasks, each from its own rows, and written in the shared folder under names that depend on
their content, so a task that runs twice writes the same files.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, shared_dir

#: Fixed value: the skippable frame that holds the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
CRLF = b"\r\n"


def record_bytes(kind: str, record_id: str, uri: str, date: str, payload: bytes, digest: str, length: int, refers_to: str | None, page_id: str) -> bytes:
    """One WARC/1.1 record. A revisit has an empty block and says to which record and digest it refers."""
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-Id", page_id),
    ]
    if kind == "revisit":
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers_to}>"), ("X-Payload-Length", str(length))]
        payload = b""
    else:
        headers.append(("Content-Type", "text/html; charset=utf-8"))
    headers.append(("Content-Length", str(len(payload))))
    head = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + head.encode() + CRLF + payload + CRLF + CRLF


def parsed_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record; raises if its lengths do not add up."""
    head, _, rest = data.partition(CRLF + CRLF)
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(headers["content-length"])
    if rest[n:] != CRLF + CRLF:
        raise ValueError(f"record {headers.get('warc-record-id')} is cut short or too long")
    return headers, rest[:n]


def archive_bytes(records: list[bytes], dictionary_bytes: int = 64 << 10, level: int = 3) -> bytes:
    """An archive of these records. Where they are too few or too alike to train a dictionary, the beginning of the first
    ones is the dictionary, as raw content."""
    import zstandard as zstd

    size = max(512, min(dictionary_bytes, sum(map(len, records)) // 20))
    try:
        dictionary = zstd.train_dictionary(size, records, k=256, d=8, f=18, accel=4, level=level).as_bytes()
    except zstd.ZstdError:  # too little material
        dictionary = b"".join(r[:size] for r in records[:8])[:size]
    options = {"dict_data": zstd.ZstdCompressionDict(dictionary)} if dictionary else {}  # none only where there is no record
    compressor = zstd.ZstdCompressor(level=level, write_checksum=True, write_content_size=True, **options)
    head = DICTIONARY_MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary
    return head + b"".join(compressor.compress(r) for r in records)


def archive_records(data: bytes) -> Iterator[bytes]:
    """The records of an archive, in order."""
    import zstandard as zstd

    if int.from_bytes(data[:4], "little") != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    at = 8 + int.from_bytes(data[4:8], "little")
    options = {"dict_data": zstd.ZstdCompressionDict(data[8:at])} if at > 8 else {}
    decompressor = zstd.ZstdDecompressor(**options)
    view = memoryview(data)
    while at < len(data):
        one = decompressor.decompressobj()
        out, start = [], at
        while not one.eof:
            if at >= len(data):
                raise ValueError("the last frame is cut short")
            out.append(one.decompress(view[at : at + (1 << 16)]))
            at += min(1 << 16, len(data) - at)
        at -= len(one.unused_data)
        if at <= start:
            raise ValueError("empty frame")
        yield b"".join(out)


def _put(folder: str, name: str, data: bytes) -> str:
    """Writes a file in a folder of any file system, in one step from the readers' view."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        where, path = fs.FileSystem.from_uri("file://" + urlparse(folder).path if folder.startswith("file:") else folder)
    else:
        where, path = fs.LocalFileSystem(), folder
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(draft) as out:
        out.write(data)
    where.move(draft, f"{path}/{name}")
    return f"{folder}/{name}"


def with_revisits(pages: DataFrame, id_col: str, payload: Column, least_bytes: int = 1000, url_col: str = "url") -> DataFrame:
    """``pages`` as (id, uri, payload, digest, response): response is the largest id with an equal payload if that has
    ``least_bytes`` or more, else the row's own. Rows that share an id are one page and stay together."""
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("uri"), F.coalesce(payload, F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.length("payload").cast("long"))
    many = rows.filter(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return rows.join(many, ["digest", "bytes"], "left").select("id", "uri", "payload", "digest", "bytes", F.coalesce("response", "id").alias("response"))


def _record_id(page: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}"


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", payload_col: str = "html", archive_size: int = 16 << 20, date: str = "2024-01-01T00:00:00Z", url_col: str = "url") -> DataFrame:
    """Writes every page to an archive in ``folder`` (default: a new one in the shared folder) and returns the manifest
    (path, records, bytes, dictionary bytes), already computed.

    Null payloads and urls are empty; rows of one id are records of one page: they share its record id, and
    each of them with the response's payload is a response; an empty table writes nothing; other columns are not read. Archives are closed
    at about ``archive_size`` bytes of records, so a task holds one at a time.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    spark = pages.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    rows = with_revisits(pages, id_col, F.col(payload_col), url_col=url_col).select(F.col("id").cast("string").alias("id"), "uri", "payload", "digest", "bytes", F.col("response").cast("string").alias("response"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        size = 0

        def closed() -> pd.DataFrame:
            data = archive_bytes(held)
            path = _put(folder, f"{hashlib.sha256(data).hexdigest()[:40]}.warc.zst", data)
            return pd.DataFrame([(path, len(held), len(data), int.from_bytes(data[4:8], "little"))], columns=["path", "records", "bytes", "dictionary_bytes"])

        for batch in batches:
            for i, uri, payload, digest, n, response in batch.itertuples(index=False):
                i = "" if i is None else i
                revisit = response is not None and response != i
                held.append(record_bytes("revisit" if revisit else "response", _record_id(i), uri, date, payload, digest, n, _record_id(response) if revisit else None, i))
                size += len(held[-1])
                if size >= archive_size:
                    yield closed()
                    held, size = [], 0
        if held:
            yield closed()

    return checkpointed(rows.mapInPandas(run, "path string, records long, bytes long, dictionary_bytes long"))


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the archives in a manifest: page_id (string), record_id, record_type, refers_to, uri, payload and
    the digest and length that its headers state (the length only of revisits)."""
    spark = manifest.sparkSession
    folder = manifest.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).limit(1).collect()
    fields = "page_id string, record_id string, record_type string, refers_to string, uri string, payload binary, stated_digest string, stated_length long"
    if not folder:
        return spark.createDataFrame([], fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for data in archive_records(content):
                    h, block = parsed_record(data)
                    rows.append((h["x-page-id"], h["warc-record-id"], h["warc-type"], h.get("warc-refers-to"), h["warc-target-uri"], block, h["warc-payload-digest"].removeprefix("sha1:"), int(h.get("x-payload-length", -1))))
                    if len(rows) == 500:
                        yield pd.DataFrame(rows, columns=[x.split()[0] for x in fields.split(", ")])
                        rows = []
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in fields.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder[0]["folder"])
    named = files.select("content", F.element_at(F.split("path", "/"), -1).alias("name")).join(manifest.select(F.element_at(F.split("path", "/"), -1).alias("name")).distinct(), "name", "left_semi")
    return named.select("content").mapInPandas(run, fields)


def read_back(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to. A revisit's payload is that of its response.

    Records of one page stay rows of their own; an empty manifest gives no rows; pages of null id have a null page_id.
    """
    records = read_archives(manifest).select("page_id", "record_id", "record_type", "refers_to", F.length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("digest"))
    records = checkpointed(records)
    target = records.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.min(F.struct("page_id", "bytes", "digest")).alias("r"))
    revisits = records.filter("record_type = 'revisit'").drop("bytes", "digest").join(target, "refers_to", "left")
    own = records.filter("record_type = 'response'")
    out = own.select("page_id", "bytes", "digest", "record_type", F.lit(None).cast("string").alias("to"))
    out = out.unionByName(revisits.select("page_id", F.col("r.bytes").alias("bytes"), F.col("r.digest").alias("digest"), "record_type", F.col("r.page_id").alias("to")))
    page = lambda c: F.when(F.col(c) != "", F.col(c)).cast(id_type)
    return out.select(page("page_id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", page("to").alias("refers_to"))
