"""TIFF columns (operator 6): image directories walked, strips and tiles decoded, predictors undone, one row per page.

Read are classic TIFF of either byte order, uncompressed, PackBits, LZW and deflate data, strips and tiles, chunky and planar
samples of 8, 16, 32 or 64 bits (1, 2 and 4 bits unpacked), horizontal and floating-point predictors. Written are grey
8-bit pages, deflated with the horizontal predictor or by another of the codecs.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags, field types and compression schemes of the TIFF 6.0 specification.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
FIELD_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
FIELD_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[at]))
            at += run
            continue
        start = at
        while at < len(data) and at - start < 128 and not (at + 2 < len(data) and data[at] == data[at + 1] == data[at + 2]):
            at += 1
        out += bytes((at - start - 1,)) + data[start:at]
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, most significant first, one earlier than the table needs them; 256 clears, 257 ends."""
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, out, made = base[:], [], 0
    width, held, bits, last = 9, 0, 0, None
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 256:
            table, width, last = base[:], 9, None
            continue
        if code == 257:
            break
        if last is None:
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                raise ValueError("LZW code beyond the table")
            table.append(last + entry[:1])
            width = min(12, (len(table) + 1).bit_length())
        last = entry
        out.append(entry)
        made += len(entry)
        if made >= size:
            break
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    table = {bytes((i,)): i for i in range(256)}
    width, size, prefix = 9, 258, b""
    put(256, width)
    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if longer in table:
            prefix = longer
            continue
        put(table[prefix], width)
        table[longer] = size
        size += 1
        if size == 4094:
            put(256, width)
            table, width, size = {bytes((k,)): k for k in range(256)}, 9, 258
        else:
            width = max(9, size.bit_length())
        prefix = data[i : i + 1]
    if prefix:
        put(table[prefix], width)
        width = min(12, max(9, (size + 1).bit_length()))
    put(257, width)
    if bits:
        out.append((held << (8 - bits)) & 0xFF)
    return bytes(out)


def _decompressed(scheme: int, data: bytes, size: int) -> bytes:
    if scheme == NONE:
        out = data
    elif scheme in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    elif scheme == PACKBITS:
        out = unpack_bits(data, size)
    elif scheme == LZW:
        out = lzw_decode(data, size)
    else:
        raise ValueError(f"compression {scheme} is not supported")
    if len(out) < size:
        raise ValueError(f"{len(out)} bytes where {size} are due")
    return out[:size]


@dataclass
class Page:
    """One directory: samples as (height, width, samples per pixel)."""

    index: int
    width: int
    height: int
    bits: int
    compression: int
    predictor: int
    samples: np.ndarray


def _directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind not in FIELD_CODE:
                continue
            size = FIELD_SIZE[kind] * count
            where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            tags[tag] = struct.unpack_from(f"{order}{count}{FIELD_CODE[kind]}", data, where)
        yield order, tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def _block(raw: bytes, order: str, rows: int, cols: int, per: int, bits: int, kind: int, predictor: int) -> np.ndarray:
    """Samples of a decompressed strip or tile as (rows, cols, per), its predictor undone."""
    if bits < 8:
        line = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(rows, -1), axis=1)[:, : cols * per * bits]
        return (line.reshape(rows, cols, per, bits) @ (1 << np.arange(bits - 1, -1, -1))).astype(np.uint8)
    size = bits // 8
    if predictor == 3:  # bytes of each row in planes, most significant first, differenced
        planes = np.cumsum(np.frombuffer(raw, dtype=np.uint8).reshape(rows, size * cols, per), axis=1, dtype=np.uint8).reshape(rows, size, cols * per)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{size}").reshape(rows, cols, per).astype(f"f{size}")
    out = np.frombuffer(raw, dtype=f"{order}{'f' if kind == 3 else 'i' if kind == 2 else 'u'}{size}").reshape(rows, cols, per)
    if predictor == 2:
        out = np.cumsum(out.view(f"{order}u{size}"), axis=1, dtype=f"u{size}").view(out.dtype.newbyteorder("="))
    return out


def pages(data: bytes) -> Iterator[Page]:
    """The pages of a TIFF file in the order of its directories; raises ValueError where it is not one or damaged."""
    for index, (order, tags) in enumerate(_directories(data)):
        one = lambda tag, default=None: tags[tag][0] if tag in tags else default
        width, height, per = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
        bits, scheme, predictor, kind = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1), one(SAMPLE_FORMAT, 1)
        if len(set(tags.get(BITS, (bits,)))) > 1 or bits not in (1, 2, 4, 8, 16, 32, 64):
            raise ValueError("samples of mixed or odd sizes are not supported")
        if not (width and height and per and width > 0 and height > 0 and per > 0):
            raise ValueError("no size")
        tiled = TILE_OFFSETS in tags
        tw, th = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
        if not (tw and th and tw > 0 and th > 0):
            raise ValueError("strips or tiles of no size")
        offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags.get(STRIP_BYTES))
        planes, inside = (per, 1) if one(PLANAR, 1) == 2 else (1, per)
        across, down = -(-width // tw), -(-height // th)
        if len(offsets) != planes * across * down or sizes and len(sizes) != len(offsets):
            raise ValueError(f"{len(offsets)} strips or tiles where {planes * across * down} are due")
        out = None
        for k, at in enumerate(offsets):
            plane, place = divmod(k, across * down)
            y, x = th * (place // across), tw * (place % across)
            rows = th if tiled else min(th, height - y)
            raw = _decompressed(scheme, data[at : at + sizes[k]] if sizes else data[at:], rows * -(-tw * inside * bits // 8))
            block = _block(raw, order, rows, tw, inside, bits, kind, predictor)
            if out is None:
                if len(offsets) == 1 and not tiled:
                    out = block
                    break
                out = np.zeros((height, width, per), dtype=block.dtype.newbyteorder("="))
            part = out[y : y + rows, x : x + tw]
            part[:, :, plane : plane + inside] = block[: part.shape[0], : part.shape[1]]
        yield Page(index, width, height, bits, scheme, predictor, out if out is not None else np.zeros((height, width, per), dtype=np.uint8))


def encoded(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, tile: int | None = None, strip_rows: int = 0, level: int = 1) -> bytes:
    """A little-endian TIFF file of grey 8-bit images (height, width), one page each."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for image in images:
        height, width = image.shape
        rows = strip_rows or height
        if tile:
            blocks = [np.pad(image[y : y + tile, x : x + tile], ((0, max(0, tile - (height - y))), (0, max(0, tile - (width - x))))) for y in range(0, height, tile) for x in range(0, width, tile)]
        else:
            blocks = [image[y : y + rows] for y in range(0, height, rows)]
        offsets, sizes = [], []
        for block in blocks:
            block = np.ascontiguousarray(block)
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            raw = block.tobytes()
            done = {NONE: lambda r: r, DEFLATE: lambda r: zlib.compress(r, level), LZW: lzw_encode, PACKBITS: pack_bits}[compression](raw)
            offsets.append(len(out))
            sizes.append(len(done))
            out += done + b"\0" * (len(done) % 2)
        layout = [(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, sizes)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows]), (STRIP_BYTES, 4, sizes)]
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor]), *layout]
        entries = bytearray()
        for tag, kind, values in sorted(fields):
            packed = struct.pack(f"<{len(values)}{FIELD_CODE[kind]}", *values)
            if len(packed) > 4:
                at = len(out)
                out += packed
                packed = struct.pack("<I", at)
            entries += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def average_hash(image: np.ndarray) -> str:
    """64 bits in hex: which cells of an 8x8 grid are brighter than the mean of all cells."""
    height, width = image.shape
    if height < 8 or width < 8:
        image = np.repeat(np.repeat(image, -(-8 // height), axis=0), -(-8 // width), axis=1)
        height, width = image.shape
    rows = np.add.reduceat(image.astype(np.int64), np.arange(8) * height // 8, axis=0)
    cells = np.add.reduceat(rows, np.arange(8) * width // 8, axis=1) / np.outer(np.diff(np.append(np.arange(8) * height // 8, height)), np.diff(np.append(np.arange(8) * width // 8, width)))
    return np.packbits((cells > cells.mean()).ravel()).tobytes().hex()


def text_payload(text: str | bytes | None) -> tuple[int, bytes]:
    """Bytes of a text, and the payload: its UTF-8 padded with zeros to a positive multiple of 64."""
    data = text.encode() if isinstance(text, str) else bytes(text or b"")
    return len(data), data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


#: How a payload may be stored: compression, predictor, tile size and rows of a strip.
LAYOUTS = [(DEFLATE, 2, None, 0), (DEFLATE, 2, 64, 0), (PACKBITS, 1, None, 256), (LZW, 2, None, 256)]


def stored(payload: bytes, page_rows: int = 1 << 16) -> bytes:
    """A payload as grey pages 64 samples wide, of at most ``page_rows`` rows, in the layout that its hash picks."""
    image = np.frombuffer(payload, dtype=np.uint8).reshape(-1, 64)
    compression, predictor, tile, strip_rows = LAYOUTS[zlib.crc32(payload) % len(LAYOUTS)]
    return encoded([image[y : y + page_rows] for y in range(0, len(image), page_rows)], compression, predictor, tile, strip_rows)


def page_rows(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per page of the TIFF in ``media_col``: id_col, page, width, height, bits, compression, predictor, samples
    (bytes, rows of pixels of samples, native order) and ahash (of the first sample). Null media have no pages; media that
    are not TIFF or damaged in any way give one row with page null and the reason in ``error``. Repeated rows and null ids are
    kept; an empty table gives no rows; other columns are not read."""
    kind = df.schema[id_col].dataType.simpleString()
    fields = f"k {kind}, page int, width int, height int, bits int, compression int, predictor int, samples binary, ahash string, error string"
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, media in zip(batch["k"].array, batch["m"].array, strict=True):
                if media is None:
                    continue
                rows = []
                try:
                    for p in pages(media):
                        grey = p.samples[:, :, 0]
                        rows.append((key, p.index, p.width, p.height, p.bits, p.compression, p.predictor, p.samples.tobytes(), average_hash(grey) if grey.size else None, None))
                except Exception as e:  # whatever a damaged file leads to is that file's row
                    rows = [(key, *[None] * 8, f"{type(e).__name__}: {e}"[:200])]
                frame = pd.DataFrame(rows, columns=names)
                yield frame.astype({c: "Int64" for c in names[1:7]})

    return df.select(F.col(id_col).alias("k"), F.col(media_col).alias("m")).mapInPandas(run, fields).withColumnRenamed("k", id_col)


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as a TIFF, reads the file back and computes features of what was read.

    Returns id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and n_pages. Null
    texts are empty (64 zero bytes); equal texts give equal values; repeated rows and null ids are kept; an empty table
    gives no rows; other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    fields = f"k {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["k"].array, batch["t"].array, strict=True):
                n, payload = text_payload(text)
                media = stored(payload)
                read = [p.samples[:, :, 0] for p in pages(media)]
                back = b"".join(x.tobytes() for x in read)
                first = np.frombuffer(back, dtype=np.uint8)
                feature = f"{'-'.join(average_hash(x) for x in read)}:{int(first.sum(dtype=np.int64)) // len(first)}:{int(np.abs(np.diff(first.astype(np.int16))).sum(dtype=np.int64)) // len(first)}"
                rows.append((key, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(read)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in fields.split(", ")])

    return df.select(F.col(id_col).alias("k"), F.col(text_col).cast("binary").alias("t")).mapInPandas(run, fields).withColumnRenamed("k", id_col)
