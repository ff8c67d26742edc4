import hashlib
import struct
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from attestra.llm import tiff, warc


def test_archive_layout_and_round_trip():
    records = [warc.record_bytes("response", f"urn:{i}", "http://x/\r\nEvil: 1", "2024-01-01T00:00:00Z", f"<html>{i} {'shared words ' * 60}".encode(), "ab", 5, None, str(i)) for i in range(400)]
    data = warc.archive_bytes(records)
    assert data[:4] == bytes.fromhex("5d2a4d18")
    n = int.from_bytes(data[4:8], "little")
    assert n > 0 and list(warc.archive_records(data)) == records
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n])).decompressobj()
    assert one.decompress(data[8 + n :]) == records[0]
    headers, block = warc.parsed_record(records[3])
    assert headers["warc-target-uri"] == "http://x/ Evil: 1" and block.startswith(b"<html>3") and "evil" not in headers
    assert list(warc.archive_records(warc.archive_bytes([]))) == []
    with pytest.raises(ValueError):
        list(warc.archive_records(data[:-5]))
    with pytest.raises(ValueError):
        warc.parsed_record(records[0][:-1])


def test_pages_are_read_back(spark):
    big, small = "<p>" + "same " * 300, "<p>small"
    rows = [(1, "http://a/", big), (2, None, big), (5, "u", big), (3, "http://b/", small), (4, "http://b/", small), (6, "", None), (7, "x", ""), (8, "x", "é" * 600), (9, "y", "é" * 499)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS digest", "1 AS id", "2 AS payload")
    manifest = warc.write_archives(pages, archive_size=2000)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_back(manifest).collect()}
    for page, _, html in rows:
        data = (html or "").encode()
        to = 5 if page in (1, 2) else None
        assert got[page] == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if to else "response", to)
    assert manifest.count() > 1 and manifest.agg({"records": "sum"}).first()[0] == len(rows)
    empty = pages.limit(0)
    assert warc.read_back(warc.write_archives(empty)).collect() == []


CODECS = [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS]


@pytest.mark.parametrize("codec", CODECS)
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("layout", [{}, {"strip_rows": 7}, {"tile": 16}])
def test_round_trip(codec, predictor, layout):
    rng = np.random.default_rng(codec)
    images = [rng.integers(0, 256, (37, 50), dtype=np.uint8), np.zeros((100, 64), np.uint8), rng.integers(0, 3, (9, 3), dtype=np.uint8)]
    pages = list(tiff.pages(tiff.encoded(images, codec, predictor, **layout)))
    assert [p.index for p in pages] == [0, 1, 2]
    for p, image in zip(pages, images, strict=True):
        assert (p.samples[:, :, 0] == image).all() and (p.height, p.width) == image.shape


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 40))
def test_codecs(data, times):
    data = data * times
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
    assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data


def hand_made(order, bits, samples, per, predictor, kind, planar=1):
    """A file with one uncompressed strip per plane, written field by field."""
    height, width = samples.shape[:2]
    planes = [samples[:, :, i : i + 1] for i in range(per)] if planar == 2 else [samples]
    body = [p.tobytes() for p in planes]
    at, offsets = 8, []
    for b in body:
        offsets.append(at)
        at += len(b)
    fields = [(256, 4, [width]), (257, 4, [height]), (258, 3, [bits] * per), (259, 3, [1]), (262, 3, [1]), (273, 4, offsets), (277, 3, [per]), (278, 4, [height]), (279, 4, [len(b) for b in body]), (284, 3, [planar]), (317, 3, [predictor]), (339, 3, [kind] * per)]
    entries, extra = b"", b""
    end = at + 2 + 12 * len(fields) + 4
    for tag, t, values in fields:
        raw = struct.pack(f"{order}{len(values)}{'H' if t == 3 else 'I'}", *values)
        if len(raw) > 4:
            raw, extra = struct.pack(order + "I", end + len(extra)), extra + raw
        entries += struct.pack(order + "HHI", tag, t, len(values)) + raw.ljust(4, b"\0")
    mark = b"II" if order == "<" else b"MM"
    return mark + struct.pack(order + "HI", 42, at) + b"".join(body) + struct.pack(order + "H", len(fields)) + entries + b"\0\0\0\0" + extra


@pytest.mark.parametrize("order", ["<", ">"])
def test_byte_orders_sample_sizes_and_predictors(order):
    rng = np.random.default_rng(2)
    for bits in (8, 16, 32):
        image = rng.integers(0, 2**bits, (5, 6, 3)).astype(f"{order}u{bits // 8}")
        for planar in (1, 2):
            (p,) = tiff.pages(hand_made(order, bits, image, 3, 1, 1, planar))
            assert (p.samples == image).all()
        stored = image.copy()
        stored[:, 1:] = image[:, 1:] - image[:, :-1]
        (p,) = tiff.pages(hand_made(order, bits, stored, 3, 2, 1))
        assert (p.samples == image).all()
    floats = rng.normal(size=(4, 5, 1)).astype(">f4")
    planes = np.frombuffer(floats.tobytes(), dtype=np.uint8).reshape(4, 5, 4).transpose(0, 2, 1).reshape(4, 20)
    stored = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).reshape(4, 20, 1)
    data = hand_made(order, 32, floats, 1, 3, 3)
    at = data.index(floats.tobytes())
    (p,) = tiff.pages(data[:at] + stored.tobytes() + data[at + 80 :])
    assert np.array_equal(p.samples, floats.astype("f4"))


def test_pages_of_a_column(spark):
    image = np.arange(64 * 3, dtype=np.uint8).reshape(3, 64)
    rows = [(1, bytearray(tiff.encoded([image, image[:1]]))), (2, None), (3, bytearray(b"no tiff")), (4, bytearray(tiff.encoded([image])[:-30])), (None, bytearray(tiff.encoded([image], tiff.LZW)))]
    got = tiff.page_rows(spark.createDataFrame(rows, "doc_id long, media binary"), "doc_id", "media").collect()
    assert sorted(((str(r.doc_id), r.page, r.error is None) for r in got), key=str) == sorted([("1", 0, True), ("1", 1, True), ("3", None, False), ("4", None, False), ("None", 0, True)], key=str)
    assert bytes(next(r for r in got if r.doc_id == 1 and r.page == 0).samples) == image.tobytes()


def test_texts_are_stored_and_read_back(spark, edge_documents, no_documents):
    texts = [(r.doc_id, (r.text or "").encode()) for r in edge_documents.collect()]
    got = tiff.text_media(edge_documents).collect()
    expected = []
    for doc, data in texts:
        padded = data + b"\0" * (-len(data) % 64 or (64 if not data else 0))
        expected.append((str(doc), len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(expected)
    assert len({(r.media_sha256, r.feature) for r in got}) == len({d for _, d in texts})
    assert tiff.text_media(no_documents).collect() == []
    payload = bytes(range(256)) * 40
    media = tiff.stored(payload, page_rows=50)
    assert b"".join(p.samples.tobytes() for p in tiff.pages(media)) == payload and len(list(tiff.pages(media))) == 4


def test_small_archives_have_a_dictionary():
    records = [b"WARC/1.1 first record with some text in it", b"WARC/1.1 second record with some text in it"]
    for n in (1, 2):
        data = warc.archive_bytes(records[:n])
        assert int.from_bytes(data[4:8], "little") > 0 and list(warc.archive_records(data)) == records[:n]


def test_any_damage_gives_an_error_row(spark):
    """Each byte of a small file is set to 0 and 255: a page is read or the error is reported, and no job fails."""
    image = np.arange(64 * 20, dtype=np.uint32).astype(np.uint8).reshape(20, 64)
    files = []
    for layout in ({"strip_rows": 7}, {"tile": 16}):
        good = tiff.encoded([image], tiff.DEFLATE, 2, **layout)
        at = struct.unpack("<I", good[4:8])[0]
        files += [good[:i] + bytes([v]) + good[i + 1 :] for i in range(at, len(good)) for v in (0, 255)]
    df = spark.createDataFrame(list(enumerate(files)), "doc_id long, media binary")
    rows = tiff.page_rows(df, "doc_id", "media").select("doc_id", "page", "error").collect()
    assert {r.doc_id for r in rows} == set(range(len(files)))
    assert all((r.page is None) == (r.error is not None) for r in rows) and sum(r.error is not None for r in rows) > 50
    assert tiff.page_rows(df.limit(0), "doc_id", "media").collect() == []
