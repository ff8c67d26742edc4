"""Online packing against a plain placement over lists, and its sequences against the texts."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from attestra.llm import online_packing, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_windows(lengths, size, many):
    """Fills of the windows emitted, in order, and of those left open: best fit by scanning a list."""
    open_, out = [], []
    for n in lengths:
        while n:
            fit = [w for w in open_ if size - w >= n]
            if n >= size:
                out.append(size)
                n -= size
            elif fit:
                open_.remove(max(fit))
                n, w = 0, max(fit) + n
                out, open_ = (out + [w], open_) if w == size else (out, open_ + [w])
            elif len(open_) < many:
                open_, n = open_ + [n], 0
            else:
                w = max(open_)
                open_.remove(w)
                out.append(size)
                n -= size - w
    return out, open_


@pytest.mark.parametrize(("size", "many", "seed"), [(16, 1, 0), (16, 3, 1), (100, 8, 2), (4096, 64, 3)])
def test_placement_equals_a_plain_loop(size, many, seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, rng.randrange(1, size // 2), rng.randrange(1, size + 1), size, 3 * size + 1]) for _ in range(500)]
    packer, done = online_packing.OnlinePacker(size, many), []
    ids = {k: np.arange(k, k + n, dtype="<u4").tobytes() for k, n in enumerate(lengths)}
    for k, x in ids.items():
        done += packer.place(k, x)
        assert len(packer._room) <= many
    emitted, left = plain_windows(lengths, size, many)
    assert len(done) == len(emitted) and all(full for _, _, full in done)
    assert sorted(size - room for room, _ in packer._room) == sorted(left)
    done += packer.rest()
    assert [full for _, _, full in done].count(False) == (sum(lengths) % size > 0)
    back = defaultdict(dict)
    for _, pieces, full in done:
        at = 0
        for key, start, n, total, part, offset in pieces:
            assert offset == at and len(part) == 4 * n and total == lengths[key]
            at += n
            back[key][start] = part
        assert (at == size) == full and at <= size
    assert {k: b"".join(back[k][s] for s in sorted(back[k])) for k in ids} == ids


def test_without_topping_up_only_long_documents_are_cut():
    rng = random.Random(5)
    lengths = [rng.randrange(1, 250) for _ in range(300)]
    packer, done = online_packing.OnlinePacker(100, 4, top_up=False), []
    for k, n in enumerate(lengths):
        done += packer.place(k, bytes(4 * n))
    done += packer.rest()
    assert sum(len(p) for _, p, _ in done) == sum(-(-n // 100) for n in lengths)
    assert all(sum(x[2] for x in p) <= 100 for _, p, _ in done) and sum(x[2] for _, p, _ in done for x in p) == sum(lengths)


def test_tails_are_powers_of_two():
    for total in [0, 1, 2, 3, 4095, 4096, 4097, 3 * 4096 + 1234]:
        starts = online_packing.tail_starts(total, 4096)
        sizes = [b - a for a, b in zip(starts, [*starts[1:], total], strict=False)]
        assert sum(sizes) == total % 4096 and all(n & (n - 1) == 0 for n in sizes) and len(sizes) <= 12


def check(rows, texts, end, size=4096):
    """Every id of every text lies in one piece, sequences have no gaps and no padding."""
    from tokenizers import Tokenizer

    tokenizer, pieces, fill = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        fill[r.sequence_id].append((r.offset, r.length))
    for doc, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        own, at = sorted(pieces[doc]), 0
        for start, length, crc, total in own:
            assert start == at and total == len(ids) and length > 0
            assert crc == zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes())
            at += length
        assert at == len(ids)
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at == size or at & (at - 1) == 0 and at < size
    return fill


def test_query_covers_all_documents_without_padding(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
        rows = queries.op13_online_packing(spark, sf).collect()
        fill = check(rows, docs, 2)
        total = sum(r.length for r in rows)
        assert len(fill) <= total // 4096 + 12
        assert len(rows) < len(docs) + 2 * len(fill)  # most documents stay whole


def test_leftovers_of_many_tasks_are_merged(spark):
    docs = [(i, "word " * (i * 37 % 700)) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(40)
    rows = online_packing.pack_online(df, PATH, windows=3, with_ids=True).collect()
    fill = check(rows, docs, 2)
    assert len(fill) <= sum(r.length for r in rows) // 4096 + 12
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)


def test_edges(spark, edge_documents, no_documents):
    out = online_packing.pack_online(edge_documents, PATH)
    rows = out.collect()
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    twice = [r for r in rows if r.doc_id == 1]
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens  # repeated rows are packed once each
    texts = {r.doc_id: r.text for r in edge_documents.collect()}
    for doc in texts:
        own = [r for r in rows if r.doc_id == doc]
        assert sum(r.length for r in own) == own[0].doc_tokens * (2 if doc == 1 else 1)
    assert online_packing.pack_online(no_documents, PATH).collect() == []
