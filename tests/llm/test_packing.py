import zlib
from collections import defaultdict

import numpy as np
import pytest

from attestra.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["don't it's we'll", "a'sb 'S", "x²½ 3¼", "<|endoftext|> hi", "Σας ΟΔΟΣ", "áb", "naïve_café__x", "İstanbul", "tab\tx\x1cy z\x1f", "", "ǅ Ǆ ß ŉ", "<|x|>", "word|| word?! a.b ...", "x\xadb ĳ", "a b c"]


def test_ids_equal_the_tokenizers(spark):
    from tokenizers import Tokenizer

    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    own = packing.WordTokenizer(PATH, max_words=500)(texts)
    plain = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    assert own == [np.array(e.ids, dtype="<u4").tobytes() for e in plain]


def test_ids_of_every_letter_equal_the_tokenizers():
    """All characters that are taken word by word, alone and between others, in small batches with a small cache."""
    from tokenizers import Tokenizer

    chars = [chr(c) for c in range(1, 0x250)]
    texts = [f"{c} a{c}b {c}{c.upper()}Z, {c}. x{c}" for c in chars] + [f"ab\t{c}\r\n\n d{c}!?" for c in chars] + ["", " ", "\n", "a" * 5000, "é." * 300]
    own = packing.WordTokenizer(PATH, max_words=300)
    got = [x for i in range(0, len(texts), 7) for x in own(texts[i : i + 7])]
    plain = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    assert got == [np.array(e.ids, dtype="<u4").tobytes() for e in plain]


def test_every_constraint_holds_and_every_rank_has_a_place():
    counts = {4096: 3, 4000: 5, 2048: 7, 1500: 4, 900: 30, 96: 11, 5: 400, 1: 50}
    for rule in ("norm", "dot"):
        capacity = (4096, 20, 9_000_000 + 4096**2 - 9_000_000)
        plan = packing.plan_packing(counts, capacity, (1.0, 2.0, 0.5), rule)
        used = defaultdict(list)
        for length, n in counts.items():
            seq, off = plan.places(np.full(n, length), np.arange(n))
            for s, o in zip(seq, off, strict=True):
                used[s].append((o, length))
        assert len(used) == plan.n_sequences
        for places in used.values():
            at = 0
            for o, length in sorted(places):
                assert o == at
                at += length
            assert at <= capacity[0] and len(places) <= capacity[1] and sum(n * n for _, n in places) <= capacity[2]


def test_plan_equals_plain_best_fit_decreasing():
    rng = np.random.default_rng(5)
    lengths = sorted(rng.integers(1, 4097, 3000).tolist(), reverse=True)
    room: list[int] = []
    for n in lengths:
        fit = [r for r in room if r >= n]
        if fit:
            best = min(fit)
            room[room.index(best)] -= n
        else:
            room.append(4096 - n)
    counts = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    assert packing.plan_packing(dict(counts), (4096, 4096, 4096**2)).n_sequences == len(room)


def test_a_piece_that_fits_nowhere_is_an_error():
    with pytest.raises(ValueError, match="exceeds"):
        packing.plan_packing({100: 1}, (4096, 1, 99))
    with pytest.raises(ValueError, match="rule"):
        packing.plan_packing({100: 1}, (4096, 1, 10**9), rule="best")


def test_edges(spark, edge_documents, no_documents):
    from tokenizers import Tokenizer

    out = packing.pack_documents(edge_documents, PATH).collect()
    texts = {r.doc_id: r.text or "" for r in edge_documents.collect()}
    pieces = defaultdict(set)
    for r in out:
        pieces[r.doc_id].add((r.piece, r.start, r.length, r.ids_crc32))
    for doc, text in texts.items():
        ids = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids + [1]
        expected = {(i // 4096, i, len(ids[i : i + 4096]), zlib.crc32(np.array(ids[i : i + 4096], dtype="<u4").tobytes())) for i in range(0, len(ids), 4096)}
        assert pieces[doc] == expected
    assert len(out) == sum(len(pieces[r.doc_id]) for r in edge_documents.collect())
    fill = defaultdict(list)
    for r in out:
        fill[r.sequence_id].append((r.offset, r.length))
    for places in fill.values():
        assert sum(n for _, n in places) <= 4096 and max(o + n for o, n in places) == sum(n for _, n in places)
    assert packing.pack_documents(no_documents, PATH).collect() == []
