"""The manifest against a plain tree that keeps every node."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from attestra.llm import merkle, queries

H = lambda *x: sha256("".join(x).encode()).hexdigest()
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def plain_leaf(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes, fanout):
    """The root, and the run of each node with its place in it, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            paths[i].append((nodes[k - k % fanout : k - k % fanout + fanout], k % fanout))
        at = [k // fanout for k in at]
        nodes = [H(*nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)]
    return nodes[0], paths


def plain_manifest(rows, fanout=2):
    """(doc_id, leaf, subroot, root, siblings, path) of each row."""
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, plain_leaf(r), r[0]))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: plain_tree([leaf for _, _, leaf, _ in sorted(by_lang[x], key=lambda r: r[:3])], fanout) for x in langs}
    root, tops = plain_tree([trees[x][0] for x in langs], fanout) if langs else (None, [])
    out = []
    for x, top in zip(langs, tops, strict=True):
        for (_, _, leaf, doc), path in zip(sorted(by_lang[x], key=lambda r: r[:3]), trees[x][1], strict=True):
            path = path + top
            out.append((doc, leaf, trees[x][0], root, H(*[n for run, k in path for i, n in enumerate(run) if i != k]), path))
    return out


def plain_fold(leaf, path):
    for run, k in path:
        leaf = H(*run[:k], leaf, *run[k + 1 :])
    return leaf


def manifest_of(df, **options):
    leaf = merkle.leaf_digest([F.col(c) for c in COLUMNS])
    return merkle.write_manifest(df, F.col("lang"), F.col("doc_id"), leaf, {"offered": F.col("text")}, **options)


@pytest.mark.parametrize(("fanout", "stride"), [(2, 1), (2, 3), (3, 2), (5, 1), (2, 10)])
def test_proofs_equal_a_plain_tree(spark, fanout, stride):
    sizes = {None: 1, "": 2, "a": 70, "b": 33, "é": 64, "zz": 9, "|": 1}
    rows = [(i * 7 % 1009, f"s{i}", lang, None if i % 5 == 0 else i, None if i % 11 == 0 else f"tex|t {i}") for lang, n in sizes.items() for i in range(n)]
    manifest = manifest_of(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5), fanout=fanout, stride=stride)
    got = merkle.proofs(manifest).select("*", merkle.folded(F.col("leaf"), F.col("proof")).alias("back"), merkle.folded(F.lit("0"), F.col("proof")).alias("forged"), merkle.sibling_digest(F.col("proof")).alias("sib")).collect()
    expected = plain_manifest(rows, fanout)
    assert manifest.root == expected[0][3]
    assert sorted((r.key, r.leaf, r.subroot, r.back, r.sib) for r in got) == sorted(x[:5] for x in expected)
    assert {(r.leaf, r.forged) for r in got} == {(x[1], plain_fold("0", x[5])) for x in expected}
    assert {(r.part, r.offered) for r in got} == {(x[2], x[4]) for x in rows}
    stored = [t.groupBy("pk").count().collect() for t in manifest.parts.levels]
    assert len(stored) == 1 + -(-merkle.height_of(70, fanout) // stride)  # only every stride-th level is written
    assert max(r["count"] for r in stored[-1]) == 1


def test_edges(spark, edge_documents, no_documents):
    rows = [tuple(r[c] for c in COLUMNS) for r in edge_documents.collect()]
    got = merkle.proofs(manifest_of(edge_documents)).select("key", "leaf", "subroot", merkle.sibling_digest(F.col("proof"))).collect()
    key = lambda r: [str(x) for x in r]
    assert sorted(map(tuple, got), key=key) == sorted([(x[0], x[1], x[2], x[4]) for x in plain_manifest(rows)], key=key)
    empty = manifest_of(no_documents)
    assert empty.root is None and merkle.proofs(empty).collect() == []
    one = manifest_of(spark.createDataFrame([(1, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string"))
    assert [(r.leaf, list(r.proof)) for r in merkle.proofs(one).collect()] == [(one.root, [])]
    with pytest.raises(ValueError, match="fanout"):
        manifest_of(no_documents, fanout=1)


def test_query_finds_what_was_tampered_with(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r[c] for c in COLUMNS) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    full = {x[0]: x for x in plain_manifest(rows)}
    by_id = {r[0]: r for r in rows}
    got = queries.op11_merkle_manifest(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        own, x = by_id[r.doc_id], full[r.doc_id]
        tampered = zlib.crc32(str(r.doc_id).encode()) % 7 == 0
        offered = plain_leaf((*own[:3], own[3] + 1, own[4])) if tampered else x[1]
        assert (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) == (*x[1:5], plain_fold(offered, x[5]), not tampered)
    assert 0 < sum(not r.verified for r in got) < len(rows) / 3
