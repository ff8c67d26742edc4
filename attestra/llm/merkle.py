"""Merkle manifest of a table (operator 11), by checkpoint and recompute.

Rows are leaves, in the order of their key within each part; every ``fanout`` consecutive nodes become one node, until one is
left of each part, and the parts' roots become the root likewise. Only every ``stride``-th level is written. The nodes between
two written levels fall into aligned subtrees of fanout ** stride leaves at most: a task that needs one regenerates it from
the subtree's stored nodes, and drops it once its own proofs or root are out. A proof is found from the top down: the steps
above a stored node come from the subtree that has it as a leaf, and are passed to the subtree below.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir

#: Stands for a node's own digest among those of its run, in a step of a proof.
OWN = "|"


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 (lower-case hex) of the fields: ``-`` for null, else the length in UTF-8 bytes, ``:`` and the value as text."""
    each = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*each), 256)


def run_digest(nodes: list[str]) -> str:
    """The node above a run of nodes."""
    return sha256("".join(nodes).encode()).hexdigest()


def height_of(n: int, fanout: int) -> int:
    """Levels between n nodes and the one they end in."""
    height = 0
    while n > 1:
        n, height = -(-n // fanout), height + 1
    return height


def subtree(nodes: list[str], height: int, fanout: int) -> list[list[str]]:
    """The levels of the tree over ``nodes``, these first."""
    levels = [nodes]
    for _ in range(height):
        below = levels[-1]
        levels.append([run_digest(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def subtree_steps(levels: list[list[str]], fanout: int) -> list[list[str]]:
    """For each lowest node the steps to the top: the run that it is hashed in, with ``OWN`` in its own place."""
    out = []
    for i in range(len(levels[0])):
        steps = []
        for nodes in levels[:-1]:
            first = i - i % fanout
            steps.append("".join(OWN if k == i else nodes[k] for k in range(first, min(first + fanout, len(nodes)))))
            i //= fanout
        out.append(steps)
    return out


@dataclass
class Tree:
    """Written levels of the trees of all parts: (pk, idx, n, node), n the part's nodes on that level; the first has the leaves'
    other columns too. A part is on the levels up to that of its root."""

    levels: list[DataFrame]
    fanout: int
    stride: int

    @property
    def width(self) -> int:
        return self.fanout**self.stride

    def roots(self) -> DataFrame:
        """(pk, node) of each part."""
        each = [t.filter("n = 1").select("pk", "node") for t in self.levels]
        out = each[0]
        for t in each[1:]:
            out = out.unionByName(t)
        return out


@dataclass
class Manifest:
    """The parts' trees and the tree over the parts' roots, as written in ``folder``; ``root`` is null for a table without rows."""

    folder: str
    parts: Tree
    top: Tree
    root: str | None


def _numbered(leaves: DataFrame, extras: list[str]) -> DataFrame:
    """Adds idx, a leaf's place in its part by key (nulls first; equal keys by digest), and n, the part's leaves.

    Leaves are dealt to ranges and numbered within them, so a part of any size is spread; each range starts after those before.
    """
    order = [F.col("pk"), F.col("key").asc_nulls_first(), F.col("node"), F.col("at")]
    placed = leaves.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = _kept(placed.select("pk", "key", "node", *extras, F.monotonically_increasing_id().alias("at")).withColumn("rng", F.expr("shiftright(at, 33)")), leaves.sparkSession)
    spans = placed.groupBy("pk", "rng").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("many"))
    whole = Window.partitionBy("pk")  # a row for each range that the part touches
    spans = spans.select("pk", "rng", "first", (F.sum("many").over(whole.orderBy("rng")) - F.col("many")).alias("before"), F.sum("many").over(whole).alias("n"))
    return placed.join(spans, ["pk", "rng"]).select("pk", (F.col("at") - F.col("first") + F.col("before")).alias("idx"), "n", "node", "key", *extras)


def _kept(df: DataFrame, spark, path: str | None = None) -> DataFrame:
    path = path or f"{shared_dir(spark)}/merkle-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def _grown(leaves: DataFrame, extras: list[str], folder: str, fanout: int, stride: int) -> Tree:
    """Writes every ``stride``-th level above the leaves (pk, key, node), a group of fanout ** stride nodes at a time."""
    spark = leaves.sparkSession
    tree = Tree([_kept(_numbered(leaves, extras), spark, f"{folder}/level=0")], fanout, stride)
    width = tree.width

    def above(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iloc[0])
        nodes = rows.sort_values("idx")["node"].tolist()
        top = subtree(nodes, min(stride, height_of(n, fanout)), fanout)[-1]
        return pd.DataFrame({"pk": [key[0]], "idx": [key[1]], "n": [-(-n // width)], "node": top})

    most = tree.levels[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        below = tree.levels[-1].filter("n > 1").select("pk", "idx", "n", "node")
        grown = below.groupBy("pk", F.expr(f"idx div {width}").alias("up")).applyInPandas(above, "pk string, idx long, n long, node string")
        tree.levels.append(_kept(grown, spark, f"{folder}/level={len(tree.levels) * stride}"))
        most = -(-most // width)
    return tree


def write_manifest(df: DataFrame, part: Column, key: Column, leaf: Column, extras: dict[str, Column] | None = None, fanout: int = 2, stride: int = 10, folder: str | None = None) -> Manifest:
    """Writes the manifest of ``df`` in ``folder`` (default: a new one in the shared folder), whose digests are ``leaf``.

    Parts are compared as text, bytewise, null first; leaves by key, null first, equal keys by digest, so repeated rows are
    leaves of their own side by side. ``extras`` travel with the leaves. An empty table has no root. ``fanout`` must be at
    least 2; stored levels take 1 / fanout ** stride of the leaves' room.
    """
    if fanout < 2 or stride < 1:
        raise ValueError("fanout must be 2 or more and stride 1 or more")
    spark, extras = df.sparkSession, extras or {}
    folder = folder or f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    named = {f"x_{name}": c for name, c in extras.items()}
    pk = F.coalesce(F.concat(F.lit("="), part.cast("string")), F.lit(""))
    leaves = _kept(df.select(pk.alias("pk"), key.alias("key"), leaf.alias("node"), *[c.alias(x) for x, c in named.items()]), spark)  # texts are read once
    parts = _grown(leaves, list(named), f"{folder}/parts", fanout, stride)
    tops = _grown(parts.roots().select(F.lit("").alias("pk"), F.col("pk").alias("key"), "node"), [], f"{folder}/top", fanout, stride)
    root = tops.roots().first()
    return Manifest(folder, parts, tops, root["node"] if root else None)


def _extraction(names: list[str], fanout: int, stride: int):
    """A subtree's stored nodes and the steps above it give each of these nodes its proof."""

    def extracted(rows: pd.DataFrame, parent: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame(columns=names)
        rows = rows.sort_values("idx")
        levels = subtree(rows["node"].tolist(), min(stride, height_of(int(rows["n"].iloc[0]), fanout)), fanout)
        further = list(parent["proof"].iloc[0])
        return rows.assign(subroot=parent["subroot"].iloc[0], proof=[own + further for own in subtree_steps(levels, fanout)])[names]

    return extracted


def _steps(tree: Tree, start: DataFrame) -> DataFrame:
    """The leaves of a tree with subroot and proof. ``start``: pk, subroot and the steps above each part's root.

    Level by level from the top: a subtree's stored nodes meet the steps above their common ancestor, and its missing nodes live
    as long as the group is worked on.
    """
    fanout, stride = tree.fanout, tree.stride
    above = None
    for table in reversed(tree.levels):
        out = table.filter("n = 1").join(start, "pk")
        if above is not None:
            fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
            names = [*table.columns, "subroot", "proof"]
            rows = table.filter("n > 1").withColumn("up", F.expr(f"idx div {tree.width}"))
            parents = above.select("pk", F.col("idx").alias("up"), "subroot", "proof")
            found = rows.groupBy("pk", "up").cogroup(parents.groupBy("pk", "up")).applyInPandas(_extraction(names, fanout, stride), f"{fields}, subroot string, proof array<string>")
            out = out.select(*names).unionByName(found)
        above = out
    return above


def proofs(manifest: Manifest) -> DataFrame:
    """Every leaf's key, digest (leaf), the extras, its part's root (subroot) and its proof: the steps up to the root, each the
    digests of a run with ``OWN`` in the place of the node that the steps so far lead to."""
    top = _steps(manifest.top, manifest.top.roots().select("pk", F.col("node").alias("subroot"), F.array().cast("array<string>").alias("proof")))
    start = top.select(F.col("key").alias("pk"), F.col("node").alias("subroot"), "proof")
    out = _steps(manifest.parts, start)
    extras = [c for c in out.columns if c.startswith("x_")]
    part = F.when(F.col("pk") != "", F.expr("substring(pk, 2)"))
    return out.select(part.alias("part"), "key", F.col("node").alias("leaf"), *[F.col(c).alias(c[2:]) for c in extras], "subroot", "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda digest, step: F.sha2(F.replace(step, F.lit(OWN), digest), 256))


def sibling_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, from the leaf's run upwards, left to right."""
    return F.sha2(F.replace(F.array_join(proof, ""), F.lit(OWN), F.lit("")), 256)
