"""Ranked lexical search by two trees (operator 12).

Documents are scored for items (queries) by a sum over the item's terms of an integer weight times an integer impact of the
term in the document. Items stand in a tree, and each task builds one over its documents, batch by batch; a node holds
the largest weight, or impact, of every term below it. So the product of two nodes bounds the score of every item below the
one and every document below the other, and a pair of nodes is dropped with all that lies below it once its bound is under
the weakest k-th score among its items. Everything is counted in 64-bit integers, so bounds and scores are exact. Each task
yields its best k documents of each item, of which the best k over all tasks stay.

Items are taken in blocks of bounded size, each searched against all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, giving_back, written

#: A-Z are lowered, other ASCII characters that are neither letters nor digits separate terms; all beyond ASCII belongs to terms.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Scale of the weights and of the impacts, and the share of a document's length that its impacts depend on.
WEIGHT_SCALE, IMPACT_SCALE, LENGTH_PERCENT = 1000, 1_000_000_000, 75


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: runs of ASCII letters and digits and of any characters beyond ASCII, A-Z lowered."""
    return text.translate(_FOLDED).split()


def term_weight(documents: int, holding: int) -> int:
    """The weight of a term that ``holding`` of ``documents`` documents have."""
    return math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(tf: np.ndarray, length_part: np.ndarray) -> np.ndarray:
    """The impact of a term that occurs tf times in a document of the given part for its length."""
    return IMPACT_SCALE * tf // (WEIGHT_SCALE * tf + 8 * length_part)


def length_parts(n: np.ndarray, documents: int, tokens: int) -> np.ndarray:
    """The part of a document of n terms among ``documents`` with ``tokens`` terms in all; Python's integers do not overflow."""
    return np.array([100 - LENGTH_PERCENT + LENGTH_PERCENT * int(x) * documents // tokens for x in n], dtype=np.int64)


def document_vectors(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document with terms (id, n, terms, tfs): how many terms it has, and how often those of the vocabulary occur."""
    kind = docs.schema[id_col].dataType
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})  # of a block of items, bounded

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = shared.value.get
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"].array, batch["text"].array, strict=True):
                words = terms_of(bytes(text)) if text is not None else []
                if words:
                    found, many = np.unique(np.array([i for i in map(place, words) if i is not None], dtype=np.int32), return_counts=True)
                    rows.append((key, len(words), found, many.astype(np.int32)))
            yield pd.DataFrame(rows, columns=["id", "n", "terms", "tfs"])

    # ids travel as text: integers with nulls among them would become floats
    plain = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text"))
    out = plain.mapInPandas(giving_back(run), "id string, n long, terms array<int>, tfs array<int>")
    return out.withColumn("id", F.col("id").cast(kind))


class Level:
    """Sparse vectors of the nodes of one level, one after another: node i has terms[starts[i] : starts[i + 1]]."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray):
        self.starts, self.terms, self.values = starts, terms, values
        self.sizes = np.diff(starts)

    def __len__(self) -> int:
        return len(self.sizes)

    def at(self, nodes: np.ndarray) -> np.ndarray:
        """Places of the entries of some nodes, node by node."""
        sizes = self.sizes[nodes]
        return np.repeat(self.starts[nodes] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())

    def taken(self, nodes: np.ndarray) -> Level:
        at = self.at(nodes)
        return Level(np.concatenate([[0], np.cumsum(self.sizes[nodes])]), self.terms[at], self.values[at])


def coordinate_maxima(level: Level, fan: int, n_terms: int) -> Level:
    """The level above: ``fan`` consecutive nodes each, with the largest value of every term."""
    key = (np.repeat(np.arange(len(level)), level.sizes) // fan) * n_terms + level.terms
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    values, key = np.maximum.reduceat(level.values[order], first), key[first]
    parents = -(-len(level) // fan)
    return Level(np.searchsorted(key, np.arange(parents + 1) * n_terms), key % n_terms, values)


def levels_over(lowest: Level, fan: list[int], n_terms: int) -> list[Level]:
    """A tree's levels from the lowest to a single root; ``fan`` from level to level, its last one from then on."""
    levels = [lowest]
    while len(levels[-1]) > 1:
        levels.append(coordinate_maxima(levels[-1], fan[min(len(levels) - 1, len(fan) - 1)], n_terms))
    return levels


def items_in_order(items: list[Counter]) -> list[int]:
    """An order in which like items are neighbours: halved again and again by whether they are nearer to one item or to that
    which shares least with it."""
    norm = [math.sqrt(sum(c * c for c in x.values())) or 1.0 for x in items]

    def like(i: int, j: int) -> float:
        return sum(c * items[j].get(t, 0) for t, c in items[i].items()) / norm[i] / norm[j]

    out, open_ = [], [list(range(len(items)))]
    while open_:
        group = open_.pop()
        if len(group) <= 2:
            out += group
            continue
        near = {i: like(i, group[0]) for i in group}
        far = min(group, key=lambda i: near[i])
        ranked = sorted(group, key=lambda i: (like(i, far) - near[i], i))
        open_ += [ranked[len(group) // 2 :], ranked[: len(group) // 2]]
    return out


class Items:
    """A block of items as a tree over their weighted terms. Terms of no weight take no part."""

    def __init__(self, items: list[Counter], weights: list[int], fan: int = 8):
        self.fan, self.n_terms = fan, len(weights)
        vectors = [Counter({t: c * weights[t] for t, c in x.items() if weights[t]}) for x in items]
        self.order = [i for i in items_in_order(vectors) if vectors[i]]  # numbers of the items, in the tree's order
        entries = [sorted(vectors[i].items()) for i in self.order]
        starts = np.concatenate([[0], np.cumsum([len(e) for e in entries])]).astype(np.int64)
        flat = np.array([x for e in entries for x in e], dtype=np.int64).reshape(-1, 2)
        self.levels = levels_over(Level(starts, flat[:, 0], flat[:, 1]), [fan], self.n_terms) if entries else []
        self.most = np.zeros(self.n_terms, dtype=np.int64)  # the largest weight of each term, and the item that has it
        self.home = np.zeros(self.n_terms, dtype=np.int64)
        for i, e in enumerate(entries):
            for t, v in e:
                if v > self.most[t]:
                    self.most[t], self.home[t] = v, i


class Search:
    """The best ``k`` documents so far of each item, and the dual descent that finds them. Of equal scores the earlier place wins;
    batches must come in the order of their places."""

    def __init__(self, items: Items, k: int, leaf: int = 16, fan: int = 8):
        self.items, self.k, self.fans = items, k, [leaf, fan]
        self.best: list[list[tuple[int, int]]] = [[] for _ in items.order]  # (-score, place)
        self.least = [np.ones(len(level), dtype=np.int64) for level in items.levels]  # what a pair must reach to matter
        self.rows = np.zeros((max(leaf, fan), items.n_terms), dtype=np.int64)
        self.pairs = 0  # pairs of nodes that were bounded or scored

    def _set_least(self, item: int, least: int) -> None:
        node, fan = item, self.items.fan
        self.least[0][item] = least
        for below, level in zip(self.least, self.least[1:], strict=False):
            node //= fan
            least = below[node * fan : (node + 1) * fan].min()
            if level[node] == least:
                break
            level[node] = least

    def _offer(self, item: int, places: list[int], scores: list[int]) -> None:
        best = sorted(self.best[item] + [(-s, p) for s, p in zip(scores, places, strict=True)])[: self.k]
        self.best[item] = best
        if len(best) == self.k:
            self._set_least(item, max(1, -best[-1][0]))

    def _bounds(self, level: Level, nodes: np.ndarray, rows: int) -> np.ndarray:
        """Products of the rows filled in and some nodes of a level of items."""
        at = level.at(nodes)
        starts = np.cumsum(level.sizes[nodes]) - level.sizes[nodes]
        self.pairs += rows * len(nodes)
        return np.add.reduceat(self.rows[:rows, level.terms[at]] * level.values[at], starts, axis=1)

    def add(self, docs: Level, places: np.ndarray) -> None:
        """Searches a batch of documents (impacts of their terms) at the given places; none may be empty."""
        if not self.items.levels or not len(docs):
            return
        for item, best in enumerate(self.best):  # later places lose against equal scores
            if len(best) == self.k:
                self._set_least(item, 1 - best[-1][0])
        each = docs.values * self.items.most[docs.terms] * len(self.items.order) + self.items.home[docs.terms]
        home = np.maximum.reduceat(each, docs.starts[:-1]) % len(self.items.order)  # the item with most weight on the heaviest term
        order = np.lexsort((docs.sizes, home))
        self._places, levels = places[order], levels_over(docs.taken(order), self.fans, self.items.n_terms)
        if len(levels) == 1:
            levels.append(levels[0])
        top = len(self.items.levels) - 1
        self._visit(levels, len(levels) - 1, 0, np.arange(len(self.items.levels[top])), top)

    def _visit(self, levels: list[Level], depth: int, node: int, nodes: np.ndarray, at: int) -> None:
        """Descends from a node over documents with the nodes of level ``at`` of the items that may matter to it."""
        below, fan = levels[depth - 1], self.fans[min(depth, len(self.fans)) - 1]
        first, last = node * fan, min((node + 1) * fan, len(below))
        spans = [slice(below.starts[c], below.starts[c + 1]) for c in range(first, last)]
        for row, span in enumerate(spans):
            self.rows[row, below.terms[span]] = below.values[span]
        while len(nodes):
            if at > 0:
                at -= 1
                children = (nodes[:, None] * self.items.fan + np.arange(self.items.fan)).ravel()
                nodes = children[children < len(self.items.levels[at])]
            bounds = self._bounds(self.items.levels[at], nodes, len(spans))
            reached = bounds >= self.least[at][nodes]
            if depth > 1 or at == 0:
                break
            nodes = nodes[reached.any(axis=0)]
        for row, span in enumerate(spans):
            self.rows[row, below.terms[span]] = 0
        if not len(nodes):
            return
        if depth == 1:
            for i in np.flatnonzero(reached.any(axis=0)):
                docs = np.flatnonzero(reached[:, i])
                self._offer(int(nodes[i]), self._places[first + docs].tolist(), bounds[docs, i].tolist())
            return
        for row in np.argsort(-bounds.max(axis=1), kind="stable"):
            still = bounds[row] >= self.least[at][nodes]  # siblings may have raised it
            if still.any():
                self._visit(levels, depth - 1, first + int(row), nodes[still], at)


def _blocks(items: DataFrame, item_col: str, text_col: str, max_items: int, max_bytes: int) -> Iterator[list[Row]]:
    """The items as lists of rows (no, id, text), none of which has many more than ``max_items`` rows or ``max_bytes`` of text, but
    for single texts beyond that."""
    rows = checkpointed(items.select(F.monotonically_increasing_id().alias("no"), F.col(item_col).alias("id"), F.col(text_col).cast("binary").alias("text")))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("b")).first()
    many = max(1, -(-size["n"] // max_items), -(-size["b"] // max_bytes))
    for i in range(many if size["n"] else 0):
        yield rows.filter(F.pmod(F.xxhash64("no"), F.lit(many)) == i).collect() if many > 1 else rows.collect()


def _searched(spark: SparkSession, vectors: DataFrame, items: list[Row], counts: list[Counter], n_terms: int, k: int) -> DataFrame:
    """(no, id, score) of the best k documents of each item in each task. A task's rows are ordered by id, so that places stand for ids."""
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    documents, tokens = size["n"], size["l"] or 1
    holding = [0] * n_terms
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():  # a row for each term of the block
        holding[r["t"]] = r["df"]
    tree = Items(counts, [term_weight(documents, df) if df else 0 for df in holding])
    shared = spark.sparkContext.broadcast((tree, [items[i]["no"] for i in tree.order]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, numbers = shared.value
        search, seen, names = Search(tree, k), 0, {}
        for batch in batches:
            sizes = np.array([len(t) for t in batch["terms"]], dtype=np.int64)
            own = np.flatnonzero(sizes)
            if len(own):
                batch, sizes = batch.iloc[own], sizes[own]
                starts = np.concatenate([[0], np.cumsum(sizes)])
                terms, tfs = (np.concatenate(batch[c].to_list()).astype(np.int64) for c in ("terms", "tfs"))
                part = length_parts(batch["n"].to_numpy(), documents, tokens)
                ids = batch["id"].array
                search.add(Level(starts, terms, impacts(tfs, np.repeat(part, sizes))), seen + np.arange(len(own)))
                kept = {p for best in search.best for _, p in best}
                names = {p: names[p] if p < seen else (x if isinstance(x := ids[p - seen], str) else None) for p in kept}
                seen += len(own)
        rows = [(numbers[i], names[p], -s) for i, best in enumerate(search.best) for s, p in best]
        yield pd.DataFrame(rows, columns=["no", "id", "score"])

    plain = vectors.sortWithinPartitions(F.col("id").asc_nulls_last()).select(F.col("id").cast("string").alias("id"), "n", "terms", "tfs")
    out = plain.mapInPandas(giving_back(run), "no long, id string, score long")
    return out.withColumn("id", F.col("id").cast(vectors.schema["id"].dataType))


def ranked_search(items: DataFrame, docs: DataFrame, k: int = 10, item_col: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text", max_items: int = 4096, max_bytes: int = 4 << 20) -> DataFrame:
    """The ``k`` documents with the highest score above 0 of each item: item_col, rank, id_col, score.

    Of equal scores the smaller id comes first, null last; rows that share an id are documents of their own, of equal rank only
    by their order. Each row of ``items`` is searched on its own, so a repeated item has its ranks repeated. Null and empty texts
    have no terms: such items find nothing, such documents count for nothing. Empty tables give no rows. Only the columns named
    are read. Items are searched in blocks of about ``max_items`` rows and ``max_bytes`` bytes, which bounds what tasks are sent.
    """
    spark = docs.sparkSession
    found = []
    for block in _blocks(items, item_col, item_text, max_items, max_bytes):
        texts = [terms_of(bytes(r["text"])) if r["text"] is not None else [] for r in block]
        number = {t: i for i, t in enumerate(sorted({t for x in texts for t in x}))}
        if number:
            vectors = written(document_vectors(docs, list(number), id_col, text_col))
            best = _searched(spark, vectors, block, [Counter(number[t] for t in x) for x in texts], len(number), k)
            names = spark.createDataFrame([(r["no"], r["id"]) for r in block], f"no long, item {items.schema[item_col].dataType.simpleString()}")
            order = Window.partitionBy("no").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
            best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            found.append(best.join(names, "no").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score"))
    if not found:
        fields = f"{item_col} {items.schema[item_col].dataType.simpleString()}, rank int, {id_col} {docs.schema[id_col].dataType.simpleString()}, score long"
        return spark.createDataFrame([], fields)
    return reduce(DataFrame.unionByName, found)
