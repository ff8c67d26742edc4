"""Best-fit packing of tokenised documents into fixed-length training sequences (operator 1).

Three jobs: tokenise every text and cut it in pieces; count the pieces of each length (a histogram of at most
``max_tokens`` rows, whatever the corpus) and plan vector best-fit over it on the driver; give each piece its rank
among the pieces of its length and look its place up in the plan. The plan is that of best-fit-decreasing over all
pieces at once, but no task or driver ever holds the pieces themselves.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, giving_back

#: Texts without these characters need no normalisation beyond lower case, and their words split at white space.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f]")
_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")
#: Marks that may follow the letters of a word, as a second pre-token.
_MARKS = ".,;:!?|"


class WordTokenizer:
    """Ids of a text as little-endian unsigned 32-bit bytes, with a bounded cache of the ids of each word.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its words in order. Texts
    with characters whose normalisation could depend on their neighbours, or with special tokens, go to the tokenizer whole.
    The words of a batch of texts are numbered by Arrow, so each distinct one is looked at once.
    """

    def __init__(self, path: str, max_words: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks use the cores already
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._letters = Tokenizer.from_file(path)  # for lower-case words of letters alone, which nothing but white space splits
        self._letters.normalizer = None
        self._letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._max_words = max_words
        self._words: dict[str, bytes] = {"": b""}
        self._once: set[str] = set()  # words that one batch of texts had only

    def _encoded(self, texts: list[str], letters: bool = False) -> list[np.ndarray]:
        tokenizer = self._letters if letters else self._tokenizer
        return [np.array(e.ids, dtype="<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, cores: list[str], others: list[str]) -> None:
        """Adds words to the cache; ``cores``, of letters alone, are encoded many at a time and cut where a word ends."""
        if cores:
            ids = np.concatenate(self._encoded([" ".join(cores[i : i + 64]) for i in range(0, len(cores), 64)], letters=True))
            whole, cuts = ids.tobytes(), [0, *(4 * np.flatnonzero(self._ends[ids]) + 4).tolist()]
            self._words.update(zip(cores, [whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
        self._words.update(zip(others, [x.tobytes() for x in self._encoded(others)], strict=True))

    def _ids_of(self, distinct: list[str]) -> list[bytes]:
        """Ids of distinct words: those of the letters, and of the marks behind them, are kept apart."""
        known = self._words
        found = list(map(known.get, distinct))
        holes = [i for i, x in enumerate(found) if x is None]
        parts = []  # letters and marks of each hole, or nothing and the word as it is
        for i in holes:
            word = distinct[i]
            core = word.rstrip(_MARKS)
            parts.append((core, word[len(core) :]) if core.isalpha() else ("", word))
        cores, others = {c for c, _ in parts}, {o for _, o in parts}
        self._once.difference_update(distinct)
        self._once -= cores | others
        cores, others = cores.difference(known), others.difference(known)
        if len(known) + len(cores) + len(others) > self._max_words:  # words seen once go first, then all that these texts lack
            for kept in (lambda w: w not in self._once, {*distinct, *(x for p in parts for x in p)}.__contains__):
                if len(self._words) + len(cores) + len(others) > self._max_words:
                    self._words, self._once = {w: x for w, x in self._words.items() if kept(w)} | {"": b""}, set()
        self._learn(list(cores), list(others))
        self._once |= cores
        self._once |= others
        known = self._words
        for i, (core, rest) in zip(holes, parts, strict=True):
            found[i] = known[core] + known[rest]
        return found

    def __call__(self, texts: list[str]) -> list[bytes]:
        whole = [not ((t.isascii() and t.isprintable()) or not _OTHER.search(t)) or ("<|" in t and bool(_SPECIAL.search(t))) for t in texts]
        lists = pc.ascii_split_whitespace(pc.utf8_lower(pa.array(["" if w else t for t, w in zip(texts, whole, strict=True)], pa.large_string())))
        words = lists.values.dictionary_encode()
        number = words.indices.to_numpy()
        each = self._ids_of(words.dictionary.to_pylist())
        size = np.fromiter(map(len, each), dtype=np.int64, count=len(each)) // 4
        ids = np.frombuffer(b"".join(each), dtype="<u4")
        taken = size[number]
        ends = np.concatenate([[0], np.cumsum(taken)])
        first = np.cumsum(size) - size
        flat = ids[np.repeat(first[number] - ends[:-1], taken) + np.arange(ends[-1])].tobytes()
        cuts = (4 * ends[lists.offsets.to_numpy()]).tolist()
        return [self._encoded([t])[0].tobytes() if w else flat[a:b] for t, w, a, b in zip(texts, whole, cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=2)
def tokenizer_at(path: str) -> WordTokenizer:
    """One tokenizer and cache for all tasks of a Python worker."""
    return WordTokenizer(path)


def tokenised_pieces(df: DataFrame, tokenizer_path: str, max_tokens: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32. A null text counts as empty and still yields ``end_id``."""
    key_type = df.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of, end, step = tokenizer_at(tokenizer_path), np.asarray([end_id], dtype="<u4").tobytes(), 4 * max_tokens
        for batch in batches:
            rows = []
            texts = [t if isinstance(t, str) else "" for t in batch["t"].array]
            for at in range(0, len(texts), 500):
                for key, ids in zip(batch["k"].array[at : at + 500], ids_of(texts[at : at + 500]), strict=True):
                    ids += end
                    for n, start in enumerate(range(0, len(ids), step)):
                        part = ids[start : start + step]
                        rows.append((key, n, start // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["k", "piece", "start", "length", "ids_crc32"])

    plain = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    return plain.mapInPandas(giving_back(cut), f"k {key_type}, piece int, start long, length long, ids_crc32 long")


@dataclass
class PackingPlan:
    """Runs of pieces of one length: those of rank ``rank`` to the next run's go to sequences ``sequence``, +1, ... at ``offset``."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    n_sequences: int

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted((self.length << 48) + self.rank, (length << 48) + rank, side="right") - 1
        return self.sequence[at] + (rank - self.rank[at]), self.offset[at]


def plan_packing(counts: dict[int, int], capacity: tuple[int, int, int], weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm") -> PackingPlan:
    """Vector best-fit-decreasing over a histogram of piece lengths.

    A piece of length n needs (n, 1, n*n) of ``capacity`` = (tokens, documents, attention cost). Open sequences of equal
    residual vectors are one class, a residual beyond what the remaining tokens could use is cut down to that, so there
    are few classes. ``rule``: "norm" takes the class with the smallest weighted norm of what would remain, "dot" that with
    the largest weighted dot-product of need and residual; either only among classes that meet every constraint.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"rule must be norm or dot, not {rule!r}")
    cap, weight = np.asarray(capacity, dtype=np.float64), np.asarray(weights, dtype=np.float64)
    clip = lambda t, d, c: (t, min(d, t), min(c, t * t))
    where: dict[tuple[int, int, int], int] = {}
    residual = np.zeros((256, 3))
    size = np.zeros(256, dtype=np.int64)
    members: list[list[tuple[int, int]]] = []
    runs: list[tuple[int, int, int, int]] = []
    opened = 0

    def put_back(state: tuple[int, int, int], first: int, many: int) -> None:
        nonlocal residual, size
        state = clip(*state)
        if min(state) <= 0:
            return
        if state not in where:
            where[state] = len(members)
            members.append([])
            if len(members) > len(size):
                residual, size = np.vstack([residual, np.zeros_like(residual)]), np.concatenate([size, np.zeros_like(size)])
            residual[where[state]] = state
        members[where[state]].append((first, many))
        size[where[state]] += many

    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        need = (length, 1, length * length)
        if any(x > c for x, c in zip(need, capacity, strict=True)):
            raise ValueError(f"a piece of {length} tokens exceeds the capacity {capacity}")
        left, rank = counts[length], 0
        while left:
            n = len(members)
            fits = (size[:n] > 0) & (residual[:n] >= need).all(axis=1)
            if fits.any():
                r = residual[:n][fits] / cap
                score = ((r - np.asarray(need) / cap) ** 2) @ weight if rule == "norm" else -(r * (np.asarray(need) / cap)) @ weight
                best = int(np.flatnonzero(fits)[np.argmin(score)])
                state = tuple(int(x) for x in residual[best])
                while left and members[best]:
                    first, many = members[best].pop()
                    take = min(left, many)
                    if many > take:
                        members[best].append((first + take, many - take))
                    runs.append((length, rank, first, capacity[0] - state[0]))
                    size[best] -= take
                    put_back(tuple(a - b for a, b in zip(state, need, strict=True)), first, take)
                    rank, left = rank + take, left - take
                continue
            each = min(c // x for c, x in zip(capacity, need, strict=True))  # new sequences hold this many such pieces
            for many, bins in ((each, left // each), (left % each, 1 if left % each else 0)):
                if bins:
                    for k in range(many):
                        runs.append((length, rank, opened, k * length))
                        rank += bins
                    put_back(tuple(c - many * x for c, x in zip(capacity, need, strict=True)), opened, bins)
                    opened += bins
            left = 0
    table = np.asarray(sorted(runs), dtype=np.int64).reshape(-1, 4)
    return PackingPlan(table[:, 0], table[:, 1], table[:, 2], table[:, 3], opened)


def pack_pieces(pieces: DataFrame, max_tokens: int = 4096, max_docs: int | None = None, max_cost: int | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm", chunk_rows: int = 50_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (k, piece, start, length, ids_crc32), which must be cheap to read twice.

    ``max_docs`` and ``max_cost`` (sum of squared lengths) default to values that cannot bind. Equal lengths are ranked
    in hashed chunks of about ``chunk_rows`` rows, so a length that a third of all pieces share is never one task's work.
    Repeated rows are packed once each; no pieces give an empty result.
    """
    spark = pieces.sparkSession
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_packing(hist, (max_tokens, max_docs or max_tokens, max_cost or max_tokens**2), weights, rule)
    chunks = max(64, sum(hist.values()) // chunk_rows)
    shared = spark.sparkContext.broadcast(plan)  # its size depends on the distinct lengths, at most max_tokens
    dealt = pieces.withColumn("chunk", F.pmod(F.xxhash64("k", "piece"), F.lit(chunks)))
    before = dealt.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("length", "chunk", (F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).alias("before"))
    local = Window.partitionBy("length", "chunk").orderBy("k", "piece", "ids_crc32")
    ranked = dealt.withColumn("local", F.row_number().over(local)).join(before, ["length", "chunk"])
    ranked = ranked.select("k", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local") - 1).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seq, off = shared.value.places(batch["length"].to_numpy(), batch["rank"].to_numpy())
            yield batch.drop(columns="rank").assign(sequence_id=seq, offset=off)

    key_type = pieces.schema["k"].dataType.simpleString()
    return ranked.mapInPandas(place, f"k {key_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer_path: str, max_tokens: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Packs all documents: one row per piece with its sequence and the offset there.

    Only ``id_col`` and ``text_col`` are read, so other columns may have any names. Null texts are empty documents of the
    end id alone; null ids and repeated rows are kept as rows of their own; an empty table gives no rows.
    """
    pieces = checkpointed(tokenised_pieces(df, tokenizer_path, max_tokens, end_id, id_col, text_col))
    return pack_pieces(pieces, max_tokens, **limits).withColumnRenamed("k", id_col)
