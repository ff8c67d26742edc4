"""Bounded-space online packing of tokenised documents (operator 13).

Each task streams its documents past a fixed number of open windows. A piece goes to the open window that it fills best; where
none has room and no further window may be opened, the fullest is emitted, topped up with the beginning of the piece, so no
emitted window is padded. At its end a task joins its open windows end to end, which leaves it one window at most that is not
full. These leftovers, one for each task, are laid end to end over all tasks and cut anew; the very last of them is cut at
powers of two. So nothing is padded, texts are never shuffled, and what a task holds does not depend on how many documents it
has or on their sizes.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, giving_back
from .packing import tokenizer_at

#: A task's windows are numbered from its partition's number times two to this power.
TASK_BITS = 33
#: Tasks whose leftovers are added up together before the sums of such groups are.
TASKS_PER_SUM = 1024

#: A piece in its window: document, start within it, length, tokens of the document, ids (bytes), offset in the window.
Piece = tuple[object, int, int, int, bytes, int]


class OnlinePacker:
    """At most ``windows`` open windows of ``max_tokens`` tokens; ``place`` and ``rest`` give the windows that are done.

    A window is (number, pieces, full): only the last one of ``rest`` may not be full, if ``top_up``. Without it pieces are cut
    only where they are longer than a window, and windows are emitted as they stand.
    """

    def __init__(self, max_tokens: int = 4096, windows: int = 64, top_up: bool = True, first: int = 0):
        if max_tokens < 1 or windows < 1:
            raise ValueError("max_tokens and windows must be positive")
        self.max_tokens, self.windows, self.top_up = max_tokens, windows, top_up
        self._next = first
        self._room: list[tuple[int, int]] = []  # (tokens left, number) of the open windows, sorted
        self._held: dict[int, list[Piece]] = {}

    def _number(self) -> int:
        self._next += 1
        return self._next - 1

    def _put(self, room: int, number: int, piece: tuple) -> Iterator[tuple[int, list[Piece], bool]]:
        """Adds a piece to a window that is not listed, and lists it again unless that fills it."""
        self._held.setdefault(number, []).append((*piece, self.max_tokens - room))
        room -= piece[2]
        if room:
            insort(self._room, (room, number))
        else:
            yield number, self._held.pop(number), True

    def place(self, key: object, ids: bytes) -> Iterator[tuple[int, list[Piece], bool]]:
        """Places a document, given by its ids of 4 bytes each, and yields the windows that this completes."""
        total, start = len(ids) // 4, 0
        part = lambda n: (key, start, n, total, ids[4 * start : 4 * (start + n)])
        while start < total:
            n = min(total - start, self.max_tokens)
            at = bisect_left(self._room, (n, -1))
            if n < self.max_tokens and at < len(self._room):
                yield from self._put(*self._room.pop(at), part(n))
            elif n == self.max_tokens or len(self._room) < self.windows:
                yield from self._put(self.max_tokens, self._number(), part(n))
            else:
                room, number = self._room.pop(0)
                if self.top_up:
                    n = room
                    yield from self._put(room, number, part(n))
                else:
                    yield number, self._held.pop(number), False
                    continue
            start += n

    def rest(self) -> Iterator[tuple[int, list[Piece], bool]]:
        """The windows that are still open; with ``top_up`` joined end to end from the fullest on, cut where one is full."""
        if not self.top_up:
            yield from ((number, self._held[number], False) for _, number in self._room)
            return
        joined: list[Piece] = []
        fill = 0
        for _, number in self._room:
            for key, start, n, total, ids, _ in self._held[number]:
                while n:
                    m = min(n, self.max_tokens - fill)
                    joined.append((key, start, m, total, ids[: 4 * m], fill))
                    start, n, ids, fill = start + m, n - m, ids[4 * m :], fill + m
                    if fill == self.max_tokens:
                        yield self._number(), joined, True
                        joined, fill = [], 0
        if joined:
            yield self._number(), joined, False


_PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def online_pieces(df: DataFrame, tokenizer_path: str, max_tokens: int = 4096, end_id: int = 2, windows: int = 64, top_up: bool = True, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces (k, the id as text, start, length, ids_crc32, doc_tokens, sequence_id, offset, full, ids) as each task places them, before its leftovers
    are merged with those of other tasks. ``ids`` are kept of windows that are not full, and of all ``with_ids``."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of, end = tokenizer_at(tokenizer_path), end_id.to_bytes(4, "little")
        packer = OnlinePacker(max_tokens, windows, top_up, TaskContext.get().partitionId() << TASK_BITS)

        def rows(done: Iterator[tuple[int, list[Piece], bool]]) -> list[tuple]:
            return [(key, start, n, zlib.crc32(ids), total, number, offset, full, ids if with_ids or not full else None) for number, pieces, full in done for key, start, n, total, ids, offset in pieces]

        def frame(found: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(found, columns=["k", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "full", "ids"])

        for batch in batches:
            found = []
            texts = [t if isinstance(t, str) else "" for t in batch["t"].array]
            for at in range(0, len(texts), 500):
                for key, ids in zip(batch["k"].array[at : at + 500], ids_of(texts[at : at + 500]), strict=True):
                    found += rows(packer.place(key, ids + end))
            yield frame(found)
        yield frame(rows(packer.rest()))

    return df.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("t")).mapInPandas(giving_back(pack), f"k string, {_PIECE}, full boolean, ids binary")


def tail_starts(total: int, max_tokens: int) -> list[int]:
    """Where sequences of ``total`` tokens end to end start: whole ones, of which only the last ``total`` mod ``max_tokens`` tokens'
    starts are listed here; these sequences have powers of two, so that none of them is padded."""
    at, starts = total - total % max_tokens, []
    while at < total:
        starts.append(at)
        at += 1 << ((total - at).bit_length() - 1)
    return starts


def merged_leftovers(pieces: DataFrame, max_tokens: int = 4096, with_ids: bool = False) -> DataFrame:
    """The pieces of windows that are not full, laid end to end in the order of their windows and cut into sequences anew (numbered
    -1, -2, ...). ``pieces`` must be cheap to read twice and hold the same rows each time."""
    left = pieces.filter("not full")
    each = left.groupBy("sequence_id").agg(F.sum("length").alias("tokens")).withColumn("block", F.expr(f"shiftright(sequence_id, {TASK_BITS}) div {TASKS_PER_SUM}"))
    blocks = each.groupBy("block").agg(F.sum("tokens").alias("in_block"))
    blocks = blocks.select("block", "in_block", (F.sum("in_block").over(Window.orderBy("block")) - F.col("in_block")).alias("before_block"))  # a row for so many tasks
    each = checkpointed(each.join(blocks, "block").withColumn("before", F.col("before_block") + F.sum("tokens").over(Window.partitionBy("block").orderBy("sequence_id")) - F.col("tokens")))
    total = each.agg(F.sum("tokens")).first()[0] or 0
    tail, whole = tail_starts(total, max_tokens), total // max_tokens
    placed = left.join(each.select("sequence_id", "before"), "sequence_id").select("k", "start", "length", "doc_tokens", (F.col("before") + F.col("offset")).alias("at"), "ids")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, start, length, tokens, at, ids in batch.itertuples(index=False, name=None):
                done = 0
                while done < length:
                    p = at + done
                    n = p // max_tokens
                    begin, end = n * max_tokens, (n + 1) * max_tokens
                    if n == whole:
                        m = sum(s <= p for s in tail) - 1
                        n, begin, end = n + m, tail[m], tail[m + 1] if m + 1 < len(tail) else total
                    m = min(length - done, end - p)
                    part = ids[4 * done : 4 * (done + m)]
                    rows.append((key, start + done, m, zlib.crc32(part), tokens, -1 - n, p - begin, part if with_ids else None))
                    done += m
            yield pd.DataFrame(rows, columns=["k", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return placed.mapInPandas(cut, f"k string, {_PIECE}, ids binary")


def pack_online(df: DataFrame, tokenizer_path: str, max_tokens: int = 4096, end_id: int = 2, windows: int = 64, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Packs all documents: one row per piece with its sequence and the offset there (and its ids, as little-endian 32-bit numbers,
    ``with_ids``). Every sequence is full, but for a dozen at most whose lengths are powers of two.

    Only ``id_col`` and ``text_col`` are read, so other columns may have any names. Null texts are empty documents of the end id
    alone; null ids and repeated rows are kept as rows of their own; an empty table gives no rows.
    """
    pieces = checkpointed(online_pieces(df, tokenizer_path, max_tokens, end_id, windows, True, id_col, text_col, with_ids))
    out = pieces.filter("full").drop("full").unionByName(merged_leftovers(pieces, max_tokens, with_ids))
    out = out.select(F.col("k").cast(df.schema[id_col].dataType).alias(id_col), *[c for c in out.columns if c != "k"])
    return out if with_ids else out.drop("ids")
