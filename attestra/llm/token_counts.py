"""Token counts by dynamic programming over a trie of pre-tokens (operator 4).

A pre-token's tokens are those of its best unigram segmentation: the pieces of a vocabulary that concatenate to it with the
largest sum of scores. The distinct pre-tokens that a Python worker meets are inserted in a trie that it keeps over its tasks.
A node holds the forward score of its prefix (best score and number of tokens up to there), which is computed when the node is made
and serves every pre-token that begins so; the count at a pre-token's last node is stored by the pre-token. A document's count is
the sum over its pre-tokens. The trie and the store are bounded: a trie that is full is begun anew, which costs time only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the mark that stands for the white space before a word in the vocabulary.
MARK = "▁"


class PieceTrie:
    """Vocabulary pieces as nested dicts from their last character backwards; the score stands at key ''."""

    def __init__(self, scores: dict[str, float]):
        self.root: dict = {}
        self.longest = max(map(len, scores), default=0)
        for piece, score in scores.items():
            node = self.root
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score


class PrefixTrie:
    """Pre-tokens by their prefixes. Nodes are numbered; node 0 is the empty prefix, and a child is found by its parent's number and
    its character. A character that no piece covers costs its UTF-8 bytes; of equal scores the fewest tokens win."""

    def __init__(self, pieces: PieceTrie, byte_score: float, max_nodes: int = 600_000):
        self.pieces, self.byte_score, self.max_nodes = pieces, byte_score, max_nodes
        self._clear()

    def _clear(self) -> None:
        self.child: dict[int, int] = {}
        self.forward: list[tuple[float, int, int]] = [(0.0, 0, 0)]  # score, minus tokens, byte tokens

    def __len__(self) -> int:
        return len(self.forward)

    def insert(self, word: str) -> tuple[int, int]:
        """(tokens, byte tokens) of the word's best segmentation, at its last node."""
        if len(self.forward) + len(word) > self.max_nodes:
            self._clear()
        path, child, forward = [0], self.child, self.forward
        for end in range(1, len(word) + 1):
            key = path[-1] << 21 | ord(word[end - 1])
            node = child.get(key)
            if node is None:
                node = child[key] = len(forward)
                forward.append(self._forward(word, end, path))
            path.append(node)
        _, tokens, fallback = forward[path[-1]]
        return -tokens, fallback

    def _forward(self, word: str, end: int, path: list[int]) -> tuple[float, int, int]:
        """The forward score of the prefix up to ``end``, from those of the prefixes on the path to it."""
        score, tokens, fallback = self.forward[path[end - 1]]
        n = len(word[end - 1].encode("utf-8", "surrogatepass"))
        best = (score + n * self.byte_score, tokens - n, fallback + n)
        node, at = self.pieces.root, end
        while at and (node := node.get(word[at - 1])) is not None:
            at -= 1
            if (s := node.get("")) is not None:
                score, tokens, fallback = self.forward[path[at]]
                new = (score + s, tokens - 1, fallback)
                if new[:2] > best[:2]:
                    best = new
        return best


def vocabulary_scores(path: str) -> dict[str, float]:
    """Pieces and scores of a sentencepiece model, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}


class TokenCounter:
    """Counts of texts, with a bounded trie and a bounded store of the terminal counts of the words met so far."""

    def __init__(self, path: str, max_words: int = 400_000, max_nodes: int = 600_000):
        scores = vocabulary_scores(path)
        self.trie = PrefixTrie(PieceTrie(scores), min(scores.values(), default=0.0) - 10.0, max_nodes)
        self._max_words = max_words
        self._counts: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(pre-tokens, tokens, byte tokens) of each text. A count and its byte tokens are held as one integer."""
        words = [t.split() for t in texts]
        found = [list(map(self._counts.get, ws)) for ws in words]
        missing = {w for ws, xs in zip(words, found, strict=True) if None in xs for w, x in zip(ws, xs, strict=True) if x is None}
        if len(self._counts) + len(missing) > self._max_words:  # the words of these texts stay
            self._counts = {w: x for ws, xs in zip(words, found, strict=True) for w, x in zip(ws, xs, strict=True) if x is not None}
        known = self._counts
        for w in missing:
            tokens, fallback = self.trie.insert(MARK + w)
            known[w] = tokens << 32 | fallback
        out = []
        for ws, xs in zip(words, found, strict=True):
            total = sum([known[w] if x is None else x for w, x in zip(ws, xs, strict=True)] if None in xs else xs)
            out.append((len(ws), total >> 32, total & 0xFFFFFFFF))
        return out


@lru_cache(maxsize=2)
def counter_at(path: str) -> TokenCounter:
    """One store for all tasks of a Python worker."""
    return TokenCounter(path)


def token_counts(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_pretokens, n_tokens, n_byte_tokens and text_crc32 of every whole text.

    Pre-tokens are what white space separates. Null and empty texts have no tokens; repeated rows and null ids are kept; an
    empty table gives no rows; other columns are not read. Nothing is shuffled.
    """
    kind = df.schema[id_col].dataType.simpleString()
    fields = f"k {kind}, n_pretokens long, n_tokens long, n_byte_tokens long, text_crc32 long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter_at(vocabulary_path)
        for batch in batches:
            rows = []
            for at in range(0, len(batch), 500):
                texts = [t if isinstance(t, str) else "" for t in batch["t"].array[at : at + 500]]
                for key, text, (n, tokens, fallback) in zip(batch["k"].array[at : at + 500], texts, count(texts), strict=True):
                    rows.append((key, n, tokens, fallback, zlib.crc32(text.encode("utf-8", "surrogatepass"))))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in fields.split(", ")])

    return df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInPandas(run, fields).withColumnRenamed("k", id_col)
