"""Quality classifier by co-training (operator 7).

Two views of a document, its text content and its page metadata (language, source, length), each get a logistic model.
The models are fitted on a bounded sample of labelled rows; over some rounds each view's confident verdicts on all other
documents become training rows of the other, as sums that Spark adds up. Both are then calibrated, and their combination
fitted, on held-out labelled rows. Every document is scored, in one pass without a shuffle of texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, giving_back, written

WORD_BUCKETS = 128
META_BUCKETS = 64


class TextView:
    """Byte shares, word shape statistics and hashed word shares of a text (UTF-8 bytes); null and empty texts alike."""

    size = 256 + 8 + WORD_BUCKETS

    def __init__(self, max_words: int = 100_000):
        self._bucket: dict[bytes, int] = {}
        self._max_words = max_words

    def __call__(self, text: bytes | None) -> np.ndarray:
        text = text or b""
        out = np.zeros(self.size, dtype=np.float32)
        words = text.split()
        if not words:
            return out
        n, known = len(words), self._bucket
        out[:256] = np.sqrt(np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) / len(text))
        lines = [x for x in text.split(b"\n") if x.strip()]
        kinds = len(set(words))
        out[256:264] = (
            np.log1p(n) / 10,
            len(text) / n / 10,
            kinds / n,
            np.log1p(n - kinds) / 10,
            1 - len(set(lines)) / len(lines),
            sum(map(bytes.__eq__, words[1:], words[:-1])) / n,
            sum(map(bytes.isupper, words)) / n,
            sum(map(bytes.istitle, words)) / n,
        )
        try:
            at = [known[w] for w in words]
        except KeyError:
            if len(known) > self._max_words:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = zlib.crc32(w.lower()) % WORD_BUCKETS
            at = [known[w] for w in words]
        out[264:] = np.sqrt(np.bincount(np.array(at), minlength=WORD_BUCKETS) / n)
        return out


class MetadataView:
    """Hashed language, source and their pair, and the length, on a log scale and in steps."""

    size = 3 * META_BUCKETS + 26

    def __call__(self, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
        out = np.zeros(self.size, dtype=np.float32)
        for i, name in enumerate((lang, source, f"{lang}\0{source}")):
            out[i * META_BUCKETS + zlib.crc32(str(name).encode()) % META_BUCKETS] = 1
        n = 0 if n_chars is None or n_chars != n_chars or n_chars < 0 else int(n_chars)
        out[3 * META_BUCKETS] = np.log1p(n) / 10
        out[3 * META_BUCKETS + 1 + min(24, n.bit_length())] = 1
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Pull:
    """Further rows of a fit, known by their loss around the coefficients ``at``: gradient there and a bound of the curvature."""

    at: np.ndarray
    gradient: np.ndarray
    curvature: np.ndarray


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 12, pull: Pull | None = None) -> np.ndarray:
    """Coefficients, intercept last, by Newton steps on the ridge-penalised log-likelihood, plus the quadratic of ``pull``."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w, pen = np.zeros(x.shape[1]), np.full(x.shape[1], ridge * len(x))
    pen[-1] = 1e-6 * len(x)
    if pull is not None:
        w = pull.at.copy()
    for _ in range(steps):
        p = _sigmoid(x @ w)
        g = x.T @ (p - y) + pen * w
        h = (x * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ x
        h[np.diag_indices_from(h)] += pen
        if pull is not None:
            g += pull.gradient + pull.curvature @ (w - pull.at)
            h += pull.curvature
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class CoTrained:
    """The two views' models, their calibrations (slope, offset) and the combination of the calibrated margins."""

    text: np.ndarray
    meta: np.ndarray
    text_scale: np.ndarray
    meta_scale: np.ndarray
    mix: np.ndarray
    exchanged: list[tuple[int, int]] = field(default_factory=list)

    def scores(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality: text view, metadata view, combined."""
        za, zb = _margin(_margin(a, self.text)[:, None], self.text_scale), _margin(_margin(b, self.meta)[:, None], self.meta_scale)
        return _sigmoid(za), _sigmoid(zb), _sigmoid(_margin(np.stack([za, zb], axis=1), self.mix))


def pseudo_sums(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray, confidence: float) -> np.ndarray:
    """What each view's confident verdicts on these rows add to the other's fit: for view a, then b, and for labels 0, then 1, the
    number of rows and the sum of the gradients of their loss (intercept last), in one flat array."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    pa, pb = _sigmoid(_margin(a, wa)), _sigmoid(_margin(b, wb))
    out = []
    for x, own, other in ((a, pa, pb), (b, pb, pa)):
        for label, sure in ((0.0, 1 - other > confidence), (1.0, other > confidence)):
            off = own[sure] - label
            out += [[np.count_nonzero(sure)], off @ x[sure], [off.sum()]]
    return np.concatenate(out)


def co_train(a: np.ndarray, b: np.ndarray, y: np.ndarray, held: np.ndarray, sums: Callable[[np.ndarray, np.ndarray, float], np.ndarray], rounds: int = 3, confidence: float = 0.95) -> CoTrained:
    """Fits the two views. ``a``, ``b``: features of labelled rows, ``y`` their 0/1 labels, ``held``: those kept for calibration.

    ``sums`` gives ``pseudo_sums`` over all unlabelled rows. In each round every verdict of probability over ``confidence`` is
    given to the other view; the rows of a class together weigh at most as much as the labelled rows of that class. Their loss
    enters by its gradient over all of them and the curvature bound of a logistic loss (a quarter of the moment matrix, which
    the labelled rows estimate), so a round costs one pass over the rows, and only sums leave it.
    """
    train = ~held
    n_class = np.array([np.count_nonzero(y[train] == 0), np.count_nonzero(y[train] == 1)])
    exchanged: list[tuple[int, int]] = []

    def moved(x: np.ndarray, w: np.ndarray, given: np.ndarray) -> np.ndarray:
        given = given.reshape(2, -1)
        weight = np.minimum(1.0, n_class / np.maximum(1, given[:, 0]))
        ones = np.hstack([x[train], np.ones((train.sum(), 1))]).astype(np.float64)
        curvature = ones.T @ ones / len(ones) / 4 * float(weight @ given[:, 0])
        return fit_logistic(x[train], y[train], pull=Pull(w, weight @ given[:, 1:], curvature))

    wa, wb = fit_logistic(a[train], y[train]), fit_logistic(b[train], y[train])
    for _ in range(rounds):
        got = sums(wa, wb, confidence)
        for_a, for_b = got[: 2 * (len(wa) + 1)], got[2 * (len(wa) + 1) :]
        exchanged.append(tuple(int(g.reshape(2, -1)[:, 0].sum()) for g in (for_b, for_a)))
        if exchanged[-1] == (0, 0):
            break
        wa, wb = moved(a, wa, for_a), moved(b, wb, for_b)
    ma, mb = _margin(a[held], wa), _margin(b[held], wb)
    sa, sb = fit_logistic(ma[:, None], y[held]), fit_logistic(mb[:, None], y[held])
    mix = fit_logistic(np.stack([_margin(ma[:, None], sa), _margin(mb[:, None], sb)], axis=1), y[held])
    return CoTrained(wa, wb, sa, sb, mix, exchanged)


_FEATURES = "id string, y double, a binary, b binary"


def _sampled_features(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Collects features and labels (id, y) of a bounded sample, in the order of the ids."""

    def run(batches):
        text_view, meta_view = TextView(), MetadataView()
        for batch in batches:
            a = [text_view(t).tobytes() for t in batch["t"].array]
            b = [meta_view(*x).tobytes() for x in zip(batch["lang"].array, batch["source"].array, batch["n_chars"].array, strict=True)]
            yield pd.DataFrame({"id": batch["id"], "y": batch["y"], "a": a, "b": b})

    docs = docs.withColumn("id", F.col("id").cast("string"))
    got = docs.mapInPandas(run, _FEATURES).toPandas().sort_values(["id", "y", "a"], ignore_index=True)
    a = np.frombuffer(b"".join(got["a"]), dtype=np.float32).reshape(-1, TextView.size)
    b = np.frombuffer(b"".join(got["b"]), dtype=np.float32).reshape(-1, MetadataView.size)
    held = np.array([zlib.crc32(f"held {i}".encode()) % 4 == 0 for i in got["id"]], dtype=bool)
    return a, b, got["y"].to_numpy(dtype=np.float64), held


def pool_sums(texts: DataFrame) -> Callable[[np.ndarray, np.ndarray, float], np.ndarray]:
    """``pseudo_sums`` over the rows of a table (t, lang, source, n_chars). Features are computed once and kept in the shared folder
    in half precision; each call adds up the sums of tasks on Spark, and one flat array reaches the driver."""

    def features(batches):
        text_view, meta_view = TextView(), MetadataView()
        for batch in batches:
            for at in range(0, len(batch), 1000):  # small frames: workers keep the memory that they once took
                part = batch.iloc[at : at + 1000]
                a = [text_view(t).astype(np.float16).tobytes() for t in part["t"].array]
                b = [meta_view(*x).astype(np.float16).tobytes() for x in zip(part["lang"].array, part["source"].array, part["n_chars"].array, strict=True)]
                yield pd.DataFrame({"a": a, "b": b})

    kept = written(texts.mapInPandas(giving_back(features), "a binary, b binary"))

    def sums(wa: np.ndarray, wb: np.ndarray, confidence: float) -> np.ndarray:
        size = 2 * (len(wa) + len(wb) + 2)

        def run(batches):
            total = np.zeros(size)
            for batch in batches:
                for at in range(0, len(batch), 2000):
                    part = batch.iloc[at : at + 2000]
                    a, b = (np.frombuffer(b"".join(part[c]), dtype=np.float16).reshape(len(part), -1) for c in "ab")
                    total += pseudo_sums(a, b, wa, wb, confidence)
            yield pd.DataFrame({"sums": [total]})

        parts = kept.mapInPandas(giving_back(run), "sums array<double>").select(F.posexplode("sums").alias("i", "v"))
        got = parts.groupBy("i").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros(size)
        out[got["i"]] = got["v"].round(6)  # the order in which tasks end must not show
        return out

    return sums


def _columns(df: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Id, text and metadata under fixed names; metadata columns that the table lacks are null."""
    have = {c.lower() for c in df.columns}
    meta = [(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in (("lang", "string"), ("source", "string"), ("n_chars", "long"))]
    return [F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"), *meta]


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 8000, **options) -> CoTrained | None:
    """Co-trained models from about ``sample`` labelled documents (the documented bound of the fit) and every other document.

    Labelled rows are drawn by a hash of the id, at a rate that gives the bound for any number of rows; all other documents,
    but none that was drawn, are the unlabelled pool. Null labels and ids are left out; of contradicting labels of one id the
    smaller counts. Returns None where the sample lacks one of the classes.
    """
    own = labels.select(F.col(id_col).alias("lid"), F.col(label_col).cast("double").alias("y")).filter("lid is not null and y is not null")
    own = own.groupBy("lid").agg(F.min("y").alias("y"))
    rate = min(1.0, sample / max(1, own.count()))
    # about `sample` rows of two numbers, whatever the tables' size: small enough to broadcast
    drawn = F.broadcast(own.filter(F.pmod(F.xxhash64("lid", F.lit("labelled")), F.lit(1 << 30)) < int((1 << 30) * rate)))
    texts = docs.select(*_columns(docs, id_col, text_col))
    labelled = texts.join(drawn, F.col("id") == F.col("lid"))
    a, b, y, held = _sampled_features(labelled.select("id", "t", "lang", "source", "n_chars", "y"))
    if any(len(set(y[at])) < 2 for at in (held, ~held)):
        return None
    further = texts.filter("id is not null").join(drawn, F.col("id") == F.col("lid"), "left_anti")  # calibration rows must stay unseen
    return co_train(a, b, y, held, pool_sums(further.select("t", "lang", "source", "n_chars")), **options)


def quality_column(df: DataFrame, model: CoTrained | None, text_col: str = "text") -> Column:
    """Struct column (p_text, p_meta, quality) for the rows of ``df``; without a model every row has quality 1."""

    @F.pandas_udf("p_text double, p_meta double, quality double")
    def scored(batches: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        text_view, meta_view = TextView(), MetadataView()
        parts = []
        for at in range(0, len(batches), 500):
            part = slice(at, at + 500)
            a = np.stack([text_view(t) for t in batches.iloc[part]])
            b = np.stack([meta_view(*x) for x in zip(lang.iloc[part], source.iloc[part], n_chars.iloc[part], strict=True)])
            parts.append(np.stack(model.scores(a, b), axis=1))
        del text_view, meta_view
        give_back()
        return pd.DataFrame(np.concatenate(parts) if parts else np.empty((0, 3)), columns=["p_text", "p_meta", "quality"])

    if model is None:
        one = F.lit(1.0)
        return F.struct(one.alias("p_text"), one.alias("p_meta"), one.alias("quality"))
    have = {c.lower() for c in df.columns}
    meta = [(F.col(c) if c in have else F.lit(None)).cast(kind) for c, kind in (("lang", "string"), ("source", "string"), ("n_chars", "long"))]
    return scored(F.col(text_col).cast("binary"), *meta)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """id, p_text, p_meta, quality (probability of good quality) and kept of every document.

    Null and empty texts are scored like any other (all text features zero); null metadata is a value of its own; repeated
    rows get equal scores; an empty table gives no rows; without labels of both classes all are kept with quality 1.
    """
    model = train_quality(docs, labels, id_col, text_col, **options)
    out = docs.select(F.col(id_col), quality_column(docs, model, text_col).alias("s"))
    return out.select(id_col, "s.*").withColumn("kept", F.col("quality") >= threshold)
