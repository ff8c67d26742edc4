"""Quality rules with robust multivariate outliers (operator 2), in DataFrame and SQL functions only.

Word, symbol and repetition counts are array functions within the row, so texts are never shuffled. The counts of all
documents then give, per language and source, a minimum-covariance-determinant estimate of their transformed vectors:
concentration steps run as partial aggregates over distance bins, so a group of any size costs each task a few rows. A
group's moments count along with those of some documents of its language, a language's with those of some of all, so that
every pair of language and source has an estimate of its own, however few its documents are.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, checkpointed, words_of

SYMBOLS = "#*$%&|<>"
#: Transformed statistics: name and the spread that counts as one unit (also the least spread of any group).
FEATURES = {"word_length": 0.03, "symbol_density": 0.3, "repeat_density": 0.5, "dup_lines": 0.4}
P = len(FEATURES)
#: Documents are judged as if they had this many more ordinary words, so a short text needs strong evidence.
PRIOR_WORDS = 100
PRIOR_LENGTH = 5.5
#: Vectors are held as integers of 1/UNIT of a spread: sums are exact, whatever the order of the tasks.
UNIT = 256
#: Squared distances are binned by BINS per unit of ln(1 + d2).
BINS = 64
#: Share of a group that the estimate is taken from, and the factor that makes it consistent for 4 normal dimensions.
H_SHARE, CONSISTENCY = 0.75, 1.485
SALTS = 32


def word_statistics(df: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long) of each whole text; null is no text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.select(*[F.col(c).alias(f"id{i}") for i, c in enumerate(id_cols)], text.alias("txt"), words_of(F.col(text_col)).alias("w"))
    ids = [F.col(f"id{i}") for i in range(len(id_cols))]
    lines = F.filter(F.split("txt", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    n = F.size("w")
    hashed = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(5)]))
    out = out.select(
        *ids,
        n.cast("long").alias("n_words"),
        F.length(F.translate("txt", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("txt") - F.length(F.translate("txt", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.when(F.locate("\n", F.col("txt")) > 0, lines).alias("lines"),
        F.when(n >= 6, hashed).alias("h"),
    )
    repeated = F.col("h").isNotNull() & (F.size(F.array_distinct("h")) < F.size("h"))
    pairs = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    out = out.select(
        *ids,
        "n_words",
        "word_chars",
        "n_symbols",
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.when(repeated, pairs).alias("s"),
    )
    same = lambda i, j: F.get(F.col("s"), i)["x"] == F.get(F.col("s"), j)["x"]
    at = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
    out = out.select(*ids, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(F.col("s").isNotNull(), F.array_sort(F.transform(at, lambda i: F.get(F.col("s"), i)["i"]))).alias("at"))
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("n"), F.lit(-5).alias("to")),  # the words covered so far, and the start of the last window
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(5), i - acc["to"])).alias("n"), i.alias("to")),
    )["n"]
    named = [F.col(f"id{i}").alias(c) for i, c in enumerate(id_cols)]
    return out.select(*named, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def transformed() -> list[Column]:
    """The vector x0..x3 of a row of word statistics, in integer units."""
    n = F.col("n_words") + PRIOR_WORDS
    raw = [
        F.log((F.col("word_chars") + PRIOR_WORDS * PRIOR_LENGTH) / n),
        F.log1p(100 * F.col("n_symbols") / n),
        F.log1p(100 * F.col("n_repeat_words") / n),
        F.log1p(F.col("n_dup_lines").cast("double")),
    ]
    return [F.round(x * UNIT / s).cast("long").alias(f"x{i}") for i, (x, s) in enumerate(zip(raw, FEATURES.values(), strict=True))]


def _moments() -> list[Column]:
    sums = [F.count(F.lit(1)).alias("n")] + [F.sum(f"x{i}").alias(f"s{i}") for i in range(P)]
    return sums + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(P) for j in range(i + 1)]


def _fitted(sums: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Mean m*, Cholesky factor l** of scale * covariance + 1 (in spreads) and its log-determinant, from moments."""
    n = F.col("n").cast("double")
    mean = [(F.col(f"s{i}") / n / UNIT).alias(f"m{i}") for i in range(P)]
    out = sums.select(*keys, "n", *mean, *[(F.col(f"q{i}{j}") / n / UNIT / UNIT).alias(f"q{i}{j}") for i in range(P) for j in range(i + 1)])
    for i in range(P):
        for j in range(i + 1):
            cov = scale * (F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) + (1.0 if i == j else 0.0)
            rest = reduce(lambda a, k, i=i, j=j: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), cov)
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    logdet = reduce(lambda a, i: a + F.log(F.col(f"l{i}{i}")), range(1, P), F.log(F.col("l00")))
    return out.select(*keys, *_parameters(), logdet.alias("logdet"))


def _parameters() -> list[str]:
    return [f"m{i}" for i in range(P)] + [f"l{i}{j}" for i in range(P) for j in range(i + 1)]


def _distance(df: DataFrame) -> DataFrame:
    """Adds the squared Mahalanobis distance d2 by forward substitution, and drops the parameters."""
    kept = [c for c in df.columns if c not in set(_parameters())]
    for i in range(P):
        y = F.col(f"x{i}") / UNIT - F.col(f"m{i}")
        y = reduce(lambda a, k, i=i: a - F.col(f"l{i}{k}") * F.col(f"y{k}"), range(i), y)
        df = df.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    return df.select(*kept, reduce(lambda a, i: a + F.col(f"y{i}") * F.col(f"y{i}"), range(1, P), F.col("y0") * F.col("y0")).alias("d2"))


def _with_parameters(rows: DataFrame, fit: DataFrame, keys: list[str]) -> DataFrame:
    """Joins on the group and a salt, as one group may hold a third of the rows."""
    salted = fit.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, [*keys, "salt"])


def _shrunk(sums: DataFrame, prior: float) -> DataFrame:
    """Moments (grp, lang, start, n, s*, q*) with those of ``prior`` average documents of the language added, the language's
    with those of as many of all documents."""
    names = [c for c in sums.columns if c not in ("grp", "lang", "start")]
    of_all = sums.groupBy("start").agg(*[(F.sum(c) / F.sum("n")).alias(f"all_{c}") for c in names])
    of_lang = sums.groupBy("lang", "start").agg(*[F.sum(c).alias(f"lang_{c}") for c in names]).join(of_all, "start")
    mean = [((F.col(f"lang_{c}") + prior * F.col(f"all_{c}")) / (F.col("lang_n") + prior)).alias(f"mean_{c}") for c in names]
    return sums.join(of_lang.select("lang", "start", *mean), ["lang", "start"]).select("grp", "lang", "start", *[(F.col(c) + prior * F.col(f"mean_{c}")).alias(c) for c in names])


def mcd_estimates(vectors: DataFrame, prior: float = 200.0, tolerance: float = 1e-3) -> DataFrame:
    """Per grp, the minimum-covariance-determinant mean and factor of x0..x3 (columns grp, lang, salt, x*).

    Two deterministic starts, the language's median with absolute deviations and the group's plain moments, are concentrated
    side by side; each step keeps the distance bins that hold the nearest three quarters of the group, and is taken where it
    lowers the determinant. The steps end when none lowers a log-determinant by more than ``tolerance``; as those cannot
    fall below 0, they do end. The smaller determinant wins.
    """
    keys = ["grp", "lang", "start"]
    med = vectors.groupBy("lang").agg(*[F.percentile(f"x{i}", F.lit(0.5)).alias(f"c{i}") for i in range(P)])
    salted = med.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    off = vectors.join(salted, ["lang", "salt"]).groupBy("lang").agg(*[F.percentile(F.abs(F.col(f"x{i}") - F.col(f"c{i}")), F.lit(0.5)).alias(f"a{i}") for i in range(P)])
    spread = [F.sqrt(F.pow(1.4826 * F.col(f"a{i}") / UNIT, 2) + 1.0) for i in range(P)]
    diagonal = [(spread[i] if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(P) for j in range(i + 1)]
    moments = checkpointed(vectors.groupBy("grp", "lang").agg(*_moments()))
    robust = moments.select("grp", "lang").join(med.join(off, "lang"), "lang").select("grp", "lang", F.lit(0).alias("start"), *[(F.col(f"c{i}") / UNIT).alias(f"m{i}") for i in range(P)], *diagonal)
    plain = _fitted(_shrunk(moments.withColumn("start", F.lit(1)), prior), keys, 1.0).select(*keys, *_parameters())
    fit = checkpointed(robust.unionByName(plain).withColumn("logdet", F.lit(float("inf"))))
    while True:
        near = _distance(_with_parameters(vectors, fit.drop("logdet", "lang", "fell"), ["grp"]))
        bins = near.groupBy(*keys, F.floor(BINS * F.log1p("d2")).alias("bin")).agg(*_moments())
        until, whole = Window.partitionBy(*keys).orderBy("bin"), Window.partitionBy(*keys)
        bins = bins.withColumn("before", F.sum("n").over(until) - F.col("n")).withColumn("of", F.sum("n").over(whole))
        inner = bins.filter(F.col("before") < H_SHARE * F.col("of")).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in moments.columns if c not in keys])
        new = _fitted(_shrunk(inner, prior), keys, CONSISTENCY)
        old = fit.select(*keys, *[F.col(c).alias(f"old_{c}") for c in [*_parameters(), "logdet"]])
        better = F.col("logdet") < F.col("old_logdet")
        taken = [F.when(better, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in [*_parameters(), "logdet"]]
        fit = checkpointed(new.join(old, keys).select(*keys, *taken, F.when(better, F.col("old_logdet") - F.col("logdet")).otherwise(0.0).alias("fell")))
        if (fit.agg(F.max("fell")).first()[0] or 0.0) <= tolerance:
            return fit.groupBy("grp").agg(F.min_by(F.struct(*_parameters()), F.struct("logdet", "start")).alias("f")).select("grp", "f.*")


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tail: float = 4.3e-8, prior: float = 200.0, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """Statistics of every text, the base rules' verdict and that of the robust outlier rule.

    Returns id_col, the five counts, base_failed, grp, distance2 and kept. Documents that pass the base rules are grouped by
    language and source; a group's estimate leans on its language's by the weight of ``prior`` documents, some fifteen for each of the 14
    numbers of an estimate, so that a few junk documents do not make a small group's rule. Rejected are those
    farther out than all but the share ``tail`` of normal vectors would be. Three of the four statistics are nil for most documents,
    so a unit of spread is added to every variance, and distances lie far below a normal vector's: ``tail`` sets the distance, it is
    no share of real documents. Null texts have no words and fail the base rules; null languages and
    sources are groups of their own; repeated rows are judged alike; an empty table gives no rows; other columns are not read.
    """
    stats = word_statistics(df, [id_col, lang_col, source_col], text_col).toDF("id", "lang", "src", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    named = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    group = F.concat_ws("\u0000", named("lang"), named("src"))
    rows = stats.withColumn("base_failed", failed).withColumn("grp", F.when(~failed, group)).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    rows = checkpointed(rows.withColumn("lang", named("lang")).drop("src").select("*", *transformed()))
    vectors = rows.filter("grp is not null").select("grp", "lang", "salt", *[f"x{i}" for i in range(P)])
    fit = mcd_estimates(vectors, prior)
    judged = _distance(rows.join(fit.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["grp", "salt"], "left"))
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("d2") > chi_square_cutoff(tail), F.lit(False))
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.replace("grp", F.lit("\u0000"), F.lit(" ")).alias("grp"), F.col("d2").alias("distance2"), kept.alias("kept"))


def chi_square_tail(d2: float) -> float:
    """Probability that a normal vector of 4 dimensions lies farther than d2."""
    return math.exp(-d2 / 2) * (1 + d2 / 2)


def chi_square_cutoff(tail: float) -> float:
    """The squared distance that the share ``tail`` of normal vectors exceeds, by bisection."""
    low, high = 0.0, 1e4
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_tail(middle) > tail else (low, middle)
    return high
