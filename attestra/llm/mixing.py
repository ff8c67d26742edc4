"""Mixing sources to target weights (operator 5), in DataFrame and SQL functions only.

Source token shares are raised to an exponent: 1 leaves them as they are, 0 makes them all equal, more than 1 sharpens them. The
exponent is the one at which the shares' entropy reaches a target, or the smallest at which no source repeats beyond a limit. The
normalised weights become whole numbers of tokens that sum to the budget: each source's documents are dealt to about sqrt(n) blocks; every epoch is a permutation of
its blocks, and of the documents within them; whole epochs are taken while the budget lasts and of the last one a prefix.
No window is wider than about the square root of a source.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, free_name, numbered, words_of

SALTS = 32


def word_count(text: Column) -> Column:
    """Tokens of a text where no tokenizer's count is at hand: its words."""
    return F.size(words_of(text)).cast("long")


def source_totals(units: DataFrame) -> DataFrame:
    """Per source key: tokens and documents. Sources without tokens have no share and are left out."""
    return units.groupBy("src").agg(F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("docs")).filter("total > 0")


def _profile(sources: DataFrame, whole: int, biggest: int, exponents: list[float]) -> list[tuple[float, float, float]]:
    """(exponent, entropy, largest weight in relation to its share) for each exponent, from one pass over the sources. Shares are taken
    in relation to the biggest, so that no power of them vanishes altogether."""
    each = sources.select(F.log(F.col("total") / F.lit(float(biggest))).alias("lp"), F.explode(F.array(*[F.lit(float(x)) for x in exponents])).alias("x"))
    power = F.exp(F.col("x") * F.col("lp"))
    sums = each.groupBy("x").agg(F.sum(power).alias("z"), F.sum(F.col("lp") * power).alias("d"), F.max((F.col("x") - 1) * F.col("lp")).alias("m"))
    rows = sums.collect()  # one row for each exponent asked for
    return sorted((r["x"], math.log(r["z"]) - r["x"] * r["d"] / r["z"], math.exp(r["m"]) * whole / biggest / r["z"]) for r in rows)


def _first(found: list[tuple[float, bool]], low: float, high: float) -> tuple[float, float]:
    """The part of the bracket at whose end a condition begins to hold, which does at ``high``."""
    high = min([x for x, held in found if held], default=high)
    return max([low, *[x for x, _ in found if x < high]]), high


def bisected_exponent(sources: DataFrame, whole: int, budget: int, entropy_share: float | None = None, max_repetition: float | None = None, ways: int = 16, rounds: int = 6) -> float:
    """The smallest exponent at which the entropy is not above ``entropy_share`` of that of equal shares and no source passes more
    often than ``max_repetition``.

    Up to 1 both conditions hold from some exponent on, so each round keeps the one of ``ways`` parts of the bracket where they
    begin to (``ways`` = 2 is plain bisection). Where the entropy of the shares themselves is above the target, the bracket is
    doubled beyond 1 until it is not: entropy falls there too. The largest source then repeats more and more; if it would
    beyond the limit, the exponent stays where it reaches that, with a warning. Shares that no exponent sharpens (one source, or all
    equal) stay as they are, with a warning unless they meet the target.
    """
    row = sources.agg(F.count(F.lit(1)).alias("n"), F.max("total").alias("most")).first()
    target = math.inf if entropy_share is None else entropy_share * math.log(row["n"])
    limit = math.inf if max_repetition is None else max_repetition * whole / budget
    at = lambda xs: [(x, h <= target + 1e-9, r <= limit + 1e-9) for x, h, r in _profile(sources, whole, row["most"], xs)]
    between = lambda low, high: [low + (high - low) * i / ways for i in range(1, ways)]
    start, end = at([0.0, 1.0])
    if start[1] and start[2]:
        return 0.0
    if not end[2]:
        warnings.warn("the budget repeats every source beyond the limit: sources keep their shares", stacklevel=2)
        return 1.0
    low, high = 0.0, 1.0
    if end[1]:
        for _ in range(rounds):
            low, high = _first([(x, h and r) for x, h, r in at(between(low, high))], low, high)
        return high
    beyond = at([2.0**i for i in range(1, 11)])
    if not beyond[-1][1]:
        warnings.warn("no exponent meets the target of the mixture: sources keep their shares", stacklevel=2)
        return 1.0
    low, high = _first([(x, h) for x, h, _ in beyond], 1.0, beyond[-1][0])
    for _ in range(rounds):
        low, high = _first([(x, h) for x, h, _ in at(between(low, high))], low, high)
    if at([high])[0][2]:
        return high
    warnings.warn("the repetition limit keeps the mixture from its target", stacklevel=2)
    low = 1.0
    for _ in range(rounds):
        low, high = _first([(x, not r) for x, _, r in at(between(low, high))], low, high)
    return low


def temperature_weights(sources: DataFrame, whole: int, exponent: float) -> DataFrame:
    """Adds the normalised weight of each source."""
    raised = F.exp(exponent * F.log(F.col("total") / F.lit(float(whole))))
    z = sources.agg(F.sum(raised)).first()[0]
    return sources.withColumn("weight", raised / F.lit(z))


def whole_shares(weighted: DataFrame, budget: int) -> DataFrame:
    """Adds ``share``, whole numbers of tokens that sum to the budget: the weights' shares rounded down, and one more for those that
    this cuts most (equal cuts by source)."""
    exact = F.col("weight") * budget
    out = checkpointed(weighted.withColumn("share", F.floor(exact)).withColumn("cut", F.floor((exact - F.floor(exact)) * (1 << 40))))
    more = budget - (out.agg(F.sum("share")).first()[0] or 0)
    if more <= 0:
        return out.drop("cut")
    place = numbered(out.select("src", "cut"), [F.desc("cut"), F.asc("src")], "place").select("src", "place")
    return out.join(place, "src").withColumn("share", F.col("share") + F.when(F.col("place") < more, 1).otherwise(0)).drop("cut", "place")


def block_permutations(units: DataFrame, sources: DataFrame, budget: int, seed: int = 0) -> DataFrame:
    """The draws: units (uid, src, tokens) with epoch, block and position, the share of its source's budget before it.

    A unit that starts within its source's budget is taken whole, so each source exceeds its budget by less than a unit.
    """
    plan = whole_shares(sources, budget).filter("share > 0").withColumn("blocks", F.ceil(F.sqrt("docs")).cast("int"))
    plan = checkpointed(plan.withColumn("epochs", F.expr("CAST((share + total - 1) div total AS INT)")))
    salted = plan.select("src", "blocks").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = units.withColumn("salt", F.pmod(F.xxhash64("uid", F.lit(seed + 1)), F.lit(SALTS)).cast("int")).join(salted, ["src", "salt"])
    dealt = dealt.select("uid", "src", "tokens", F.pmod(F.xxhash64("uid", F.lit(seed)), F.col("blocks")).cast("int").alias("block"))
    dealt = checkpointed(dealt)
    blocks = dealt.groupBy("src", "block").agg(F.sum("tokens").alias("in_block")).join(plan, "src")
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    order = Window.partitionBy("src", "epoch").orderBy(F.xxhash64("block", "src", "epoch", F.lit(seed)), "block")
    before = F.sum("in_block").over(order) - F.col("in_block") + F.col("epoch") * F.col("total")
    blocks = blocks.withColumn("before", before).filter(F.col("before") < F.col("share"))
    drawn = dealt.join(blocks.select("src", "block", "epoch", "before", "share"), ["src", "block"])
    inner = Window.partitionBy("src", "block", "epoch").orderBy(F.xxhash64("uid", "epoch", F.lit(seed)), "uid", "tokens")
    at = F.col("before") + F.sum("tokens").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    return drawn.withColumn("at", at).filter(F.col("at") < F.col("share")).select("uid", "src", "tokens", "epoch", "block", (F.col("at") / F.col("share")).alias("position"))


def _source_key(name: str) -> Column:
    """A source as a key that is never null: null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("null"))


def mixture(df: DataFrame, tokens: Column, id_col: str = "doc_id", source_col: str = "source", budget: int | None = None, entropy_share: float | None = 0.95, max_repetition: float | None = 4.0, seed: int = 0) -> DataFrame:
    """Draws of the documents: id_col, source_col, tokens, epoch, block, position.

    ``budget`` defaults to the tokens of the whole table. Rows with one id and source are one unit, drawn together. Null
    sources are a source of their own, null ids a unit of their own for each source; null token counts are 0; sources without
    any tokens are left out; an empty table gives no rows. Only the columns named are read.
    """
    units = df.select(F.col(id_col).alias("uid"), F.col(source_col).alias("source_"), _source_key(source_col).alias("src"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"))
    units = checkpointed(units.groupBy("uid", "src").agg(F.sum("tokens").alias("tokens"), F.first("source_").alias("source_")))
    sources = checkpointed(source_totals(units))
    whole = sources.agg(F.sum("total")).first()[0] or 0
    spent = budget or whole
    exponent = bisected_exponent(sources, whole, spent, entropy_share, max_repetition) if whole else 1.0
    weighted = temperature_weights(sources, whole, exponent) if whole else sources.withColumn("weight", F.lit(0.0))
    drawn = block_permutations(units.select("uid", "src", "tokens"), weighted, spent, seed)
    kind = df.schema[source_col].dataType
    source = F.when(F.col("src") != "null", F.expr("substring(src, 2)")).cast(kind)
    return drawn.select(F.col("uid").alias(id_col), source.alias(source_col), "tokens", "epoch", "block", "position")


def mixed(df: DataFrame, tokens: Column, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """``df`` with each row as often as it is drawn (see ``mixture``). Texts are shuffled once, by id and source.

    Rows that share id and source are drawn together, null ids and sources like any other; sources without any tokens give
    no rows, nor does an empty table; all other columns pass through, whatever their names.
    """
    own, uid, src, many, at = (free_name(df, c) for c in ("own_source", "drawn_id", "drawn_source", "drawn_times", "drawn_at"))
    draws = mixture(df, tokens, id_col, source_col, **options).groupBy(F.col(id_col).alias(uid), _source_key(source_col).alias(src)).agg(F.count(F.lit(1)).cast("int").alias(many))
    joined = df.withColumn(own, _source_key(source_col)).join(draws, F.col(id_col).eqNullSafe(F.col(uid)) & (F.col(own) == F.col(src)))
    return joined.withColumn(at, F.explode(F.sequence(F.lit(1), F.col(many)))).select(*[F.col(f"`{c}`") for c in df.columns])
