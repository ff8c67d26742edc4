"""Exact joins of bit hashes within a Hamming distance, over tables of any size.

Equal hashes are one class, so copies are compared once. Classes meet by bands: hashes are cut into m bands, each band i has a
radius r_i, and the radii sum to threshold - m + 1; of two hashes within the threshold, some band then differs in r_i bits at
most, for else they would differ in more than the threshold (a band may have no radius at all, and takes no part). One side
probes all values so near to its own, which leaves an equi join. The more rows there are, the wider the bands that pay: fewer
pairs meet by chance, and more values are probed. So m and the radii follow from the rows on both sides and from how often two
rows share a band's value, as counted over all rows: a band with a value that very many rows share gets a small radius or none.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.hashes import bare_hex

#: A row that is shuffled costs as much as the comparison of so many pairs that meet.
ROW_COST = 10
#: Band values are counted only where more pairs than this could meet; below, any layout will do.
COUNTED_FROM = 1e9
#: Values that a row may probe in a band.
MOST_PROBES = 20_000
#: Values that one task probes, about.
VALUES_PER_TASK = 2_000_000


@dataclass(frozen=True)
class Band:
    """Bits of a 64-bit word from ``shift`` upwards."""

    word: int
    shift: int
    width: int

    def value(self, words: Column) -> Column:
        word = F.element_at(words, self.word + 1)
        return word if self.width == 64 else F.shiftrightunsigned(word, self.shift).bitwiseAND(F.lit((1 << self.width) - 1).cast("long"))

    def near(self, words: Column, masks: Column) -> Column:
        """Array of this band's value changed by each of the ``masks``."""
        value = self.value(words)
        return F.transform(masks, lambda mask: mask.bitwiseXOR(value))


def even_bands(bits: int, per_word: int) -> list[Band]:
    """Every 64-bit word (or the whole of a shorter hash) in ``per_word`` bands of nearly equal widths."""
    size = min(bits, 64)
    cuts = [size * i // per_word for i in range(per_word + 1)]
    return [Band(word, a, b - a) for word in range(-(-bits // 64)) for a, b in zip(cuts, cuts[1:], strict=False)]


def probes(width: int, radius: int) -> int:
    """Values within ``radius`` bits of a value of ``width`` bits."""
    return sum(comb(width, i) for i in range(radius + 1))


def radii(bands: list[Band], threshold: int, row_cost: float, meeting: list[float]) -> tuple[list[int], float]:
    """The cheapest radii (-1: none) that sum to threshold - m + 1, and their cost. ``row_cost`` is that of one probed value of all
    rows, ``meeting`` the pairs that meet at a band for each value probed. Costs are convex in the radius, so steps are taken one by
    one where they cost least."""
    out, cost = [-1] * len(bands), 0.0
    for _ in range(threshold + 1):
        steps = [comb(b.width, r + 1) * (row_cost + meet) if r < b.width and probes(b.width, r + 1) <= MOST_PROBES else float("inf") for b, r, meet in zip(bands, out, meeting, strict=True)]
        i = min(range(len(bands)), key=steps.__getitem__)
        out[i] += 1
        cost += steps[i]
    return out, cost


def layouts(bits: int, threshold: int) -> list[list[Band]]:
    """The divisions that are weighed against each other: two to eight bands a word."""
    words = -(-bits // 64)
    return [even_bands(bits, m) for m in range(1 if words > 1 else 2, 9) if m * words <= threshold + 1] or [even_bands(bits, 1)]


def _meeting_shares(classes: DataFrame, options: list[list[Band]]) -> dict[Band, float]:
    """For each band the share of pairs of rows with equal values, over all rows."""
    bands = sorted({b for o in options for b in o}, key=lambda b: (b.word, b.shift, b.width))
    each = classes.select(F.posexplode(F.array(*[b.value(F.col("words")) for b in bands])).alias("band", "value"))
    counts = each.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy("band").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("equal"), F.sum("n").alias("n")).collect()  # a row for each band
    return {bands[r["band"]]: r["equal"] / r["n"] ** 2 for r in rows}


def chosen_bands(probing: DataFrame, other: DataFrame, bits: int, threshold: int, n_probing: int, n_other: int) -> list[tuple[Band, int]]:
    """The bands that take part, with their radii."""
    options = layouts(bits, threshold)
    pairs = float(n_probing) * n_other
    shares = _meeting_shares(other, options) if pairs > COUNTED_FROM else {}
    best: tuple[float, list[tuple[Band, int]]] | None = None
    for bands in options:
        found, cost = radii(bands, threshold, ROW_COST * n_probing, [pairs * shares.get(b, 2.0**-b.width) for b in bands])
        used = [(b, r) for b, r in zip(bands, found, strict=True) if r >= 0]
        cost += ROW_COST * n_other * len(used)
        if best is None or cost < best[0]:
            best = cost, used
    return best[1]


def hash_classes(df: DataFrame, hash_col: str, bits: int = 64) -> DataFrame:
    """The distinct well-formed hashes of a column: key (bare lower-case hex) and words (its 64-bit words)."""
    size = min(bits, 64) // 4
    words = F.array(*[F.conv(F.substring("key", size * i + 1, size), 16, -10).cast("long") for i in range(-(-bits // 64))])
    keys = df.select(bare_hex(F.col(hash_col)).alias("key")).filter(F.length("key") == bits // 4).distinct()
    return keys.withColumn("words", words)


def _masks(zero: Column, width: int, radius: int) -> Column:
    """Array of the numbers of ``width`` bits with at most ``radius`` ones. ``zero`` is a column, so that no plan holds the numbers."""
    bits, bit = F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    further = lambda e: F.transform(F.filter(bits, lambda i: i >= e["next"]), lambda i: F.struct(e["v"].bitwiseXOR(bit(i)).alias("v"), (i + 1).alias("next")))
    levels = [F.array(F.struct(zero.alias("v"), F.lit(0).alias("next")))]
    for _ in range(radius):
        levels.append(F.flatten(F.transform(levels[-1], further)))
    return F.transform(F.concat(*levels), lambda e: e["v"])


def _probing(classes: DataFrame, bands: list[tuple[Band, int]], n: int) -> DataFrame:
    """The n classes, dealt to tasks by the values that they will probe, with ``masks`` of each band: a table of one row, sent to all."""
    tasks = ceil(n * sum(probes(band.width, r) for band, r in bands) / VALUES_PER_TASK)
    dealt = classes.repartition(tasks, "key") if tasks > 1 else classes
    table = classes.sparkSession.range(1).select(F.array(*[_masks(F.col("id"), band.width, r) for band, r in bands]).alias("masks"))
    return dealt.crossJoin(F.broadcast(table))  # one row


def _distance(a: Column, b: Column, words: int) -> Column:
    each = [F.bit_count(F.element_at(a, i + 1).bitwiseXOR(F.element_at(b, i + 1))) for i in range(words)]
    out = each[0]
    for x in each[1:]:
        out = out + x
    return out


def near_classes(a: DataFrame, b: DataFrame, a_hash: str, b_hash: str, threshold: int, bits: int = 64, bands: list[tuple[Band, int]] | None = None) -> DataFrame:
    """Pairs (a_key, b_key, distance) of distinct hashes of the two tables within ``threshold`` bits, each pair once.

    Malformed and null hashes take no part. The side with fewer distinct hashes probes. ``bands`` overrides the choice.
    """
    if threshold < 0:
        raise ValueError("threshold must not be negative")
    words = -(-bits // 64)
    left, right = hash_classes(a, a_hash, bits), hash_classes(b, b_hash, bits)
    sides = left.select(F.lit("left").alias("side")).unionByName(right.select(F.lit("right").alias("side"))).groupBy("side").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["side"]: r["n"] for r in sides.collect()}
    n_left, n_right = sizes.get("left", 0), sizes.get("right", 0)
    turned = n_right < n_left
    probing, other = (right, left) if turned else (left, right)
    if threshold >= bits:
        raise ValueError("every pair is within the threshold")
    if bands is None:
        bands = chosen_bands(probing, other, bits, threshold, min(n_left, n_right), max(n_left, n_right))

    def keyed(classes: DataFrame, name: str, probe: bool) -> DataFrame:
        classes = _probing(classes, bands, min(n_left, n_right)) if probe else classes
        values = [band.near(F.col("words"), F.get("masks", i)) if probe else F.array(band.value(F.col("words"))) for i, (band, _) in enumerate(bands)]
        out = classes.select(F.col("key").alias(f"{name}_key"), F.col("words").alias(f"{name}_words"), F.posexplode(F.array(*values)).alias("band", "values"))
        return out.select(f"{name}_key", f"{name}_words", "band", F.explode("values").alias("value"))

    p, o = keyed(probing, "p", True), keyed(other, "o", False)
    distance = _distance(F.col("p_words"), F.col("o_words"), words)
    met = p.join(o, (p["band"] == o["band"]) & (p["value"] == o["value"]) & (distance <= threshold)).select("p_key", "o_key", "p_words", "o_words", p["band"].alias("band"), distance.alias("distance"))
    # a pair may meet at several bands: it stays at the first at which it is near
    near = [F.bit_count(band.value(F.col("p_words")).bitwiseXOR(band.value(F.col("o_words")))) <= r for band, r in bands]
    first = F.coalesce(*[F.when(c, i) for i, c in enumerate(near)])
    met = met.filter(first == F.col("band"))
    a_key, b_key = ("o_key", "p_key") if turned else ("p_key", "o_key")
    return met.select(F.col(a_key).alias("a_key"), F.col(b_key).alias("b_key"), "distance")


def near_rows(a: DataFrame, b: DataFrame, a_hash: str, b_hash: str, threshold: int, bits: int = 64) -> DataFrame:
    """All pairs of rows within ``threshold`` bits, with the distance: the pairs of hashes, met by the rows that have them."""
    pairs = near_classes(a, b, a_hash, b_hash, threshold, bits)
    out = a.withColumn("a_key", bare_hex(F.col(a_hash))).join(pairs, "a_key").join(b.withColumn("b_key", bare_hex(F.col(b_hash))), "b_key")
    return out.drop("a_key", "b_key")


def meeting_rows(a: DataFrame, b: DataFrame, a_hash: str, b_hash: str, threshold: int, bits: int = 64) -> tuple[int, int]:
    """What a join costs: values probed, and pairs that meet at a band and are compared."""
    left, right = hash_classes(a, a_hash, bits), hash_classes(b, b_hash, bits)
    probing, other = (right, left) if (turned := right.count() < left.count()) else (left, right)
    n, m = (right.count(), left.count()) if turned else (left.count(), right.count())
    bands = chosen_bands(probing, other, bits, threshold, n, m)
    total = 0
    for i, (band, _) in enumerate(bands):
        p = _probing(probing, bands, n).select(F.explode(band.near(F.col("words"), F.get("masks", i))).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        o = other.select(band.value(F.col("words")).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("m"))
        total += p.join(o, "value").agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    return n * sum(probes(band.width, r) for band, r in bands), total


def similarity_links(queries: DataFrame, images: DataFrame, threshold: int = 10, bits: int = 64) -> DataFrame:
    """Pairs of distinct hashes (query_hash, phash, distance) with the rows on either side (n_queries, n_images); copies are not
    expanded. ``queries``: query_hash; ``images``: phash."""
    pairs = near_classes(queries, images, "query_hash", "phash", threshold, bits)
    of = lambda df, col, key, n: df.groupBy(bare_hex(F.col(col)).alias(key)).agg(F.count(F.lit(1)).alias(n))
    out = pairs.join(of(queries, "query_hash", "a_key", "n_queries"), "a_key").join(of(images, "phash", "b_key", "n_images"), "b_key")
    return out.select(F.col("a_key").alias("query_hash"), F.col("b_key").alias("phash"), "distance", "n_queries", "n_images")
