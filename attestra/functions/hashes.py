"""Column functions on perceptual hashes: hex strings of 64 or 256 bits, optionally prefixed ``phash:``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare_hex(c: Column) -> Column:
    """Lower-case hex digits of a hash, or null where it is malformed."""
    digits = F.lower(F.regexp_replace(c, "^phash:", ""))
    return F.when(digits.rlike("^[0-9a-f]+$"), digits)


def _bits64(digits: Column) -> Column:
    return F.conv(digits, 16, -10).cast("long")


def hamming_hex(a: Column, b: Column, bits: int = 64) -> Column:
    """Bit distance of two hashes of ``bits`` bits; null where either is malformed or has another width (FN-1)."""
    a, b = bare_hex(a), bare_hex(b)
    width = bits // 4
    chunks = [(i * 16 + 1, min(16, width - i * 16)) for i in range(-(-width // 16))]
    parts = [F.bit_count(_bits64(F.substring(a, at, n)).bitwiseXOR(_bits64(F.substring(b, at, n)))) for at, n in chunks]
    return F.when((F.length(a) == width) & (F.length(b) == width), reduce(lambda x, y: x + y, parts))


def similarity_pct(distance: Column, bits: int = 64) -> Column:
    """Share of equal bits in per cent, two decimals (FN-2)."""
    return F.floor((bits - distance) * 100.0 / bits * 100 + 0.5) / 100


def ladder(c: Column, steps: list[tuple[float, str]], rest: str, at_most: bool = False) -> Column:
    """The label of the first step that ``c`` reaches: c >= step, or c <= step if ``at_most``. Null falls to ``rest``."""
    out = None
    for step, label in steps:
        reached = (c <= step) if at_most else (c >= step)
        out = F.when(reached, label) if out is None else out.when(reached, label)
    return out.otherwise(rest)


#: Distance and similarity ladders.
IMAGE_STEPS = [(0, "Identical"), (5, "Nearly identical"), (10, "Very similar"), (15, "Similar"), (20, "Somewhat similar")]
AUDIO_STEPS = [(100, "Identical"), (95, "Nearly Identical"), (90, "Very Similar"), (85, "Similar"), (70, "Somewhat Similar")]
BAND_STEPS = [(0.95, "very-high"), (0.85, "high"), (0.75, "medium")]
MATCH_STEPS = [(0.98, "exact-duplicate"), (0.90, "near-duplicate"), (0.80, "similar")]
FRAME_STEPS = [(8, "match"), (16, "weak")]


def interpret_distance(d: Column) -> Column:
    """FN-3."""
    return ladder(d, IMAGE_STEPS, "Different", at_most=True)


def interpret_audio(s: Column) -> Column:
    """FN-4."""
    return ladder(s, AUDIO_STEPS, "Different")


def frame_match(d: Column) -> Column:
    """FN-5."""
    return ladder(d, FRAME_STEPS, "no-match", at_most=True)


def similarity_band(s: Column) -> Column:
    """FN-6, band."""
    return ladder(s, BAND_STEPS, "low")


def match_type(s: Column) -> Column:
    """FN-6, type."""
    return ladder(s, MATCH_STEPS, "possible-match")


def positional_equal(a: Column, b: Column) -> Column:
    """Positions at which two strings have the same character, over the shorter one."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))), F.lit(0), lambda s, x: s + x)


def positional_similarity(a: Column, b: Column) -> Column:
    """Share of equal characters of two strings of one length; 0 where empty, missing or of unequal length (FN-7)."""
    same = (F.length(a) == F.length(b)) & (F.length(a) > 0)
    return F.when(same, positional_equal(a, b) / F.length(a)).otherwise(F.lit(0.0))


def _hex_of_bits(bits: Column, n: int) -> Column:
    """Hex string of an array of n booleans, most significant first."""
    text = F.array_join(F.transform(bits, lambda b: F.when(b, "1").otherwise("0")), "")
    parts = [(at, min(64, n - at)) for at in range(0, n, 64)]
    return F.concat(*[F.lpad(F.lower(F.conv(F.substring(text, at + 1, size), 2, 16)), size // 4, "0") for at, size in parts])


def _above(values: Column, threshold: Column) -> Column:
    """Which values exceed the threshold; it is bound once, not computed for each value."""
    return F.get(F.transform(F.array(threshold), lambda t: F.transform(values, lambda x: x > t)), 0)


def _median(values: Column, n: int) -> Column:
    ordered = F.sort_array(values)
    if n % 2:
        return F.element_at(ordered, n // 2 + 1)
    return (F.element_at(ordered, n // 2) + F.element_at(ordered, n // 2 + 1)) / 2


def median_threshold_hash(coefficients: Column, n: int = 64) -> Column:
    """Bit i: coefficient i exceeds the median of all but the first (FN-8)."""
    median = _median(F.slice(coefficients, 2, n - 1), n - 1)
    return _hex_of_bits(_above(coefficients, median), n)


def average_hash(cells: Column, n: int = 64) -> Column:
    """Bit i: cell i exceeds the mean of all cells (FN-9)."""
    mean = F.aggregate(cells, F.lit(0.0), lambda s, x: s + x.cast("double")) / n
    return _hex_of_bits(_above(cells, mean), n)


def difference_hash(cells: Column, width: int = 9, rows: int = 8) -> Column:
    """Bit per row and column but the last: the cell is smaller than its right neighbour (FN-9)."""
    at = [r * width + c + 1 for r in range(rows) for c in range(width - 1)]
    return _hex_of_bits(F.array(*[F.element_at(cells, i) < F.element_at(cells, i + 1) for i in at]), rows * (width - 1))
