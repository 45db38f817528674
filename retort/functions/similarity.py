"""Similarity and distance of bit and count vectors as Column expressions.

Bit vectors are packed into one or more longs (``pack_bits``), so a pair costs a few
``bit_count`` calls inside generated code. One rule for empty vectors holds everywhere, scalar
and bulk alike; each function states it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 64


def pack_bits(on: Column, width: int) -> Column:
    """``array<boolean>`` of ``width`` entries as ``array<bigint>`` words, bit 0 first; ``on`` is evaluated once."""
    count = -(-width // BITS)
    fold = lambda part: F.aggregate(F.reverse(part), F.lit(0).cast("bigint"), lambda w, b: F.shiftleft(w, 1).bitwiseOR(F.when(b, F.lit(1)).otherwise(F.lit(0)).cast("bigint")))
    if count == 1:
        return F.array(fold(F.slice(on, 1, width)))
    words = F.transform(F.array(on), lambda v: F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: fold(F.slice(v, k * BITS + 1, F.least(F.lit(BITS), width - k * BITS)))))
    return F.get(words, F.lit(0))


def on_bits(words: Column) -> Column:
    """Numbers of the bits that are set, ascending."""
    within = lambda w: F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.call_function("shiftright", w, i).bitwiseAND(F.lit(1)) == 1)
    return F.flatten(F.transform(words, lambda w, k: F.transform(within(w), lambda i: k * BITS + i)))


#: Vectors of so many words or counts at most are unrolled into generated code.
UNROLLED = 64


def ones(words: Column, width: int | None = None) -> Column:
    """Number of set bits; ``width``, if given, in generated code."""
    count = -(-width // BITS) if width else UNROLLED + 1
    if count <= UNROLLED:
        return sum((F.bit_count(F.get(words, F.lit(k))) for k in range(1, count)), F.bit_count(F.get(words, F.lit(0))))
    return F.aggregate(words, F.lit(0), lambda s, w: s + F.bit_count(w))


def shared_ones(x: Column, y: Column, width: int | None = None) -> Column:
    """Number of bits set in both."""
    count = -(-width // BITS) if width else UNROLLED + 1
    if count <= UNROLLED:
        both = [F.bit_count(F.get(x, F.lit(k)).bitwiseAND(F.get(y, F.lit(k)))) for k in range(count)]
        return sum(both[1:], both[0])
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.bitwiseAND(b)), F.lit(0), lambda s, w: s + F.bit_count(w))


def dot(x: Column, y: Column, width: int | None = None) -> Column:
    """Inner product of ``array<double>``."""
    if width and width <= UNROLLED:
        parts = [F.get(x, F.lit(k)) * F.get(y, F.lit(k)) for k in range(width)]
        return sum(parts[1:], parts[0])
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p * q).cast("double")), F.lit(0.0), lambda s, v: s + v)


def bit_table(x: Column, y: Column, width: int) -> tuple[Column, Column, Column, Column]:
    """(both, only x, only y, neither) as doubles."""
    both = shared_ones(x, y, width).cast("double")
    only_x, only_y = ones(x, width) - both, ones(y, width) - both
    return both, only_x, only_y, F.lit(float(width)) - both - only_x - only_y


def count_table(x: Column, y: Column, width: int | None = None) -> tuple[Column, Column, Column]:
    """(x.y, x.x, y.y) of ``array<double>``."""
    return dot(x, y, width), dot(x, x, width), dot(y, y, width)


def _over(top: Column, bottom: Column, empty: float) -> Column:
    return F.when(bottom == 0, F.lit(empty)).otherwise(F.try_divide(top, bottom))


def tanimoto(a, b, c, d):
    """a / (a+b+c); two empty vectors: 1."""
    return _over(a, a + b + c, 1.0)


def dice(a, b, c, d):
    """2a / (2a+b+c); two empty vectors: 1."""
    return _over(2 * a, 2 * a + b + c, 1.0)


def ct4(a, b, c, d):
    """ln(1+a) / ln(1+a+b+c); two empty vectors: 1."""
    return _over(F.log1p(a), F.log1p(a + b + c), 1.0)


def braun_blanquet(a, b, c, d):
    """a over the larger vector; two empty vectors: 1."""
    return _over(a, a + F.greatest(b, c), 1.0)


def simpson(a, b, c, d):
    """a over the smaller vector; one empty vector: 0."""
    return _over(a, a + F.least(b, c), 0.0)


def kulczynski(a, b, c, d):
    """Mean of a over either vector; two empty vectors: 1, one: 0."""
    mean = (F.try_divide(a, a + b) + F.try_divide(a, a + c)) / 2
    return F.when(a + b + c == 0, F.lit(1.0)).otherwise(F.coalesce(mean, F.lit(0.0)))


def mcconnaughey(a, b, c, d):
    """(a^2 - bc) / ((a+b)(a+c)), from -1 to 1; two empty vectors: 1, one: -1."""
    return F.when(a + b + c == 0, F.lit(1.0)).otherwise(_over(a * a - b * c, (a + b) * (a + c), -1.0))


def sokal_sneath_2(a, b, c, d):
    """a / (a+2b+2c); two empty vectors: 1."""
    return _over(a, a + 2 * b + 2 * c, 1.0)


def rand(a, b, c, d):
    """(a+d) / n."""
    return (a + d) / (a + b + c + d)


def russell(a, b, c, d):
    """a / n; a vector's similarity with itself may be below 1."""
    return a / (a + b + c + d)


def rogot_goldberg(a, b, c, d):
    """a/(2a+b+c) + d/(2d+b+c); 1 if either denominator is 0."""
    one, two = 2 * a + b + c, 2 * d + b + c
    return F.when((one == 0) | (two == 0), F.lit(1.0)).otherwise(F.try_divide(a, one) + F.try_divide(d, two))


def harris_lahey(a, b, c, d):
    """a(2d+b+c)/(2(a+b+c)) + d(2a+b+c)/(2(b+c+d)), from 0 to n; 1 if either denominator is 0."""
    one, two = 2 * (a + b + c), 2 * (b + c + d)
    value = F.try_divide(a * (2 * d + b + c), one) + F.try_divide(d * (2 * a + b + c), two)
    return F.when((one == 0) | (two == 0), F.lit(1.0)).otherwise(value)


def harris_lahey_normalized(a, b, c, d):
    """harris_lahey over n; 1 if either denominator is 0."""
    n = a + b + c + d
    return F.when((a + b + c == 0) | (b + c + d == 0), F.lit(1.0)).otherwise(harris_lahey(a, b, c, d) / n)


def mcconnaughey_normalized(a, b, c, d):
    return (mcconnaughey(a, b, c, d) + 1) / 2


def tanimoto_count(ab, aa, bb):
    """ab / (aa+bb-ab); 1 if the denominator is under 1e-8."""
    bottom = aa + bb - ab
    return F.when(bottom < 1e-8, F.lit(1.0)).otherwise(F.try_divide(ab, bottom))


def dice_count(ab, aa, bb):
    """2ab / (aa+bb); 1 if the denominator is under 1e-8."""
    return F.when(aa + bb < 1e-8, F.lit(1.0)).otherwise(F.try_divide(2 * ab, aa + bb))


def ct4_count(ab, aa, bb):
    """ln(1+ab) / ln(1+aa+bb-ab); 1 if the denominator is under 1e-8."""
    bottom = F.log1p(aa + bb - ab)
    return F.when(bottom < 1e-8, F.lit(1.0)).otherwise(F.try_divide(F.log1p(ab), bottom))


BINARY: dict[str, Callable[..., Column]] = {
    "tanimoto": tanimoto, "dice": dice, "ct4": ct4, "braun_blanquet": braun_blanquet, "simpson": simpson, "kulczynski": kulczynski,
    "mcconnaughey": mcconnaughey, "sokal_sneath_2": sokal_sneath_2, "rand": rand, "russell": russell, "rogot_goldberg": rogot_goldberg, "harris_lahey": harris_lahey,
}
COUNT: dict[str, Callable[..., Column]] = {"tanimoto": tanimoto_count, "dice": dice_count, "ct4": ct4_count}
#: Distances are 1 - similarity of these; the other families are their own.
NORMALIZED: dict[str, Callable[..., Column]] = {"mcconnaughey": mcconnaughey_normalized, "harris_lahey": harris_lahey_normalized}


def binary_similarity(name: str, x: Column, y: Column, width: int, normalized: bool = False) -> Column:
    return (NORMALIZED.get(name, BINARY[name]) if normalized else BINARY[name])(*bit_table(x, y, width))


def binary_distance(name: str, x: Column, y: Column, width: int) -> Column:
    return 1 - binary_similarity(name, x, y, width, normalized=True)


def count_similarity(name: str, x: Column, y: Column) -> Column:
    return COUNT[name](*count_table(x, y))


def count_distance(name: str, x: Column, y: Column) -> Column:
    return 1 - count_similarity(name, x, y)
