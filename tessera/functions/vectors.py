"""Vector expressions over array columns, evaluated in the JVM in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """Null where a norm is 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def int8(a) -> Column:
    """Per-vector minimum and maximum to 0..255, half to even."""
    lo, hi = F.array_min(a).cast("double"), F.array_max(a).cast("double")
    span = F.greatest(hi - lo, F.lit(1e-8))
    return F.transform(a, lambda x: F.rint((x.cast("double") - lo) / span * 255).cast("int"))


def int8_back(qv, lo, hi) -> Column:
    span = F.greatest(hi - lo, F.lit(1e-8))
    return F.transform(qv, lambda x: x / 255.0 * span + lo)


def bits(a) -> Column:
    """One bit a component, packed eight to a byte, first component highest; the last byte is padded with zeros."""
    bit = F.transform(a, lambda x: (x > 0).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 8).cast("int")), lambda i: F.aggregate(
        F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda s, j: s * 2 + F.coalesce(F.try_element_at(bit, (i * 8 + j + 1).cast("int")), F.lit(0))))


def hamming(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def int4(a) -> Column:
    """Sixteen levels, two to a byte, the first in the high half; an odd length is padded with 0."""
    lo, hi = F.array_min(a).cast("double"), F.array_max(a).cast("double")
    level = F.transform(a, lambda x: F.rint((x.cast("double") - lo) / F.greatest(hi - lo, F.lit(1e-8)) * 15).cast("int"))
    return F.transform(F.sequence(F.lit(1), F.size(a), F.lit(2)), lambda i: F.element_at(level, i) * 16 + F.coalesce(F.try_element_at(level, i + 1), F.lit(0)))
