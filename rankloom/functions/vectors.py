"""Vector expressions in double precision, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    # the length is bound to a name of its own: inside the components' lambda it would be worked out once a component
    lengths = F.array(F.greatest(norm(v), F.lit(1e-12)))
    return F.get(F.transform(lengths, lambda n: F.transform(v, lambda x: x.cast("double") / n)), F.lit(0))


def cut(v: Column, k: int) -> Column:
    """The first ``k`` dimensions, normalised again."""
    return normalised(F.slice(v, 1, k))


def quantise_int8(v: Column, low: float, high: float) -> Column:
    """255 steps between ``low`` and ``high``, truncated towards zero and clamped to a signed byte."""
    scale = F.lit(255.0) / F.lit(high - low)
    step = lambda x: F.least(F.greatest((x.cast("double") - low) * scale - 128, F.lit(-128.0)), F.lit(127.0)).cast("int")
    return F.transform(v, step)


def sign_bits(v: Column) -> Column:
    """One bit a component (1 if above zero), the first the highest bit of its byte, as integers of a byte each."""
    at = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 8).cast("int"))
    bit = lambda i, j: F.when(F.try_element_at(v, i * 8 + j + 1) > 0, F.lit(1 << (7 - j))).otherwise(F.lit(0))

    def byte(i: Column) -> Column:
        total = F.lit(0)
        for j in range(8):
            total = total + bit(i, j)
        return total

    return F.transform(at, byte)


def quantise_uint8(v: Column, low: float, high: float) -> Column:
    """As ``quantise_int8``, moved up to an unsigned byte."""
    return F.transform(quantise_int8(v, low, high), lambda x: x + 128)
