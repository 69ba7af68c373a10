"""Vectors as array columns, in double precision, JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: what a lambda only refers to is computed
    anew for each element."""
    return F.transform(F.array(value), body)[0]


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column, eps: float = 1e-12) -> Column:
    """v over its length, or over eps if that is more."""
    return let(v, lambda own: let(F.greatest(norm(own), F.lit(eps)), lambda n: F.transform(own, lambda x: x.cast("double") / n)))


def unit_candidate(code: Column, eps: float = 1e-9) -> Column:
    """A code over its length plus eps: the scale of the code cancels."""
    return let(code, lambda own: let(norm(own) + eps, lambda n: F.transform(own, lambda x: x.cast("double") / n)))


def quantise_scale(v: Column) -> Column:
    return F.greatest(F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))), F.lit(1e-12)) / 127.0


def quantise(v: Column, scale: Column) -> Column:
    """Symmetric int8 codes: half to even, within 127 on either side."""
    return let(scale, lambda s: F.transform(v, lambda x: F.greatest(F.least(F.rint(x.cast("double") / s), F.lit(127.0)), F.lit(-127.0)).cast("tinyint")))


def dequantised_dot(query: Column, code: Column, scale: Column) -> Column:
    """The query stays as it is; only the index is coded."""
    return dot(query, code) * scale
