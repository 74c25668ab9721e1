"""Arithmetic on groups of numbers within an array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let


def _groups(x: Column, group: int, pad: bool) -> Column:
    n = F.ceil(F.size(x) / group).cast("int")
    part = lambda g: F.slice(x, g * group + 1, group)
    whole = (lambda g: F.concat(part(g), F.array_repeat(F.lit(0.0), group - F.size(part(g))))) if pad else part
    return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), n - 1), whole)).otherwise(F.array().cast("array<array<double>>"))


def half(x: Column) -> Column:
    """A number of no sign as the nearest that 16 bits hold (ties to even), as numbers of 64 bits; too large ones are infinite."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(x)), F.lit(-14)) - 10)
    near = F.bround(x / step, 0) * step
    return F.when(x <= 0, F.lit(0.0)).when(near >= 65520, F.lit(float("inf"))).otherwise(near)


def _scale(g: Column, bits: int, fp16: bool) -> Column:
    s = F.greatest(F.array_max(F.transform(g, lambda v: F.abs(v))) / float(2 ** (bits - 1) - 1), F.lit(1e-8))
    return half(s) if fp16 else s


def _rounded(g: Column, bits: int, fp16: bool, out) -> Column:
    """``out`` of each number's code and its group's scale; where 16 bits hold no scale so small, codes are zero."""
    top = float(2 ** (bits - 1) - 1)
    code = lambda v, s: F.when(s == 0, F.lit(0.0)).otherwise(F.greatest(F.least(F.bround(v / s, 0), F.lit(top)), F.lit(-top)))
    return let(_scale(g, bits, fp16), lambda s: F.transform(g, lambda v: out(code(v, s), s)))


def scales(x: Column, bits: int = 4, group: int = 64, fp16: bool = False) -> Column:
    return F.transform(_groups(x, group, False), lambda g: _scale(g, bits, fp16))


def codes(x: Column, bits: int = 4, group: int = 64, fp16: bool = False) -> Column:
    """Symmetric integers of each group, rounded half to even."""
    return F.flatten(F.transform(_groups(x, group, False), lambda g: _rounded(g, bits, fp16, lambda c, s: c.cast("int"))))


def quantized(x: Column, bits: int = 4, group: int = 64, fp16: bool = False) -> Column:
    """What codes stand for; ``fp16`` stores a group's scale in 16 bits."""
    return F.flatten(F.transform(_groups(x, group, False), lambda g: _rounded(g, bits, fp16, lambda c, s: c * s)))


def quantizable(name: Column, n_dims: Column, tables: bool = True) -> Column:
    """Whether a model's parameter is quantized: those of two dimensions or more, look-up tables only if asked for."""
    return (n_dims >= 2) & (F.lit(tables) | ~F.contains(name, F.lit("table")))


def packed(code: Column, bits_offset: int = 8) -> Column:
    """Two codes in a byte, the even one low; where the last byte has one, its high half is zero."""

    def join(c):
        at = lambda i: F.coalesce(F.try_element_at(c, i) + bits_offset, F.lit(0))
        pairs = F.sequence(F.lit(0), F.ceil(F.size(c) / 2).cast("int") - 1)
        return F.when(F.size(c) > 0, F.array_join(F.transform(pairs, lambda p: F.lower(F.lpad(F.hex(at(2 * p + 1) + 16 * at(2 * p + 2)), 2, "0"))), ""))

    return let(code, join)
