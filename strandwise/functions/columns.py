"""Scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def printable(text: Column) -> Column:
    """The text with control characters written as their code in brackets."""
    shown = F.transform(F.split(text, ""), lambda c: F.when((F.ascii(c) < 32) | (F.ascii(c) == 127), F.concat(F.lit("<"), F.ascii(c).cast("string"), F.lit(">"))).otherwise(c))
    return F.when(text == "", text).otherwise(F.array_join(shown, ""))


def log2_floor(n: Column) -> Column:
    """Place of the highest bit of a positive number."""
    return (F.length(F.bin(n)) - 1).cast("long")


def common_prefix(a: Column, b: Column, bits: int = 31) -> Column:
    """Length of the longest common prefix of two strings, by halving: as many comparisons as the length has ``bits`` at most."""
    shorter = F.least(F.length(a), F.length(b))
    powers = F.transform(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))
    same = lambda n, p: (n + p <= shorter) & (F.substring(a, n + 1, p) == F.substring(b, n + 1, p))
    return F.aggregate(powers, F.lit(0), lambda n, p: F.when(same(n, p), n + p).otherwise(n)).cast("long")


def marked(value: Column) -> tuple[Column, Column]:
    """(negative, zero): aggregates that count marked entries."""
    return F.count_if(value < 0), F.count_if(value == 0)
