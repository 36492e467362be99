"""Numeric columns: softmax, inverse Poisson, products of factors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits; the largest is subtracted first."""
    exps = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(exps, F.lit(0.0), lambda a, x: a + x)
    return F.transform(exps, lambda e: e / total)


def product(factors: Column) -> Column:
    return F.aggregate(factors, F.lit(1.0), lambda a, x: a * x)


def poisson(u: Column, mean: float, most: int = 20) -> Column:
    """The Poisson number that a uniform number gives, up to ``most``."""
    total, term, out = 0.0, math.exp(-mean), F.lit(0)
    for k in range(most):
        total += term
        out = out + (u > total).cast("int")
        term *= mean / (k + 1)
    return out


def capped_rate(rate: Column, *factors: Column, most: float = 0.6) -> Column:
    """A base rate times its factors, never above ``most``."""
    for f in factors:
        rate = rate * f
    return F.least(F.lit(most), rate)
