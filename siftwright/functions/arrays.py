"""Sets and distributions held in arrays, in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets; 0 for two empty ones."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def log_softmax(logits: Column) -> Column:
    """Logarithms of the probabilities of logits; the largest is taken off first."""
    # bound once, in arrays of one; as plain expressions they would be computed for every element
    def shifted(x: Column) -> Column:
        top = F.array_max(x)
        return F.transform(F.array(F.struct(x.alias("x"), top.alias("top"))), normal)[0]

    def normal(v: Column) -> Column:
        mass = F.ln(F.aggregate(v["x"], F.lit(0.0), lambda s, y: s + F.exp(y - v["top"]))) + v["top"]
        return F.transform(F.array(F.struct(v["x"].alias("x"), mass.alias("mass"))), lambda w: F.transform(w["x"], lambda y: y - w["mass"]))[0]

    return F.transform(F.array(logits.cast("array<double>")), shifted)[0]


def reverse_kl(log_p: Column, log_q: Column) -> Column:
    """Divergence of p from q: the sum of p (log p - log q)."""
    return total(F.zip_with(log_p, log_q, lambda p, q: F.exp(p) * (p - q)))
