"""Column expressions for smoothed probabilities and score normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kadence.conventions import PROB_FLOOR


def m_estimate(n: Column, total: Column, values: Column | float) -> Column:
    """Smoothed relative frequency with weight one: (n + 1/values) / (total + 1)."""
    return (n + 1.0 / values) / (total + 1.0)


def log_m_estimate(n: Column, total: Column, values: Column | float) -> Column:
    """Natural log of the m-estimate, floored."""
    return F.log(F.greatest(m_estimate(n, total, values), F.lit(PROB_FLOOR)))


def normalise_vector(scores: Column) -> Column:
    """Softmax of an array of scores, shifted by the maximum.

    The maximum and the sum come as arrays beside the scores: within a lambda they would be worked out per element.
    """
    beside = lambda value: F.array_repeat(value, F.size(scores))
    weights = F.zip_with(scores, beside(F.array_max(scores)), lambda s, peak: F.exp(s - peak))
    mass = F.aggregate(weights, F.lit(0.0), lambda a, b: a + b)
    return F.zip_with(weights, beside(mass), lambda w, total: w / total)
