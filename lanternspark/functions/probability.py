"""Probability algebra over columns: softmax, log-softmax, interpolation, guarded division."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

FLOOR = -10000.0  #: log-probability of a token that no neighbour names


def softmax(logit: Column, *by: str) -> Column:
    """Softmax of a column within groups; the largest is subtracted first."""
    w = Window.partitionBy(*by)
    e = F.exp(logit - F.max(logit).over(w))
    return e / F.sum(e).over(w)


def log_softmax(logit: Column, *by: str) -> Column:
    w = Window.partitionBy(*by)
    top = F.max(logit).over(w)
    return logit - (top + F.log(F.sum(F.exp(logit - top)).over(w)))


def floor_log(p: Column) -> Column:
    """log(p), FLOOR for 0 or null."""
    return F.when(p > 0, F.log(p)).otherwise(F.lit(FLOOR))


def log_add(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)) without overflow."""
    top = F.greatest(a, b)
    return top + F.log(F.exp(a - top) + F.exp(b - top))


def interpolate(knn: Column, lm: Column, weight: float) -> Column:
    """log((1 - weight) exp(lm) + weight exp(knn)); the ends 0 and 1 give lm and knn themselves."""
    if weight <= 0:
        return lm
    if weight >= 1:
        return knn
    return log_add(lm + F.log(F.lit(1 - weight)), knn + F.log(F.lit(weight)))


def safe_div(a: Column, b: Column) -> Column:
    """a / b, 1.0 where b is 0."""
    return F.when(b == 0, F.lit(1.0)).otherwise(a / b)


def perplexity(mean_loss: Column) -> Column:
    """exp of a mean loss; overflow gives infinity."""
    return F.exp(mean_loss)


def no_nan(c: Column) -> Column:
    """NaN as null, so that averages leave it out."""
    return F.when(~F.isnan(c), c)
