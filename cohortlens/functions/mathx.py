"""Numeric expressions (sigmoid, threshold, stable BCE, histogram bins)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["sigmoid", "predict", "bce_with_logits", "bin_index", "safe_div"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(x)))


def predict(score, threshold: float = 0.5) -> Column:
    """p_sigmoid_threshold: strict '>' on the probability."""
    return F.when(_c(score) > threshold, 1).otherwise(0)


def bce_with_logits(logit, y, pos_weight: float = 1.0) -> Column:
    """Numerically stable BCE with logits:
    l = pw*y*softplus(-x) + (1-y)*softplus(x), softplus(z)=max(z,0)+log1p(exp(-|z|))."""
    x, y = _c(logit), _c(y).cast("double")

    def softplus(z):
        return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    return pos_weight * y * softplus(-x) + (1 - y) * softplus(x)


def bin_index(x, lo, hi, bins: int) -> Column:
    """Equal-width bin of x in [lo, hi] (numpy rule: last bin closed)."""
    x, lo, hi = _c(x), _c(lo), _c(hi)
    w = (hi - lo) / bins
    return F.when(hi == lo, 0).otherwise(
        F.least(F.floor((x - lo) / w), F.lit(bins - 1))).cast("int")


def safe_div(a, b) -> Column:
    """p_ratio: a / b, null when b is 0."""
    return _c(a) / F.nullif(_c(b), F.lit(0))
