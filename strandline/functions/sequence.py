"""Scalar, array and aggregate expressions over token sequences.

Token tables hold one row a token; an array form exists where whole sequences
travel in one row. Everything is computed in double precision.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

EPS = 1e-8
#: Log floor of binary cross-entropy on probabilities.
LOG_FLOOR = -100.0
#: Probabilities are kept this far from 0 and 1 before noisy-or.
CLAMP = 1e-6


def _d(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_d(x)))


def relu(x) -> Column:
    return F.greatest(_d(x), F.lit(0.0))


def bce_with_logits(x, target) -> Column:
    x = _d(x)
    return F.greatest(x, F.lit(0.0)) - x * _d(target) + F.log1p(F.exp(-F.abs(x)))


def bce(p, target) -> Column:
    """Cross-entropy of a probability; logarithms stop at LOG_FLOOR."""
    p, y = _d(p), _d(target)
    log = lambda v: F.greatest(F.ln(v), F.lit(LOG_FLOOR))  # noqa: E731  ln(0) is null, and greatest skips nulls
    return -(y * log(p) + (1 - y) * log(1 - p))


def squared_error(a, b) -> Column:
    return (_d(a) - _d(b)) * (_d(a) - _d(b))


# Arrays


def let(value: Column, f) -> Column:
    """f(value), with value worked out once even if f uses it inside a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def dot(a, b) -> Column:
    """Inner product of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def linear(x, weights, bias: float = 0.0) -> Column:
    """Affine head with fixed weights.

    One fold over the array: unrolled sums of many heads outgrow what the JVM
    compiles, and take longer to plan than to run.
    """
    x = F.col(x) if isinstance(x, str) else x
    return F.lit(float(bias)) + dot(x, F.array(*[F.lit(float(w)) for w in weights]))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a, eps: float = 1e-12) -> Column:
    return let(F.greatest(norm(a), F.lit(eps)), lambda size: F.transform(a, lambda x: x.cast("double") / size))


def layer_norm(a, eps: float = 1e-5) -> Column:
    """Zero mean and unit (biased) variance; the affine part is left to the caller."""
    a = F.col(a) if isinstance(a, str) else a
    total = lambda f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x.cast("double")))
    spread = lambda mean: total(lambda x: (x - mean) * (x - mean)) / F.size(a)
    scaled = lambda mean, var: F.transform(a, lambda x: (x.cast("double") - mean) / F.sqrt(var + eps))
    return let(total(lambda x: x) / F.size(a), lambda mean: let(spread(mean), lambda var: scaled(mean, var)))


def pad_or_trim(a, length) -> Column:
    """Array cut to length or filled up with zeros; null stays null."""
    a = F.col(a) if isinstance(a, str) else a
    length = length if isinstance(length, Column) else F.lit(length)
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0), length)), F.lit(1), length)


def first_true(flags) -> Column:
    """Index of the first true element, or -1."""
    return F.coalesce(F.array_position(flags, True), F.lit(0)).cast("int") - 1


# Windows over the tokens of a row


def over_row(key: str = "row_index"):
    return Window.partitionBy(key)


def normalize_attention(att, key: str = "row_index", eps: float = EPS) -> Column:
    """Attention clamped at 0 and scaled to sum to one over the row's tokens."""
    a = relu(att)
    return a / F.greatest(F.sum(a).over(over_row(key)), F.lit(eps))


def softmax(logit, key: str = "row_index", eps: float = EPS) -> Column:
    """Softmax over the tokens of a row; there are no masked ones among them."""
    w = over_row(key)
    e = F.exp(_d(logit) - F.max(_d(logit)).over(w))
    return e / F.greatest(F.sum(e).over(w), F.lit(eps))


# Aggregates


def masked(value: Column, mask: Column) -> Column:
    return F.when(mask, value)


def mean_or_zero(value: Column, mask: Column | None = None) -> Column:
    """Mean over the rows where mask holds; 0 if there are none."""
    return F.coalesce(F.avg(value if mask is None else masked(value, mask)), F.lit(0.0))


def weighted_mean(value, weight, eps: float = EPS) -> Column:
    return F.sum(_d(weight) * _d(value)) / F.greatest(F.sum(_d(weight)), F.lit(eps))


def masked_mean(value, mask=None) -> Column:
    """Sum over the mask, divided by its size or 1."""
    m = F.lit(1.0) if mask is None else _d(mask)
    return F.sum(_d(value) * m) / F.greatest(F.sum(m), F.lit(1.0))


def noisy_or(logit) -> Column:
    """Probability that at least one token is positive."""
    p = F.greatest(F.least(sigmoid(logit), F.lit(1 - CLAMP)), F.lit(CLAMP))
    return 1 - F.exp(F.sum(F.ln(1 - p)))


def first_crossing(logit, pos, threshold: float = 0.5) -> Column:
    """First position whose probability is at least threshold, or -1."""
    return F.coalesce(F.min(F.when(sigmoid(logit) >= threshold, F.col(pos) if isinstance(pos, str) else pos)), F.lit(-1)).cast("long")
