"""Array/math column functions (M1–M6) as native higher-order expressions.

These run inside the JVM.  The bulk question × index scoring does not use
them (it is a blocked NumPy product, see ``operators.search``); they serve
re-scoring, pooling and small per-row work.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reference's embedding maths.
NORM_EPS = 1e-12      # L2 normalise: v / max(||v||, eps)
MASK_EPS = 1e-9       # mean pooling: sum(mask) clamped below


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda a, x: a + x)


def dot(a, b) -> Column:
    """M2: Σ a_i·b_i in double."""
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))))


def l2_normalise(a) -> Column:
    """M1: ``v / max(||v||, 1e-12)``."""
    n = F.greatest(l2_norm(a), F.lit(NORM_EPS))
    return F.transform(_c(a), lambda x: x.cast("double") / n)


def cosine(a, b) -> Column:
    return dot(a, b) / (F.greatest(l2_norm(a), F.lit(NORM_EPS)) * F.greatest(l2_norm(b), F.lit(NORM_EPS)))


def squared_l2(a, b) -> Column:
    """M3: Σ (a_i − b_i)²."""
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) *
                                                      (x.cast("double") - y.cast("double"))))


def truncate(a, n: int) -> Column:
    """M5: keep the first ``n`` elements (model token limit)."""
    return F.slice(_c(a), 1, n)


def pad(a, n: int, value) -> Column:
    """M6: right-pad to length ``n`` with ``value`` (longer arrays unchanged)."""
    arr = _c(a)
    return F.concat(arr, F.array_repeat(F.lit(value), F.greatest(F.lit(n) - F.size(arr), F.lit(0))))


def attention_mask(a, n: int) -> Column:
    """M6: 1 for real elements, 0 for padding, length ``max(n, size(a))``."""
    size = F.size(_c(a))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(n), size) - 1),
                       lambda i: F.when(i < size, 1).otherwise(0))
