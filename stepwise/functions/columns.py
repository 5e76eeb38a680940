"""Scalar column expressions (P-operators and the hashed random columns).

Everything here returns a ``Column``: no Python runs per row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference job constants.
DAMPENING = 0.85          # PageRank dampening factor
EPSILON = 0.0001          # bulk PageRank change threshold (strict >)
DELTA_THRESHOLD = 0.1     # delta PageRank threshold (strict >)
LEARNING_RATE = 0.01      # regression step size


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def duplicate_value(v, left: str = "v", right: str = "comp") -> list[Column]:
    """``v -> (v, v)``."""
    return [_c(v).alias(left), _c(v).alias(right)]


def dampen(rank, num_pages, d: float = DAMPENING) -> Column:
    """P5: ``rank * d + (1 - d) / numPages``."""
    return _c(rank) * F.lit(d) + (F.lit(1.0 - d) / _c(num_pages).cast("double")) \
        if not isinstance(num_pages, (int, float)) else \
        _c(rank) * F.lit(d) + F.lit((1.0 - d) / num_pages)


def changed(new, old, eps: float = EPSILON) -> Column:
    """Strict ``abs(new - old) > eps``."""
    return F.abs(_c(new) - _c(old)) > F.lit(eps)


def over_threshold(delta, t=DELTA_THRESHOLD) -> Column:
    """Strict ``abs(delta) > t`` (``t`` a number or a column)."""
    return F.abs(_c(delta)) > (t if isinstance(t, Column) else F.lit(t))


def smaller(candidate, current) -> Column:
    """Strict ``candidate < current``."""
    return _c(candidate) < _c(current)


def distance(x1, y1, x2, y2) -> Column:
    """Euclidean distance in two dimensions."""
    dx = _c(x1) - _c(x2)
    dy = _c(y1) - _c(y2)
    return F.sqrt(dx * dx + dy * dy)


def gradient_step(theta0, theta1, x, y, rate: float = LEARNING_RATE) -> tuple[Column, Column]:
    """One per-sample gradient step from ``(theta0, theta1)``."""
    t0, t1 = _c(theta0), _c(theta1)
    err = (t0 + t1 * _c(x)) - _c(y)
    return (t0 - F.lit(rate) * err).alias("theta0"), (t1 - F.lit(rate) * (err * _c(x))).alias("theta1")


# --- position-addressable random numbers (G7) -------------------------------
# A row's value depends only on (salt, id), never on partitioning or order:
# the 52 leading bits of md5("<salt>:<id>") scaled to [0, 1).
_TWO_52 = float(2 ** 52)


def _digest(id_col, salt) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(salt)), _c(id_col).cast("string")))


def _bits52(digest: Column, start: int) -> Column:
    """13 hex digits (52 bits) of a digest, scaled to [0, 1)."""
    return F.conv(F.substring(digest, start, 13), 16, 10).cast("double") / F.lit(_TWO_52)


def uniform(id_col, salt) -> Column:
    """Uniform double in [0, 1) addressed by ``(salt, id)``."""
    return _bits52(_digest(id_col, salt), 1)


def gaussian(id_col, salt) -> Column:
    """Standard normal by Box-Muller over the two halves of one digest."""
    dg = _digest(id_col, salt)
    u1 = F.lit(1.0) - _bits52(dg, 1)      # (0, 1], safe for log
    u2 = _bits52(dg, 14)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def format_2dp(x) -> Column:
    """S14 number format: two decimals, half-even, no grouping (``#0.00``)."""
    return F.call_function("format_number", _c(x), F.lit("#0.00"))
