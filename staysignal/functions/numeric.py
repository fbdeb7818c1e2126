"""Rounding that two engines evaluate bit-identically.

``round(x, d)`` implementations differ at near-ties (one rounds the decimal
representation, another scales by 10^d in floating point).  Money and
percentages computed from 4-decimal probabilities hit such ties often, so
they use ``floor(x * 10^d + 0.5) / 10^d``: the same IEEE operations
everywhere, half-up on the scaled binary value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(col, digits: int) -> Column:
    x = F.col(col) if isinstance(col, str) else col
    scale = float(10 ** digits)
    return (F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale))


def round_half_up_sql(expr: str, digits: int) -> str:
    scale = float(10 ** digits)
    return f"(CAST(FLOOR(({expr}) * {scale!r}e0 + 0.5e0) AS DOUBLE) / {scale!r}e0)"
