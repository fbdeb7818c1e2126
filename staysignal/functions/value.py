"""Lifetime value, revenue at risk and ROI as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DEFAULT_EXPECTED_MONTHS, EXPECTED_TOTAL_MONTHS


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def expected_months(contract) -> Column:
    """Contract -> expected total months, unknown -> 24 (a literal map, so the
    lookup is a hash probe inside codegen rather than a join)."""
    pairs = []
    for k, v in EXPECTED_TOTAL_MONTHS.items():
        pairs += [F.lit(k), F.lit(float(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), _c(contract)), F.lit(float(DEFAULT_EXPECTED_MONTHS)))


def remaining_months(contract, tenure) -> Column:
    return F.greatest(F.lit(0.0), expected_months(contract) - _c(tenure).cast("double"))
