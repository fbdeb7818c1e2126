"""Right-closed binning ``(a, b]`` like pandas ``cut`` (Spark's Bucketizer is
left-closed, so it is not used here)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (COHORT_BAND_EDGES, COHORT_BAND_LABELS, EDA_BAND_EDGES, EDA_BAND_LABELS,
                         NOTEBOOK_BAND_EDGES, NOTEBOOK_BAND_LABELS, RISK_LOW_MAX, RISK_MEDIUM_MAX)


def right_closed_band(col, edges, labels, include_lowest: bool = False) -> Column:
    """Label of the bin ``(edges[i], edges[i+1]]``; values outside -> NULL.

    With ``include_lowest`` the first bin is closed on the left too.
    """
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per bin")
    x = F.col(col) if isinstance(col, str) else col
    expr = None
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        cond = ((x >= lo) if (include_lowest and i == 0) else (x > lo)) & (x <= hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def eda_tenure_band(col="tenure") -> Column:
    return right_closed_band(col, EDA_BAND_EDGES, EDA_BAND_LABELS, include_lowest=False)


def cohort_tenure_band(col="tenure") -> Column:
    return right_closed_band(col, COHORT_BAND_EDGES, COHORT_BAND_LABELS, include_lowest=True)


def notebook_tenure_band(col="tenure") -> Column:
    return right_closed_band(col, NOTEBOOK_BAND_EDGES, NOTEBOOK_BAND_LABELS, include_lowest=False)


def risk_level(prob) -> Column:
    """Probability in [0,1] -> Low (<= .3), Medium (<= .6), High."""
    p = F.col(prob) if isinstance(prob, str) else prob
    return (F.when((p >= 0) & (p <= RISK_LOW_MAX), "Low")
             .when((p > RISK_LOW_MAX) & (p <= RISK_MEDIUM_MAX), "Medium")
             .when((p > RISK_MEDIUM_MAX) & (p <= 1.0), "High"))
