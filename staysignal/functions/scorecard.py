"""A fixed linear scorecard: a deterministic stand-in for a fitted model.

It makes every scoring-dependent operator (metrics, curves, recommendations,
what-if, attributions) exactly reproducible, and it is pure Column algebra,
so scoring stays inside whole-stage codegen.  Operators also accept any
``scorer(DataFrame) -> DataFrame`` that adds ``p`` (e.g. a PipelineModel).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED VALUES — scorecard weights (intercept, then (term, weight) in order)
INTERCEPT = -0.9
TERMS = [
    ("Contract=Month-to-month", 1.2),
    ("Contract=Two year", -1.0),
    ("InternetService=Fiber optic", 0.8),
    ("tenure", -0.03),
    ("MonthlyCharges", 0.01),
    ("PaymentMethod=Electronic check", 0.4),
    ("TechSupport=Yes", -0.4),
    ("OnlineSecurity=Yes", -0.3),
    ("SeniorCitizen", 0.2),
]
FEATURES = ["Contract", "InternetService", "tenure", "MonthlyCharges", "PaymentMethod",
            "TechSupport", "OnlineSecurity", "SeniorCitizen"]


# probabilities carry this many decimals (at most 10,001 distinct values)
DECIMALS = 4


def term_value(term: str, cols: dict | None = None) -> Column:
    """Value of one scorecard term (indicator or numeric) as double."""
    cols = cols or {}
    if "=" in term:
        name, level = term.split("=", 1)
        src = cols.get(name, F.col(name))
        return F.when(src == level, F.lit(1.0)).otherwise(F.lit(0.0))
    return cols.get(term, F.col(term)).cast("double")


def margin(cols: dict | None = None) -> Column:
    """Linear predictor z; ``cols`` overrides feature columns (what-if, actions)."""
    z = F.lit(INTERCEPT)
    for term, w in TERMS:
        z = z + F.lit(w) * term_value(term, cols)
    return z


def probability(cols: dict | None = None) -> Column:
    """p = round(sigmoid(z), DECIMALS)."""
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(cols))), DECIMALS)


def score(df: DataFrame, out: str = "p") -> DataFrame:
    """Scorer interface: adds probability column ``out``."""
    return df.withColumn(out, probability())
