"""Scalar cleaning expressions shared by the batch and scoring paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import YES_NO_MAP

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def yes_no_code(col, strict: bool = True) -> Column:
    """Trimmed text -> 1/0; NULL when the spelling is not a known one.

    ``strict=False`` also reads the spellings "1" and "0".
    """
    text = F.trim(_c(col).cast("string"))
    expr = None
    for word, code in YES_NO_MAP.items():
        if strict and word in ("1", "0"):
            continue
        expr = (F.when(text == word, F.lit(code)) if expr is None
                else expr.when(text == word, F.lit(code)))
    return expr


def binary_flag(col, strict: bool = True) -> Column:
    """Yes/No style flag -> int 1/0, unknown spellings and NULL -> 0."""
    return F.coalesce(yes_no_code(col, strict), F.lit(0)).cast("int")


def label_text(col) -> Column:
    """Consolidate True/False/Yes/No spellings to Yes/No text (others NULL)."""
    code = yes_no_code(col)
    return F.when(code == 1, "Yes").when(code == 0, "No")


def to_number(col) -> Column:
    """Text or number -> double, invalid -> NULL (never raises under ANSI).
    Only decimal notation counts: not "NaN", nor the "5d" a cast would take."""
    text = F.trim(_c(col).cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def senior_flag(col) -> Column:
    return F.coalesce(to_number(col), F.lit(0.0)).cast("int")


def blank_to_null(col) -> Column:
    return F.nullif(F.trim(_c(col).cast("string")), F.lit(""))


def total_charges(total, monthly="MonthlyCharges", tenure="tenure", impute: bool = True) -> Column:
    """TotalCharges text -> double; blank filled by MonthlyCharges*tenure when
    ``impute`` (batch cleaning), left NULL otherwise (scoring path)."""
    parsed = to_number(total)
    if not impute:
        return parsed
    return F.coalesce(parsed, _c(monthly) * _c(tenure))


def is_non_numeric(col) -> Column:
    """Present but not parseable as a number."""
    return _c(col).isNotNull() & to_number(col).isNull()
