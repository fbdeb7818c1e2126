"""Registry of named query plans: name -> fn(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        return fn
    return deco


# Fits that take minutes in local mode; listed last so every cheap plan runs first.
HEAVY = ["ml_gbt", "ml_vote", "leaderboard", "ml_compare", "ml_select", "ml_tune"]


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Registered plans: SQL-checked plans first, then fitted-model plans,
    the slowest fits last."""
    # importing the modules registers their plans
    from . import q_clean, q_profile, q_sample, q_value, q_io, q_ml  # noqa: F401
    from .oracle import all_oracles
    checked = all_oracles()
    first = [k for k in QUERIES if k in checked]
    rest = [k for k in QUERIES if k not in checked and k not in HEAVY]
    return {k: QUERIES[k] for k in first + rest + [h for h in HEAVY if h in QUERIES]}
