"""Registry of oracle SQL strings (DuckDB dialect): name -> SQL."""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    if name in ORACLE:
        raise ValueError(f"duplicate oracle {name}")
    ORACLE[name] = sql


def all_oracles() -> dict[str, str]:
    from . import q_clean, q_profile, q_sample, q_value, q_io, q_ml  # noqa: F401
    return dict(ORACLE)
