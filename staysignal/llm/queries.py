"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir
from . import (op1_sentencepiece, op2_substring, op3_langid, op4_packing, op5_license, op6_itq, op7_lines, op8_toxicity,
               op9_exact, op10_chosenpath, op11_token_counts, op12_negatives, op13_spelling)
from .common import table


def _over(name: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        return f(table(spark, sf_dir, name))
    return query


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return op8_toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": _over("documents", op1_sentencepiece.digest),
    "op2_substring_dedup": _over("documents", op2_substring.digest),
    "op3_language_id": _over("documents", op3_langid.digest),
    "op4_best_fit_packing": _over("documents", op4_packing.digest),
    "op5_license_scan": _over("documents", op5_license.digest),
    "op6_embedding_dedup": _over("embeddings", op6_itq.digest),
    "op7_line_dedup": _over("documents", op7_lines.digest),
    "op7_repeated_lines": _over("documents", op7_lines.digest_repeated),
    "op8_toxicity": _toxicity,
    "op9_exact_dedup": _over("documents", op9_exact.digest),
    "op10_jaccard_join": _over("documents", op10_chosenpath.digest),
    "op11_token_counts": _over("documents", op11_token_counts.digest),
    "op12_hard_negatives": _over("embeddings", op12_negatives.digest),
    "op13_spelling_variants": _over("documents", op13_spelling.digest),
}

ORACLES: dict[str, str] = {
    "op2_substring_dedup": op2_substring.ORACLE,
    "op5_license_scan": op5_license.ORACLE,
    "op6_embedding_dedup": op6_itq.ORACLE,
    "op7_line_dedup": op7_lines.ORACLE,
    "op7_repeated_lines": op7_lines.ORACLE_REPEATED,
    "op9_exact_dedup": op9_exact.ORACLE,
    "op10_jaccard_join": op10_chosenpath.ORACLE,
    "op12_hard_negatives": op12_negatives.ORACLE,
    "op13_spelling_variants": op13_spelling.ORACLE,
}
