"""The registered queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quakelens.llm import binary_packing, bpe, exact, hard_negatives, html, minhash, packing, quality, secrets, spelling, tiff, tokcount, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": minhash.op1,
    "op2_secrets": secrets.op2,
    "op3_exact_dedup": exact.op3,
    "op4_quality": quality.op4,
    "op5_tiff": tiff.op5,
    "op6_packing": packing.op6,
    "op7_bpe": bpe.op7,
    "op8_url_filter": urls.op8,
    "op9_token_counts": tokcount.op9,
    "op10_html": html.op10,
    "op11_binary_packing": binary_packing.op11,
    "op12_spelling": spelling.op12,
    "op13_hard_negatives": hard_negatives.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": exact.ORACLE,
    "op8_url_filter": urls.ORACLE,
    "op12_spelling": spelling.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
