"""The scalar builders as SQL functions with bodies in SQL, for queries written as text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quakelens.functions import columns as C


def _text(value: str) -> str:
    return "r'" + value + "'" if "'" not in value else 'r"' + value + '"' if '"' not in value else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _masked() -> str:
    body = "body"
    for pattern, mark in C.MASK:
        body = f"regexp_replace({body}, {_text(C.ascii_bounded(pattern))}, {_text(mark)})"
    return body


_FLOOR = f"{C.ABSOLUTE_MIN_SCALE!r}D"
_BY_REFERENCE = f"abs(reference) * {C.MIN_SCALE_FRACTION}D"
_SPREAD = f"{C.CONFIDENCE_CEILING - C.CONFIDENCE_FLOOR!r}D"

#: Name: parameters, type and body.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "mask_log": ("body STRING", "STRING", _masked()),
    "iso_utc": ("ts TIMESTAMP", "STRING", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"),
    "seconds_between": ("earlier TIMESTAMP, later TIMESTAMP", "DOUBLE", "(unix_micros(later) - unix_micros(earlier)) / 1000000D"),
    "error_ratio": ("failures DOUBLE, requests DOUBLE", "DOUBLE", "round(CASE WHEN requests > 0 THEN failures / requests ELSE 0D END, 6)"),
    "robust_scale": (
        "median_value DOUBLE, mad DOUBLE, points BIGINT, reference DOUBLE", "DOUBLE",
        f"CASE WHEN points < 2 THEN CASE WHEN coalesce(reference, 0D) <> 0 THEN {_BY_REFERENCE} ELSE {_FLOOR} END ELSE greatest(mad * {C.MAD_TO_SIGMA}D, abs(median_value) * {C.MIN_SCALE_FRACTION}D, CASE WHEN median_value = 0 AND coalesce(reference, 0D) <> 0 THEN {_BY_REFERENCE} ELSE {_FLOOR} END) END",
    ),
    "robust_z": ("baseline DOUBLE, incident DOUBLE, scale DOUBLE", "DOUBLE", "coalesce((incident - baseline) / scale, 0D)"),
    "directed": ("signed DOUBLE, direction STRING", "DOUBLE", "CASE direction WHEN 'UP' THEN greatest(signed, 0D) WHEN 'DOWN' THEN greatest(-signed, 0D) ELSE abs(signed) END"),
    "confidence_from_ratio": (
        "top DOUBLE, runner_up DOUBLE", "DOUBLE",
        f"CASE WHEN runner_up IS NULL THEN {C.CONFIDENCE_FLOOR}D WHEN runner_up <= 0 THEN {C.CONFIDENCE_CEILING}D ELSE round({C.CONFIDENCE_FLOOR}D + {_SPREAD} * (1D - 1D / greatest(top / runner_up, 1D)), 4) END",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Register every function in the session; its names. A body is expanded into the query, so plans are those of the builders."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
