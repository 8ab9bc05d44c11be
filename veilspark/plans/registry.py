"""All redaction queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import detections, faces, media, redaction, timelines, tracks

Query = Callable[[SparkSession, str], DataFrame]

_MODULES: list = [detections, timelines, media, tracks, redaction, faces]


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for m in _MODULES:
        found |= m.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _MODULES:
        found |= m.ORACLE
    return found
