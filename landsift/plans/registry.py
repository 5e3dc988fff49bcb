"""All registered queries of the reference's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from landsift.plans import fields, files, intake, lifecycle, proofs, records, state

_ALL = records.QUERIES | fields.QUERIES | state.QUERIES | intake.QUERIES | files.QUERIES | lifecycle.QUERIES | proofs.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
