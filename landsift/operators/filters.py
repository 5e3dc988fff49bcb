"""Record filters: absent means all, ``none`` means no rows, anything else is a list of known values."""

from __future__ import annotations

from collections.abc import Sequence

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

# Fixed vocabularies.
STATUSES = ("layout", "preliminary", "final", "issued_permit", "completed", "proposed")
TYPES = ("subdivision", "building_permit", "public_submission")
CONFIDENCE = ("low", "medium", "high")
FLAGS = ("intersects_floodplain", "near_protected_area", "near_waterway", "near_wetland")
NONE = "none"


class InvalidFilter(ValueError):
    """A filter that mixes ``none`` with values or names an unknown one."""


def parse(values: Sequence[str] | None, field: str, allowed: Sequence[str]) -> list[str] | None:
    if values is None:
        return None
    if NONE in values:
        if set(values) != {NONE}:
            raise InvalidFilter(f"{field}={NONE} stands alone")
        return []
    if unknown := sorted(set(values) - set(allowed)):
        raise InvalidFilter(f"unknown {field}: {', '.join(unknown)}")
    return list(values)


def predicate(column: Column, values: list[str] | None) -> Column:
    return F.lit(True) if values is None else F.lit(False) if not values else column.isin(*values)


def filter_records(
    df: DataFrame,
    *,
    status: Sequence[str] | None = None,
    development_type: Sequence[str] | None = None,
    confidence: Sequence[str] | None = None,
    flag: Sequence[str] | None = None,
) -> DataFrame:
    """Status, type, confidence and any of the flags (array column proximity_flags of struct<flag_type>)."""
    for column, values, allowed in (("status", status, STATUSES), ("development_type", development_type, TYPES), ("confidence_level", confidence, CONFIDENCE)):
        df = df.where(predicate(F.col(column), parse(values, column, allowed)))
    wanted = parse(flag, "flag", FLAGS)
    return df if wanted is None else df.where(F.exists("proximity_flags", lambda f: predicate(f["flag_type"], wanted)))


def watch_predicate(status: Column, kind: Column, statuses: Column, types: Column) -> Column:
    """A watch without a list takes all."""
    return F.when(statuses.isNull(), True).otherwise(F.array_contains(statuses, status)) & F.when(types.isNull(), True).otherwise(F.array_contains(types, kind))


def watch_filter_problem(statuses: Column, types: Column, most: int = 16) -> Column:
    unknown = lambda values, allowed: F.size(F.array_except(F.coalesce(values, F.array()), F.array(*map(F.lit, allowed)))) > 0
    return F.when(unknown(statuses, STATUSES), "unknown_status").when(unknown(types, TYPES), "unknown_type").when(F.size(F.coalesce(statuses, F.array())) + F.size(F.coalesce(types, F.array())) > most, "too_many")


def eligible_for_screening(df: DataFrame) -> DataFrame:
    """Only subdivisions with a geometry are screened."""
    return df.where((F.col("development_type") == "subdivision") & F.col("geom").isNotNull())


def serialise(filters: dict[str, Sequence[str] | None]) -> list[tuple[str, str]]:
    """Query pairs: an absent filter gives none, an empty one the word ``none``."""
    return [(k, v) for k, values in filters.items() if values is not None for v in (values or [NONE])]
