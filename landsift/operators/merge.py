"""Coverage-aware merge of source batches, duplicate quarantine, source-missing detection, backfill report.

A batch holds observations (source_key, record_id, content, seen_on). The registry holds one row an
anchor (source_key, record_id): public id, first and last sighting, fingerprint. The registry is a
snapshot; a merge reads one and returns the next, so replays and lost jobs change nothing.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from landsift.functions.scalars import fingerprint, public_id, source_id_problem
from landsift.operators.tables import reject_all_duplicates

ANCHOR = ["source_key", "record_id"]


def quarantine(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a usable anchor that occurs once in the batch, the others with a reason)."""
    checked = batch.withColumn("problem", source_id_problem(F.col("record_id")))
    once, often = reject_all_duplicates(checked.where("problem is null"), ANCHOR)
    return once.drop("problem"), checked.where("problem is not null").unionByName(often.withColumn("problem", F.lit("duplicate_anchor")))


def merge(registry: DataFrame, batch: DataFrame) -> DataFrame:
    """Every anchor of the registry or the batch, with what the merge did to it: inserted, changed, seen or kept.

    ``batch`` has one row an anchor, and may name the public ids of new ones. Public id and discovery date stay those of the registry.
    """
    own = F.col("public_id") if "public_id" in batch.columns else public_id("rec", F.col("source_key"), F.col("record_id"))
    new = batch.select(*ANCHOR, own.alias("new_id"), fingerprint(F.col("content")).alias("new_print"), F.col("seen_on").alias("new_seen"))
    both = registry.join(new, ANCHOR, "full_outer")
    what = F.when(F.col("fingerprint").isNull(), "inserted").when(F.col("new_print").isNull(), "kept").when(F.col("new_print") != F.col("fingerprint"), "changed").otherwise("seen")
    return both.select(
        *ANCHOR,
        F.coalesce("public_id", "new_id").alias("public_id"),
        F.coalesce("discovered_on", "new_seen").alias("discovered_on"),
        F.coalesce("new_seen", "last_seen_on").alias("last_seen_on"),
        F.coalesce("new_print", "fingerprint").alias("fingerprint"),
        what.alias("change"),
    )


def empty_registry(like: DataFrame) -> DataFrame:
    """A registry without rows."""
    return like.where("false").select(*ANCHOR, F.lit("").alias("public_id"), F.lit("").alias("discovered_on"), F.lit("").alias("last_seen_on"), F.lit("").alias("fingerprint"))


def source_missing(registry: DataFrame, batch: DataFrame, coverage: DataFrame) -> DataFrame:
    """Registered anchors that a successful and complete batch of their source doesn't hold.

    ``coverage``: source_key, status, coverage; an omitted coverage is unknown and proves nothing.
    """
    complete = coverage.where("status = 'success' and coverage = 'complete'").select("source_key")
    return registry.join(complete, "source_key", "left_semi").join(batch.select(*ANCHOR), ANCHOR, "left_anti").select(*ANCHOR, "public_id", "last_seen_on")


def coverage_status(success: Column, declared: Column, quarantined: Column) -> Column:
    """failed, then partial where any row was quarantined, then what was declared, else unknown."""
    return F.when(~success, "failed").when(quarantined > 0, "partial").otherwise(F.coalesce(declared, F.lit("unknown")))


def layer_coverage(status: Column, reported: Column, fetched: Column) -> Column:
    """partial only where more is reported than was fetched; equal counts prove nothing."""
    return F.when(~status.eqNullSafe(F.lit("healthy")), "failed").when(reported > fetched, "partial").otherwise("unknown")


def collisions(merged: DataFrame) -> DataFrame:
    """Public ids that stand for several anchors: must be empty."""
    return merged.groupBy("public_id").agg(F.count(F.lit(1)).alias("anchors")).where("anchors > 1")


def backfill_report(records: DataFrame, registry: DataFrame) -> DataFrame:
    """What a dry run says of each record (public_id, source_key, record_id, discovered_on).

    skipped for records without a source; diagnostic with a code; registered; else a candidate.
    """
    used = records.where("source_key is not null and record_id is not null").groupBy(*ANCHOR).agg(F.count(F.lit(1)).alias("claims"))
    known = registry.select(*ANCHOR, F.col("public_id").alias("registered_id"))
    joined = records.join(used, ANCHOR, "left").join(known, ANCHOR, "left")
    code = (
        F.when(F.col("source_key").isNull(), "out_of_scope")
        .when(source_id_problem(F.col("record_id")).isNotNull(), "unusable_id")
        .when(F.col("claims") > 1, "ambiguous_anchor")
        .when(F.col("registered_id") == F.col("public_id"), "registered")
        .when(F.col("registered_id").isNotNull(), "registered_elsewhere")
        .when(~F.coalesce(F.col("discovered_on").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)), "bad_discovery_date")
        .otherwise("candidate")
    )
    kind = F.when(code.isin("candidate", "registered"), code).when(code == "out_of_scope", "skipped").otherwise("diagnostic")
    return joined.select("public_id", "source_key", "record_id", kind.alias("kind"), code.alias("code"))


def report_digest(report: DataFrame) -> DataFrame:
    """One row: rows of each kind and an order-free digest of the report.

    Rows are hashed apart and the hashes are summed in two halves, so nothing is gathered or sorted.
    """
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("public_id", "source_key", "record_id", "code")]), 256)
    half = lambda a: F.sum(F.conv(F.substring(row, a, 12), 16, 10).cast("decimal(38,0)"))
    return report.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("kind") == "candidate").alias("candidates"), F.count_if(F.col("kind") == "diagnostic").alias("diagnostics"), F.concat_ws(":", half(1).cast("string"), half(13).cast("string")).alias("digest"))
