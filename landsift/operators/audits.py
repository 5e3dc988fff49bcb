"""Audits that recompute and compare: artifact references, page proofs, display builds, attestations, import reports."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

from landsift.functions.scalars import fingerprint
from landsift.operators.merge import ANCHOR


def reference_problems(references: DataFrame, copies: DataFrame, blobs: DataFrame) -> DataFrame:
    """Of each reference (reference_id, blob_key, sha256) to a copy (blob_key, sink_id, state) of a blob (blob_key, sha256, bytes): null, or unknown_blob, digest_mismatch, no_copy, unverified."""
    b = blobs.select("blob_key", F.col("sha256").alias("blob_sha_"), "bytes")
    c = copies.groupBy("blob_key").agg(F.count(F.lit(1)).alias("copies_"), F.count_if(F.col("state") == "verified").alias("verified_"))
    joined = references.join(b, "blob_key", "left").join(c, "blob_key", "left")
    problem = F.when(F.col("blob_sha_").isNull(), "unknown_blob").when(F.col("blob_sha_") != F.col("sha256"), "digest_mismatch").when(F.col("copies_").isNull(), "no_copy").when(F.col("verified_") == 0, "unverified")
    return joined.select("reference_id", "blob_key", F.coalesce("verified_", F.lit(0)).alias("verified_copies"), "bytes", problem.alias("problem"))


def page_proofs(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """Of each run (run_id, expected_pages) with pages (run_id, page_no from 1, sha256): complete only for exactly these pages, each once; and the digest of the pages in order.

    The digest is that of the sorted page digests' own digests in buckets of BUCKET pages, so no long run is gathered in one row at once.
    """
    part = pages.groupBy("run_id", F.floor((F.col("page_no") - 1) / BUCKET).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("page_no").alias("distinct_"), F.min("page_no").alias("low_"), F.max("page_no").alias("high_"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "sha256"))), lambda p: F.concat_ws(":", p["page_no"].cast("string"), p["sha256"])), "\n"), 256).alias("digest_"),
    )
    whole = part.groupBy("run_id").agg(
        F.sum("n").alias("pages"), F.sum("distinct_").alias("distinct_"), F.min("low_").alias("low_"), F.max("high_").alias("high_"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest_"))), lambda b: b["digest_"]), "\n"), 256).alias("digest"),
    )
    joined = runs.join(whole, "run_id", "left")
    exact = (F.col("pages") == F.col("expected_pages")) & (F.col("distinct_") == F.col("expected_pages")) & (F.col("low_") == 1) & (F.col("high_") == F.col("expected_pages"))
    state = F.when(F.col("pages").isNull(), "no_pages").when(F.col("distinct_") < F.col("pages"), "repeated_page").when(exact, "complete").otherwise("wrong_pages")
    return joined.select("run_id", F.coalesce("pages", F.lit(0)).alias("pages"), state.alias("state"), F.when(state == "complete", F.col("digest")).alias("proof"))


BUCKET = 1000


def attestation_gate(layers: DataFrame, attested: DataFrame) -> DataFrame:
    """Layers (layer_id, data_version, input_checksum) against what was attested of them; refused where nothing was, or it was of something else.

    The attested digest binds layer, version and checksum, so a changed attestation is refused too.
    """
    a = attested.select("layer_id", F.struct("data_version", "input_checksum", "digest").alias("a_"))
    bound = fingerprint(F.col("layer_id"), F.col("a_.data_version"), F.col("a_.input_checksum"))
    gate = (
        F.when(F.col("a_").isNull(), "not_attested")
        .when(F.col("a_.digest") != bound, "attestation_changed")
        .when(F.col("a_.data_version") != F.col("data_version"), "version_changed")
        .when(F.col("a_.input_checksum") != F.col("input_checksum"), "input_changed")
        .otherwise("open")
    )
    return layers.join(a, "layer_id", "left").select("layer_id", gate.alias("gate"))


def build_differences(built: DataFrame, again: DataFrame, keys: list[str]) -> DataFrame:
    """Of each band: rows, rows that a second build lacks, has otherwise, or has in addition; a checkpoint holds where all are 0."""
    rest = [c for c in built.columns if c not in keys]
    side = lambda df, name: df.select(*keys, F.struct(*rest).alias(name))
    both = side(built, "a_").join(side(again, "b_"), keys, "full_outer")
    count = lambda cond: F.count_if(cond)
    return both.groupBy("band").agg(count(F.col("a_").isNotNull()).alias("rows"), count(F.col("b_").isNull()).alias("lacking"), count(F.col("a_").isNull()).alias("added"), count(F.col("a_").isNotNull() & F.col("b_").isNotNull() & ~F.col("a_").eqNullSafe(F.col("b_"))).alias("changed"))


def stale_inputs(results: DataFrame, canonical: DataFrame) -> DataFrame:
    """Results (feature_id, input_digest) whose canonical feature (feature_id, content) is gone or another now."""
    now = canonical.select("feature_id", fingerprint(F.col("content")).alias("now_"))
    state = F.when(F.col("now_").isNull(), "gone").when(F.col("now_") != F.col("input_digest"), "changed")
    return results.join(now, "feature_id", "left").select("feature_id", state.alias("problem")).where("problem is not null")


def reason_report(rows: DataFrame, samples: int = 25) -> DataFrame:
    """Of each reason for rejection (reason, source_id): how many, and the first ``samples`` ids in order.

    Ids are picked by rank within their reason's parts first, so a frequent reason is never gathered.
    """
    part = F.pmod(F.xxhash64("source_id"), F.lit(64))
    w = W.partitionBy("reason", "part_").orderBy("source_id")
    few = rows.withColumn("part_", part).withColumn("rank_", F.row_number().over(w)).where(F.col("rank_") <= samples)
    picked = few.groupBy("reason").agg(F.slice(F.array_sort(F.collect_list("source_id")), 1, samples).alias("samples"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).join(picked, "reason")


def bounds(df: DataFrame, box: str = "box", *keys: str) -> DataFrame:
    """The running bounds of boxes."""
    low, high = (lambda c: F.min(f"{box}.{c}").alias(c)), (lambda c: F.max(f"{box}.{c}").alias(c))
    return df.groupBy(*keys).agg(low("w"), low("s"), high("e"), high("n"))


def apply_backfill(report: DataFrame, expected: str, digest: str) -> DataFrame:
    """The mapping (source_key, record_id, public_id) that a reviewed dry run allows, in order; refused where the report changed or has diagnostics."""
    if expected != digest:
        raise ValueError("the report has changed since it was reviewed")
    if not report.where("kind = 'diagnostic'").isEmpty():
        raise ValueError("the report has diagnostics")
    return report.where("kind in ('candidate', 'registered')").select(*ANCHOR, "public_id").orderBy(*ANCHOR, "public_id")


def import_option_problem(layer_id: Column, scope_id: Column, coverage: Column, expected: Column, batch: Column) -> Column:
    """Null for options that an import takes, else what is wrong."""
    named = lambda c, most: F.char_length(F.coalesce(c, F.lit(""))).between(1, most)
    return F.when(~named(layer_id, 100), "layer_id").when(~named(scope_id, 2048), "scope_id").when(~F.coalesce(coverage.isin("complete", "partial", "failed", "unknown"), F.lit(False)), "coverage").when(expected < 0, "expected_count").when(~batch.between(1, 5000), "batch_size")


def layer_row(layer: Column, checksum: Column, version: Column) -> Column:
    """A new version of a layer before anything is imported."""
    zero = lambda n: F.lit(0).cast("long").alias(n)
    return F.struct(layer.alias("layer_id"), checksum.alias("checksum"), version.alias("data_version"), F.lit("importing").alias("status"), zero("seen"), zero("accepted"), zero("rejected"), zero("duplicate"))
