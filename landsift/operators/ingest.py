"""One call from a source's features to its next snapshot: staged rows, quarantine, flags, merge, missing records, health.

A run reads the snapshot before it and writes its own folder; nothing of an older one changes, so a run that is lost or repeated
does no harm. The health table is written last: a folder that has it is a whole snapshot.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from landsift.functions import geometry as G
from landsift.functions.scalars import fingerprint
from landsift.operators import merge, normalize, spatial, tables

#: What a record says; a change of any of these is a change of the record.
SAID = ("title", "description", "status", "source_status", "application_date", "approval_date", "permit_issue_date", "geometry_json")
TABLES = ("staged", "quarantined", "records", "registry", "missing", "health")


def snapshot(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a run."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}


def _written(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def ingest(features: DataFrame, context: DataFrame, fetched: DataFrame, checked_at: str, folder: str, before: str | None = None, context_verified: bool = True) -> dict[str, DataFrame]:
    """Ingest ``features`` (source, properties, geometry_json) over the snapshot in the folder ``before``; the tables written to ``folder``.

    ``context``: category, feature_order, feature_id, geom, box, for the flags; where it isn't verified, no source is merged and all
    are degraded. ``fetched``: key, status (healthy or failing), reported_count, declared (coverage or null), a row a source; features
    of sources that aren't in it are staged only. A failing source isn't merged. Coverage is failed, partial where rows were quarantined
    or more were reported than came, else as declared, else unknown; only a complete one tells which records are missing. Rows without
    a usable id and all rows of an id that occurs twice in a source are quarantined, with the reason. A record keeps the public id
    and the day it was first seen with. Null properties, empty frames and sources without a row are fine.
    """
    spark = features.sparkSession
    staged = _written(normalize.normalize_all(features, checked_at).withColumnRenamed("source_record_id", "record_id").drop("problem"), folder, "staged")
    sound, refused = merge.quarantine(staged)
    quarantined = _written(refused.select("source_key", "record_id", "title", "problem"), folder, "quarantined")

    old = snapshot(spark, before) if before else None
    registry = old["registry"].drop("change") if old else merge.empty_registry(staged)
    open_ = fetched.where((F.col("status") == "healthy") & F.lit(context_verified)).select(F.col("key").alias("source_key"))
    rows = sound.join(F.broadcast(open_), "source_key", "left_semi").withColumn("box", G.bbox(F.col("geom")))  # a row a configured source
    flags = spatial.flags(rows.select("public_id", "geom", "box"), context)
    rows = rows.drop("box").join(flags, "public_id", "left")
    batch = rows.withColumn("content", fingerprint(*[F.col(c) for c in SAID], F.to_json("proximity_flags"))).withColumn("seen_on", F.lit(checked_at[:10]))

    merged = _written(merge.merge(registry, batch.select(*merge.ANCHOR, "content", "seen_on", "public_id")), folder, "registry")
    told = merged.select(*merge.ANCHOR, "public_id", "discovered_on", "last_seen_on")
    records = batch.drop("public_id", "date_discovered", "content", "seen_on").join(told, merge.ANCHOR)
    records = _written(tables.override(old["records"], records, merge.ANCHOR) if old else records, folder, "records")

    counts = staged.groupBy("source_key").agg(F.count(F.lit(1)).alias("records_seen"), F.sum(F.size("validation_errors")).alias("invalid"))
    held = quarantined.groupBy("source_key").agg(F.count(F.lit(1)).alias("quarantined_count"))
    changes = merged.groupBy("source_key").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("inserted", "changed", "seen", "kept")])
    flagged = records.where(F.col("last_seen_on") == checked_at[:10]).groupBy("source_key").agg(F.sum(F.size(F.coalesce("proximity_flags", F.array()))).alias("flags"))
    all_ = fetched.withColumnRenamed("key", "source_key")
    for part in (counts, held, changes, flagged):
        all_ = all_.join(part, "source_key", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    success = F.col("status") == "healthy"
    declared = F.when(F.col("reported_count") > n("records_seen"), "partial").otherwise(F.col("declared"))
    status = F.when(~success, F.col("status")).when(F.lit(not context_verified), "degraded").otherwise("healthy")
    health = all_.select(
        F.col("source_key").alias("key"), status.alias("status"), merge.coverage_status(success, declared, n("quarantined_count")).alias("coverage"),
        n("records_seen").alias("records_seen"), (n("records_seen") - n("quarantined_count")).alias("records_created"), n("quarantined_count").alias("quarantined_count"),
        (n("quarantined_count") + n("invalid") + (status != "healthy").cast("long")).alias("error_count"),
        *[n(c).alias(c) for c in ("inserted", "changed", "seen", "kept", "flags")], F.lit(checked_at).alias("checked_at"),
    )
    covered = health.select(F.col("key").alias("source_key"), F.when(F.col("status") == "healthy", "success").otherwise("failed").alias("status"), "coverage")
    missing = _written(merge.source_missing(registry, batch, covered), folder, "missing")
    lacking = missing.groupBy(F.col("source_key").alias("key")).agg(F.count(F.lit(1)).alias("missing"))
    health = _written(health.join(lacking, "key", "left").withColumn("missing", n("missing")), folder, "health")
    return {"staged": staged, "quarantined": quarantined, "records": records, "registry": merged, "missing": missing, "health": health}


def overall(health: DataFrame) -> DataFrame:
    """One row: degraded where any source isn't healthy or has errors."""
    bad = F.count_if((F.col("status") != "healthy") | (F.col("error_count") > 0))
    return health.agg(F.when(bad > 0, "degraded").otherwise("healthy").alias("status"), F.count(F.lit(1)).alias("sources"), F.sum("records_seen").alias("records_seen"))
