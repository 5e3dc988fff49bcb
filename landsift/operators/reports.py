"""Roll-ups: health and freshness, catalog, quotas, percentiles, import counters, display builds, graphs."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W

from landsift.functions import display, mercator
from landsift.functions.geometry import component_count, hole_count
from landsift.functions.scalars import chained_digest
from landsift.operators.tables import numbered_rows
from landsift.scratch import stored

# Zoom bands with their tolerances in metres; parts and vertices a feature may have.
BANDS = (("z08_10", 8, 10, 100), ("z11_12", 11, 12, 40), ("z13_14", 13, 14, 10), ("z15_16", 15, 16, 2), ("z17_18", 17, 18, 0))
MOST_PARTS, MOST_VERTICES = 8192, 256
CHAIN = 1000


def health_issues(rows: DataFrame, as_of: Column, max_age_hours: float) -> DataFrame:
    """key, status, issues, healthy, age_hours; a source that didn't run counts as failing."""
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_checked_at").cast("timestamp"))) / 3.6e9
    issues = F.array_compact(
        F.array(
            F.when(F.col("status") == "not_run", "not_run").when(F.col("status") != "healthy", F.concat(F.lit("status:"), "status")),
            F.when(F.col("error_count") > 0, F.concat(F.lit("errors:"), F.col("error_count").cast("string"))),
            F.when(F.col("last_checked_at").isNull(), "missing_checked_at").when(age > max_age_hours, "stale"),
        )
    )
    return rows.select("key", "status", issues.alias("issues"), (F.size(issues) == 0).alias("healthy"), (F.floor(age * 100 + 0.5) / 100).alias("age_hours"))


def monitor(checks: DataFrame) -> DataFrame:
    bad = F.count_if(~F.col("healthy"))
    return checks.agg(F.count(F.lit(1)).alias("sources_total"), F.count_if("healthy").alias("sources_healthy"), bad.alias("sources_failing"), F.when(bad == 0, "healthy").otherwise("degraded").alias("status"))


def worst_status(df: DataFrame, *keys: str) -> DataFrame:
    """failed before degraded before healthy."""
    rank = F.when(F.col("status") == "failed", 2).when(F.col("status") == "degraded", 1).otherwise(0)
    names = F.element_at(F.array(F.lit("healthy"), F.lit("degraded"), F.lit("failed")), F.max(rank) + 1)
    return df.groupBy(*keys).agg(names.alias("status"))


def connector_health(sources: DataFrame, latest: DataFrame) -> DataFrame:
    """Every active source with its latest health, or not_run with zero counts."""
    joined = sources.where("active").join(latest, "key", "left")
    return joined.select("key", "name", F.coalesce("status", F.lit("not_run")).alias("status"), F.coalesce("records_seen", F.lit(0)).alias("records_seen"), F.coalesce("error_count", F.lit(0)).alias("error_count"), "last_checked_at")


def merge_catalog(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Layers of both; a ready layer stays as it is, other layers are replaced."""
    old = existing.select("layer", F.struct("delivery_status", "version").alias("old_"))
    new = incoming.select("layer", F.struct("delivery_status", "version").alias("new_"))
    keep = F.when(F.col("old_.delivery_status") == "ready", F.col("old_")).otherwise(F.coalesce("new_", "old_"))
    return old.join(new, "layer", "full_outer").select("layer", keep.alias("kept_")).select("layer", "kept_.delivery_status", "kept_.version")


def quota(attempts: DataFrame, unit: str, limit: int) -> DataFrame:
    """Attempts of a client on a route in each fixed window, numbered in order; the first ``limit`` are accepted."""
    window = F.date_trunc(unit, "ts")
    w = W.partitionBy("client", "route", "window_start").orderBy("ts", "event_id")
    return attempts.withColumn("window_start", window).withColumn("attempt", F.row_number().over(w)).withColumn("accepted", F.col("attempt") <= limit)


def percentiles(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Count, median and nearest-rank 95th percentile of finite values."""
    finite = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")))
    return finite.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile(value, F.lit(0.5)).alias("median"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"))


def import_rows(rows: DataFrame, key: str, content: str, ordinal: str, valid: Column) -> DataFrame:
    """Each row's fate: rejected, accepted (the first of its key), duplicate (same content) or conflict."""
    checked = rows.withColumn("valid_", valid)
    first = checked.where("valid_").groupBy(key).agg(F.min_by(F.struct(content, ordinal), F.col(ordinal)).alias("first_"))
    fate = F.when(~F.col("valid_"), "rejected").when(F.col(ordinal) == F.col(f"first_.{ordinal}"), "accepted").when(F.col(content).eqNullSafe(F.col(f"first_.{content}")), "duplicate").otherwise("conflict")
    return checked.join(first, key, "left").withColumn("fate", fate).drop("valid_", "first_")


def import_counters(imported: DataFrame, *keys: str) -> DataFrame:
    count = lambda name: F.count_if(F.col("fate") == name).alias(name)
    return imported.groupBy(*keys).agg(F.count(F.lit(1)).alias("seen"), *[count(n) for n in ("accepted", "rejected", "duplicate", "conflict")])


def bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BANDS, "band string, minzoom int, maxzoom int, tolerance int")


def display_build(features: DataFrame, most_vertices: int = MOST_VERTICES) -> DataFrame:
    """Parts of each feature (feature_id, geom with one polygon) for each zoom band, with an error code instead of an exception.

    Degrees are transformed, simplified by the band's tolerance without losing topology, subdivided, and checked: a valid polygon with
    as many holes and components as before, parts that make it up exactly, not too many of them, and none with too many vertices.
    Features of one shape are built once.
    """
    spark = features.sparkSession
    features = features.select("feature_id", "geom", F.coalesce(F.sha2(F.to_json("geom"), 256), F.lit("")).alias("shape_"))
    rows = features.groupBy("shape_").agg(F.any_value("geom").alias("geom")).crossJoin(F.broadcast(bands(spark)))  # five rows; geometry is work for many tasks, however few files it came from
    rows = rows.withColumn("b", display.build(mercator.polygon_forward(F.col("geom.polys")[0]), F.col("tolerance").cast("double"), F.lit(most_vertices)))
    sizes = F.transform("b.parts", lambda p: F.size(F.flatten(p)))
    code = (
        F.when(component_count(F.col("geom")) != 1, "not_one_polygon")
        .when(F.col("b.rings") - 1 != hole_count(F.col("geom")), "hole_lost")
        .when(F.col("b.fault").isNotNull(), F.concat(F.lit("invalid_"), "b.fault"))
        .when(F.size("b.parts") > MOST_PARTS, "too_many_parts")
        .when(F.exists(sizes, lambda n: n > most_vertices), "too_many_vertices")
        .when(~F.col("b.same"), "parts_differ")
    )
    shapes = rows.select("shape_", "band", "tolerance", F.col("b.vertices").alias("vertices"), F.size("b.parts").alias("part_count"), code.alias("error_code"), F.when(code.isNull(), F.col("b.parts")).alias("parts"))
    return features.select("feature_id", "shape_").join(shapes, "shape_").drop("shape_")


def band_report(built: DataFrame) -> DataFrame:
    """Counters and a chained digest of each band over its features in order.

    Digests are chained CHAIN features at a time, then CHAIN chains at a time, and so on, so no row gathers more than CHAIN of them.
    """
    digest = F.sha2(F.concat_ws("|", "feature_id", "band", "vertices", "part_count", F.coalesce("error_code", F.lit("ok"))), 256)
    one = built.select("band", "feature_id", F.lit(1).cast("long").alias("features"), F.col("part_count").cast("long").alias("parts"), F.col("error_code").isNotNull().cast("long").alias("failed"), digest.alias("digest"))
    one = stored(one, "band-report")  # numbering reads its rows more than once, and a build isn't to be repeated for it
    rows = numbered_rows(one, ["band", "feature_id"]).drop("feature_id")
    counters = [F.sum(c).alias(c) for c in ("features", "parts", "failed")]
    chain = chained_digest(F.transform(F.array_sort(F.collect_list(F.struct("number_", "digest"))), lambda s: s["digest"])).alias("digest")
    left = rows.count()
    while True:
        rows = rows.withColumn("at_", F.floor((F.col("number_") - 1) / CHAIN)).groupBy("band", "at_").agg(*counters, chain).select("band", (F.col("at_") + 1).alias("number_"), "features", "parts", "failed", "digest")
        left = -(-left // CHAIN)
        if left <= 1:
            return rows.groupBy("band").agg(*counters, chain)


def topological_levels(edges: DataFrame, most: int = 64) -> DataFrame:
    """node, level: 0 for nodes that depend on nothing, else one more than the deepest they depend on; nodes of a cycle have none.

    A level a round; each round joins the open edges with the levels found so far.
    """
    nodes = edges.select("node").unionByName(edges.select(F.col("depends_on").alias("node"))).distinct()
    done = nodes.join(edges.select("node").distinct(), "node", "left_anti").withColumn("level", F.lit(0))
    open_ = edges
    for level in range(1, most + 1):
        left = open_.join(done.select(F.col("node").alias("depends_on")), "depends_on", "left_anti")
        ready = open_.select("node").distinct().join(left.select("node").distinct(), "node", "left_anti").join(done.select("node"), "node", "left_anti").withColumn("level", F.lit(level))
        if ready.isEmpty():
            return done
        done = stored(done.unionByName(ready), "levels")
        open_ = edges.join(done.select("node"), "node", "left_anti")
    raise ValueError(f"more than {most} levels")
