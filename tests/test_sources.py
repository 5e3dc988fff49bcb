"""Readers and writers of collections, staged pages, the paged source, and the streaming forms."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landsift.sources import collections as C
from landsift.streaming import quota

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])


def test_a_read_says_missing_ready_or_unreadable(spark, tmp_path):
    assert C.read_json(spark, str(tmp_path / "none"), SCHEMA).status == C.MISSING
    good, bad, empty = tmp_path / "good.json", tmp_path / "bad.json", tmp_path / "empty.json"
    good.write_text('{"id": "a", "n": 1}\n{"id": "b", "n": 2}\n')
    bad.write_text('{"id": "a", "n": 1}\nnot json\n')
    empty.write_text("")
    read = C.read_json(spark, str(good), SCHEMA)
    assert read.status == C.READY and read.rows.columns == ["id", "n"] and read.rows.count() == 2
    assert C.read_json(spark, str(bad), SCHEMA).status == C.UNREADABLE
    assert C.read_json(spark, str(empty), SCHEMA).status == C.READY  # empty isn't missing
    assert C.read_table(spark, str(tmp_path / "none")).status == C.MISSING
    (tmp_path / "folder").mkdir()
    assert C.read_table(spark, str(tmp_path / "folder")).status == C.UNREADABLE


def test_only_known_collections_are_written(spark, tmp_path):
    rows = spark.range(3)
    path = C.write_collection(rows, "change_log", str(tmp_path))
    assert C.read_table(spark, path).rows.count() == 3
    with pytest.raises(ValueError, match="unknown"):
        C.write_collection(rows, "other", str(tmp_path))
    with pytest.raises(ValueError, match="one row"):
        C.write_collection(rows, "source_health", str(tmp_path))
    C.append_jsonl(rows, str(tmp_path / "log"))
    C.append_jsonl(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6


def _page(folder, name, ids, **more):
    features = [{"type": "Feature", "id": i, "properties": {"OBJECTID": i}, "geometry": {"type": "Point", "coordinates": [i, 0]}} for i in ids]
    (folder / name).write_text(json.dumps({"type": "FeatureCollection", "features": features} | more))


def test_staged_pages(spark, tmp_path):
    _page(tmp_path, "1.json", [1, 2, 3])
    _page(tmp_path, "2.json", [5, 4])
    rows = C.staged_pages(spark, str(tmp_path)).withColumn("oid", F.col("id").cast("long"))
    assert sorted(r["id"] for r in rows.collect()) == ["1", "2", "3", "4", "5"]
    assert [r["id"] for r in C.out_of_order(rows, "oid").collect()] == ["4"]
    report = {r["seen"]: r for r in C.page_report(rows, F.col("oid") < 5).collect()}
    assert (report[3]["accepted"], report[2]["accepted"], report[2]["rejected"], report[2]["unique_ids"]) == (3, 1, 1, True)
    _page(tmp_path, "3.json", [], error={"code": 500})
    with pytest.raises(Exception, match="error in page"):
        C.staged_pages(spark, str(tmp_path)).collect()


def test_registry_overlays_and_artifacts(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text(json.dumps({"id": "x", "name": "X", "sources": [{"key": "k1", "name": "K1", "active": True}, {"key": "k2", "name": "K2", "active": False}]}))
    assert [tuple(r) for r in C.registry(spark, str(tmp_path / "j")).collect()] == [("x", "X", "k1", "K1")]
    (tmp_path / "o.json").write_text(json.dumps([{"id": "l1", "name": "L", "category": "wetlands", "source_url": "u", "attribution": "a", "geom_type": "Polygon", "features": [1, 2]}]))
    assert [(r["id"], r["features"]) for r in C.overlays(spark, str(tmp_path / "o.json")).collect()] == [("l1", 2)]
    assert C.artifacts(spark, str(tmp_path / "o.json")).first()["length"] == (tmp_path / "o.json").stat().st_size


def test_schema_drift():
    assert C.schema_drift(SCHEMA, SCHEMA) == []
    assert len(C.schema_drift(T.StructType([T.StructField("id", T.LongType())]), SCHEMA)) == 2


def test_paged_source_reads_a_partition_a_page(spark, tmp_path):
    (tmp_path / "fetches_numbers.py").write_text("def fetch(offset, count):\n    return [(str(k), {'k': str(k)}, None) for k in range(offset, offset + count)]\n")
    spark.sparkContext.addPyFile(str(tmp_path / "fetches_numbers.py"))
    import sys

    sys.path.insert(0, str(tmp_path))
    spark.dataSource.register(C.PagedFeatures)
    df = spark.read.format("paged_features").option("total", 25).option("page_size", 10).option("limit", 23).option("fetch", "fetches_numbers.fetch").load()
    assert sorted(int(r["id"]) for r in df.collect()) == list(range(23))
    assert df.rdd.getNumPartitions() == 3


def _streamed(spark, df, made, tmp_path, mode):
    """What a stream over ``df`` as files gives."""
    source, out = str(tmp_path / "in"), f"out_{tmp_path.name.replace('-', '_')}"
    df.write.parquet(source)
    query = made(spark.readStream.schema(df.schema).parquet(source)).writeStream.format("memory").queryName(out).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(out)


def test_streamed_quota_counts_as_the_batch_does(spark, tmp_path):
    rows = spark.range(60).select(F.expr("timestamp_seconds(1700000000 + id * 120)").alias("ts"), F.concat(F.lit("c"), F.col("id") % 2).alias("client"), F.lit("r").alias("route"))
    got = {(r["window_start"], r["client"]): (r["attempts"], r["rejected"]) for r in _streamed(spark, rows, lambda s: quota.attempts_by_window(s, limit=10), tmp_path, "complete").collect()}
    want = {(r["w"], r["client"]): (r["n"], max(r["n"] - 10, 0)) for r in rows.groupBy(F.date_trunc("hour", "ts").alias("w"), "client").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want and sum(x[1] for x in got.values()) > 0


def test_streamed_alerts(spark, tmp_path):
    box = lambda x: F.struct(F.lit(float(x)).alias("w"), F.lit(0.0).alias("s"), F.lit(x + 1.0).alias("e"), F.lit(1.0).alias("n"))
    records = spark.range(1).select(F.lit("a").alias("public_id"), F.lit("final").alias("status"), F.lit("subdivision").alias("development_type"), box(0).alias("box"))
    records = records.unionByName(records.select(F.lit("b").alias("public_id"), F.lit("layout").alias("status"), "development_type", box(5).alias("box")))
    none = F.lit(None).cast("array<string>")
    watches = spark.range(1).select(F.lit("w1").alias("watch_id"), F.array(F.lit("final")).alias("statuses"), none.alias("types"), box(1).alias("box"))
    watches = watches.unionByName(watches.select(F.lit("w2").alias("watch_id"), none.alias("statuses"), none.alias("types"), box(6).alias("box")))
    got = _streamed(spark, records, lambda s: quota.alerts(s, watches), tmp_path, "append").collect()
    assert sorted(tuple(r) for r in got) == [("w1", "a"), ("w2", "b")]
    # the watches may be any number: no pair is compared that shares no cell
    many = spark.range(3000).select(F.concat(F.lit("m"), "id").alias("watch_id"), none.alias("statuses"), none.alias("types"), F.struct(*[(F.col("id") * 3 + k).cast("double").alias(c) for k, c in ((0, "w"), (0, "s"), (1, "e"), (1, "n"))]).alias("box"))
    assert [tuple(r) for r in quota.alerts(records, many, cell=1.0).collect()] == [("m0", "a")]
