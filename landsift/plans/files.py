"""Queries over files that are written from the given tables and read back, with their SQL."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from landsift import scratch
from landsift.operators import tables
from landsift.plans.state import _FATES, _lines
from landsift.sources import collections as C
from landsift.sources import overlay_files as O
from landsift.sources import testdata as T
from landsift.streaming import imports

#: A layer's metadata; braces and quotes in it must not mislead a reader.
_SAID = {"name": "Layer {{{0}}}", "category": "customers \"of\" {0}", "source_url": "https://example.org/{0}", "attribution": "a, b }}", "caveat": ""}


def _overlays(spark, sf) -> O.Overlays:
    """Customers as features, a layer a nation, with braces and quotes in their names."""
    c = T.table(spark, sf, "customer")
    nation = c["c_nationkey"].cast("string")
    said = [F.format_string(text.replace("{{", "{").replace("}}", "}").replace("{0}", "%s"), *[nation] * text.count("{0}")).alias(m) for m, text in _SAID.items()]
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col("c_custkey") * 0.5, F.lit(34.5)).alias("coordinates"))
    name = F.concat(F.lit('{"'), "c_name", F.lit('\\"}'))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("c_custkey").alias("id"), F.struct(name.alias("name"), F.col("c_acctbal").alias("balance")).alias("properties"), point.alias("geometry")))
    path = scratch.fresh_dir(spark, "overlay-files")
    O.write(c.select(F.concat(F.lit("n"), nation).alias("id"), *said, F.lit("point").alias("geom_type"), "c_custkey", feature.alias("feature")), path, "c_custkey")
    return O.inspect(spark, path)


def overlay_file_features(spark, sf):
    """The features of overlay files, read in ranges."""
    o = _overlays(spark, sf)
    layers = o.layers().select("path", "layer", "id", "name", "category")
    rows = o.features().join(F.broadcast(layers), ["path", "layer"])  # a hundred layers a file at most
    field = lambda p: F.get_json_object("feature", p)
    return rows.select(F.col("id").alias("layer_id"), F.col("name").alias("layer_name"), "category", field("$.id").cast("long").alias("c_custkey"), field("$.properties.name").alias("name"), field("$.geometry.coordinates[0]").cast("double").alias("x"), F.coalesce("error", F.lit("")).alias("error"))


def overlay_file_layers(spark, sf):
    """How many features the layers have, over all files."""
    return _overlays(spark, sf).layers().groupBy("id", "source_url", "attribution", "caveat").agg(F.sum("features").alias("features"))


def import_resumed(spark, sf):
    """The lines of lineitem staged a quarter of the years at a time, imported with a stop before the second batch's commit, then resumed."""
    lines = _lines(spark, sf).select(F.col("source_key").alias("source"), F.col("anchor").alias("identity"), F.concat_ws("|", "l_partkey", "l_suppkey").alias("content"), "pos")
    quarter = F.least(F.lit(3), F.floor((F.substring("pos", 1, 4).cast("int") - 1992) / 2))
    lines = tables.numbered_rows(lines.withColumn("quarter", quarter), ["pos", "identity"]).withColumnRenamed("number_", "ordinal")
    staged, target = scratch.fresh_dir(spark, "import-staged"), scratch.fresh_dir(spark, "import-target")
    schema, valid, every = lines.drop("quarter", "pos").schema, F.col("source") != "R", 2**31 - 1

    def stage(k: int) -> None:
        lines.where(F.col("quarter") == k).drop("quarter", "pos").write.mode("append").parquet(staged)

    def stop(number: int) -> None:
        if number == 1:
            raise RuntimeError("stopped")

    # a quarter's files are written in no order, so they are one batch; the next quarter is staged when they are imported
    stage(0)
    imports.run(spark, staged, schema, target, valid, every)
    stage(1)
    try:
        imports.run(spark, staged, schema, target, valid, every, stop)
    except Exception as error:
        if "stopped" not in str(error):
            raise
    stage(2)
    stage(3)
    rows = imports.run(spark, staged, schema, target, valid, every)
    return rows.groupBy("source", "fate").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("identity").alias("identities"))


_RESUMED = f"{_FATES} SELECT source_key AS source, fate, count(*) AS rows, count(DISTINCT anchor) AS identities FROM i GROUP BY 1, 2"


def collection_json_read(spark, sf):
    """Orders appended to a JSON-lines collection in two calls, read with a schema."""
    o = T.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    path = scratch.fresh_dir(spark, "collection-json")
    C.append_jsonl(o.where("o_orderkey % 2 = 0"), path)
    C.append_jsonl(o.where("o_orderkey % 2 = 1"), path)
    found = C.read_json(spark, path, o.schema)
    return found.rows.withColumn("status", F.lit(found.status))


def collection_availability(spark, sf):
    """Whether collections can be read, and how many rows they have: a table, a broken one of JSON lines, an empty one, and none."""
    s = T.table(spark, sf, "supplier")
    folder = scratch.fresh_dir(spark, "collections")
    table = C.read_table(spark, C.write_collection(s, "watch_areas", folder))
    empty = C.read_table(spark, C.write_collection(s.where("s_suppkey < 0"), "alerts", folder))
    s.select(F.when(F.col("s_suppkey") % 7 == 3, "{broken").otherwise(F.to_json(F.struct("s_suppkey"))).alias("value")).write.text(f"{folder}/lines")
    broken, missing = C.read_json(spark, f"{folder}/lines", s.select("s_suppkey").schema), C.read_table(spark, f"{folder}/none")
    out = None
    for name, read in (("table", table), ("empty", empty), ("broken", broken), ("missing", missing)):
        rows = read.rows if read.rows is not None else s.limit(0)
        one = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("collection"), F.lit(read.status).alias("status"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def collection_overwrite(spark, sf):
    """A collection that is overwritten holds what was written last, with its types."""
    c = T.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    folder = scratch.fresh_dir(spark, "collection-overwrite")
    C.write_collection(c, "development_records", folder)
    changed = c.where("c_custkey % 3 <> 0").withColumn("c_name", F.upper("c_name"))
    return C.read_table(spark, C.write_collection(changed, "development_records", folder)).rows


def registry_active_sources(spark, sf):
    """Active sources of jurisdiction files: a jurisdiction twenty suppliers, the odd ones active."""
    s = T.table(spark, sf, "supplier")
    number = F.floor(F.col("s_suppkey") / 20)
    source = F.struct(F.concat(F.lit("s"), "s_suppkey").alias("key"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 2 == 1).alias("active"))
    files = s.groupBy(number.alias("number")).agg(F.collect_list(source).alias("sources"))
    said = F.to_json(F.struct(F.concat(F.lit("j"), "number").alias("id"), F.concat(F.lit("Place "), "number").alias("name"), "sources"))
    path = scratch.fresh_dir(spark, "registry")
    files.select("number", said.alias("value")).repartition("number").write.partitionBy("number").text(path)
    return C.registry(spark, path)


def staged_page_features(spark, sf):
    """Features of staged page files, a page a hundred parts, with their place in the page."""
    p = T.table(spark, sf, "part")
    feature = F.to_json(F.struct(F.concat(F.lit("p"), "p_partkey").alias("id"), F.struct("p_brand", F.col("p_size").cast("string").alias("p_size")).alias("properties")))
    pages = p.groupBy(F.floor(F.col("p_partkey") / 100).alias("number")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", feature.alias("f")))).alias("fs"))
    page = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", F.transform("fs", lambda x: x["f"])), F.lit("]}"))
    path = scratch.fresh_dir(spark, "staged-pages")
    pages.select("number", page.alias("value")).repartition("number").write.partitionBy("number").text(path)
    rows = C.staged_pages(spark, path)
    return rows.select(F.regexp_extract("page", "number=([0-9]+)", 1).cast("long").alias("page"), F.col("pos").cast("long").alias("pos"), "id", F.col("properties")["p_brand"].alias("brand"), F.col("properties")["p_size"].alias("size"))


def artifact_hashes(spark, sf):
    """Files hashed as they are read: the customers of a nation, a line each, in order."""
    c = T.table(spark, sf, "customer")
    path = scratch.fresh_dir(spark, "artifacts")
    lines = c.select("c_nationkey", "c_custkey", F.concat_ws(",", "c_custkey", "c_name").alias("value")).repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    lines.select("c_nationkey", "value").write.partitionBy("c_nationkey").text(path)
    found = C.artifacts(spark, path)
    return found.select(F.regexp_extract("path", "c_nationkey=([0-9]+)", 1).cast("long").alias("nation"), "length", "sha256")


QUERIES: dict[str, tuple] = {
    "overlay_file_features": (overlay_file_features, """SELECT 'n' || c_nationkey AS layer_id, 'Layer {' || c_nationkey || '}' AS layer_name, 'customers "of" ' || c_nationkey AS category, c_custkey::BIGINT AS c_custkey, '{"' || c_name || '\\"}' AS name, c_custkey * 0.5::DOUBLE AS x, '' AS error FROM customer"""),
    "overlay_file_layers": (overlay_file_layers, "SELECT 'n' || c_nationkey AS id, 'https://example.org/' || c_nationkey AS source_url, 'a, b }' AS attribution, '' AS caveat, count(*) AS features FROM customer GROUP BY c_nationkey"),
    "import_resumed": (import_resumed, _RESUMED),
    "collection_json_read": (collection_json_read, "SELECT o_orderkey, o_custkey, o_orderstatus, 'ready' AS status FROM orders"),
    "collection_availability": (collection_availability, "SELECT 'table' AS collection, 'ready' AS status, count(*) AS rows FROM supplier UNION ALL SELECT * FROM (VALUES ('empty', 'ready', 0), ('missing', 'uninitialized', 0)) UNION ALL SELECT 'broken', CASE WHEN count(*) FILTER (s_suppkey % 7 = 3) > 0 THEN 'unavailable' ELSE 'ready' END, CASE WHEN count(*) FILTER (s_suppkey % 7 = 3) > 0 THEN 0 ELSE count(*) END FROM supplier"),
    "collection_overwrite": (collection_overwrite, "SELECT c_custkey, upper(c_name) AS c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0"),
    "registry_active_sources": (registry_active_sources, "SELECT 'j' || (s_suppkey // 20) AS jurisdiction_id, 'Place ' || (s_suppkey // 20) AS jurisdiction, 's' || s_suppkey AS key, s_name AS name FROM supplier WHERE s_suppkey % 2 = 1"),
    "staged_page_features": (staged_page_features, "SELECT p_partkey // 100 AS page, row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) - 1 AS pos, 'p' || p_partkey AS id, p_brand AS brand, p_size::VARCHAR AS size FROM part"),
    "artifact_hashes": (artifact_hashes, "SELECT c_nationkey::BIGINT AS nation, length(string_agg(c_custkey || ',' || c_name || chr(10), '' ORDER BY c_custkey))::BIGINT AS length, sha256(string_agg(c_custkey || ',' || c_name || chr(10), '' ORDER BY c_custkey)) AS sha256 FROM customer GROUP BY 1"),
}
