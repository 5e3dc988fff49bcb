"""Readers and writers of collections: availability, staged pages, registries, overlays, artifacts.

A read says whether a collection is ready, missing or unreadable; an empty ready one isn't missing.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

READY, MISSING, UNREADABLE = "ready", "uninitialized", "unavailable"
#: Collections that may be written.
LISTS = ("development_records", "staged_development_records", "environmental_overlays", "source_documents", "record_versions", "change_log", "watch_areas", "alerts", "duplicate_candidates")
SINGLES = ("source_health", "map_layer_catalog")


@dataclass(frozen=True)
class Read:
    """What reading a collection gave; ``rows`` is None unless it is ready."""

    status: str
    rows: DataFrame | None = None


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> Read:
    """A JSON-lines collection; any line that doesn't fit the schema makes the whole unreadable."""
    if not _exists(spark, path):
        return Read(MISSING)
    broken = "_broken"
    whole = T.StructType([*schema.fields, T.StructField(broken, T.StringType())])
    parsed = F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken}).alias("row")
    rows = spark.read.text(path).where(F.trim("value") != "").select(parsed).select("row.*")
    if not rows.where(F.col(broken).isNotNull()).isEmpty():
        return Read(UNREADABLE)
    return Read(READY, rows.drop(broken))


def read_table(spark: SparkSession, path: str) -> Read:
    if not _exists(spark, path):
        return Read(MISSING)
    try:
        return Read(READY, spark.read.parquet(path))
    except Exception as error:  # a path that exists but holds no table
        if type(error).__name__ != "AnalysisException":
            raise
        return Read(UNREADABLE)


def write_collection(df: DataFrame, name: str, folder: str) -> str:
    """Overwrite a collection; only known names. A single one must have one row."""
    if name not in LISTS and name not in SINGLES:
        raise ValueError(f"unknown collection {name}")
    if name in SINGLES and df.limit(2).count() != 1:
        raise ValueError(f"{name} has one row")
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return path


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def staged_pages(spark: SparkSession, path: str) -> DataFrame:
    """Features of staged page files (one GeoJSON collection a file): page, pos, id, properties, geometry_json.

    An error object in a page fails the job.
    """
    text = spark.read.option("wholetext", "true").text(path).withColumn("page", F.input_file_name())
    checked = text.withColumn("value", F.when(F.get_json_object("value", "$.error").isNotNull(), F.raise_error(F.concat(F.lit("error in page "), "page"))).otherwise(F.col("value")))
    features = F.from_json(F.get_json_object("value", "$.features"), "array<string>")
    rows = checked.select("page", F.posexplode(features).alias("pos", "feature"))
    field = lambda p: F.get_json_object("feature", p)
    return rows.select("page", "pos", field("$.id").alias("id"), F.from_json(field("$.properties"), "map<string,string>").alias("properties"), field("$.geometry").alias("geometry_json"))


def page_report(features: DataFrame, valid: Column) -> DataFrame:
    """Accepted and rejected features of each page, and a digest of its ids."""
    ids = F.array_join(F.array_sort(F.collect_list(F.coalesce("id", F.lit("")))), "\n")  # a page is bounded by the page size
    return features.groupBy("page").agg(F.count(F.lit(1)).alias("seen"), F.count_if(valid).alias("accepted"), F.count_if(~valid).alias("rejected"), (F.countDistinct("id") == F.count("id")).alias("unique_ids"), F.sha2(ids, 256).alias("sha256"))


def out_of_order(features: DataFrame, oid: str) -> DataFrame:
    """Features whose id doesn't rise over its predecessor's in page order; must be empty. The window runs in a page."""
    w = W.partitionBy("page").orderBy("pos")
    return features.withColumn("before_", F.lag(oid).over(w)).where(F.col("before_") >= F.col(oid)).drop("before_")


def schema_drift(actual: T.StructType, expected: T.StructType) -> list[str]:
    """What is missing or of another type."""
    have = {f.name: f.dataType.simpleString() for f in actual}
    return [f"{f.name}: {have.get(f.name, 'missing')}, expected {f.dataType.simpleString()}" for f in expected if have.get(f.name) != f.dataType.simpleString()]


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Active sources of the jurisdiction files: jurisdiction_id, jurisdiction, key, name."""
    schema = "id string, name string, sources array<struct<key:string,name:string,active:boolean>>"
    found = spark.read.schema(schema).option("multiLine", "true").json(path)
    rows = found.select(F.col("id").alias("jurisdiction_id"), F.col("name").alias("jurisdiction"), F.explode("sources").alias("s"))
    return rows.where("s.active").select("jurisdiction_id", "jurisdiction", "s.key", "s.name")


def overlays(spark: SparkSession, path: str) -> DataFrame:
    """Layers of an overlay file with their feature counts, features left unread."""
    text = spark.read.option("wholetext", "true").text(path)
    layer = F.explode(F.from_json("value", "array<string>")).alias("layer")
    field = lambda n: F.get_json_object("layer", f"$.{n}").alias(n)
    return text.select(layer).select(*[field(n) for n in ("id", "name", "category", "source_url", "attribution", "geom_type")], F.json_array_length(F.get_json_object("layer", "$.features")).alias("features"))


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


@dataclass
class _Page(InputPartition):
    offset: int
    count: int


class PagedFeatures(DataSource):
    """A scan of an offset-paged feature service, a partition a page.

    Options: ``total``, ``page_size``, ``limit`` and ``fetch``, the dotted name of a function
    fetch(offset, count) -> list of (id, properties, geometry_json).
    """

    @classmethod
    def name(cls):
        return "paged_features"

    def schema(self):
        return "id string, properties map<string,string>, geometry_json string"

    def reader(self, schema):
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.total, self.size = int(options["total"]), int(options.get("page_size", 1000))
        self.most, self.fetch = int(options.get("limit", self.total)), options["fetch"]

    def partitions(self):
        end = min(self.total, self.most)
        return [_Page(at, min(self.size, end - at)) for at in range(0, end, self.size)]

    def read(self, partition):
        import importlib

        module, _, function = self.fetch.rpartition(".")
        for row in getattr(importlib.import_module(module), function)(partition.offset, partition.count):
            yield tuple(row)
