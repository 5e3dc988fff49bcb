"""Queries over what is stored and proven: blobs, canonical text, digest trees, checkpoints, quota keys. With their SQL."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql import Window as W

from landsift import scratch
from landsift.operators import digests, ingest, intake
from landsift.plans import fields
from landsift.sources import blobs
from landsift.sources import testdata as T

PART, BLOCK, FAN = 1024, 65536, 64
SECRET = b"a secret of thirty-two bytes, or more"


def blob_store(spark, sf):
    """Every page's html put into a store, each blob hashed anew by an audit."""
    root = scratch.fresh_dir(spark, "blobs")
    manifest = blobs.put(T.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("name"), F.col("html").alias("content")), root, PART)
    audited = blobs.audit(manifest, root, PART).withColumnRenamed("blob_key", "key_")
    rows = manifest.join(audited, F.col("blob_key") == F.col("key_"))
    return rows.select(F.col("name").cast("long").alias("page_id"), "blob_key", "bytes", F.size("parts").cast("long").alias("parts"), "state")


_BLOB_STORE = f"SELECT page_id, 'sha256/' || substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || h AS blob_key, b AS bytes, greatest(1, (b + {PART - 1}) // {PART})::BIGINT AS parts, 'verified' AS state FROM (SELECT page_id, sha256(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, ''))) AS b FROM pages)"


def _lines(spark, sf) -> DataFrame:
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line"))


def canonical_blocks(spark, sf):
    """The lines of lineitem as one canonical text, stored in blocks; the digest of each and of them all."""
    root = scratch.fresh_dir(spark, "canonical")
    manifest, tree = digests.write_canonical(_lines(spark, sf), ["l_orderkey", "l_linenumber"], "line", root, "lines", BLOCK)
    audited = blobs.audit(manifest, root, BLOCK).withColumnRenamed("blob_key", "key_")
    first = tree.where("level = 1").select((F.col("position") * digests.FAN).alias("from_"), F.col("digest").alias("node"))
    rows = manifest.join(audited, F.col("blob_key") == F.col("key_")).join(first, F.expr(f"block div {digests.FAN} * {digests.FAN}") == F.col("from_"))
    return rows.select("block", "bytes", "sha256", "state", "node")


_CANONICAL_BLOCKS = f"""WITH whole AS (SELECT string_agg(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || chr(10), '' ORDER BY l_orderkey, l_linenumber, l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey) AS t FROM lineitem),
b AS (SELECT k AS block, substr(t, k * {BLOCK} + 1, {BLOCK}) AS x FROM (SELECT t, unnest(range((length(t) + {BLOCK - 1}) // {BLOCK})) AS k FROM whole)),
h AS (SELECT block, length(x) AS bytes, sha256(x) AS sha256 FROM b)
SELECT block, bytes, sha256, 'verified' AS state, sha256(string_agg(block || ':' || sha256, chr(10)) OVER (PARTITION BY block // 256 ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS node FROM h"""


def digest_tree_nodes(spark, sf):
    """The two lowest levels of the digest trees over the orders of each priority, by their keys."""
    leaves = T.table(spark, sf, "orders").select("o_orderpriority", F.col("o_orderkey").alias("position"), F.sha2(F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus"), 256).alias("digest"))
    return digests.digest_tree(leaves, ["o_orderpriority"], FAN).where("level <= 2")


_NODES = f"""one AS (SELECT o_orderpriority, o_orderkey // {FAN} AS position, count(*) AS rows, sha256(string_agg(o_orderkey || ':' || d, chr(10) ORDER BY o_orderkey, d)) AS digest FROM (SELECT *, sha256(o_orderkey || '|' || o_custkey || '|' || o_orderstatus) AS d FROM orders) GROUP BY 1, 2)"""
_TREE = f"WITH {_NODES} SELECT o_orderpriority, 1 AS level, position, rows, digest FROM one UNION ALL SELECT o_orderpriority, 2, position // {FAN}, sum(rows)::BIGINT, sha256(string_agg(position || ':' || digest, chr(10) ORDER BY position)) FROM one GROUP BY 1, 3"


def _build(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Results and parts of a build: a band a priority, a feature an order, a part a line. Parts are stored as an array a feature."""
    columns = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    # lines are sent once and as they are, shorter than their digests; orders meet them in the same partitions
    lines = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("position"), *columns).repartition("position")
    made = lines.select("position", F.unhex(F.sha2(F.concat_ws("|", *columns), 256)).alias("part")).groupBy("position").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    rows = T.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("band"), F.col("o_orderkey").alias("position"), "o_orderstatus", "o_custkey").repartition("position")
    rows = rows.withColumn("first", F.row_number().over(W.partitionBy("position", "band").orderBy("o_custkey")) == 1).join(made, "position", "left")
    none = F.col("parts").isNull()
    built = rows.select(
        "band", "position", F.when(none, 0).otherwise(F.size("parts")).alias("part_count"), (F.col("o_orderstatus") == "F").alias("collapsed"), F.when(none, "not_one_polygon").alias("error_code"),
        F.when(none, "").otherwise(digests.parts_digest(F.col("parts"))).alias("output_sha256"), "o_custkey", "parts", "first",
    )
    built = scratch.stored(built, "checkpoint-build")
    return built.drop("parts", "first"), built.where("first").select("band", "position", "parts")


def checkpoint_codes(spark, sf):
    """A build damaged after its checkpoint, each band in another way, by the customer of its orders; from where it must go on."""
    results, parts = _build(spark, sf)
    then = digests.results_tree(results, FAN)
    noted = scratch.stored(digests.checkpoints(results, FAN, then), "checkpoint-noted")
    odd, kind = F.col("o_custkey") % 7 == 3, F.substring("band", 1, 1)
    now = results.where(~(odd & (kind == "1")))
    now = now.withColumn("output_sha256", F.when(odd & (kind == "2"), "other").otherwise(F.col("output_sha256")))
    now = now.withColumn("collapsed", F.when(odd & (kind == "3"), True).otherwise(F.col("collapsed")))
    left = parts.join(now.select("band", "position"), ["band", "position"], "left_semi").select("band", "position", F.posexplode("parts").alias("pos", "part"))
    left = left.select("band", "position", (F.col("pos") + 1).alias("part_number"), F.lower(F.hex("part")).alias("geometry_sha256")).where(~((kind == "4") & (F.col("part_number") == 1)))
    found = digests.results_tree(now, FAN)
    codes = digests.checkpoint_problems(now, left, noted, FAN, found)
    return codes.join(digests.resume_positions(then, found, noted, FAN), "band")


_CHECKPOINT_CODES = f"""WITH r AS (SELECT o_orderpriority AS band, substr(o_orderpriority, 1, 1) AS kind, o_orderkey AS position, o_custkey % 7 = 3 AS odd, o_orderstatus = 'F' AS collapsed, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders),
b AS (SELECT band, any_value(kind) AS kind, max(position) AS top, min(position) FILTER (odd) AS first_odd, count(*) FILTER (odd) AS odds, count(*) FILTER (odd AND NOT collapsed) AS fell, count(*) FILTER (n > 0) AS made, count(*) FILTER (odd AND n > 0) AS odd_made FROM r GROUP BY 1)
SELECT band, CASE WHEN kind = '1' AND odds > 0 THEN 'checkpoint_result_count_mismatch' WHEN kind = '2' AND odds > 0 THEN 'checkpoint_checksum_mismatch' WHEN kind = '3' AND fell > 0 THEN 'checkpoint_collapse_count_mismatch' WHEN kind = '4' AND made > 0 THEN 'checkpoint_parts_mismatch' END AS code,
CASE kind WHEN '2' THEN odd_made WHEN '4' THEN made ELSE 0 END::BIGINT AS bad_features, CASE WHEN kind IN ('1', '2') AND odds > 0 THEN least(top + 1, first_odd // {FAN} * {FAN}) ELSE top + 1 END::BIGINT AS resume_at FROM b"""


def ingest_runs(spark, sf):
    """Two runs of three sources, with ids that are missing or doubled, new, changed and missing records, a source that reports more and one that fails: the second's health."""
    folder, r, k = scratch.fresh_dir(spark, "ingest"), T.records(spark, sf), F.col("rec_key")
    f = T.features(spark, sf).where("category = 'floodplain'").withColumn("box", F.struct(*[T.degrees(F.col(c)).alias(c) for c in "wsen"])).withColumn("geom", T.square())
    context = f.select("category", "feature_order", "feature_id", "geom", "box")

    def odd(records: DataFrame) -> DataFrame:
        rows = fields.source_features(records)
        city = F.col("source") == "city_subdivisions"
        nameless = F.when((k % 40 == 13) & ~city, F.map_filter("properties", lambda name, _: ~name.isin("PermitID", "Subd_ID"))).otherwise(F.col("properties"))
        times = F.when((k % 50 == 11) & ~city, 2).otherwise(1)
        return rows.withColumn("properties", nameless).withColumn("copy", F.explode(F.sequence(F.lit(1), times))).drop("copy", "rec_key")

    fetched = lambda *rows: spark.createDataFrame([(*r,) for r in rows], "key string, status string, reported_count long, declared string")
    names = ("city_subdivisions", "city_permits", "county_subdivisions")
    ingest.ingest(odd(r.where(k % 4 != 1)), context, fetched(*[(n, "healthy", None, "complete") for n in names]), "2024-02-01T00:00:00Z", f"{folder}/1")
    later = r.where(k % 10 != 7).withColumn("title", F.when(k % 6 == 0, F.concat("title", F.lit(" revised"))).otherwise(F.col("title")))
    said = fetched((names[0], "healthy", 1, "complete"), (names[1], "healthy", 10**12, "complete"), (names[2], "failing", None, None))
    return ingest.ingest(odd(later), context, said, "2024-03-01T00:00:00Z", f"{folder}/2", f"{folder}/1")["health"]


_INGEST_RUNS = f"""{T.with_sql('records', 'features')},
r AS (SELECT *, rec_key AS k, CASE rec_key % 3 WHEN 0 THEN 'city_subdivisions' WHEN 1 THEN 'city_permits' ELSE 'county_subdivisions' END AS key, rec_key % 3 <> 0 AND rec_key % 40 = 13 AS bad, rec_key % 3 <> 0 AND rec_key % 50 = 11 AS twice FROM records),
x AS (SELECT *, NOT bad AND NOT twice AS good, k % 4 <> 1 AS one, k % 10 <> 7 AS two, key <> 'county_subdivisions' AS open,
 EXISTS (SELECT 1 FROM features f WHERE category = 'floodplain' AND r.w <= f.e AND f.w <= CASE WHEN k % 3 = 1 THEN r.w ELSE r.e END AND r.s <= f.n AND f.s <= CASE WHEN k % 3 = 1 THEN r.s ELSE r.n END) AS wet FROM r),
c AS (SELECT key, any_value(open) AS open, coalesce(sum(CASE WHEN twice THEN 2 ELSE 1 END) FILTER (two), 0) AS seen_, coalesce(sum(CASE WHEN twice THEN 2 ELSE 1 END) FILTER (two AND NOT good), 0) AS held,
 count(*) FILTER (good AND two AND open AND NOT one) AS inserted, count(*) FILTER (good AND two AND open AND one AND k % 6 = 0) AS changed, count(*) FILTER (good AND two AND open AND one AND k % 6 <> 0) AS seen,
 count(*) FILTER (good AND one AND NOT (two AND open)) AS kept, count(*) FILTER (good AND two AND open AND wet) AS flags, count(*) FILTER (good AND one AND NOT two) AS lost FROM x GROUP BY 1)
SELECT key, CASE WHEN open THEN 'healthy' ELSE 'failing' END AS status, CASE WHEN NOT open THEN 'failed' WHEN held > 0 OR key = 'city_permits' THEN 'partial' ELSE 'complete' END AS coverage, seen_::BIGINT AS records_seen, (seen_ - held)::BIGINT AS records_created,
 held::BIGINT AS quarantined_count, (held + CASE WHEN open THEN 0 ELSE 1 END)::BIGINT AS error_count, inserted, changed, seen, kept, flags, '2024-03-01T00:00:00Z' AS checked_at, CASE WHEN key = 'city_subdivisions' THEN lost ELSE 0 END AS missing FROM c"""


def client_keys(spark, sf):
    """Requests by way of proxies over IPv4, IPv6 and mapped addresses: the client in normal text and the key that its quota counts by."""
    user = F.col("user_id")
    long_ = F.concat(F.lit("2001:0DB8:0000:0000:0000:0000:0000:"), F.lpad(F.hex(user % 65535 + 1), 4, "0"))
    mapped = F.concat(F.lit("::FFFF:203.0."), (user.bitwiseAND(0xFFFF) / 256).cast("int"), F.lit("."), user.bitwiseAND(0xFF))
    client = F.when(F.col("event_type") < "d", long_).otherwise(mapped)
    chain = F.concat(F.lit("198.51.100.9, "), client, F.lit(" , fd00:0::1"))
    address = intake.client_address(F.lit("::ffff:10.1.2.3"), chain, [("10.0.0.0", 8), ("fd00::", 8)])
    e = T.table(spark, sf, "events").select("event_id", "ts", "event_type", address.alias("client"))
    return e.select("event_id", "client", intake.client_key(SECRET, F.col("ts"), F.col("event_type"), F.col("client")).alias("key"))


def _pad(x: int) -> str:
    return bytes(b ^ x for b in SECRET.ljust(64, b"\0")).hex()


_CLIENT_KEYS = f"""WITH c AS (SELECT event_id, ts, event_type, CASE WHEN event_type < 'd' THEN '2001:db8::' || lower(to_hex(user_id % 65535 + 1)) ELSE '203.0.' || ((user_id & 65535) // 256) || '.' || (user_id & 255) END AS client FROM events)
SELECT event_id, client, sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode(strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S+00:00') || '|' || event_type || '|' || client)))) AS key FROM c"""

#: ``ingest_runs`` isn't registered: it gives the rows of its SQL at scale 0.001, but is too slow for whole tables yet.
QUERIES = {
    "blob_store": (blob_store, _BLOB_STORE),
    "canonical_blocks": (canonical_blocks, _CANONICAL_BLOCKS),
    "digest_tree_nodes": (digest_tree_nodes, _TREE),
    "checkpoint_codes": (checkpoint_codes, _CHECKPOINT_CODES),
    "client_keys": (client_keys, _CLIENT_KEYS),
}
