"""The domain's inputs derived from the supplied star-schema tables, with whole-number arithmetic.

Coordinates are micro-degrees until geometry is built, so that every engine gets the same numbers.
``SQL`` holds the same derivations as views for the oracle queries.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from landsift.functions import geometry as G

TYPES = ("subdivision", "building_permit", "public_submission")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Development records from orders: a square footprint on a grid of 460 by 310 cells."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    half = (1 + c % 5) * 200
    x, y = -86880000 + (k % 460) * 1000, 34600000 + (F.floor(k / 460) % 310) * 1000
    first = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").select(
        k.alias("rec_key"),
        F.concat(F.lit("rec-"), k).alias("public_id"),
        F.concat(F.lit("Record "), k, F.lit(" of Customer "), c).alias("title"),
        F.when(F.col("o_orderstatus") == "F", "final").when(F.col("o_orderstatus") == "O", "layout").otherwise("preliminary").alias("status"),
        F.when(k % 3 == 0, TYPES[0]).when(k % 3 == 1, TYPES[1]).otherwise(TYPES[2]).alias("development_type"),
        F.when(first.isin("1", "2"), "high").when(first == "3", "medium").otherwise("low").alias("confidence_level"),
        day(F.col("o_orderdate")).alias("date_discovered"),
        c.alias("owner_key"),
        (x - half).cast("long").alias("w"), (y - half).cast("long").alias("s"), (x + half).cast("long").alias("e"), (y + half).cast("long").alias("n"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Environmental features: floodplain squares from suppliers, wetland squares from customers."""

    def of(name: str, key: str, category: str) -> DataFrame:
        k = F.col(key)
        x, y = -86880000 + ((k * 7919) % 460) * 1000, 34600000 + ((k * 104729) % 310) * 1000
        box = [(v + d).cast("long").alias(a) for v, d, a in ((x, -600, "w"), (y, -600, "s"), (x, 600, "e"), (y, 600, "n"))]
        return table(spark, sf_dir, name).select(F.lit(category).alias("category"), k.alias("feature_order"), F.concat(F.lit(category + "-"), k).alias("feature_id"), *box)

    return of("supplier", "s_suppkey", "floodplain").unionByName(of("customer", "c_custkey", "wetlands"))


def box(df: DataFrame) -> Column:
    return F.struct("w", "s", "e", "n")


def degrees(value: Column) -> Column:
    return value.cast("double") / 1000000.0


def square(w: str = "w", s: str = "s", e: str = "e", n: str = "n") -> Column:
    return G.polygon(G.box_ring(*(degrees(F.col(c)) for c in (w, s, e, n))))


def triangle(w: str = "w", s: str = "s", e: str = "e", n: str = "n") -> Column:
    """The lower left half of a box."""
    a, b, c = (degrees(F.col(w)), degrees(F.col(s))), (degrees(F.col(e)), degrees(F.col(s))), (degrees(F.col(w)), degrees(F.col(n)))
    return G.polygon(F.array(G.point(*a), G.point(*b), G.point(*c), G.point(*a)))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source observations from lineitem: the anchor is (order, line), the batch the month of shipping."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("source_key"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("record_id"),
        F.date_format("l_shipdate", "yyyy-MM").alias("batch"),
        day(F.col("l_shipdate")).alias("seen_on"),
        F.when(F.col("l_linestatus") == "F", "complete").otherwise("partial").alias("coverage"),
        F.concat_ws("|", F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("long")).alias("content"),
        "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber",
    )


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents as titles: even ids staged, odd ids published."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("title"), (F.col("doc_id") % 2 == 0).alias("staged"), F.when(F.col("doc_id") % 4 < 2, "final").otherwise("layout").alias("status"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", F.concat(F.lit("client-"), "user_id").alias("client"), F.col("event_type").alias("route"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review actions a candidate: purchase approves, click asks for information, error rejects."""
    verdict = F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "click", "needs_info").when(F.col("event_type") == "error", "rejected")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("cand-"), "user_id").alias("candidate_id"), "event_id", "ts", verdict.alias("action")).where("action is not null")


def watches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A watch rectangle a nation, some with filters."""
    k = F.col("n_nationkey").cast("long")
    status = F.when(k % 3 == 0, F.array(F.lit("final"))).when(k % 3 == 1, F.array(F.lit("layout"), F.lit("preliminary")))
    kinds = F.when(k % 2 == 0, F.array(F.lit("subdivision")))
    x, y = -86880000 + (k * 17 % 460) * 1000, 34600000 + (k * 11 % 310) * 1000
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("watch-"), k).alias("watch_id"), F.col("n_name").alias("name"), status.alias("statuses"), kinds.alias("types"), x.alias("w"), y.alias("s"), (x + 20000).alias("e"), (y + 15000).alias("n"))


def health_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's health a type of event: last time, rows seen and errors."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("key")).agg(F.max("ts").alias("last_checked_at"), F.count(F.lit(1)).alias("records_seen"), F.count_if(F.col("value") > 90).alias("error_count"))


def dag_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, depends_on: nations on their region, customers on their nation, region n on region n - 1."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return (
        c.select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("depends_on"))
        .unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("depends_on")))
        .unionByName(r.where("r_regionkey > 0").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.concat(F.lit("r"), F.col("r_regionkey") - 1).alias("depends_on")))
    )


#: The same derivations for the oracle, as common table expressions by name.
SQL = {
    "records": """records AS (SELECT o_orderkey AS rec_key, 'rec-' || o_orderkey AS public_id, 'Record ' || o_orderkey || ' of Customer ' || o_custkey AS title,
 CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'layout' ELSE 'preliminary' END AS status,
 CASE o_orderkey % 3 WHEN 0 THEN 'subdivision' WHEN 1 THEN 'building_permit' ELSE 'public_submission' END AS development_type,
 CASE WHEN o_orderpriority[1] IN ('1','2') THEN 'high' WHEN o_orderpriority[1] = '3' THEN 'medium' ELSE 'low' END AS confidence_level,
 strftime(o_orderdate, '%Y-%m-%d') AS date_discovered, o_custkey AS owner_key,
 -86880000 + (o_orderkey % 460) * 1000 - (1 + o_custkey % 5) * 200 AS w, 34600000 + ((o_orderkey // 460) % 310) * 1000 - (1 + o_custkey % 5) * 200 AS s,
 -86880000 + (o_orderkey % 460) * 1000 + (1 + o_custkey % 5) * 200 AS e, 34600000 + ((o_orderkey // 460) % 310) * 1000 + (1 + o_custkey % 5) * 200 AS n FROM orders)""",
    "features": """features AS (SELECT category, k AS feature_order, category || '-' || k AS feature_id,
 -86880000 + ((k * 7919) % 460) * 1000 - 600 AS w, 34600000 + ((k * 104729) % 310) * 1000 - 600 AS s,
 -86880000 + ((k * 7919) % 460) * 1000 + 600 AS e, 34600000 + ((k * 104729) % 310) * 1000 + 600 AS n
 FROM (SELECT 'floodplain' AS category, s_suppkey AS k FROM supplier UNION ALL SELECT 'wetlands', c_custkey FROM customer))""",
    "observations": """observations AS (SELECT l_returnflag AS source_key, l_orderkey || '-' || l_linenumber AS record_id, strftime(l_shipdate, '%Y-%m') AS batch,
 strftime(l_shipdate, '%Y-%m-%d') AS seen_on, CASE l_linestatus WHEN 'F' THEN 'complete' ELSE 'partial' END AS coverage,
 l_partkey || '|' || l_suppkey || '|' || l_quantity::BIGINT AS content, l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem)""",
    "titles": """titles AS (SELECT doc_id, coalesce(text, '') AS title,
 doc_id % 2 = 0 AS staged, CASE WHEN doc_id % 4 < 2 THEN 'final' ELSE 'layout' END AS status FROM documents)""",
    "attempts": "attempts AS (SELECT event_id, ts, 'client-' || user_id AS client, event_type AS route FROM events)",
    "actions": """actions AS (SELECT * FROM (SELECT 'cand-' || user_id AS candidate_id, event_id, ts,
 CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'click' THEN 'needs_info' WHEN 'error' THEN 'rejected' END AS action FROM events) WHERE action IS NOT NULL)""",
    "watches": """watches AS (SELECT 'watch-' || k AS watch_id, n_name AS name, CASE k % 3 WHEN 0 THEN ['final'] WHEN 1 THEN ['layout', 'preliminary'] END AS statuses,
 CASE WHEN k % 2 = 0 THEN ['subdivision'] END AS types, -86880000 + (k * 17 % 460) * 1000 AS w, 34600000 + (k * 11 % 310) * 1000 AS s,
 -86880000 + (k * 17 % 460) * 1000 + 20000 AS e, 34600000 + (k * 11 % 310) * 1000 + 15000 AS n FROM (SELECT n_nationkey::BIGINT AS k, n_name FROM nation))""",
    "health": "health AS (SELECT event_type AS key, max(ts) AS last_checked_at, count(*) AS records_seen, count(*) FILTER (value > 90) AS error_count FROM events GROUP BY event_type)",
    "edges": """edges AS (SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS depends_on FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
 UNION ALL SELECT 'r' || r_regionkey, 'r' || (r_regionkey - 1) FROM region WHERE r_regionkey > 0)""",
}


def with_sql(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in names)
