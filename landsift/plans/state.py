"""Queries over stateful and roll-up operators: dedupe, merge, review, catalog, quota, imports, display, graphs."""

from __future__ import annotations

import re

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from landsift.functions import geometry as G
from landsift.functions import scalars as S
from landsift.operators import merge, reports, review, tables
from landsift.sources import testdata as T

def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with an anchor and an order in which they came; the order is made unique by content."""
    pos = F.concat_ws("|", T.day(F.col("l_shipdate")), F.lpad("l_partkey", 8, "0"), F.lpad("l_suppkey", 8, "0"), F.lpad((F.col("l_quantity") * 100).cast("long").cast("string"), 8, "0"), F.lpad(F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"), 12, "0"))
    return T.table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("anchor"), F.col("l_returnflag").alias("source_key"), "l_partkey", "l_suppkey", pos.alias("pos"))


_LINES = """lines AS (SELECT l_orderkey || '-' || l_linenumber AS anchor, l_returnflag AS source_key, l_partkey, l_suppkey,
 strftime(l_shipdate, '%Y-%m-%d') || '|' || lpad(l_partkey::VARCHAR, 8, '0') || '|' || lpad(l_suppkey::VARCHAR, 8, '0') || '|' || lpad((l_quantity * 100)::BIGINT::VARCHAR, 8, '0') || '|' || lpad(round(l_extendedprice * 100)::BIGINT::VARCHAR, 12, '0') AS pos FROM lineitem)"""


def dedupe_first_wins(spark, sf):
    return tables.first_wins(_lines(spark, sf).select("anchor", "l_partkey", "l_suppkey", "pos"), "anchor", "pos")


def dedupe_last_wins(spark, sf):
    return tables.last_wins(_lines(spark, sf).select("anchor", "l_partkey", "l_suppkey", "pos"), "anchor", "pos")


def dedupe_reject_all_duplicates(spark, sf):
    return tables.reject_all_duplicates(_lines(spark, sf).select("source_key", "anchor", "l_partkey"), ["source_key", "anchor"])[0]


def duplicate_groups_having(spark, sf):
    return _lines(spark, sf).groupBy("source_key", "anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def collection_counts(spark, sf):
    names = ("orders", "part", "customer", "supplier", "nation")
    out = None
    for n in names:
        part = T.table(spark, sf, n).agg(F.count(F.lit(1)).alias("items")).select(F.lit(n).alias("collection"), "items")
        out = part if out is None else out.unionByName(part)
    return out


def _registry(spark, sf, before: str) -> DataFrame:
    """What batches before a month registered: one row an anchor, first and last sighting, content of the last."""
    o = T.observations(spark, sf).where(F.col("batch") < before)
    last = F.max_by("content", F.struct("seen_on", "content"))
    return o.groupBy(*merge.ANCHOR).agg(F.min("seen_on").alias("discovered_on"), F.max("seen_on").alias("last_seen_on"), S.fingerprint(last).alias("fingerprint")).withColumn("public_id", S.public_id("rec", F.col("source_key"), F.col("record_id")))


def _batch(spark, sf, month: str) -> DataFrame:
    o = T.observations(spark, sf).where(F.col("batch") >= month)
    return tables.last_wins(o.select(*merge.ANCHOR, "content", "seen_on", F.concat_ws("|", "seen_on", "content").alias("pos")), merge.ANCHOR, "pos").select(*merge.ANCHOR, "content", "seen_on")


MONTH = "1998-01"
_MERGED = f"""{T.with_sql('observations')},
reg AS (SELECT source_key, record_id, min(seen_on) AS discovered_on, max(seen_on) AS last_seen_on, max_by(content, seen_on || '|' || content) AS content FROM observations WHERE batch < '{MONTH}' GROUP BY 1, 2),
new AS (SELECT source_key, record_id, max_by(content, seen_on || '|' || content) AS content, max(seen_on) AS seen_on FROM observations WHERE batch >= '{MONTH}' GROUP BY 1, 2),
m AS (SELECT coalesce(reg.source_key, new.source_key) AS source_key, coalesce(reg.record_id, new.record_id) AS record_id, coalesce(discovered_on, seen_on) AS discovered_on, coalesce(seen_on, last_seen_on) AS last_seen_on,
 CASE WHEN reg.content IS NULL THEN 'inserted' WHEN new.content IS NULL THEN 'kept' WHEN reg.content <> new.content THEN 'changed' ELSE 'seen' END AS change, coalesce(new.content, reg.content) AS content
 FROM reg FULL JOIN new ON reg.source_key = new.source_key AND reg.record_id = new.record_id)"""


def merge_registry_upsert(spark, sf):
    m = merge.merge(_registry(spark, sf, MONTH), _batch(spark, sf, MONTH))
    return m.select(*merge.ANCHOR, "public_id", "discovered_on", "last_seen_on", "fingerprint", "change")


def merge_change_counts(spark, sf):
    return merge.merge(_registry(spark, sf, MONTH), _batch(spark, sf, MONTH)).groupBy("source_key", "change").agg(F.count(F.lit(1)).alias("n"))


def merge_replay_noop(spark, sf):
    """Merging the same batch again inserts and changes nothing."""
    once = merge.merge(_registry(spark, sf, MONTH), _batch(spark, sf, MONTH)).drop("change")
    return merge.merge(once, _batch(spark, sf, MONTH)).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def merge_source_missing(spark, sf):
    coverage = spark.createDataFrame([("A", "success", "complete"), ("N", "success", None), ("R", "failed", "complete")], "source_key string, status string, coverage string")
    return merge.source_missing(_registry(spark, sf, MONTH), _batch(spark, sf, MONTH), coverage).select(*merge.ANCHOR, "last_seen_on")


def merge_quarantine(spark, sf):
    o = T.observations(spark, sf)
    bad = merge.quarantine(o.select(*merge.ANCHOR, "content", "seen_on"))[1]
    return bad.groupBy("source_key", "problem").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("record_id").alias("anchors"))


def merge_id_collisions(spark, sf):
    """Ids made without the source's name, as they would collide: the same line under two return flags."""
    merged = merge.merge(_registry(spark, sf, MONTH), _batch(spark, sf, MONTH))
    return merge.collisions(merged.withColumn("public_id", F.concat(F.lit("rec-"), "record_id")))


def _backfill(spark, sf) -> DataFrame:
    r = T.records(spark, sf)
    k = F.col("rec_key")
    made = r.select("public_id", F.when(k % 10 != 0, F.concat(F.lit("s"), (k % 3).cast("string"))).alias("source_key"), F.when(k % 11 == 0, " ").when(k % 13 == 0, "shared").otherwise(k.cast("string")).alias("record_id"), F.when(k % 17 == 0, "unknown").otherwise(F.col("date_discovered")).alias("discovered_on"))
    known = r.where(k % 4 == 0).select(F.concat(F.lit("s"), (k % 3).cast("string")).alias("source_key"), k.cast("string").alias("record_id"), F.when(k % 8 == 0, F.col("public_id")).otherwise("other").alias("public_id"))
    return merge.backfill_report(made, known)


def backfill_report(spark, sf):
    return _backfill(spark, sf)


def backfill_summary(spark, sf):
    return merge.report_digest(_backfill(spark, sf)).select("rows", "candidates", "diagnostics")


_BACKFILL = f"""{T.with_sql('records')},
b AS (SELECT public_id, rec_key AS k, CASE WHEN rec_key % 10 <> 0 THEN 's' || (rec_key % 3) END AS source_key, CASE WHEN rec_key % 11 = 0 THEN ' ' WHEN rec_key % 13 = 0 THEN 'shared' ELSE rec_key::VARCHAR END AS record_id, CASE WHEN rec_key % 17 = 0 THEN 'unknown' ELSE date_discovered END AS discovered_on FROM records),
u AS (SELECT source_key, record_id, count(*) AS claims FROM b WHERE source_key IS NOT NULL GROUP BY 1, 2),
g AS (SELECT 's' || (rec_key % 3) AS source_key, rec_key::VARCHAR AS record_id, CASE WHEN rec_key % 8 = 0 THEN public_id ELSE 'other' END AS registered FROM records WHERE rec_key % 4 = 0),
c AS (SELECT public_id, b.source_key, b.record_id, CASE WHEN b.source_key IS NULL THEN 'out_of_scope' WHEN b.record_id = ' ' THEN 'unusable_id' WHEN claims > 1 THEN 'ambiguous_anchor' WHEN registered = public_id THEN 'registered' WHEN registered IS NOT NULL THEN 'registered_elsewhere' WHEN discovered_on = 'unknown' THEN 'bad_discovery_date' ELSE 'candidate' END AS code
 FROM b LEFT JOIN u ON u.source_key = b.source_key AND u.record_id = b.record_id LEFT JOIN g ON g.source_key = b.source_key AND g.record_id = b.record_id),
r AS (SELECT public_id, source_key, record_id, CASE WHEN code IN ('candidate', 'registered') THEN code WHEN code = 'out_of_scope' THEN 'skipped' ELSE 'diagnostic' END AS kind, code FROM c)"""


# --- collections -----------------------------------------------------------------------------------


def collection_upsert(spark, sf):
    """Every fifth customer updated, two suppliers' worth of new keys appended after the largest order."""
    c = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("item"), F.col("c_name").alias("payload"), F.col("c_custkey").alias("sort_order"))
    new = c.where("item % 5 = 0").select("item", F.upper("payload").alias("payload")).unionByName(T.table(spark, sf, "supplier").select((F.col("s_suppkey") + 10000000).alias("item"), F.col("s_name").alias("payload")))
    return tables.upsert(c, new, "item")


def collection_delete_and_ignore(spark, sf):
    c = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("item"), F.col("c_name").alias("payload"))
    left = tables.delete(c, c.where("item % 3 = 0").select("item"), "item")
    return tables.insert_or_ignore(left, c.where("item % 2 = 0").select("item", F.lit("new").alias("payload")), "item")


def immutable_conflicts(spark, sf):
    c = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("item"), F.col("c_name").alias("payload"))
    new = c.select("item", F.when(F.col("item") % 9 == 0, "other").otherwise(F.col("payload")).alias("payload"))
    return tables.conflicts(c, new, "item", ["payload"])


def replace_by_source(spark, sf):
    s = T.table(spark, sf, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey") % 5).alias("source_key"), F.col("s_suppkey").alias("item"))
    new = s.where("source_key in ('n1', 'n2')").select("source_key", (F.col("item") + 1000000).alias("item"))
    return tables.replace_by_source(s, new)


def set_equality_audit(spark, sf):
    """Ids requested and ids returned: those of one side only."""
    o = T.table(spark, sf, "orders")
    return tables.symmetric_difference(o.where("o_orderkey % 100 < 60").select("o_orderkey"), o.where("o_orderkey % 100 >= 1 and o_orderkey % 100 <= 60").select("o_orderkey"))


def paged_scan_audit(spark, sf):
    """Offset pages of 500: rows a page, and whether ids rise strictly."""
    numbered = tables.numbered_rows(T.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return numbered.groupBy(F.floor((F.col("number_") - 1) / 500).alias("page")).agg(F.count(F.lit(1)).alias("rows"), F.min("o_orderkey").alias("first_id"), F.max("o_orderkey").alias("last_id"), (F.countDistinct("o_orderkey") == F.count(F.lit(1))).alias("unique_ids"))


# --- review, history, alerts -----------------------------------------------------------------------


def review_transitions(spark, sf):
    return review.transitions(T.actions(spark, sf)).select("candidate_id", "event_id", "before", "after", "revision")


def review_projection(spark, sf):
    p = review.projection(review.transitions(T.actions(spark, sf)))
    return p.select("candidate_id", "review_status", "state_revision", F.array_join("allowed_actions", ",").alias("allowed_actions"), "reason", "requests")


def review_decide(spark, sf):
    p = review.projection(review.transitions(T.actions(spark, sf)))
    c = T.table(spark, sf, "customer").select(F.concat(F.lit("cand-"), "c_custkey").alias("candidate_id"), F.lit("approved").alias("action"), (F.col("c_custkey") % 3).cast("long").alias("expected_revision"))
    return review.decide(p, c).select("candidate_id", "outcome", "review_status", "state_revision")


_LEGAL = f"""{T.with_sql('actions')},
t AS (SELECT *, min(CASE WHEN action IN ('approved', 'rejected') THEN ts END) OVER (PARTITION BY candidate_id) AS stop FROM actions),
l AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY ts, event_id)::INTEGER AS revision, coalesce(lag(action) OVER (PARTITION BY candidate_id ORDER BY ts, event_id), 'pending') AS before FROM t WHERE stop IS NULL OR ts <= stop),
p AS (SELECT candidate_id, arg_max(action, revision) AS review_status, max(revision)::BIGINT AS state_revision, count(*) FILTER (action = 'needs_info') AS requests FROM l GROUP BY 1)"""


def decision_import_outcomes(spark, sf):
    """Histories cut, extended or altered by candidate number against the present ones."""
    now = review.history(review.transitions(T.actions(spark, sf)))
    k = F.substring_index("candidate_id", "-", -1).cast("long") % 4
    changed = F.when(k == 0, F.col("actions")).when(k == 1, F.concat("actions", F.array(F.lit("approved")))).when(k == 2, F.concat(F.array(F.lit("odd")), "actions")).otherwise(F.slice("actions", F.lit(1), F.size("actions") - 1))
    return review.import_outcomes(now, now.select("candidate_id", changed.alias("actions")))


_IMPORT = _LEGAL + """
SELECT candidate_id, CASE split_part(candidate_id, '-', 2)::BIGINT % 4 WHEN 0 THEN 'no_op' WHEN 1 THEN CASE WHEN review_status IN ('approved', 'rejected') THEN 'illegal' ELSE 'extended' END ELSE 'prefix_conflict' END AS outcome FROM p"""


def record_versions(spark, sf):
    o = T.records(spark, sf).select("owner_key", "rec_key", "status", "date_discovered")
    return review.versions(o, "owner_key", "date_discovered", "rec_key")


def publication_events(spark, sf):
    return review.publication_events(record_versions(spark, sf)).select("owner_key", "rec_key", "version_number", "kind")


_VERSIONS = f"{T.with_sql('records')}, v AS (SELECT owner_key, rec_key, status, date_discovered, row_number() OVER w::INTEGER AS version_number, lag(status) OVER w AS previous_status FROM records WINDOW w AS (PARTITION BY owner_key ORDER BY date_discovered, rec_key))"


def latest_version_pick(spark, sf):
    o = T.records(spark, sf).select("owner_key", "rec_key", "status", "date_discovered")
    return tables.latest(o, "owner_key", "date_discovered", "rec_key")


def agenda_candidate_revisions(spark, sf):
    """Revisions of a source's documents in order of id: only changed content counts."""
    d = T.table(spark, sf, "documents").select("source", "doc_id", S.fingerprint(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z]", "")).alias("print"))
    r = review.content_revisions(d, "source", "print", "doc_id")
    return r.select("source", "doc_id", "is_new", F.col("revision").cast("long").alias("revision"))


def change_log_topk(spark, sf):
    r = T.records(spark, sf)
    explicit = r.where("rec_key % 40 = 0").select(F.concat(F.lit("change-"), "rec_key").alias("id"), "public_id", F.col("date_discovered").alias("changed_at"), F.lit("published").alias("change_type"), F.col("rec_key").alias("position"))
    records = r.where("rec_key % 3 = 0").select("public_id", F.col("date_discovered").alias("changed_at"), F.col("rec_key").alias("position"))
    return review.change_log(explicit, records, 50)


_LOG = f"""{T.with_sql('records')}, x AS (SELECT 'change-' || rec_key AS id, public_id, date_discovered AS changed_at, 'published' AS change_type, 0 AS r, rec_key AS pos FROM records WHERE rec_key % 40 = 0
 UNION ALL (SELECT 'change-' || public_id || '-current', public_id, date_discovered, 'current_snapshot', 1, rec_key FROM records WHERE rec_key % 3 = 0 ORDER BY rec_key LIMIT 50))
SELECT id, public_id, changed_at, change_type FROM x ORDER BY changed_at DESC, r, pos LIMIT 50"""


def delivery_plan(spark, sf):
    e = T.table(spark, sf, "events")
    alerts = e.select(F.concat(F.lit("alert-"), "event_id").alias("alert_id"), F.concat(F.lit("watch-"), F.col("user_id") % 30).alias("watch_id"), F.when(F.col("event_id") % 2 == 0, "queued").otherwise("sent").alias("status"), F.col("event_id").alias("sort_order"))
    watches = T.watches(spark, sf).select("watch_id", (F.substring_index("watch_id", "-", -1).cast("int") % 4 == 0).alias("unsubscribed"))
    return review.delivery_plan(alerts, watches, 300)


def history_inventory_anti_joins(spark, sf):
    """Candidates that lack a review event, by kind of what is missing."""
    ids = T.table(spark, sf, "customer").select(F.concat(F.lit("cand-"), "c_custkey").alias("candidate_id"))
    parts = None
    for action in ("approved", "needs_info", "rejected"):
        have = T.actions(spark, sf).where(F.col("action") == action).select("candidate_id")
        part = ids.join(have, "candidate_id", "left_anti").agg(F.count(F.lit(1)).alias("candidates")).select(F.lit(action).alias("lacks"), "candidates")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def ownership_check(spark, sf):
    """Which store owns a public record: one, both or none."""
    r = T.records(spark, sf)
    a = r.where("rec_key % 2 = 0").select("public_id", F.lit(True).alias("a"))
    b = r.where("rec_key % 3 = 0").select("public_id", F.lit(True).alias("b"))
    owner = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "processed").when(F.col("b"), "operational").otherwise("none")
    return r.select("public_id").join(a, "public_id", "left").join(b, "public_id", "left").select("public_id", owner.alias("owner"))


def copy_transitions(spark, sf):
    states, events = ("reserved", "leased", "uploaded", "verified", "retry"), ("claim", "upload", "verify", "audit", "fail")
    k = F.col("event_id")
    state = F.element_at(F.array(*map(F.lit, states)), (k % 5 + 1).cast("int"))
    event = F.element_at(F.array(*map(F.lit, events)), (k % 7 % 5 + 1).cast("int"))
    return T.table(spark, sf, "events").select("event_id", review.copy_transition(state, event).alias("next_state"))


_COPY = """WITH s AS (SELECT event_id, ['reserved','leased','uploaded','verified','retry'][event_id % 5 + 1] AS s, ['claim','upload','verify','audit','fail'][event_id % 7 % 5 + 1] AS e FROM events)
SELECT event_id, CASE e WHEN 'claim' THEN CASE WHEN s IN ('reserved','retry') THEN 'leased' END WHEN 'upload' THEN CASE WHEN s = 'leased' THEN 'uploaded' END
 WHEN 'verify' THEN CASE WHEN s = 'uploaded' THEN 'verified' END WHEN 'audit' THEN CASE WHEN s = 'verified' THEN 'leased' END ELSE CASE WHEN s IN ('leased','uploaded') THEN 'retry' END END AS next_state FROM s"""


# --- roll-ups --------------------------------------------------------------------------------------

AS_OF = "2024-01-31 00:00:00"


def _health(spark, sf) -> DataFrame:
    return T.health_rows(spark, sf).withColumn("status", F.when(F.col("key") == "error", "failed").when(F.col("key") == "signup", "not_run").otherwise("healthy"))


def freshness_issues(spark, sf):
    h = reports.health_issues(_health(spark, sf), F.to_timestamp_ntz(F.lit(AS_OF)), 0.25)
    return h.select("key", F.array_join("issues", ",").alias("issues"), "healthy")


def health_monitor(spark, sf):
    return reports.monitor(reports.health_issues(_health(spark, sf).withColumn("error_count", F.lit(0)), F.to_timestamp_ntz(F.lit(AS_OF)), 24.0))


_ISSUES = f"""{T.with_sql('health')}, i AS (SELECT *, list_filter([CASE key WHEN 'signup' THEN 'not_run' WHEN 'error' THEN 'status:failed' END, CASE WHEN error_count > 0 THEN 'errors:' || error_count END, CASE WHEN last_checked_at < TIMESTAMP '{AS_OF}' - INTERVAL 15 MINUTE THEN 'stale' END], lambda x: x IS NOT NULL) AS l FROM health)
SELECT key, array_to_string(l, ',') AS issues, len(l) = 0 AS healthy FROM i"""


def connector_health_left_join(spark, sf):
    sources = T.table(spark, sf, "nation").select(F.element_at(F.array(*map(F.lit, ("view", "click", "error", "purchase", "none"))), F.col("n_nationkey") % 5 + 1).alias("key"), F.col("n_name").alias("name"), (F.col("n_regionkey") != 2).alias("active"))
    return reports.connector_health(sources, _health(spark, sf)).select("key", "name", "status", "records_seen", "error_count")


_CONNECTORS = f"""{T.with_sql('health')}, s AS (SELECT ['view','click','error','purchase','none'][n_nationkey % 5 + 1] AS key, n_name AS name FROM nation WHERE n_regionkey <> 2)
SELECT s.key, name, CASE WHEN h.key IS NULL THEN 'not_run' WHEN h.key = 'error' THEN 'failed' ELSE 'healthy' END AS status, coalesce(records_seen, 0) AS records_seen, coalesce(error_count, 0) AS error_count FROM s LEFT JOIN health h ON h.key = s.key"""


def status_rollup(spark, sf):
    e = T.table(spark, sf, "events")
    s = F.when((F.col("event_type") == "error") & (F.col("value") > 95), "failed").when(F.col("event_type") == "error", "degraded").otherwise("healthy")
    return reports.worst_status(e.select("user_id", s.alias("status")), "user_id")


def catalog_build_merge(spark, sf):
    n = T.table(spark, sf, "nation")
    old = n.where("n_nationkey < 15").select(F.col("n_name").alias("layer"), F.when(F.col("n_nationkey") % 2 == 0, "ready").otherwise("pending").alias("delivery_status"), F.lit(1).alias("version"))
    new = n.where("n_nationkey >= 5").select(F.col("n_name").alias("layer"), F.lit("importing").alias("delivery_status"), F.lit(2).alias("version"))
    return reports.merge_catalog(old, new)


def coverage_precedence(spark, sf):
    k = F.col("o_orderkey")
    layer = merge.layer_coverage(F.when(k % 5 != 0, "healthy"), F.when(k % 3 != 0, k % 10), k % 7)
    batch = merge.coverage_status(k % 4 != 0, F.when(k % 3 == 0, "complete"), F.when(k % 6 == 0, F.lit(2)).otherwise(0))
    return T.table(spark, sf, "orders").groupBy(layer.alias("layer"), batch.alias("batch")).agg(F.count(F.lit(1)).alias("n"))


def quota_daily(spark, sf):
    q = reports.quota(T.attempts(spark, sf), "day", 1)
    return q.select("event_id", F.date_format("window_start", "yyyy-MM-dd").alias("window"), "attempt", "accepted")


def quota_hourly(spark, sf):
    q = reports.quota(T.attempts(spark, sf), "hour", 5)
    return q.groupBy("route").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"), F.max("attempt").alias("most"))


def percentile_summary(spark, sf):
    return reports.percentiles(T.table(spark, sf, "events").select("event_type", "value"), "value", "event_type")


def import_resumable_dedupe(spark, sf):
    i = reports.import_rows(_lines(spark, sf).withColumn("content", F.concat_ws("|", "l_partkey", "l_suppkey")).select("source_key", "anchor", "content", "pos"), "anchor", "content", "pos", F.col("source_key") != "R")
    return i.select("anchor", "pos", "fate")


def import_counters(spark, sf):
    i = reports.import_rows(_lines(spark, sf).withColumn("content", F.concat_ws("|", "l_partkey", "l_suppkey")).select("source_key", "anchor", "content", "pos"), "anchor", "content", "pos", F.col("source_key") != "R")
    return reports.import_counters(i, "source_key")


_FATES = f"WITH {_LINES}, f AS (SELECT anchor, min(pos) AS first_pos, arg_min(l_partkey || '|' || l_suppkey, pos) AS first_content FROM lines WHERE source_key <> 'R' GROUP BY 1), i AS (SELECT source_key, anchor, pos, CASE WHEN source_key = 'R' THEN 'rejected' WHEN pos = first_pos THEN 'accepted' WHEN l_partkey || '|' || l_suppkey = first_content THEN 'duplicate' ELSE 'conflict' END AS fate FROM lines LEFT JOIN f USING (anchor))"


def _ring_features(spark, sf) -> DataFrame:
    """Dense rings about the suppliers' places: 400 vertices on a wavy circle, some with a hole."""
    k = F.col("s_suppkey")
    x, y = (-86880000 + ((k * 7919) % 460) * 1000) / 1000000.0, (34600000 + ((k * 104729) % 310) * 1000) / 1000000.0

    def ring(radius: float, n: int):
        turn = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: (i % n) * 2 * 3.141592653589793 / n)
        return F.transform(turn, lambda t: G.point(x + radius * F.cos(t) * (1 + 0.05 * F.sin(t * 12)), y + radius * F.sin(t) * (1 + 0.05 * F.sin(t * 12))))

    geom = F.when(k % 3 == 0, G.polygon(ring(0.02, 400), ring(0.008, 60))).otherwise(G.polygon(ring(0.02, 400)))
    return T.table(spark, sf, "supplier").select(F.concat(F.lit("f"), k).alias("feature_id"), geom.alias("geom"))


def display_bands_simplify_subdivide(spark, sf):
    b = reports.display_build(_ring_features(spark, sf), 128)
    return b.select("feature_id", "band", "vertices", "part_count", "error_code")


def _corner_features(spark, sf) -> DataFrame:
    """L shapes about the suppliers' places, their edges in 40 pieces, some with a square hole, its edges in 10."""
    k = F.col("s_suppkey")
    x, y, u = (-86880000 + ((k * 7919) % 460) * 1000) / 1000000.0, (34600000 + ((k * 104729) % 310) * 1000) / 1000000.0, 0.01 * (1 + k % 3)

    def ring(corners, pieces: int):
        places = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(float(c - a)).alias("da"), F.lit(float(d - b)).alias("db")) for (a, b), (c, d) in zip(corners, corners[1:] + corners[:1], strict=True)])
        turn = F.flatten(F.transform(places, lambda e: F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: G.point(x + u * (e["a"] + e["da"] * i / pieces), y + u * (e["b"] + e["db"] * i / pieces)))))
        return F.concat(turn, F.slice(turn, 1, 1))

    shell, hole = ring([(0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3)], 40), ring([(0.25, 1.25), (0.25, 1.75), (0.75, 1.75), (0.75, 1.25)], 10)
    geom = F.when(k % 3 == 0, G.polygon(shell, hole)).otherwise(G.polygon(shell))
    return T.table(spark, sf, "supplier").select(F.concat(F.lit("l"), k).alias("feature_id"), geom.alias("geom"))


def display_known_shapes(spark, sf):
    """Vertices that are left in each band, and the area that the parts cover, of shapes for which both are known."""
    b = reports.display_build(_corner_features(spark, sf), 128)
    ring_area = lambda r: F.abs(G.shoelace(F.transform(r, lambda p: G.point(p["x"] - r[0]["x"], p["y"] - r[0]["y"])))) / 2
    area = F.aggregate("parts", F.lit(0.0), lambda t, p: t + 2 * ring_area(p[0]) - F.aggregate(p, F.lit(0.0), lambda s, r: s + ring_area(r)))
    return b.select("feature_id", "band", "vertices", F.floor(area / 100).alias("area_ha100"), (F.col("part_count") > 1).alias("divided"), F.coalesce("error_code", F.lit("")).alias("error_code"))


_KNOWN_SHAPES = """
WITH f AS (SELECT s_suppkey AS k, (34600000 + ((s_suppkey * 104729) % 310) * 1000) / 1000000.0 AS y, 0.01 * (1 + s_suppkey % 3) AS u FROM supplier),
m AS (SELECT *, 6378137.0 * radians(u) AS x1, lambda_y(y) AS y0, lambda_y(y + u) AS y1, lambda_y(y + 3 * u) AS y3, lambda_y(y + 1.25 * u) AS h0, lambda_y(y + 1.75 * u) AS h1 FROM f),
b(band, tolerance) AS (VALUES ('z08_10', 100), ('z11_12', 40), ('z13_14', 10), ('z15_16', 2), ('z17_18', 0))
SELECT 'l' || k AS feature_id, band,
  (CASE WHEN tolerance = 0 THEN 241 ELSE 7 END + CASE WHEN k % 3 <> 0 THEN 0 WHEN tolerance = 0 THEN 41 ELSE 5 END)::INTEGER AS vertices,
  floor((3 * x1 * (y1 - y0) + x1 * (y3 - y1) - CASE WHEN k % 3 = 0 THEN 0.5 * x1 * (h1 - h0) ELSE 0 END) / 100)::BIGINT AS area_ha100,
  tolerance = 0 AS divided, '' AS error_code FROM m, b"""
_KNOWN_SHAPES = re.sub(r"lambda_y\(([^()]*)\)", r"6378137.0 * ln(tan(pi() / 4 + radians(\1) / 2))", _KNOWN_SHAPES)


def display_band_report(spark, sf):
    return reports.band_report(reports.display_build(_ring_features(spark, sf), 128))


def dag_topological_check(spark, sf):
    return reports.topological_levels(T.dag_edges(spark, sf))


_DAG = T.with_sql("edges", recursive=True) + """, n AS (SELECT node FROM edges UNION SELECT depends_on FROM edges),
w(node, level) AS (SELECT node, 0 FROM n WHERE node NOT IN (SELECT node FROM edges) UNION ALL SELECT e.node, w.level + 1 FROM w JOIN edges e ON e.depends_on = w.node)
SELECT node, max(level) AS level FROM w GROUP BY 1"""

QUERIES = {
    "dedupe_first_wins": (dedupe_first_wins, f"WITH {_LINES} SELECT anchor, arg_min(l_partkey, pos) AS l_partkey, arg_min(l_suppkey, pos) AS l_suppkey, min(pos) AS pos FROM lines GROUP BY 1"),
    "dedupe_last_wins": (dedupe_last_wins, f"WITH {_LINES} SELECT anchor, arg_max(l_partkey, pos) AS l_partkey, arg_max(l_suppkey, pos) AS l_suppkey, max(pos) AS pos, min(pos) AS position FROM lines GROUP BY 1"),
    "dedupe_reject_all_duplicates": (dedupe_reject_all_duplicates, f"WITH {_LINES}, c AS (SELECT *, count(*) OVER (PARTITION BY source_key, anchor) AS n FROM lines) SELECT source_key, anchor, l_partkey FROM c WHERE n = 1"),
    "duplicate_groups_having": (duplicate_groups_having, f"WITH {_LINES} SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS rows FROM (SELECT count(*) AS n FROM lines GROUP BY source_key, anchor HAVING count(*) > 1)"),
    "collection_counts": (collection_counts, " UNION ALL ".join(f"SELECT '{n}' AS collection, count(*) AS items FROM {n}" for n in ("orders", "part", "customer", "supplier", "nation"))),
    "collection_upsert": (collection_upsert, "SELECT c_custkey AS item, CASE WHEN c_custkey % 5 = 0 THEN upper(c_name) ELSE c_name END AS payload, c_custkey AS sort_order FROM customer UNION ALL SELECT s_suppkey + 10000000, s_name, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_suppkey) FROM supplier"),
    "collection_delete_and_ignore": (collection_delete_and_ignore, "SELECT c_custkey AS item, c_name AS payload FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 6 = 0"),
    "immutable_conflicts": (immutable_conflicts, "SELECT c_custkey AS item, 'other' AS payload FROM customer WHERE c_custkey % 9 = 0"),
    "replace_by_source": (replace_by_source, "SELECT 'n' || (s_nationkey % 5) AS source_key, CASE WHEN s_nationkey % 5 IN (1, 2) THEN s_suppkey + 1000000 ELSE s_suppkey END AS item FROM supplier"),
    "set_equality_audit": (set_equality_audit, "SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 THEN 'left' ELSE 'right' END AS side FROM orders WHERE o_orderkey % 100 IN (0, 60)"),
    "paged_scan_audit": (paged_scan_audit, "WITH n AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS page FROM orders) SELECT page, count(*) AS rows, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id, count(DISTINCT o_orderkey) = count(*) AS unique_ids FROM n GROUP BY 1"),
    "merge_registry_upsert": (merge_registry_upsert, f"{_MERGED} SELECT source_key, record_id, 'rec-' || record_id || '-' || substr(sha256(source_key || chr(0) || record_id), 1, 16) AS public_id, discovered_on, last_seen_on, sha256(content) AS fingerprint, change FROM m"),
    "merge_change_counts": (merge_change_counts, f"{_MERGED} SELECT source_key, change, count(*) AS n FROM m GROUP BY 1, 2"),
    "merge_replay_noop": (merge_replay_noop, f"{_MERGED} SELECT CASE WHEN change = 'kept' THEN 'kept' ELSE 'seen' END AS change, count(*) AS n FROM m GROUP BY 1"),
    "merge_source_missing": (merge_source_missing, f"{_MERGED} SELECT source_key, record_id, last_seen_on FROM m WHERE change = 'kept' AND source_key = 'A'"),
    "merge_quarantine": (merge_quarantine, f"{T.with_sql('observations')}, c AS (SELECT source_key, record_id, count(*) AS n FROM observations GROUP BY 1, 2 HAVING count(*) > 1) SELECT source_key, 'duplicate_anchor' AS problem, sum(n)::BIGINT AS rows, count(*) AS anchors FROM c GROUP BY 1"),
    "merge_id_collisions": (merge_id_collisions, f"{_MERGED} SELECT 'rec-' || record_id AS public_id, count(*) AS anchors FROM m GROUP BY 1 HAVING count(*) > 1"),
    "backfill_report": (backfill_report, f"{_BACKFILL} SELECT * FROM r"),
    "backfill_summary": (backfill_summary, f"{_BACKFILL} SELECT count(*) AS rows, count(*) FILTER (kind = 'candidate') AS candidates, count(*) FILTER (kind = 'diagnostic') AS diagnostics FROM r"),
    "review_transitions": (review_transitions, f"{_LEGAL} SELECT candidate_id, event_id, before, action AS after, revision FROM l"),
    "review_projection": (review_projection, f"{_LEGAL} SELECT candidate_id, review_status, state_revision, CASE WHEN review_status = 'needs_info' THEN 'approve,needs_info,reject' ELSE '' END AS allowed_actions, CASE WHEN review_status = 'needs_info' THEN 'open' ELSE 'final' END AS reason, requests FROM p"),
    "review_decide": (review_decide, _LEGAL + """
SELECT 'cand-' || c_custkey AS candidate_id, CASE WHEN state_revision IS NULL THEN 'unknown_candidate' WHEN review_status <> 'needs_info' THEN 'not_actionable' WHEN c_custkey % 3 <> state_revision THEN 'revision_conflict' ELSE 'applied' END AS outcome,
 CASE WHEN review_status = 'needs_info' AND c_custkey % 3 = state_revision THEN 'approved' ELSE review_status END AS review_status, CASE WHEN review_status = 'needs_info' AND c_custkey % 3 = state_revision THEN state_revision + 1 ELSE state_revision END AS state_revision
FROM customer LEFT JOIN p ON p.candidate_id = 'cand-' || c_custkey"""),
    "decision_import_outcomes": (decision_import_outcomes, _IMPORT),
    "record_versions": (record_versions, f"{_VERSIONS} SELECT * FROM v"),
    "publication_events": (publication_events, f"{_VERSIONS} SELECT owner_key, rec_key, version_number, CASE WHEN previous_status IS NULL THEN 'published' WHEN status <> previous_status THEN 'changed' ELSE 'context_changed' END AS kind FROM v"),
    "latest_version_pick": (latest_version_pick, f"{T.with_sql('records')} SELECT owner_key, arg_max(rec_key, (date_discovered, rec_key)) AS rec_key, arg_max(status, (date_discovered, rec_key)) AS status, max(date_discovered) AS date_discovered FROM records GROUP BY 1"),
    "agenda_candidate_revisions": (agenda_candidate_revisions, "WITH p AS (SELECT source, doc_id, regexp_replace(coalesce(text, ''), '[^a-z]', '', 'g') AS x FROM documents), n AS (SELECT source, doc_id, coalesce(x <> lag(x) OVER (PARTITION BY source ORDER BY doc_id), true) AS is_new FROM p) SELECT source, doc_id, is_new, (sum(is_new::INTEGER) OVER (PARTITION BY source ORDER BY doc_id))::BIGINT AS revision FROM n"),
    "change_log_topk": (change_log_topk, _LOG),
    "delivery_plan": (delivery_plan, "WITH q AS (SELECT event_id, user_id % 30 AS k FROM events WHERE event_id % 2 = 0 ORDER BY event_id LIMIT 300) SELECT 'alert-' || event_id AS alert_id, 'watch-' || k AS watch_id, event_id AS sort_order, CASE WHEN k >= 25 OR k % 4 = 0 THEN 'suppressed' ELSE 'sent' END AS plan FROM q"),
    "history_inventory_anti_joins": (history_inventory_anti_joins, f"{T.with_sql('actions')} SELECT a AS lacks, (SELECT count(*) FROM customer WHERE 'cand-' || c_custkey NOT IN (SELECT candidate_id FROM actions WHERE action = a)) AS candidates FROM (VALUES ('approved'), ('needs_info'), ('rejected')) v(a)"),
    "ownership_check": (ownership_check, "SELECT 'rec-' || o_orderkey AS public_id, CASE WHEN o_orderkey % 6 = 0 THEN 'both' WHEN o_orderkey % 2 = 0 THEN 'processed' WHEN o_orderkey % 3 = 0 THEN 'operational' ELSE 'none' END AS owner FROM orders"),
    "copy_transitions": (copy_transitions, _COPY),
    "freshness_issues": (freshness_issues, _ISSUES),
    "health_monitor": (health_monitor, f"{T.with_sql('health')} SELECT count(*) AS sources_total, count(*) FILTER (key NOT IN ('error', 'signup')) AS sources_healthy, count(*) FILTER (key IN ('error', 'signup')) AS sources_failing, CASE WHEN count(*) FILTER (key IN ('error', 'signup')) = 0 THEN 'healthy' ELSE 'degraded' END AS status FROM health"),
    "connector_health_left_join": (connector_health_left_join, _CONNECTORS),
    "status_rollup": (status_rollup, "SELECT user_id, CASE max(CASE WHEN event_type = 'error' AND value > 95 THEN 2 WHEN event_type = 'error' THEN 1 ELSE 0 END) WHEN 2 THEN 'failed' WHEN 1 THEN 'degraded' ELSE 'healthy' END AS status FROM events GROUP BY 1"),
    "catalog_build_merge": (catalog_build_merge, "SELECT n_name AS layer, CASE WHEN n_nationkey < 15 AND n_nationkey % 2 = 0 THEN 'ready' WHEN n_nationkey >= 5 THEN 'importing' ELSE 'pending' END AS delivery_status, CASE WHEN n_nationkey < 15 AND n_nationkey % 2 = 0 THEN 1 WHEN n_nationkey >= 5 THEN 2 ELSE 1 END AS version FROM nation"),
    "coverage_precedence": (coverage_precedence, "SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'failed' WHEN o_orderkey % 3 <> 0 AND o_orderkey % 10 > o_orderkey % 7 THEN 'partial' ELSE 'unknown' END AS layer, CASE WHEN o_orderkey % 4 = 0 THEN 'failed' WHEN o_orderkey % 6 = 0 THEN 'partial' WHEN o_orderkey % 3 = 0 THEN 'complete' ELSE 'unknown' END AS batch, count(*) AS n FROM orders GROUP BY 1, 2"),
    "quota_daily": (quota_daily, f"{T.with_sql('attempts')} SELECT event_id, strftime(ts, '%Y-%m-%d') AS window, row_number() OVER (PARTITION BY client, route, date_trunc('day', ts) ORDER BY ts, event_id)::INTEGER AS attempt, row_number() OVER (PARTITION BY client, route, date_trunc('day', ts) ORDER BY ts, event_id) <= 1 AS accepted FROM attempts"),
    "quota_hourly": (quota_hourly, f"{T.with_sql('attempts')}, q AS (SELECT route, row_number() OVER (PARTITION BY client, route, date_trunc('hour', ts) ORDER BY ts, event_id)::INTEGER AS a FROM attempts) SELECT route, count(*) FILTER (a <= 5) AS accepted, count(*) FILTER (a > 5) AS rejected, max(a) AS most FROM q GROUP BY 1"),
    "percentile_summary": (percentile_summary, "SELECT event_type, count(value) AS n, quantile_cont(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1"),
    "import_resumable_dedupe": (import_resumable_dedupe, f"{_FATES} SELECT anchor, pos, fate FROM i"),
    "import_counters": (import_counters, f"{_FATES} SELECT source_key, count(*) AS seen, count(*) FILTER (fate = 'accepted') AS accepted, count(*) FILTER (fate = 'rejected') AS rejected, count(*) FILTER (fate = 'duplicate') AS duplicate, count(*) FILTER (fate = 'conflict') AS conflict FROM i GROUP BY 1"),
    "dag_topological_check": (dag_topological_check, _DAG),
    "display_bands_simplify_subdivide": (display_bands_simplify_subdivide, None),
    "display_band_report": (display_band_report, None),
    "display_known_shapes": (display_known_shapes, _KNOWN_SHAPES),
}
