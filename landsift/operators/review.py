"""Review: transitions, projection, import of decisions, history, change log, alerts and delivery.

A candidate is pending, then takes actions in order until a final one. All of it is window and
aggregate work by candidate; a candidate's own actions are few, and an aggregate finds the end of
them before any row is numbered.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

from landsift.operators.tables import ranged

# What may follow an open status, and what an action is called.
OPEN, FINAL = ("pending", "needs_info"), ("approved", "rejected")
NAMES = {"approved": "approve", "rejected": "reject", "needs_info": "needs_info"}


def transitions(actions: DataFrame) -> DataFrame:
    """Legal events of each candidate (candidate_id, event_id, ts, action): up to its first final action.

    Adds before, after, revision (from 1) and reviewed_at; later actions aren't legal and are left out.
    """
    order = F.struct("ts", "event_id")
    end = actions.where(F.col("action").isin(*FINAL)).groupBy("candidate_id").agg(F.min(order).alias("end_"))
    legal = actions.join(end, "candidate_id", "left").where(F.col("end_").isNull() | (order <= F.col("end_"))).drop("end_")
    w = W.partitionBy("candidate_id").orderBy("ts", "event_id")
    return legal.select("candidate_id", "event_id", F.coalesce(F.lag("action").over(w), F.lit("pending")).alias("before"), F.col("action").alias("after"), F.row_number().over(w).alias("revision"), F.col("ts").alias("reviewed_at"))


def projection(events: DataFrame) -> DataFrame:
    """Current status, revision, allowed actions and reason of each candidate, from its legal events."""
    now = events.groupBy("candidate_id").agg(F.max_by("after", "revision").alias("review_status"), F.max("revision").cast("long").alias("state_revision"), F.count_if(F.col("after") == "needs_info").alias("requests"))
    allowed = F.when(F.col("review_status").isin(*OPEN), F.array(*[F.lit(NAMES[x]) for x in ("approved", "needs_info", "rejected")])).otherwise(F.array().cast("array<string>"))
    return now.withColumn("allowed_actions", allowed).withColumn("reason", F.when(F.size(allowed) > 0, "open").otherwise("final"))


def decide(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """The outcome of one decision (candidate_id, action, expected_revision) a candidate: applied, revision_conflict, not_actionable or unknown_candidate."""
    joined = decisions.join(candidates.select("candidate_id", "review_status", "state_revision"), "candidate_id", "left")
    outcome = F.when(F.col("state_revision").isNull(), "unknown_candidate").when(~F.col("review_status").isin(*OPEN), "not_actionable").when(F.col("expected_revision") != F.col("state_revision"), "revision_conflict").otherwise("applied")
    applied = outcome == "applied"
    return joined.select("candidate_id", "action", outcome.alias("outcome"), F.when(applied, F.col("action")).otherwise(F.col("review_status")).alias("review_status"), F.when(applied, F.col("state_revision") + 1).otherwise(F.col("state_revision")).alias("state_revision"))


def history(events: DataFrame) -> DataFrame:
    """Each candidate's actions in order."""
    return events.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("revision", "after"))).alias("steps")).select("candidate_id", F.transform("steps", lambda s: s["after"]).alias("actions"))


def import_outcomes(current: DataFrame, imported: DataFrame) -> DataFrame:
    """Of an imported history against the present one (candidate_id, actions): no_op, extended, prefix_conflict, illegal or unknown_candidate."""
    now, new = F.col("current_"), F.col("actions")
    joined = imported.join(current.select("candidate_id", F.col("actions").alias("current_")), "candidate_id", "left")
    suffix = F.slice(new, F.size(now) + 1, F.greatest(F.size(new) - F.size(now), F.lit(0)))
    fold = F.aggregate(F.concat(now, suffix), F.lit("pending"), lambda s, a: F.when(s.isin(*OPEN) & a.isin(*NAMES), a).otherwise("illegal"))
    outcome = F.when(now.isNull(), "unknown_candidate").when(~F.slice(new, F.lit(1), F.size(now)).eqNullSafe(now), "prefix_conflict").when(F.size(suffix) == 0, "no_op").when(fold == "illegal", "illegal").otherwise("extended")
    return joined.select("candidate_id", outcome.alias("outcome"))


def versions(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of each key numbered as versions, with the status before."""
    w = W.partitionBy(key).orderBy(*order)
    return rows.withColumn("version_number", F.row_number().over(w)).withColumn("previous_status", F.lag("status").over(w))


def publication_events(versioned: DataFrame) -> DataFrame:
    """Kind of each version: the first is published, one with another status changed, else context_changed."""
    kind = F.when(F.col("previous_status").isNull(), "published").when(F.col("status") != F.col("previous_status"), "changed").otherwise("context_changed")
    return versioned.withColumn("kind", kind)


def content_revisions(rows: DataFrame, key: str, fingerprint: str, *order: str) -> DataFrame:
    """Revision numbers of content: a row whose fingerprint is its predecessor's is no new revision.

    Rows are dealt by ranges of key and order, so the rows of a hot key are split; what a part needs of those before it
    (the key's last fingerprint, how many revisions it had) is a row a part and key.
    """
    kept = ranged(rows, [key, *order])
    w = W.partitionBy("part_", key).orderBy(*order)
    ends = kept.groupBy("part_", key).agg(F.max_by(fingerprint, F.struct(*order)).alias("last_"))
    ends = ends.withColumn("before_", F.lag("last_").over(W.partitionBy(key).orderBy("part_"))).drop("last_")
    marked = _beside(kept, ends, key).withColumn("new_", F.coalesce((F.col(fingerprint) != F.coalesce(F.lag(fingerprint).over(w), F.col("before_"))).cast("int"), F.lit(1)))
    sums = marked.groupBy("part_", key).agg(F.sum("new_").alias("sum_"))
    sums = sums.withColumn("offset_", F.sum("sum_").over(W.partitionBy(key).orderBy("part_")) - F.col("sum_")).drop("sum_")
    counted = _beside(marked.withColumn("in_", F.sum("new_").over(w.rowsBetween(W.unboundedPreceding, 0))), sums, key)
    return counted.withColumn("is_new", F.col("new_") == 1).withColumn("revision", F.col("offset_") + F.col("in_")).select(*rows.columns, "is_new", "revision")


def _beside(rows: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """Rows with what is known of their part and key; a null key is a key."""
    ends = ends.withColumnsRenamed({"part_": "their_part_", key: "their_key_"})
    return rows.join(ends, (F.col("part_") == F.col("their_part_")) & F.col(key).eqNullSafe(F.col("their_key_"))).drop("their_part_", "their_key_")


def change_log(explicit: DataFrame, records: DataFrame, limit: int) -> DataFrame:
    """Explicit entries and a synthetic one for each of the first ``limit`` records, newest first; ties keep explicit, then input order."""
    synthetic = records.orderBy("position").limit(limit).select(F.concat(F.lit("change-"), "public_id", F.lit("-current")).alias("id"), "public_id", "changed_at", F.lit("current_snapshot").alias("change_type"), F.lit(1).alias("rank_"), "position")
    both = explicit.select("id", "public_id", "changed_at", "change_type", F.lit(0).alias("rank_"), "position").unionByName(synthetic)
    return both.orderBy(F.desc("changed_at"), "rank_", "position").limit(limit).drop("rank_", "position")


def delivery_plan(alerts: DataFrame, watches: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` queued alerts: sent, or suppressed where the watch is unsubscribed or gone."""
    queue = alerts.where("status = 'queued'").orderBy("sort_order").limit(limit)
    known = watches.select("watch_id", "unsubscribed", F.lit(True).alias("known_"))
    planned = F.when(F.col("known_").isNull() | F.col("unsubscribed"), "suppressed").otherwise("sent")
    return queue.join(known, "watch_id", "left").select("alert_id", "watch_id", "sort_order", planned.alias("plan"))


def message(subject: Column, summary: Column, *links: Column) -> Column:
    return F.concat_ws("\n", subject, F.lit(""), summary, *links)


def copy_transition(state: Column, event: Column) -> Column:
    """The next state of an artifact copy: reserved, leased, uploaded, verified; a failure makes it retryable, an audit revokes."""
    return (
        F.when((event == "claim") & state.isin("reserved", "retry"), "leased")
        .when((event == "upload") & (state == "leased"), "uploaded")
        .when((event == "verify") & (state == "uploaded"), "verified")
        .when((event == "audit") & (state == "verified"), "leased")
        .when((event == "fail") & state.isin("leased", "uploaded"), "retry")
    )


def claimable(state: Column, lease_until: Column, retry_at: Column, now: Column) -> Column:
    free = lease_until.isNull() | (lease_until <= now)
    return state.isin("reserved", "retry", "leased") & free & (retry_at.isNull() | (retry_at <= now))


def resolve_alias(exact: Column, same_date: Column, same_url: Column, same_checksum: Column) -> Column:
    """Which document an observation belongs to: an exact alias, else new, unless something else is alike, which is left to a person."""
    return F.when(exact.isNotNull(), "existing").when(F.greatest(same_date, same_url, same_checksum) > 0, "ambiguous").otherwise("new")
