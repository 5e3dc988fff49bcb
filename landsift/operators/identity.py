"""Agenda identity: which stored document and candidate an observation belongs to, and what of it is open.

Stored rows and incoming rows are tables; a merge is joins on aliases and keys and returns what each incoming row
became. Nothing is guessed: what is only alike is left to a person, by a decision that names the revision it saw.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from landsift.functions.scalars import fingerprint, stable_id

#: Fields that only a person fills in.
REVIEWED = ("review_status", "decision", "resolution", "review_actor", "reviewed_at", "review_notes", "notes", "resolved_at")
UNRESOLVED = "identity_unresolved"


def merge_documents(known: DataFrame, revisions: DataFrame, incoming: DataFrame) -> DataFrame:
    """Of each incoming document (observation_id, url, document_date, sha256): outcome, document_id, revision_id, is_new_revision.

    ``known``: aliases (document_id, url, document_date), one row an alias; ``revisions``: document_id, sha256. An
    exact alias is existing; a known address under another date, or known content, is ambiguous and has no document;
    else the document is new, named by its alias, so that a replay names it the same.
    """
    exact = known.groupBy("url", "document_date").agg(F.min("document_id").alias("exact_"))
    address = known.groupBy("url").agg(F.count(F.lit(1)).alias("same_url_"))
    content = revisions.groupBy("sha256").agg(F.count(F.lit(1)).alias("same_content_"))
    alike = F.coalesce("same_url_", F.lit(0)) + F.coalesce("same_content_", F.lit(0)) > 0
    joined = incoming.join(exact, ["url", "document_date"], "left").join(address, "url", "left").join(content, "sha256", "left")
    outcome = F.when(F.col("exact_").isNotNull(), "existing").when(alike, "ambiguous").otherwise("new")
    made = F.concat(F.lit("agenda-doc-"), F.substring(fingerprint(F.col("url"), F.col("document_date")), 1, 16))
    placed = joined.withColumn("outcome", outcome).withColumn("document_id", F.when(F.col("outcome") == "new", made).otherwise(F.col("exact_")))
    have = revisions.select("document_id", "sha256", F.lit(True).alias("have_")).distinct()
    revision = F.when(F.col("document_id").isNotNull(), fingerprint(F.col("document_id"), F.col("sha256")))
    out = placed.join(have, ["document_id", "sha256"], "left")
    return out.select("observation_id", "outcome", "document_id", revision.alias("revision_id"), (F.col("document_id").isNotNull() & F.col("have_").isNull()).alias("is_new_revision"))


def merge_candidates(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """What each occurrence (occurrence_id, candidate_id, content, applied) does to its candidate.

    ``current``: candidate_id, fingerprint, content_revision, state_revision, review_status. unresolved without a candidate; replayed
    where it was applied before; created; no_op for equal content; else revised: the next revisions, pending again.
    """
    now = current.select("candidate_id", F.struct("fingerprint", "content_revision", "state_revision", "review_status").alias("now_"))
    joined = incoming.withColumn("new_", fingerprint(F.col("content"))).join(now, "candidate_id", "left")
    had = F.col("now_").isNotNull()
    outcome = F.when(F.col("candidate_id").isNull(), "unresolved").when(F.col("applied"), "replayed").when(~had, "created").when(F.col("now_.fingerprint") == F.col("new_"), "no_op").otherwise("revised")
    moved = outcome.isin("created", "revised")
    step = lambda c: F.when(moved, F.coalesce(F.col(f"now_.{c}"), F.lit(0)) + 1).otherwise(F.col(f"now_.{c}"))
    return joined.select("occurrence_id", "candidate_id", outcome.alias("outcome"), step("content_revision").alias("content_revision"), step("state_revision").alias("state_revision"), F.when(moved, "pending").otherwise(F.col("now_.review_status")).alias("review_status"))


def batch_summary(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Of each batch's documents (document_id) with their items (document_id, ordinal): items, occurrences named twice, and whether the context holds."""
    counted = items.groupBy("document_id", "ordinal").agg(F.count(F.lit(1)).alias("n_")).groupBy("document_id").agg(F.sum("n_").alias("items"), F.count_if(F.col("n_") > 1).alias("repeated"))
    joined = documents.select("document_id", F.lit(True).alias("known_")).join(counted, "document_id", "full_outer")
    context = F.when(F.col("known_").isNull(), "document_missing").when(F.col("repeated") > 0, "ambiguous_items").when(F.col("items").isNull(), "empty").otherwise("ok")
    return joined.select("document_id", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("repeated", F.lit(0)).alias("repeated"), context.alias("context"))


def unresolved(documents: DataFrame, observations: DataFrame) -> DataFrame:
    """Both kinds of open identities: kind, id, observation_revision."""
    pick = lambda df, kind: df.where(F.col("status") == UNRESOLVED).select(F.lit(kind).alias("kind"), "id", "observation_revision")
    return pick(documents, "document").unionByName(pick(observations, "observation"))


def resolve(rows: DataFrame, targets: DataFrame, decisions: DataFrame) -> DataFrame:
    """Outcome of decisions (id, target_id, expected_revision, reason) on identities (id, status, observation_revision) and known ``targets`` (target_id).

    A decision without a target creates one. Outcomes: linked, created, revision_conflict, already_resolved, unknown_target, unknown_observation, no_reason.
    """
    known = targets.select("target_id", F.lit(True).alias("there_")).distinct()
    joined = decisions.join(rows.select("id", "status", "observation_revision"), "id", "left").join(known, "target_id", "left")
    outcome = (
        F.when(F.col("status").isNull(), "unknown_observation")
        .when(F.trim(F.coalesce("reason", F.lit(""))) == "", "no_reason")
        .when(F.col("status") != UNRESOLVED, "already_resolved")
        .when(F.col("expected_revision") != F.col("observation_revision"), "revision_conflict")
        .when(F.col("target_id").isNull(), "created")
        .when(F.col("there_").isNull(), "unknown_target")
        .otherwise("linked")
    )
    done = outcome.isin("linked", "created")
    return joined.select("id", outcome.alias("outcome"), F.when(outcome == "created", stable_id("agenda", F.col("id"))).when(done, F.col("target_id")).alias("resolved_to"), F.when(done, F.col("observation_revision") + 1).otherwise(F.col("observation_revision")).alias("observation_revision"))


def identity_health(health: DataFrame, open_identities: DataFrame) -> DataFrame:
    """Health rows (key, ingestion_status, validation_errors) with what is open: degraded while anything is, or any error stands."""
    count = open_identities.agg(F.count(F.lit(1)).alias("identity_unresolved_count"))
    rows = health.crossJoin(F.broadcast(count))  # one row
    open_ = F.col("identity_unresolved_count") > 0
    others = F.filter(F.coalesce("validation_errors", F.array().cast("array<string>")), lambda e: e != "agenda_identity_unresolved")
    errors = F.when(open_, F.concat(others, F.array(F.lit("agenda_identity_unresolved")))).otherwise(others)
    status = F.when(F.size(errors) > 0, "degraded").otherwise(F.coalesce("ingestion_status", F.lit("degraded")))
    return rows.select("key", status.alias("status"), errors.alias("validation_errors"), F.size(errors).alias("error_count"), "identity_unresolved_count")


def attempt_times(status: Column, checked_at: Column, last_success: Column, last_status: Column, last_checked: Column) -> Column:
    """When a source last succeeded, now that it was tried again."""
    return F.when(status == "healthy", checked_at).otherwise(F.coalesce(last_success, F.when(last_status == "healthy", last_checked)))


def is_system_suggestion(staged_id: Column, public_id: Column) -> Column:
    """Whether a duplicate candidate is the matcher's own and untouched: its id follows from the pair, and no reviewed field is filled in."""
    made = F.coalesce("generated_by", F.lit("agenda_matcher")) == "agenda_matcher"
    untouched = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in REVIEWED]).isNull()
    return made & (F.col("id") == stable_id("duplicate", staged_id, public_id)) & untouched


def quarantine_staged(staged: DataFrame, published: DataFrame) -> DataFrame:
    """Published rows (public_id, source_key) with their staged row's record_id, and why they are held back: duplicate_public_id, duplicate_anchor or null.

    A staged row's id is stage- and the public id. All rows of a duplicate are held back, none is picked.
    """
    names = staged.select(F.regexp_replace("id", "^stage-", "").alias("public_id"), "raw_record_id").groupBy("public_id").agg(F.max("raw_record_id").alias("record_id"))
    ids = published.groupBy("public_id").agg(F.count(F.lit(1)).alias("claims_"))
    rows = published.select("public_id", "source_key").join(ids, "public_id").join(names, "public_id", "left")
    usable = (F.col("claims_") == 1) & F.col("record_id").isNotNull()
    anchors = rows.where(usable).groupBy("source_key", "record_id").agg(F.count(F.lit(1)).alias("anchors_"))
    problem = F.when(F.col("claims_") > 1, "duplicate_public_id").when(F.col("anchors_") > 1, "duplicate_anchor")
    return rows.join(anchors, ["source_key", "record_id"], "left").select("public_id", "source_key", "record_id", problem.alias("problem"))
