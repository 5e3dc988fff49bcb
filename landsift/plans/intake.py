"""Queries over agenda identity, public intake, output health, audits and checks, with their SQL."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from landsift.functions import geometry as G
from landsift.functions import mercator as M
from landsift.functions import scalars as S
from landsift.operators import audits, filters, identity, intake, normalize, reports, review, similarity, spatial, tables
from landsift.plans.records import _DUPLICATES, _sides
from landsift.plans.state import _ring_features
from landsift.sources import collections as C
from landsift.sources import testdata as T

# --- agenda identity ---------------------------------------------------------------------------------


def _document_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as agenda observations: an address of a hundred, a date of twelve, the content's digest."""
    k = F.col("doc_id")
    return T.table(spark, sf, "documents").select(k.alias("observation_id"), F.concat(F.lit("http://x/"), k % 100).alias("url"), F.concat(F.lit("2024-"), F.lpad((k % 12 + 1).cast("string"), 2, "0")).alias("document_date"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


def agenda_document_merge(spark, sf):
    """Even observations are stored, odd ones arrive; one of three stored ones has an alias."""
    rows = _document_rows(spark, sf)
    old = rows.where("observation_id % 2 = 0").withColumn("document_id", F.concat(F.lit("doc-"), F.col("observation_id") % 600))
    known = old.where("observation_id % 3 = 0").select("document_id", "url", "document_date")
    return identity.merge_documents(known, old.select("document_id", "sha256"), rows.where("observation_id % 2 = 1"))


_DOCUMENT_MERGE = """
WITH d AS (SELECT doc_id AS id, 'http://x/' || (doc_id % 100) AS url, '2024-' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') AS day, sha256(coalesce(text, '')) AS sha FROM documents),
old AS (SELECT *, 'doc-' || (id % 600) AS doc FROM d WHERE id % 2 = 0),
e AS (SELECT url, day, min(doc) AS doc FROM old WHERE id % 3 = 0 GROUP BY 1, 2),
o AS (SELECT d.*, e.doc AS known, d.url IN (SELECT url FROM old WHERE id % 3 = 0) OR d.sha IN (SELECT sha FROM old) AS alike FROM d LEFT JOIN e USING (url, day) WHERE id % 2 = 1),
p AS (SELECT *, CASE WHEN known IS NOT NULL THEN 'existing' WHEN alike THEN 'ambiguous' ELSE 'new' END AS outcome, CASE WHEN known IS NOT NULL THEN known WHEN NOT alike THEN 'agenda-doc-' || substr(sha256(url || chr(31) || day), 1, 16) END AS doc FROM o)
SELECT id AS observation_id, outcome, doc AS document_id, CASE WHEN doc IS NOT NULL THEN sha256(doc || chr(31) || sha) END AS revision_id,
 doc IS NOT NULL AND NOT EXISTS (SELECT 1 FROM old WHERE old.doc = p.doc AND old.sha = p.sha) AS is_new_revision FROM p"""


def agenda_candidate_merge(spark, sf):
    """Orders are candidates, lines the occurrences of their items; some lines have no candidate or were applied before."""
    o = T.table(spark, sf, "orders")
    current = o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("candidate_id"), S.fingerprint(F.concat(F.lit("c"), F.col("o_orderkey") % 3)).alias("fingerprint"), (F.col("o_orderkey") % 4 + 1).alias("content_revision"), (F.col("o_orderkey") % 5 + 1).alias("state_revision"), F.lit("approved").alias("review_status"))
    lines = T.table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("occurrence_id"), F.when(F.col("l_linenumber") != 3, F.col("l_orderkey")).alias("candidate_id"), F.concat(F.lit("c"), F.col("l_partkey") % 3).alias("content"), (F.col("l_linenumber") == 4).alias("applied"))
    return identity.merge_candidates(current, lines)


_CANDIDATE_MERGE = """
WITH c AS (SELECT o_orderkey AS k, o_orderkey % 3 AS x, o_orderkey % 4 + 1 AS cr, o_orderkey % 5 + 1 AS sr FROM orders WHERE o_orderkey % 7 <> 0),
j AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS occurrence_id, CASE WHEN l_linenumber <> 3 THEN l_orderkey END AS candidate_id, c.k, cr, sr,
 CASE WHEN l_linenumber = 3 THEN 'unresolved' WHEN l_linenumber = 4 THEN 'replayed' WHEN c.k IS NULL THEN 'created' WHEN c.x = l_partkey % 3 THEN 'no_op' ELSE 'revised' END AS outcome
 FROM lineitem LEFT JOIN c ON c.k = CASE WHEN l_linenumber <> 3 THEN l_orderkey END)
SELECT occurrence_id, candidate_id, outcome, CASE WHEN outcome IN ('created', 'revised') THEN coalesce(cr, 0) + 1 ELSE cr END AS content_revision, CASE WHEN outcome IN ('created', 'revised') THEN coalesce(sr, 0) + 1 ELSE sr END AS state_revision,
 CASE WHEN outcome IN ('created', 'revised') THEN 'pending' WHEN k IS NOT NULL THEN 'approved' END AS review_status FROM j"""


def agenda_batch_context(spark, sf):
    docs = T.table(spark, sf, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("document_id"))
    items = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("ordinal"))
    return identity.batch_summary(docs, items)


_BATCH = """
WITH n AS (SELECT l_orderkey AS k, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2), i AS (SELECT k, sum(n)::BIGINT AS items, count(*) FILTER (n > 1) AS repeated FROM n GROUP BY 1),
d AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(d.k, i.k) AS document_id, coalesce(items, 0) AS items, coalesce(repeated, 0) AS repeated, CASE WHEN d.k IS NULL THEN 'document_missing' WHEN repeated > 0 THEN 'ambiguous_items' WHEN items IS NULL THEN 'empty' ELSE 'ok' END AS context
FROM d FULL JOIN i ON d.k = i.k"""


def _open_rows(spark, sf):
    status = lambda k: F.when(k % 3 == 0, identity.UNRESOLVED).otherwise("resolved").alias("status")
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    observations = T.table(spark, sf, "customer").select(F.concat(F.lit("o"), c).alias("id"), status(c), (c % 4 + 1).cast("long").alias("observation_revision"))
    documents = T.table(spark, sf, "supplier").select(F.concat(F.lit("d"), s).alias("id"), status(s), F.lit(1).cast("long").alias("observation_revision"))
    return documents, observations


def agenda_unresolved(spark, sf):
    return identity.unresolved(*_open_rows(spark, sf))


def agenda_resolution(spark, sf):
    """A decision on each customer's observation and on some that don't exist: with and without target, reason and the right revision."""
    c = F.col("c_custkey")
    decided = T.table(spark, sf, "customer").select(F.concat(F.when(c % 17 == 0, "x").otherwise("o"), c).alias("id"), F.when(c % 2 == 0, F.concat(F.lit("t"), c % 20)).alias("target_id"), (c % 4 + 1 + F.when(c % 5 == 0, 1).otherwise(0)).cast("long").alias("expected_revision"), F.when(c % 13 != 0, "seen").alias("reason"))
    targets = T.table(spark, sf, "nation").select(F.concat(F.lit("t"), F.col("n_nationkey") % 16).alias("target_id"))
    return identity.resolve(_open_rows(spark, sf)[1], targets, decided)


_RESOLUTION = """
WITH d AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 17 = 0 THEN 'x' ELSE 'o' END || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 20 END AS t, c_custkey % 4 + 1 AS rev FROM customer),
o AS (SELECT *, CASE WHEN c % 17 = 0 THEN 'unknown_observation' WHEN c % 13 = 0 THEN 'no_reason' WHEN c % 3 <> 0 THEN 'already_resolved' WHEN c % 5 = 0 THEN 'revision_conflict' WHEN t IS NULL THEN 'created' WHEN t >= 16 THEN 'unknown_target' ELSE 'linked' END AS outcome FROM d)
SELECT id, outcome, CASE outcome WHEN 'created' THEN 'agenda-' || id || '-' || substr(sha256(id), 1, 10) WHEN 'linked' THEN 't' || t END AS resolved_to,
 CASE WHEN outcome = 'unknown_observation' THEN NULL WHEN outcome IN ('created', 'linked') THEN rev + 1 ELSE rev END AS observation_revision FROM o"""


def agenda_identity_health(spark, sf):
    n = F.col("n_nationkey")
    health = T.table(spark, sf, "nation").select(F.col("n_name").alias("key"), F.when(n % 3 == 0, "healthy").when(n % 3 == 1, "degraded").alias("ingestion_status"), F.when(n % 4 == 0, F.array(F.lit("agenda_identity_unresolved"))).when(n % 4 == 1, F.array(F.lit("fetch_failed"))).alias("validation_errors"))
    out = identity.identity_health(health, identity.unresolved(*_open_rows(spark, sf)))
    return out.withColumn("validation_errors", F.array_join("validation_errors", ","))


_IDENTITY_HEALTH = """WITH u AS (SELECT (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) + (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 0) AS n)
SELECT n_name AS key, 'degraded' AS status, CASE WHEN n_nationkey % 4 = 1 THEN 'fetch_failed,' ELSE '' END || 'agenda_identity_unresolved' AS validation_errors, CASE WHEN n_nationkey % 4 = 1 THEN 2 ELSE 1 END AS error_count, n AS identity_unresolved_count FROM nation, u"""


def agenda_last_success(spark, sf):
    k = F.col("event_id")
    day = F.date_format("ts", "yyyy-MM-dd")
    last = identity.attempt_times(F.when(k % 2 == 0, "healthy").otherwise("failing"), day, F.when(k % 3 == 0, "2020-01-01"), F.when(k % 5 == 0, "healthy"), F.lit("2021-01-01"))
    return T.table(spark, sf, "events").select("event_id", last.alias("last_success_at"))


def system_suggestions(spark, sf):
    """Suggestions over supplier and part pairs, some altered by hand."""
    k = F.col("p_partkey")
    own = S.stable_id("duplicate", F.concat(F.lit("s"), k), F.concat(F.lit("p"), k))
    made = T.table(spark, sf, "part").select(k, F.when(k % 5 == 0, "duplicate-other").otherwise(own).alias("id"), F.concat(F.lit("s"), k).alias("staged_id"), F.concat(F.lit("p"), k).alias("public_id"), F.when(k % 3 == 0, "person").when(k % 3 == 1, "agenda_matcher").alias("generated_by"), *[(F.when(k % 7 == 0, "x") if c == "notes" else F.lit(None).cast("string")).alias(c) for c in identity.REVIEWED])
    return made.select("p_partkey", identity.is_system_suggestion(F.col("staged_id"), F.col("public_id")).alias("own"))


def staged_published_quarantine(spark, sf):
    """Published lines with staged rows: an id is order and line; anchors repeat where two orders share a part and line."""
    l = T.table(spark, sf, "lineitem")  # noqa: E741
    public = F.concat_ws("-", "l_orderkey", "l_linenumber")
    published = l.select(public.alias("public_id"), F.col("l_returnflag").alias("source_key"))
    staged = l.where("l_linenumber <> 2").select(F.concat(F.lit("stage-"), public).alias("id"), F.concat_ws(":", F.col("l_partkey") % 500, F.col("l_linenumber")).alias("raw_record_id"))
    return identity.quarantine_staged(staged, published).groupBy("source_key", F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("record_id").alias("records"))


_QUARANTINE = """
WITH p AS (SELECT l_orderkey || '-' || l_linenumber AS id, l_returnflag AS source_key, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS claims FROM lineitem),
s AS (SELECT l_orderkey || '-' || l_linenumber AS id, max((l_partkey % 500) || ':' || l_linenumber) AS record FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1),
j AS (SELECT p.*, record FROM p LEFT JOIN s USING (id)), a AS (SELECT source_key, record, count(*) AS n FROM j WHERE claims = 1 AND record IS NOT NULL GROUP BY 1, 2)
SELECT j.source_key, CASE WHEN claims > 1 THEN 'duplicate_public_id' WHEN n > 1 THEN 'duplicate_anchor' ELSE 'none' END AS problem, count(*) AS rows, count(DISTINCT j.record) AS records
FROM j LEFT JOIN a ON a.source_key = j.source_key AND a.record = j.record GROUP BY 1, 2"""


def alias_resolution(spark, sf):
    k = F.col("event_id")
    where = review.resolve_alias(F.when(k % 4 == 0, "doc"), k % 3, (k % 5 == 0).cast("int"), F.lit(0))
    return T.table(spark, sf, "events").groupBy(where.alias("identity")).agg(F.count(F.lit(1)).alias("n"))


# --- intake ------------------------------------------------------------------------------------------


def _requests(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    url = F.when(k % 6 == 1, F.concat(F.lit("https://example.org/p?id="), k)).when(k % 6 == 2, "ftp://example.org").when(k % 6 == 3, "http://user:pw@example.org/")
    contact = F.when(k % 5 == 1, F.concat(F.lit(" User"), k, F.lit("@Example.org "))).when(k % 5 == 2, "nobody")
    return T.table(spark, sf, "part").select(k, F.when(k % 11 == 0, "ab").otherwise(F.col("p_name")).alias("title"), F.when(k % 13 == 0, "none").otherwise(F.col("p_type")).alias("notes"), url.alias("source_url"), contact.alias("contact"), F.concat(F.lit("2024-01-01T"), k).alias("created_at"), F.when(k % 19 == 0, "not_closed").alias("geometry_problem"))


def submission_intake(spark, sf):
    return intake.submissions(_requests(spark, sf)).select("p_partkey", "problem", "submission_id", "staged_id", "contact_hash", "status")


_SUBMISSIONS = """
WITH r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN 'ab' ELSE p_name END AS title, CASE WHEN p_partkey % 13 = 0 THEN 'none' ELSE p_type END AS notes FROM part),
c AS (SELECT *, CASE WHEN length(title) NOT BETWEEN 3 AND 200 THEN 'title_length' WHEN length(notes) NOT BETWEEN 5 AND 2000 THEN 'notes_length' WHEN k % 6 IN (2, 3) THEN 'source_link' WHEN k % 5 = 2 THEN 'contact' WHEN k % 19 = 0 THEN 'geometry' END AS problem,
 'submission-' || substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 1, 64) || '-' || substr(sha256(title || '|2024-01-01T' || k), 1, 10) AS own FROM r)
SELECT k AS p_partkey, problem, CASE WHEN problem IS NULL THEN own END AS submission_id, CASE WHEN problem IS NULL THEN 'stage-' || own END AS staged_id,
 CASE WHEN problem IS NULL AND k % 5 = 1 THEN sha256('user' || k || '@example.org') END AS contact_hash, CASE WHEN problem IS NULL THEN 'pending' ELSE 'rejected' END AS status FROM c"""


def submission_status_sync(spark, sf):
    sub = T.table(spark, sf, "customer").select(F.concat(F.lit("sub-"), "c_custkey").alias("submission_id"), F.lit("pending").alias("status"))
    p = review.projection(review.transitions(T.actions(spark, sf)))
    return intake.synced_status(sub, p.select(F.concat(F.lit("sub-"), F.substring_index("candidate_id", "-", -1)).alias("submission_id"), "review_status"))


def duplicates_ranked(spark, sf):
    return intake.ranked_duplicates(similarity.duplicate_candidates(*_sides(spark, sf))).select("staged_id", "public_id", "score", "rank")


def rejection_counts(spark, sf):
    k = F.col("event_id") % 7
    reason = F.element_at(F.array(*map(F.lit, (*intake.REASONS, "odd", ""))), (k + 1).cast("int"))
    return intake.rejection_counts(T.table(spark, sf, "events").select(reason.alias("reason")))


def client_addresses(spark, sf):
    """Chains behind trusted proxies of 10.0.0.0/8 and 192.168.1.0/24: untrusted peers, proxies in the middle, broken entries."""
    k = F.col("event_id")
    user = F.concat(F.lit("203.0.113."), (k % 200).cast("string"))
    peer = F.when(k % 4 == 0, F.concat(F.lit("198.51.100."), (k % 100).cast("string"))).otherwise("10.1.2.3")
    chain = F.when(k % 5 == 0, F.concat(F.lit("8.8.8.8, "), user, F.lit(" , 192.168.1.7"))).when(k % 5 == 1, F.concat(user, F.lit(", 192.168.2.7"))).when(k % 5 == 2, F.concat(F.lit("junk, "), user)).when(k % 5 == 3, F.concat(user, F.lit(", junk")))
    return T.table(spark, sf, "events").select("event_id", intake.client_address(peer, chain, [("10.0.0.0", 8), ("192.168.1.0", 24)]).alias("client"))


def source_health_public(spark, sf):
    e = F.col("event_id")
    raw = F.when(e % 3 == 0, -e).when(e % 3 == 1, e).otherwise(e + 2_000_000_000)
    ident = F.when(e % 2 == 0, F.concat(F.lit("scope:"), e)).otherwise(F.concat(F.lit("scope "), e))
    digest = F.when(e % 5 == 0, F.sha2(e.cast("string"), 256)).otherwise(F.upper(F.sha2(e.cast("string"), 256)))
    stamp = F.when(e % 7 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return T.table(spark, sf, "events").select("event_id", intake.public_count(raw).alias("raw"), intake.public_identifier(ident).alias("scope_id"), intake.public_digest(digest).alias("sha256"), intake.public_timestamp(stamp).alias("checked_at"), intake.one_of(F.col("event_type"), intake.COVERAGE, "unknown").alias("coverage"))


def health_for_output(spark, sf):
    sources = T.health_rows(spark, sf).select("key", F.lit("healthy").alias("status"))
    agenda = T.table(spark, sf, "region").where("r_regionkey = 1").select(F.lit("agenda").alias("key"), F.lit("failing").alias("status"))
    return intake.health_for_output(sources, agenda, "unknown")


def overlay_imports(spark, sf):
    n = F.col("n_nationkey")
    url = lambda k: F.concat(F.lit("http://layers/"), k)
    overlays = T.table(spark, sf, "nation").select(F.when(n % 6 != 5, F.col("n_name")).alias("layer_id"), url(n % 9).alias("source_url"))
    s = F.col("s_suppkey")
    health = T.table(spark, sf, "supplier").groupBy(url(s % 7).alias("source_url")).agg(F.max(s).alias("key"), F.count(F.lit(1)).alias("records_seen")).select("key", "source_url", F.when(F.col("key") % 4 == 0, "failing").otherwise("healthy").alias("status"), F.when(F.col("key") % 3 == 0, "complete").otherwise("strange").alias("coverage"), "records_seen")
    return intake.overlay_imports(overlays, health)


_OVERLAYS = """
WITH h AS (SELECT 'http://layers/' || (s_suppkey % 7) AS u, max(s_suppkey) AS k, count(*) AS n FROM supplier GROUP BY 1), o AS (SELECT CASE WHEN n_nationkey % 6 <> 5 THEN n_name END AS layer_id, 'http://layers/' || (n_nationkey % 9) AS u FROM nation)
SELECT layer_id, o.u AS source_url, CASE WHEN layer_id IS NULL THEN 'invalid_metadata' WHEN k % 4 = 0 THEN 'skipped' ELSE 'import' END AS outcome, CASE WHEN k % 3 = 0 THEN 'complete' ELSE 'unknown' END AS coverage, n AS expected FROM o LEFT JOIN h ON h.u = o.u"""


def scoped_attempts(spark, sf):
    c, s = F.col("c_custkey"), F.col("o_custkey")
    previous = T.table(spark, sf, "customer").select(F.concat(F.lit("k"), c).alias("key"), F.when(c % 2 == 0, "healthy").otherwise("failing").alias("status"), F.when(c % 3 == 0, "partial").alias("coverage"), F.lit("2023-01-01").alias("checked_at"), F.when(c % 5 == 0, "2022-06-01").alias("last_success_at"))
    reports_ = T.table(spark, sf, "orders").groupBy(F.concat(F.lit("k"), s * 2).alias("key"), s).agg(F.count(F.lit(1)).alias("fetched")).select("key", F.when(s % 3 == 0, "complete").otherwise("failed").alias("coverage"), F.lit("2024-01-01").alias("fetched_at"), "fetched", (s % 2).alias("rejected"), F.when(s % 7 == 0, "timeout").alias("error_code"))
    return intake.attempted(previous, reports_)


_ATTEMPTS = """
WITH p AS (SELECT 'k' || c_custkey AS key, c_custkey AS c FROM customer), r AS (SELECT 'k' || (o_custkey * 2) AS key, o_custkey AS s, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT coalesce(p.key, r.key) AS key, CASE WHEN s IS NULL THEN CASE WHEN c % 2 = 0 THEN 'healthy' ELSE 'failing' END WHEN s % 3 = 0 THEN 'staged' ELSE 'failing' END AS status, CASE WHEN c % 3 = 0 THEN 'partial' ELSE 'unknown' END AS coverage,
 CASE WHEN s % 3 = 0 THEN 'complete' WHEN s IS NOT NULL THEN 'failed' END AS attempt_coverage, CASE WHEN s IS NULL THEN '2023-01-01' ELSE '2024-01-01' END AS checked_at,
 CASE WHEN c % 5 = 0 THEN '2022-06-01' WHEN s IS NOT NULL AND c % 2 = 0 THEN '2023-01-01' END AS last_success_at, coalesce(n, 0) AS records_seen, CASE WHEN s % 7 = 0 OR s % 2 > 0 THEN 1 ELSE 0 END AS error_count FROM p FULL JOIN r ON p.key = r.key"""


def catalog_validation(spark, sf):
    """A catalog a region over its nations; some were changed after their digest was made, or are of another mode."""
    n = T.table(spark, sf, "nation")
    layer = F.struct(F.col("n_name").alias("layer"), F.when(F.col("n_nationkey") % 2 == 0, "ready").otherwise("pending").alias("delivery_status"), F.col("n_nationkey").alias("version"))
    catalogs = n.groupBy(F.col("n_regionkey").alias("catalog")).agg(F.collect_list(layer).alias("layers"))
    made = intake.catalog_revision(F.col("layers"))
    catalogs = catalogs.withColumn("data_mode", F.when(F.col("catalog") == 3, "demo").otherwise("live")).withColumn("revision", F.when(F.col("catalog") == 2, F.lit("0" * 64)).otherwise(made))
    return intake.validated_catalogs(catalogs, "live", F.when(F.col("catalog") == 0, F.col("revision")))


_CATALOGS = """
WITH r AS (SELECT n_regionkey AS catalog, sha256(string_agg(n_name || ':' || CASE WHEN n_nationkey % 2 = 0 THEN 'ready' ELSE 'pending' END || ':' || n_nationkey, chr(10) ORDER BY n_name)) AS revision FROM nation GROUP BY 1)
SELECT catalog, CASE WHEN catalog IN (2, 3) THEN 'unavailable' WHEN catalog = 0 THEN 'not_modified' ELSE 'ready' END AS availability, CASE WHEN catalog NOT IN (2, 3) THEN revision END AS etag FROM r"""


def finite_numbers(spark, sf):
    k = F.col("event_id")
    text = F.when(k % 6 == 0, "NaN").when(k % 6 == 1, F.concat(k, F.lit(".5"))).when(k % 6 == 2, "1e999").when(k % 6 == 3, F.concat(F.lit("-"), k, F.lit("e1"))).when(k % 6 == 4, "Infinity").otherwise(F.concat(F.lit("0"), k))
    return T.table(spark, sf, "events").select("event_id", intake.finite_number(text).alias("number"))


def version_digests(spark, sf):
    found = intake.version_digests(F.sha2(F.coalesce("html", F.lit("")), 256), F.col("url"), "spark-1")
    return T.table(spark, sf, "pages").select("page_id", *[c.alias(n) for n, c in found.items()])


_VERSION_DIGESTS = """WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS c, sha256(sha256(coalesce(html, '')) || chr(31) || url) AS d, sha256('display:spark-1') AS f FROM pages)
SELECT page_id, d AS data_version, f AS config_hash, sha256(d || chr(31) || c || chr(31) || f) AS display_version FROM p"""


# --- audits ------------------------------------------------------------------------------------------


def artifact_references(spark, sf):
    """Lines refer to parts' blobs, which suppliers copy."""
    key = lambda k: F.concat(F.lit("blob-"), k)
    p = F.col("p_partkey")
    blobs = T.table(spark, sf, "part").where("p_partkey % 10 <> 9").select(key(p).alias("blob_key"), F.sha2(p.cast("string"), 256).alias("sha256"), F.col("p_size").cast("long").alias("bytes"))
    l = T.table(spark, sf, "lineitem")  # noqa: E741
    copies = l.where("l_partkey % 7 <> 0").select(key(F.col("l_partkey")).alias("blob_key"), F.col("l_suppkey").alias("sink_id"), F.when(F.col("l_linenumber") % 2 == 0, "verified").otherwise("leased").alias("state"))
    references = T.table(spark, sf, "part").select(F.concat(F.lit("ref-"), p).alias("reference_id"), key(p).alias("blob_key"), F.sha2(F.when(p % 8 == 0, "x").otherwise(p.cast("string")), 256).alias("sha256"))
    return audits.reference_problems(references, copies, blobs)


_REFERENCES = """
WITH c AS (SELECT l_partkey AS k, count(*) FILTER (l_linenumber % 2 = 0) AS v FROM lineitem WHERE l_partkey % 7 <> 0 GROUP BY 1)
SELECT 'ref-' || p_partkey AS reference_id, 'blob-' || p_partkey AS blob_key, coalesce(v, 0) AS verified_copies, CASE WHEN p_partkey % 10 <> 9 THEN p_size::BIGINT END AS bytes,
 CASE WHEN p_partkey % 10 = 9 THEN 'unknown_blob' WHEN p_partkey % 8 = 0 THEN 'digest_mismatch' WHEN c.k IS NULL THEN 'no_copy' WHEN v = 0 THEN 'unverified' END AS problem FROM part LEFT JOIN c ON c.k = p_partkey"""


def observation_proofs(spark, sf):
    """Runs are orders, pages their lines."""
    pages = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("page_no"), F.concat_ws("/", "l_partkey", "l_suppkey").alias("sha256"))
    runs = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 5 + 1).alias("expected_pages"))
    return audits.page_proofs(runs, pages)


_PROOFS = """
WITH g AS (SELECT l_orderkey AS k, count(*) AS n, count(DISTINCT l_linenumber) AS d, min(l_linenumber) AS lo, max(l_linenumber) AS hi, sha256(sha256(string_agg(l_linenumber || ':' || l_partkey || '/' || l_suppkey, chr(10) ORDER BY l_linenumber, l_partkey || '/' || l_suppkey))) AS digest FROM lineitem GROUP BY 1),
s AS (SELECT o_orderkey AS run_id, coalesce(n, 0) AS pages, CASE WHEN n IS NULL THEN 'no_pages' WHEN d < n THEN 'repeated_page' WHEN n = o_orderkey % 5 + 1 AND lo = 1 AND hi = n THEN 'complete' ELSE 'wrong_pages' END AS state, digest FROM orders LEFT JOIN g ON g.k = o_orderkey)
SELECT run_id, pages, state, CASE WHEN state = 'complete' THEN digest END AS proof FROM s"""


def attestation_gate(spark, sf):
    k = F.col("p_partkey")
    layer = lambda: F.concat(F.lit("layer-"), k)
    layers = T.table(spark, sf, "part").select(layer().alias("layer_id"), F.col("p_type").alias("data_version"), F.col("p_brand").alias("input_checksum"))
    version, checksum = F.when(k % 4 == 0, "old").otherwise(F.col("p_type")), F.when(k % 5 == 0, "old").otherwise(F.col("p_brand"))
    digest = F.when(k % 6 == 0, "0").otherwise(S.fingerprint(layer(), version, checksum))
    return audits.attestation_gate(layers, T.table(spark, sf, "part").where("p_partkey % 3 <> 0").select(layer().alias("layer_id"), version.alias("data_version"), checksum.alias("input_checksum"), digest.alias("digest")))


def display_checkpoint(spark, sf):
    """The display build against itself built anew, with a tampered count: nothing else differs."""
    keep = ["feature_id", "band", "tolerance", "vertices", "part_count", "error_code"]
    built = reports.display_build(_ring_features(spark, sf), 128).select(*keep)
    odd = F.when((F.col("feature_id") == "f1") & (F.col("band") == "z08_10"), F.col("part_count") + 1).otherwise(F.col("part_count"))
    return audits.build_differences(built.withColumn("part_count", odd), reports.display_build(_ring_features(spark, sf), 128).select(*keep), ["feature_id", "band"])


_CHECKPOINT = "SELECT band, count(*) AS rows, 0::BIGINT AS lacking, 0::BIGINT AS added, count(*) FILTER (s_suppkey = 1 AND band = 'z08_10') AS changed FROM supplier, (VALUES ('z08_10'), ('z11_12'), ('z13_14'), ('z15_16'), ('z17_18')) b(band) GROUP BY 1"


def display_stale_inputs(spark, sf):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("f"), k)
    s = T.table(spark, sf, "supplier")
    results = s.select(name.alias("feature_id"), S.fingerprint(F.when(k % 4 == 0, "old").otherwise(F.col("s_name"))).alias("input_digest"))
    return audits.stale_inputs(results, s.where("s_suppkey % 9 <> 0").select(name.alias("feature_id"), F.col("s_name").alias("content")))


def import_reason_report(spark, sf):
    l = T.table(spark, sf, "lineitem")  # noqa: E741
    rows = l.select(F.when(F.col("l_quantity") > 45, "too_large").when(F.col("l_returnflag") == "R", "returned").otherwise("late").alias("reason"), F.concat_ws("-", F.lpad("l_orderkey", 9, "0"), "l_linenumber", F.lpad("l_partkey", 7, "0")).alias("source_id"))
    return audits.reason_report(rows).select("reason", "n", F.array_join("samples", ",").alias("samples"))


_REASONS = """WITH r AS (SELECT CASE WHEN l_quantity > 45 THEN 'too_large' WHEN l_returnflag = 'R' THEN 'returned' ELSE 'late' END AS reason, lpad(l_orderkey::VARCHAR, 9, '0') || '-' || l_linenumber || '-' || lpad(l_partkey::VARCHAR, 7, '0') AS id FROM lineitem)
SELECT reason, count(*) AS n, array_to_string(list_sort(list(id))[1:25], ',') AS samples FROM r GROUP BY 1"""


def import_bounds(spark, sf):
    f = T.features(spark, sf).withColumn("box", F.struct("w", "s", "e", "n"))
    return audits.bounds(f.select("category", "box"), "box", "category")


def backfill_apply(spark, sf):
    """The mapping of a dry run without diagnostics: records with usable and distinct anchors."""
    from landsift.operators import merge

    k = F.col("rec_key")
    r = T.records(spark, sf)
    made = r.select("public_id", F.when(k % 10 != 0, F.concat(F.lit("s"), k % 3)).alias("source_key"), k.cast("string").alias("record_id"), F.col("date_discovered").alias("discovered_on"))
    known = r.where(k % 4 == 0).select(F.concat(F.lit("s"), k % 3).alias("source_key"), k.cast("string").alias("record_id"), "public_id")
    report = merge.backfill_report(made, known)
    digest = merge.report_digest(report).first()["digest"]
    return audits.apply_backfill(report, digest, digest)


def import_options(spark, sf):
    k = F.col("p_partkey")
    problem = audits.import_option_problem(F.when(k % 7 != 0, F.col("p_name")), F.when(k % 6 == 0, "").otherwise(F.col("p_type")), F.when(k % 5 == 0, "odd").otherwise("complete"), F.when(k % 4 == 0, -1).otherwise(3), F.when(k % 9 == 0, 0).otherwise(F.col("p_size")))
    return T.table(spark, sf, "part").select("p_partkey", problem.alias("problem"))


def new_layer_rows(spark, sf):
    row = audits.layer_row(F.col("n_name"), F.sha2("n_name", 256), F.col("n_nationkey").cast("string"))
    return T.table(spark, sf, "nation").select(row.alias("r")).select("r.*")


def sink_identities(spark, sf):
    return T.table(spark, sf, "nation").select("n_name", S.fingerprint(F.col("n_name"), F.col("n_regionkey")).alias("sink_id"))


# --- geometry and records ------------------------------------------------------------------------------


def watch_topology(spark, sf):
    """Watch polygons that are sound or broken by key: holes outside, crossing, or in each other; too large."""
    kind = (F.col("rec_key") % 6).alias("k")
    records = T.records(spark, sf).select("public_id", F.struct(kind, "w", "s", "e", "n").alias("shape"))
    k = F.col("shape.k")
    w, s, e, n = (T.degrees(F.col(f"shape.{c}")) for c in "wsen")
    d = (e - w) / 10
    ring = lambda a, b: G.box_ring(w + a * d, s + a * d, w + b * d, s + b * d)
    shell = ring(F.lit(0.0), F.lit(10.0))
    rings = (
        F.when(k == 0, F.array(shell, ring(F.lit(2.0), F.lit(4.0)), ring(F.lit(5.0), F.lit(8.0))))
        .when(k == 1, F.array(shell, ring(F.lit(12.0), F.lit(14.0))))
        .when(k == 2, F.array(shell, ring(F.lit(8.0), F.lit(12.0))))
        .when(k == 3, F.array(shell, ring(F.lit(2.0), F.lit(8.0)), ring(F.lit(3.0), F.lit(5.0))))
        .when(k == 4, F.array(G.box_ring(w, s, w + 1, s + 1)))
        .otherwise(F.array(F.slice(shell, 1, 4)))
    )
    # once for all copies of a polygon; its rings are a column, as an expression would be built anew wherever a check names it
    problems = records.select("shape").distinct().select("shape", rings.alias("rings")).select("shape", G.polygon_problem(F.col("rings"), 2500.0).alias("problem"))
    return records.join(problems, "shape").select("public_id", "problem")


_TOPOLOGY = f"{T.with_sql('records')} SELECT public_id, CASE rec_key % 6 WHEN 1 THEN 'hole_outside' WHEN 2 THEN 'rings_cross' WHEN 3 THEN 'holes_nest' WHEN 4 THEN 'too_large' WHEN 5 THEN 'not_closed' END AS problem FROM records"


def geometry_classes(spark, sf):
    """Points and polygons of the normalized collections apart."""
    k = F.col("rec_key")
    kind = F.when(k % 3 == 1, '{"type":"Point","coordinates":[1,2]}').otherwise('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}')
    g = G.from_geojson(kind)
    return T.records(spark, sf).groupBy(G.geometry_class(g).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def exact_geometry(spark, sf):
    """Which boxes are those of the feature with the record's number, coordinate by coordinate."""
    r = T.records(spark, sf).select("rec_key", T.square().alias("a"))
    shifted = T.records(spark, sf).select(F.col("rec_key").alias("k"), F.when(F.col("rec_key") % 3 == 0, T.square()).otherwise(T.triangle()).alias("b"))
    return r.join(shifted, F.col("rec_key") == F.col("k")).select("rec_key", G.same_geometry(F.col("a"), F.col("b")).alias("same"))


def ring_assembly(spark, sf):
    """Three nested boxes and one beside them a supplier: shell, hole, shell within, shell."""
    k = F.col("s_suppkey")
    x = (k * 100).cast("double")
    box = lambda a, b: G.box_ring(x + a, F.lit(float(a)), x + b, F.lit(float(b)))
    rings = F.array(box(0, 40), box(10, 30), box(15, 20), box(50, 60))
    flat = T.table(spark, sf, "supplier").select(k.alias("feature_id"), F.posexplode(rings).alias("ring_no", "ring"))
    return spatial.assemble_rings(flat).select("feature_id", "ring_no", "depth", "role", "shell_no")


def extent_checks(spark, sf):
    k = F.col("rec_key")
    box = F.struct((F.col("w") * F.when(k % 4 == 0, 10.0).otherwise(0.1)).alias("w"), F.col("s").alias("s"), F.when(k % 5 == 0, float("nan")).otherwise(F.col("e").cast("double") * 0.1).alias("e"), (F.col("n") / 2).alias("n"))
    small = F.transform(F.array(box["w"], box["s"], box["e"], box["n"]), lambda v: v / 10)
    ok = M.extent_ok(F.struct(small[0].alias("w"), small[1].alias("s"), small[2].alias("e"), small[3].alias("n")))
    return T.records(spark, sf).select("public_id", ok.alias("ok"))


def emails(spark, sf):
    c = F.col("c_custkey")
    text = F.when(c % 3 == 0, F.concat(F.lit("  "), "c_name", F.lit("@Example.ORG "))).when(c % 3 == 1, F.concat(F.regexp_replace("c_name", "[^A-Za-z0-9]", ""), F.lit("@x.y"))).otherwise(F.concat(F.col("c_name"), F.lit(" at x")))
    return T.table(spark, sf, "customer").select("c_custkey", S.normalized_email(text).alias("email"))


def filter_pairs(spark, sf):
    """Filters as query pairs for each nation's choice of them."""
    some = {"status": ["final", "layout"], "flag": [], "kind": None}
    pairs = filters.serialise(some)
    text = "&".join(f"{k}={v}" for k, v in pairs)
    return T.table(spark, sf, "nation").select("n_name", F.concat(F.lit("?"), F.lit(text), F.lit("&nation="), F.col("n_nationkey")).alias("query"))


def watch_filter_checks(spark, sf):
    k = F.col("n_nationkey")
    statuses = F.when(k % 4 == 0, F.array(F.lit("odd"))).when(k % 4 == 1, F.array_repeat(F.lit("final"), 17)).when(k % 4 == 2, F.array(F.lit("final")))
    types = F.when(k % 5 == 3, F.array(F.lit("odd")))
    return T.table(spark, sf, "nation").select("n_name", filters.watch_filter_problem(statuses, types).alias("problem"))


def screening_eligibility(spark, sf):
    r = T.records(spark, sf).withColumn("geom", F.when(F.col("rec_key") % 5 != 0, T.square()))
    return filters.eligible_for_screening(r).select("public_id")


def feature_ids(spark, sf):
    k = F.col("s_suppkey")
    props = F.when(k % 3 == 0, F.create_map(F.lit("OBJECTID"), k.cast("string"))).when(k % 3 == 1, F.create_map(F.lit("FID"), F.concat(F.lit("f"), k), F.lit("WETLAND_ID"), F.lit("w"))).otherwise(F.create_map(F.lit("WETLAND_ID"), F.concat(F.lit("w"), k)))
    return T.table(spark, sf, "supplier").withColumn("properties", props).select("s_suppkey", normalize.feature_id().alias("feature_id"))


def property_guard(spark, sf):
    k = F.col("p_partkey")
    props = F.when(k % 4 == 0, F.lit(None)).otherwise(F.create_map(F.lit("Status"), F.when(k % 4 == 1, "  ").when(k % 4 == 2, F.concat(F.lit(" "), "p_brand", F.lit(" ")))))
    features = T.table(spark, sf, "part").withColumn("properties", props.cast("map<string,string>"))
    return normalize.texts(features, "Status").select("p_partkey", normalize.prop("Status").alias("status"))


def item_ids(spark, sf):
    k = F.col("c_custkey")
    own = tables.item_id([F.when(k % 3 == 0, F.col("c_name")), F.when(k % 3 == 1, "").otherwise(F.repeat("c_mktsegment", 40))], k)
    return T.table(spark, sf, "customer").select("c_custkey", own.alias("id"))


def lease_claims(spark, sf):
    k = F.col("event_id")
    state = F.element_at(F.array(*map(F.lit, ("reserved", "leased", "uploaded", "verified", "retry"))), (k % 5 + 1).cast("int"))
    now = F.lit(1000)
    free = review.claimable(state, F.when(k % 3 == 0, F.lit(2000)).when(k % 3 == 1, F.lit(500)), F.when(k % 4 == 0, F.lit(1500)), now)
    return T.table(spark, sf, "events").select("event_id", free.alias("claimable"))


def alert_messages(spark, sf):
    text = review.message(F.concat(F.lit("Alert for "), F.col("c_name")), F.concat(F.lit("Balance "), F.floor("c_acctbal").cast("string")), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("http://x/"), "c_custkey")))
    return T.table(spark, sf, "customer").select("c_custkey", text.alias("message"))


def map_override(spark, sf):
    c = T.table(spark, sf, "customer")
    old = c.where("c_custkey % 2 = 0").select("c_custkey", F.lit("old").alias("state"))
    new = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("state"))
    return tables.override(old, new, "c_custkey")


def url_categories(spark, sf):
    k = F.col("event_id")
    path = F.when(k % 4 == 0, "/api/records").when(k % 4 == 1, "/tiles/1/2/3.pbf").when(k % 4 == 2, "/Basemap/x.png").otherwise("/app.js")
    return T.table(spark, sf, "events").groupBy(S.url_category(path).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def retry_delays(spark, sf):
    k = F.col("event_id")
    delay = S.retry_delay((k % 7).cast("double"), F.when(k % 3 == 0, (k % 20 - 5).cast("double")))
    return T.table(spark, sf, "events").select("event_id", delay.alias("seconds"), S.is_retryable(F.lpad((k % 60000).cast("string"), 5, "0")).alias("retryable"))


def page_reports(spark, sf):
    """Staged features in pages of a thousand orders."""
    o = T.table(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / 1000).alias("page"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("id"), "o_orderstatus")
    return C.page_report(o, F.col("o_orderstatus") != "F")


_PAGES = "SELECT o_orderkey // 1000 AS page, count(*) AS seen, count(*) FILTER (o_orderstatus <> 'F') AS accepted, count(*) FILTER (o_orderstatus = 'F') AS rejected, count(DISTINCT o_orderkey) = count(*) AS unique_ids, sha256(string_agg(o_orderkey::VARCHAR, chr(10) ORDER BY o_orderkey::VARCHAR)) AS sha256 FROM orders GROUP BY 1"


def pages_out_of_order(spark, sf):
    """Lines whose part's number doesn't rise over their predecessor's in an order."""
    l = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice").alias("pos"), "l_partkey")  # noqa: E741
    return C.out_of_order(l, "l_partkey").groupBy("page").agg(F.count(F.lit(1)).alias("n"))


def schema_drifts(spark, sf):
    """What the tables lack of an expected schema."""
    from pyspark.sql import types as Ty

    expected = Ty.StructType([Ty.StructField("n_name", Ty.StringType()), Ty.StructField("n_nationkey", Ty.StringType()), Ty.StructField("n_area", Ty.DoubleType())])
    found = C.schema_drift(T.table(spark, sf, "nation").schema, expected)
    return spark.createDataFrame([(x,) for x in found], "problem string")


def flag_types(spark, sf):
    """The distinct event types, in order, of each user."""
    return T.table(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))


QUERIES = {
    "agenda_document_merge": (agenda_document_merge, _DOCUMENT_MERGE),
    "agenda_candidate_merge": (agenda_candidate_merge, _CANDIDATE_MERGE),
    "agenda_batch_context": (agenda_batch_context, _BATCH),
    "agenda_unresolved": (agenda_unresolved, "SELECT 'observation' AS kind, 'o' || c_custkey AS id, c_custkey % 4 + 1 AS observation_revision FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'document', 'd' || s_suppkey, 1 FROM supplier WHERE s_suppkey % 3 = 0"),
    "agenda_resolution": (agenda_resolution, _RESOLUTION),
    "agenda_identity_health": (agenda_identity_health, _IDENTITY_HEALTH),
    "agenda_last_success": (agenda_last_success, "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') WHEN event_id % 3 = 0 THEN '2020-01-01' WHEN event_id % 5 = 0 THEN '2021-01-01' END AS last_success_at FROM events"),
    "system_suggestions": (system_suggestions, "SELECT p_partkey, p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AS own FROM part"),
    "staged_published_quarantine": (staged_published_quarantine, _QUARANTINE),
    "alias_resolution": (alias_resolution, "SELECT CASE WHEN event_id % 4 = 0 THEN 'existing' WHEN event_id % 3 > 0 OR event_id % 5 = 0 THEN 'ambiguous' ELSE 'new' END AS identity, count(*) AS n FROM events GROUP BY 1"),
    "submission_intake": (submission_intake, _SUBMISSIONS),
    "submission_status_sync": (submission_status_sync, f"{T.with_sql('actions')}, t AS (SELECT *, min(CASE WHEN action IN ('approved', 'rejected') THEN ts END) OVER (PARTITION BY candidate_id) AS stop FROM actions), p AS (SELECT candidate_id, arg_max(action, (ts, event_id)) AS s FROM t WHERE stop IS NULL OR ts <= stop GROUP BY 1) SELECT 'sub-' || c_custkey AS submission_id, coalesce(s, 'pending') AS status FROM customer LEFT JOIN p ON candidate_id = 'cand-' || c_custkey"),
    "duplicates_ranked": (duplicates_ranked, f"SELECT staged_id, public_id, score, row_number() OVER (PARTITION BY staged_id ORDER BY score DESC, public_id)::INTEGER AS rank FROM ({_DUPLICATES})"),
    "rejection_counts": (rejection_counts, "SELECT CASE event_id % 7 WHEN 1 THEN 'invalid_geometry' WHEN 2 THEN 'quota_exceeded' WHEN 3 THEN 'payload_too_large' WHEN 4 THEN 'unsupported_media_type' ELSE 'invalid_request' END AS reason, count(*) AS n FROM events GROUP BY 1"),
    "client_addresses": (client_addresses, "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '198.51.100.' || (event_id % 100) WHEN event_id % 5 IN (0, 2) THEN '203.0.113.' || (event_id % 200) WHEN event_id % 5 = 1 THEN '192.168.2.7' ELSE '10.1.2.3' END AS client FROM events"),
    "source_health_public": (source_health_public, "SELECT event_id, CASE WHEN event_id % 3 = 1 OR event_id = 0 THEN event_id END AS raw, CASE WHEN event_id % 2 = 0 THEN 'scope:' || event_id END AS scope_id, CASE WHEN event_id % 5 = 0 THEN sha256(event_id::VARCHAR) END AS sha256, CASE WHEN event_id % 7 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS checked_at, 'unknown' AS coverage FROM events"),
    "health_for_output": (health_for_output, "SELECT key, status, 'degraded' AS overall FROM (SELECT DISTINCT event_type AS key, 'healthy' AS status FROM events UNION ALL SELECT 'agenda', 'failing')"),
    "overlay_imports": (overlay_imports, _OVERLAYS),
    "scoped_attempts": (scoped_attempts, _ATTEMPTS),
    "catalog_validation": (catalog_validation, _CATALOGS),
    "finite_numbers": (finite_numbers, "SELECT event_id, CASE event_id % 6 WHEN 1 THEN event_id + 0.5::DOUBLE WHEN 3 THEN -10.0::DOUBLE * event_id END AS number FROM events"),
    "version_digests": (version_digests, _VERSION_DIGESTS),
    "artifact_references": (artifact_references, _REFERENCES),
    "observation_proofs": (observation_proofs, _PROOFS),
    "attestation_gate": (attestation_gate, "SELECT 'layer-' || p_partkey AS layer_id, CASE WHEN p_partkey % 3 = 0 THEN 'not_attested' WHEN p_partkey % 6 = 0 THEN 'attestation_changed' WHEN p_partkey % 4 = 0 THEN 'version_changed' WHEN p_partkey % 5 = 0 THEN 'input_changed' ELSE 'open' END AS gate FROM part"),
    "display_checkpoint": (display_checkpoint, _CHECKPOINT),
    "display_stale_inputs": (display_stale_inputs, "SELECT 'f' || s_suppkey AS feature_id, CASE WHEN s_suppkey % 9 = 0 THEN 'gone' ELSE 'changed' END AS problem FROM supplier WHERE s_suppkey % 9 = 0 OR s_suppkey % 4 = 0"),
    "import_reason_report": (import_reason_report, _REASONS),
    "import_bounds": (import_bounds, f"{T.with_sql('features')} SELECT category, min(w) AS w, min(s) AS s, max(e) AS e, max(n) AS n FROM features GROUP BY 1"),
    "backfill_apply": (backfill_apply, "SELECT 's' || (o_orderkey % 3) AS source_key, o_orderkey::VARCHAR AS record_id, 'rec-' || o_orderkey AS public_id FROM orders WHERE o_orderkey % 10 <> 0"),
    "import_options": (import_options, "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'layer_id' WHEN p_partkey % 6 = 0 THEN 'scope_id' WHEN p_partkey % 5 = 0 THEN 'coverage' WHEN p_partkey % 4 = 0 THEN 'expected_count' WHEN p_partkey % 9 = 0 OR p_size < 1 THEN 'batch_size' END AS problem FROM part"),
    "new_layer_rows": (new_layer_rows, "SELECT n_name AS layer_id, sha256(n_name) AS checksum, n_nationkey::VARCHAR AS data_version, 'importing' AS status, 0::BIGINT AS seen, 0::BIGINT AS accepted, 0::BIGINT AS rejected, 0::BIGINT AS duplicate FROM nation"),
    "sink_identities": (sink_identities, "SELECT n_name, sha256(n_name || chr(31) || n_regionkey) AS sink_id FROM nation"),
    "watch_topology": (watch_topology, _TOPOLOGY),
    "geometry_classes": (geometry_classes, "SELECT CASE WHEN o_orderkey % 3 = 1 THEN 'point' ELSE 'polygon' END AS class, count(*) AS n FROM orders GROUP BY 1"),
    "exact_geometry": (exact_geometry, "SELECT o_orderkey AS rec_key, o_orderkey % 3 = 0 AS same FROM orders"),
    "ring_assembly": (ring_assembly, "SELECT s_suppkey AS feature_id, r AS ring_no, CASE r WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END::BIGINT AS depth, CASE r WHEN 1 THEN 'hole' ELSE 'shell' END AS role, CASE r WHEN 1 THEN 0 END AS shell_no FROM supplier, (VALUES (0), (1), (2), (3)) v(r)"),
    "extent_checks": (extent_checks, "SELECT 'rec-' || o_orderkey AS public_id, o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0 AS ok FROM orders"),
    "emails": (emails, "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN CASE WHEN NOT regexp_matches(c_name, '\\s') THEN lower(c_name) || '@example.org' END WHEN 1 THEN lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) || '@x.y' END AS email FROM customer"),
    "filter_pairs": (filter_pairs, "SELECT n_name, '?status=final&status=layout&flag=none&nation=' || n_nationkey AS query FROM nation"),
    "watch_filter_checks": (watch_filter_checks, "SELECT n_name, CASE WHEN n_nationkey % 4 = 0 THEN 'unknown_status' WHEN n_nationkey % 5 = 3 THEN 'unknown_type' WHEN n_nationkey % 4 = 1 THEN 'too_many' END AS problem FROM nation"),
    "screening_eligibility": (screening_eligibility, "SELECT 'rec-' || o_orderkey AS public_id FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0"),
    "feature_ids": (feature_ids, "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'f' ELSE 'w' END || s_suppkey AS feature_id FROM supplier"),
    "property_guard": (property_guard, "SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN p_brand END AS status FROM part"),
    "item_ids": (item_ids, "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_custkey::VARCHAR ELSE substr(repeat(c_mktsegment, 40), 1, 255) END AS id FROM customer"),
    "lease_claims": (lease_claims, "SELECT event_id, event_id % 5 IN (0, 1, 4) AND event_id % 3 <> 0 AND event_id % 4 <> 0 AS claimable FROM events"),
    "alert_messages": (alert_messages, "SELECT c_custkey, 'Alert for ' || c_name || chr(10) || chr(10) || 'Balance ' || floor(c_acctbal)::BIGINT || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || 'http://x/' || c_custkey ELSE '' END AS message FROM customer"),
    "map_override": (map_override, "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0"),
    "url_categories": (url_categories, "SELECT CASE event_id % 4 WHEN 0 THEN 'data' WHEN 3 THEN 'assets' ELSE 'basemap' END AS category, count(*) AS n FROM events GROUP BY 1"),
    "retry_delays": (retry_delays, "SELECT event_id, least(5, CASE WHEN event_id % 3 = 0 THEN greatest(event_id % 20 - 5, 0) ELSE 0.25 * power(2, event_id % 7) END)::DOUBLE AS seconds, regexp_matches(lpad((event_id % 60000)::VARCHAR, 5, '0'), '^(08|40|53|54|57|58|72|F0)') AS retryable FROM events"),
    "page_reports": (page_reports, _PAGES),
    "pages_out_of_order": (pages_out_of_order, "WITH l AS (SELECT l_orderkey AS page, l_partkey, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS b FROM lineitem) SELECT page, count(*) AS n FROM l WHERE b >= l_partkey GROUP BY 1"),
    "schema_drifts": (schema_drifts, "SELECT unnest(['n_nationkey: int, expected string', 'n_area: missing, expected double']) AS problem"),
    "flag_types": (flag_types, "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types FROM events GROUP BY 1"),
}
