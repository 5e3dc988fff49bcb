"""Public intake and health for output: submissions, client addresses, rejection counts, sanitized health, catalogs."""

from __future__ import annotations

import ipaddress

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

from landsift.functions.addresses import address_text, let, within, words
from landsift.functions.scalars import contact_hash, fingerprint, hmac_sha256, normalized_email, public_url, stable_id

# What public rows may say.
COVERAGE = ("complete", "partial", "failed", "unknown")
REASONS = ("invalid_request", "invalid_geometry", "quota_exceeded", "payload_too_large", "unsupported_media_type")
TITLE, NOTES, MOST_URL, MOST_CONTACT, MOST_COUNT = (3, 200), (5, 2000), 1000, 255, 1_000_000_000


def submission_problem(title: Column, notes: Column, url: Column, contact: Column, geometry_problem: Column) -> Column:
    """Null for a submission that may be taken in, else the first thing wrong with it."""
    within = lambda c, ends: F.char_length(F.coalesce(c, F.lit(""))).between(*ends)
    link = (F.char_length(url) <= MOST_URL) & public_url(url).isNotNull()
    return (
        F.when(~within(title, TITLE), "title_length")
        .when(~within(notes, NOTES), "notes_length")
        .when(url.isNotNull() & ~F.coalesce(link, F.lit(False)), "source_link")
        .when(contact.isNotNull() & ((F.char_length(contact) > MOST_CONTACT) | normalized_email(contact).isNull()), "contact")
        .when(geometry_problem.isNotNull(), "geometry")
    )


def submissions(requests: DataFrame) -> DataFrame:
    """Requests (title, notes, source_url, contact, created_at, geometry_problem) with their problem; the sound ones with ids, staged id, contact hash and status."""
    problem = submission_problem(*(F.col(c) for c in ("title", "notes", "source_url", "contact", "geometry_problem")))
    sound = lambda c: F.when(F.col("problem").isNull(), c)
    own = stable_id("submission", F.col("title"), F.col("created_at"))
    rows = requests.withColumn("problem", problem)
    return rows.withColumns({"submission_id": sound(own), "staged_id": sound(F.concat(F.lit("stage-"), own)), "contact_hash": sound(contact_hash(normalized_email(F.col("contact")))), "status": F.coalesce(sound(F.lit("pending")), F.lit("rejected"))})


def synced_status(submitted: DataFrame, staged: DataFrame) -> DataFrame:
    """Submissions (submission_id, status) with the decision on their staged row (submission_id, review_status), where there is one."""
    return submitted.join(staged.select("submission_id", "review_status"), "submission_id", "left").withColumn("status", F.coalesce("review_status", "status")).drop("review_status")


def ranked_duplicates(found: DataFrame) -> DataFrame:
    """Duplicate candidates of each staged row numbered by score, highest first; ties by public id."""
    return found.withColumn("rank", F.row_number().over(W.partitionBy("staged_id").orderBy(F.desc("score"), "public_id")))


def rejection_counts(reasons: DataFrame) -> DataFrame:
    """Rejections by reason; what isn't a known reason counts as invalid_request."""
    known = F.when(F.col("reason").isin(*REASONS), F.col("reason")).otherwise("invalid_request")
    return reasons.groupBy(known.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def client_address(peer: Column, forwarded: Column, trusted: list[tuple[str, int]], most: int = 2048) -> Column:
    """Who asks: the peer, or, while the nearest address is a trusted proxy (network, prefix bits), the next one of the chain from its right end.

    Addresses are IPv4, IPv6 or mapped, and told in their normal text. A chain that is too long or holds what isn't an address is not
    believed. A peer that isn't an address is 0.0.0.0.
    """
    networks = [ipaddress.ip_network(f"{network}/{bits}") for network, bits in trusted]

    def is_trusted(address: Column) -> Column:
        out = F.lit(False)
        for network in networks:
            out = out | within(address, network)
        return out

    def told(own: Column) -> Column:
        chain = F.transform(F.reverse(F.split(forwarded, ",")), words)
        start = F.struct(own.alias("now"), F.lit(False).alias("stopped"), F.lit(False).alias("broken"))

        def step(acc: Column, next_: Column) -> Column:
            stop = acc["stopped"] | ~is_trusted(acc["now"])
            bad = ~stop & next_.isNull()
            return F.struct(F.when(stop | bad, acc["now"]).otherwise(next_).alias("now"), (stop | bad).alias("stopped"), (acc["broken"] | bad).alias("broken"))

        believed = F.when(F.char_length(forwarded) <= most, F.aggregate(chain, start, step))
        return let(believed, lambda b: F.when(b.isNull() | b["broken"], own).otherwise(b["now"]))

    own = F.coalesce(words(peer), F.array(F.lit(0), F.lit(0)))
    return address_text(let(own, told))


def client_key(secret: bytes, at: Column, route: Column, address: Column) -> Column:
    """What a quota counts by: an HMAC of the hour (UTC), the route and the address, so that no address is stored.

    The session's time zone must be UTC. The secret has 32 bytes at least; it is part of the plan's text.
    """
    if len(secret) < 32:
        raise ValueError("the secret is too short")
    hour = F.date_format(F.date_trunc("hour", at), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return hmac_sha256(secret, F.concat_ws("|", hour, route, address))


def public_count(value: Column) -> Column:
    return F.when(value.between(0, MOST_COUNT), value)


def public_identifier(value: Column, limit: int = 160) -> Column:
    return F.when((F.char_length(value) <= limit) & value.rlike(r"^[A-Za-z0-9._:-]+$"), value)


def public_digest(value: Column) -> Column:
    return F.when(value.rlike("^[0-9a-f]{64}$"), value)


def public_timestamp(value: Column) -> Column:
    return F.when((F.char_length(value) <= 64) & F.try_to_timestamp(value).isNotNull(), value)


def one_of(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(default)


def health_for_output(sources: DataFrame, agenda: DataFrame, status: str) -> DataFrame:
    """Source rows (key, status) and the agenda's, with the overall status: degraded by a failing agenda, healthy where it was unknown."""
    rows = sources.select("key", "status").unionByName(agenda.select("key", "status"))
    failing = agenda.agg(F.count(F.lit(1)).alias("there_"), F.count_if(F.col("status") == "failing").alias("failing_"))
    overall = F.when(F.col("failing_") > 0, "degraded").when((F.col("there_") > 0) & (F.lit(status) == "unknown"), "healthy").otherwise(status)
    return rows.crossJoin(F.broadcast(failing)).select("key", "status", overall.alias("overall"))  # one row


def overlay_imports(overlays: DataFrame, health: DataFrame) -> DataFrame:
    """Overlays (layer_id, source_url) with their source's coverage and expected count; failed for a source that is failing or a layer without an id."""
    h = health.where(F.col("source_url").isNotNull()).groupBy("source_url").agg(F.max_by(F.struct("status", "coverage", "records_seen"), "key").alias("h_"))
    outcome = F.when(F.col("layer_id").isNull(), "invalid_metadata").when(F.col("h_.status") == "failing", "skipped").otherwise("import")
    return overlays.join(h, "source_url", "left").select("layer_id", "source_url", outcome.alias("outcome"), one_of(F.col("h_.coverage"), COVERAGE, "unknown").alias("coverage"), public_count(F.col("h_.records_seen")).alias("expected"))


def attempted(previous: DataFrame, reports: DataFrame) -> DataFrame:
    """Health rows after an attempt (key, coverage, fetched_at, fetched, rejected, error_code): what was published before stays, the attempt is told beside it."""
    p = previous.select("key", F.struct("status", "coverage", "checked_at", "last_success_at").alias("p_"))
    r = reports.select("key", F.struct("coverage", "fetched_at", "fetched", "rejected", "error_code").alias("r_"))
    new = F.col("r_").isNotNull()
    success = F.coalesce("p_.last_success_at", F.when(F.col("p_.status") == "healthy", F.col("p_.checked_at")))
    wrong = (F.col("r_.error_code").isNotNull() | (F.coalesce("r_.rejected", F.lit(0)) > 0)).cast("int")
    return p.join(r, "key", "full_outer").select(
        "key", F.when(new, F.when(F.col("r_.coverage") == "complete", "staged").otherwise("failing")).otherwise(F.col("p_.status")).alias("status"), F.coalesce("p_.coverage", F.lit("unknown")).alias("coverage"),
        F.col("r_.coverage").alias("attempt_coverage"), F.coalesce("r_.fetched_at", "p_.checked_at").alias("checked_at"), F.when(new, success).otherwise(F.col("p_.last_success_at")).alias("last_success_at"),
        F.coalesce("r_.fetched", F.lit(0)).alias("records_seen"), F.when(new, wrong).otherwise(0).alias("error_count"),
    )


def catalog_revision(layers: Column) -> Column:
    """The digest of a catalog's layers (array of struct<layer, delivery_status, version>) in order of their names."""
    return F.sha2(F.array_join(F.transform(F.array_sort(layers), lambda x: F.concat_ws(":", x["layer"], x["delivery_status"], x["version"].cast("string"))), "\n"), 256)


def validated_catalogs(catalogs: DataFrame, mode: str, if_none_match: Column | None = None) -> DataFrame:
    """Catalogs (catalog, data_mode, layers, revision): unavailable where the mode or the digest is another; not_modified where the reader has this revision."""
    sound = (F.col("data_mode") == mode) & (F.col("revision") == catalog_revision(F.col("layers")))
    have = F.lit(False) if if_none_match is None else F.coalesce(if_none_match == F.col("revision"), F.lit(False))
    return catalogs.select("catalog", F.when(~F.coalesce(sound, F.lit(False)), "unavailable").when(have, "not_modified").otherwise("ready").alias("availability"), F.when(sound, F.col("revision")).alias("etag"))


def finite_number(text: Column) -> Column:
    """A JSON number as a double; null for names of numbers, for what isn't one, and for what overflows."""
    value = text.try_cast("double")
    return F.when(text.rlike(r"^-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?$") & (F.abs(value) < float("inf")), value)


def version_digests(checksum: Column, options: Column, backend: str) -> dict[str, Column]:
    """data_version, config_hash and display_version: each binds what the one before it was made from."""
    data, config = fingerprint(checksum, options), F.sha2(F.concat(F.lit("display:"), F.lit(backend)), 256)
    return {"data_version": data, "config_hash": config, "display_version": fingerprint(data, checksum, config)}
