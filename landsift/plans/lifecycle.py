"""Queries over what changes with time: watches' matches, deliveries; and areas on the ellipsoid. With their SQL."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from landsift import scratch
from landsift.functions import geometry as G
from landsift.operators import deliveries, filters, review, scopes, spatial, watches
from landsift.plans.state import _VERSIONS
from landsift.sources import testdata as T

CELL = 20000


def _versions(spark, sf) -> DataFrame:
    """An owner's records as versions of one record that moves; one that is preliminary retracts it."""
    r = T.records(spark, sf)
    numbered = review.versions(r.select("owner_key", "rec_key", "status", "date_discovered"), "owner_key", "date_discovered", "rec_key").select("rec_key", "version_number")
    return r.join(numbered, "rec_key").withColumn("key", F.col("owner_key")).withColumn("version", F.col("version_number")).withColumn("retracted", F.col("status") == "preliminary")


def _transitions(spark, sf) -> DataFrame:
    v, w = _versions(spark, sf), T.watches(spark, sf)
    boxed = lambda df: df.withColumn("box", F.struct(*[F.col(c).cast("double").alias(c) for c in "wsen"])).withColumn("geom", G.polygon(G.box_ring(*[F.col(c) for c in "wsen"])))
    pairs = spatial.spatial_join(boxed(v), boxed(w), G.intersects_projected, CELL)
    pairs = pairs.where(filters.watch_predicate(F.col("status"), F.col("development_type"), F.col("r_statuses"), F.col("r_types")))
    return watches.match_transitions(v.select("key", "version", "retracted"), pairs.select("key", "version", F.col("r_watch_id").alias("watch_id")))


def watch_transitions(spark, sf):
    """Matches that enter, stay, exit or are retracted with each version, by exact geometry."""
    return _transitions(spark, sf)


_TRANSITIONS = f"""{_VERSIONS}, {T.SQL['watches']},
x AS (SELECT v.owner_key AS key, v.version_number AS version, v.status = 'preliminary' AS retracted, r.* FROM v JOIN records r USING (rec_key)),
m AS (SELECT DISTINCT x.key, x.version, watch_id FROM x JOIN watches t ON x.w <= t.e AND t.w <= x.e AND x.s <= t.n AND t.s <= x.n
 AND (t.statuses IS NULL OR list_contains(t.statuses, x.status)) AND (t.types IS NULL OR list_contains(t.types, x.development_type)) WHERE NOT x.retracted),
c AS (SELECT x.key, x.version, x.retracted, w.watch_id, EXISTS (FROM m WHERE m.key = x.key AND m.version = x.version AND m.watch_id = w.watch_id) AS now,
 EXISTS (FROM m WHERE m.key = x.key AND m.version = x.version - 1 AND m.watch_id = w.watch_id) AS before
 FROM x JOIN (SELECT DISTINCT key, watch_id FROM m) w ON w.key = x.key)
SELECT key, version, watch_id, CASE WHEN now AND before THEN 'stay' WHEN now THEN 'enter' WHEN retracted THEN 'retract' ELSE 'exit' END AS transition FROM c WHERE now OR before"""


def watch_notices(spark, sf):
    """What active, confirmed watches are told: by nation, confirmed from 1992 to 1997, every fourth unsubscribed."""
    n = T.table(spark, sf, "nation")
    state = F.when(F.col("n_nationkey") % 4 == 3, "unsubscribed").when(F.col("n_nationkey") % 7 == 5, "pending_confirmation").otherwise("active")
    known = n.select(F.concat(F.lit("watch-"), F.col("n_nationkey").cast("long")).alias("watch_id"), state.alias("state"), F.concat(F.lit(1992) + F.col("n_nationkey") % 6, F.lit("-06-01")).alias("confirmed_at"))
    occurred = _versions(spark, sf).select("key", "version", F.col("date_discovered").alias("occurred_at"))
    return watches.notices(_transitions(spark, sf), known, occurred)


_NOTICES = f"""WITH t AS ({_TRANSITIONS}), o AS ({_VERSIONS} SELECT owner_key AS key, version_number AS version, date_discovered FROM v),
k AS (SELECT 'watch-' || n_nationkey AS watch_id, (1992 + n_nationkey % 6) || '-06-01' AS confirmed_at FROM nation WHERE n_nationkey % 4 <> 3 AND n_nationkey % 7 <> 5)
SELECT key, version, watch_id, transition FROM t JOIN o USING (key, version) JOIN k USING (watch_id) WHERE transition <> 'stay' AND confirmed_at <= date_discovered"""


def delivery_lifecycle(spark, sf):
    """Events as what happens to deliveries, one a user and five days: queued, claimed by one of two workers, sent, failed, unsubscribed."""
    e = T.table(spark, sf, "events")
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    kind = F.when(F.col("event_type") == "signup", "queue").when(F.col("event_type").isin("view", "click"), "claim").when(F.col("event_type") == "error", "failed").when(F.col("value") > 150, "unsubscribe").otherwise("sent")
    rows = e.select(F.concat_ws("-", "user_id", F.floor(at / 432000)).alias("delivery"), F.col("event_id").alias("seq"), kind.alias("kind"), at.alias("at"), (F.col("event_id") % 2).alias("token"))
    policy = deliveries.Policy(lease=43200, delay=7200, longest=28800, attempts=3)
    return deliveries.replay(rows, policy)


_LIFECYCLE = """
WITH RECURSIVE r AS (SELECT user_id || '-' || (epoch_us(ts) // 1000000 // 432000) AS delivery, event_id AS seq, epoch_us(ts) // 1000000 AS moment, event_id % 2 AS token,
  CASE WHEN event_type = 'signup' THEN 'queue' WHEN event_type IN ('view', 'click') THEN 'claim' WHEN event_type = 'error' THEN 'failed' WHEN value > 150 THEN 'unsubscribe' ELSE 'sent' END AS kind FROM events),
e AS (SELECT *, row_number() OVER (PARTITION BY delivery ORDER BY moment, seq) AS rn FROM r),
w AS (SELECT DISTINCT delivery, 0::BIGINT AS rn, NULL::BIGINT AS seq, ''::VARCHAR AS kind, ''::VARCHAR AS state, 0 AS attempts, 0::BIGINT AS next_at, -1::BIGINT AS held, 0::BIGINT AS expires, ''::VARCHAR AS outcome FROM e
UNION ALL
SELECT delivery, rn, seq, kind,
  CASE action WHEN 'queue' THEN 'queued' WHEN 'claim' THEN 'leased' WHEN 'sent' THEN 'sent' WHEN 'failed' THEN CASE WHEN attempts >= 3 THEN 'dead' ELSE 'retry' END WHEN 'unsubscribe' THEN 'suppressed' ELSE state END,
  CASE WHEN action = 'claim' THEN attempts + 1 ELSE attempts END,
  CASE action WHEN 'queue' THEN moment WHEN 'failed' THEN moment + least(28800, 7200 * (1 << greatest(attempts - 1, 0))) ELSE next_at END,
  CASE WHEN action = 'claim' THEN token ELSE held END, CASE WHEN action = 'claim' THEN moment + 43200 ELSE expires END,
  CASE WHEN action = '' THEN 'refused' ELSE 'done' END
FROM (SELECT *, CASE WHEN kind = 'queue' AND state = '' THEN kind WHEN kind = 'claim' AND state IN ('queued', 'retry') AND moment >= next_at THEN kind
    WHEN kind IN ('sent', 'failed') AND state = 'leased' AND token = held THEN kind WHEN kind = 'unsubscribe' AND state IN ('queued', 'retry', 'leased') THEN kind ELSE '' END AS action
  FROM (SELECT e.delivery, e.rn, e.seq, e.kind, e.moment, e.token, w.attempts, w.held, w.expires,
      CASE WHEN w.state = 'leased' AND e.moment >= w.expires THEN CASE WHEN w.attempts >= 3 THEN 'dead' ELSE 'retry' END ELSE w.state END AS state,
      CASE WHEN w.state = 'leased' AND e.moment >= w.expires THEN w.expires + least(28800, 7200 * (1 << greatest(w.attempts - 1, 0))) ELSE w.next_at END AS next_at
    FROM w JOIN e ON e.delivery = w.delivery AND e.rn = w.rn + 1)))
SELECT delivery, seq, kind, nullif(state, '') AS state, attempts, outcome FROM w WHERE rn > 0"""


def geo_geodesic_area(spark, sf):
    """Areas of the records' footprints on the ellipsoid, in hundreds of square metres, and whether they are under a limit."""
    w, s, e, n = (T.degrees(F.col(c)) for c in "wsen")
    area = G.geodesic_area_km2(G.box_ring(w, s, e, n))
    return T.records(spark, sf).select("public_id", F.floor(area * 10000 + 0.5).cast("long").alias("area"), (area <= 0.0121).alias("small"))


_AREA = f"""{T.with_sql('records')},
c AS (SELECT 1 / 298.257223563 AS f, sqrt(1 / 298.257223563 * (2 - 1 / 298.257223563)) AS k),
q AS (SELECT public_id, radians(e / 1e6) - radians(w / 1e6) AS d, k, k * sin(radians(s / 1e6)) AS low, k * sin(radians(n / 1e6)) AS high, 1 - (1 - k * k) / (2 * k) * ln((1 - k) / (1 + k)) AS pole FROM records, c),
b AS (SELECT public_id, d, pole, tan(asin((low / (1 - low * low) - ln((1 - low) / (1 + low)) / 2) * (1 - k * k) / k / pole) / 2) AS a, tan(asin((high / (1 - high * high) - ln((1 - high) / (1 + high)) / 2) * (1 - k * k) / k / pole) / 2) AS b FROM q),
x AS (SELECT public_id, abs(2 * atan2(tan(d / 2) * 2 * b, 1 + b * b) - 2 * atan2(tan(d / 2) * 2 * a, 1 + a * a)) * 6378.137 * 6378.137 * pole / 2 AS area FROM b)
SELECT public_id, floor(area * 10000 + 0.5)::BIGINT AS area, area <= 0.0121 AS small FROM x"""

def scope_coverage(spark, sf):
    """Records that a scope covers exactly: the watches' rectangles, less a rectangle in their middle, as GeoJSON."""
    t = T.watches(spark, sf)
    ring = lambda w, s, e, n: F.format_string("[[%s,%s],[%s,%s],[%s,%s],[%s,%s],[%s,%s]]", *(v.cast("string") for v in (w, s, e, s, e, n, w, n, w, s)))
    d = lambda c, more=0: T.degrees(F.col(c) + more)
    shell, hole = ring(d("w"), d("s"), d("e"), d("n")), ring(d("w", 8000), d("s", 6000), d("w", 12000), d("s", 9000))
    declared = scopes.declared(t.select(F.col("watch_id").alias("scope_id"), F.concat(F.lit('{"type":"Polygon","coordinates":['), shell, F.lit(","), hole, F.lit("]}")).alias("geojson")))
    box = F.struct(*[d(c).alias(c) for c in "wsen"]).alias("box")
    r = T.records(spark, sf).select(F.col("public_id").alias("feature_id"), G.polygon(G.box_ring(d("w"), d("s"), d("e"), d("n"))).alias("geom"), box)
    return scopes.covered(r, scratch.stored(declared, "scopes"), 0.02).select("feature_id", "scope_id")


_SCOPES = f"""{T.with_sql('records', 'watches')} SELECT public_id AS feature_id, watch_id AS scope_id FROM records r JOIN watches t ON r.w >= t.w AND r.e <= t.e AND r.s >= t.s AND r.n <= t.n
WHERE NOT (r.w < t.w + 12000 AND r.e > t.w + 8000 AND r.s < t.s + 9000 AND r.n > t.s + 6000)"""

QUERIES: dict[str, tuple] = {
    "scope_coverage": (scope_coverage, _SCOPES),
    "watch_transitions": (watch_transitions, _TRANSITIONS),
    "watch_notices": (watch_notices, _NOTICES),
    "delivery_lifecycle": (delivery_lifecycle, _LIFECYCLE),
    "geo_geodesic_area": (geo_geodesic_area, _AREA),
}
