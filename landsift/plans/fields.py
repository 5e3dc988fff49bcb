"""Queries over scalar operators: normalization, identity, digests, geometry measures, agenda text and links."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from landsift.functions import geometry as G
from landsift.functions import mercator as M
from landsift.functions import scalars as S
from landsift.operators import agenda, normalize
from landsift.sources import testdata as T


def normalize_titles(spark, sf):
    p = T.table(spark, sf, "part")
    phase = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Phase "), (F.col("p_size") % 5).cast("string")))
    named = F.concat_ws(" / ", S.clean(F.col("p_name")), F.when(F.col("p_size") % 2 == 0, F.col("p_type")), F.lit(None).cast("string"))
    return p.select("p_partkey", F.concat_ws(" ", S.clean(F.concat(F.lit("  "), "p_name", F.lit(" "))), phase).alias("subdivision_title"), named.alias("permit_title"), S.title_case(F.concat_ws(" of the ", "p_name", "p_type")).alias("title_cased"))


_TITLES = """SELECT p_partkey, concat_ws(' ', trim(p_name), CASE WHEN p_size % 3 = 0 THEN 'Phase ' || (p_size % 5) END) AS subdivision_title,
 concat_ws(' / ', trim(p_name), CASE WHEN p_size % 2 = 0 THEN p_type END) AS permit_title,
 array_to_string(list_transform(string_split(lower(p_name || ' of the ' || p_type), ' '), lambda w, i: CASE WHEN i > 1 AND w IN ('at','and','of','the','in','on') THEN w ELSE upper(w[1]) || w[2:] END), ' ') AS title_cased FROM part"""


def normalize_status(spark, sf):
    raw = F.when(F.col("o_orderstatus") == "F", " Final ").when(F.col("o_orderstatus") == "O", "LAYOUT").otherwise(F.col("o_orderpriority"))
    return T.table(spark, sf, "orders").groupBy(S.subdivision_status(raw).alias("status"), raw.alias("source_status")).agg(F.count(F.lit(1)).alias("n"))


def normalize_dates_epoch(spark, sf):
    o = T.table(spark, sf, "orders")
    seconds = 946684800 + F.col("o_orderkey") % 5000 * 86400
    raw = F.when(F.col("o_orderkey") % 4 == 0, seconds.cast("string")).when(F.col("o_orderkey") % 4 == 1, (seconds * 1000).cast("string")).when(F.col("o_orderkey") % 4 == 2, F.concat(T.day(F.col("o_orderdate")), F.lit("T12:00:00Z"))).otherwise(F.lit("  unknown text "))
    return o.select("o_orderkey", S.epoch_date(raw).alias("date"))


_EPOCH = """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN 'unknown te'
 ELSE strftime(TIMESTAMP '2000-01-01' + to_days((o_orderkey % 5000)::INTEGER), '%Y-%m-%d') END AS date FROM orders"""


def normalize_dates_text(spark, sf):
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format(d, "M/d/yyyy")).when(k == 1, F.date_format(d, "MM-dd-yyyy")).when(k == 2, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "yyyy/MM/dd"))
    return T.table(spark, sf, "orders").select("o_orderkey", S.text_date(raw).alias("date"))


def meeting_dates(spark, sf):
    d = F.col("o_orderdate")
    title = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Agenda "), F.date_format(d, "MMMM"), F.lit(" "), F.dayofmonth(d).cast("string"), F.lit(", "), F.year(d).cast("string"))).otherwise("Agenda")
    url = F.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("http://x/"), F.lower(F.date_format(d, "MMMM")), F.lit("-"), F.dayofmonth(d).cast("string"), F.lit("-"), F.year(d).cast("string"), F.lit("-agenda.pdf"))).otherwise("http://x/2020/01/agenda.pdf")
    return T.table(spark, sf, "orders").select("o_orderkey", S.meeting_date(title, url).alias("date"))


def public_fields_allowlist(spark, sf):
    e = T.table(spark, sf, "events")
    fields = F.create_map(F.lit("Status"), F.col("event_type"), F.lit("secret"), F.col("user_id").cast("string"), F.lit("location"), F.get_json_object("props", "$.k"))
    kept = S.public_fields(fields)
    return e.select("event_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("keys"), kept["location"].alias("location"))


def url_sanitize(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", S.public_url(F.col("url")).alias("public_url"))


def email_hints(spark, sf):
    mail = F.when(F.col("c_custkey") % 7 == 0, F.lower("c_name")).otherwise(F.concat(F.lower("c_name"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".org")))
    return T.table(spark, sf, "customer").select("c_custkey", S.email_hint(mail).alias("hint"), S.contact_hash(F.concat(F.lit(" "), F.upper(mail))).alias("contact_hash"), S.normalized_email(F.upper(mail)).alias("email"))


_EMAIL = """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '***' ELSE substr(lower(c_name), 1, 2) || '***@' || lower(c_mktsegment) || '.org' END AS hint,
 sha256(CASE WHEN c_custkey % 7 = 0 THEN lower(c_name) ELSE lower(c_name) || '@' || lower(c_mktsegment) || '.org' END) AS contact_hash,
 CASE WHEN c_custkey % 7 <> 0 THEN lower(c_name) || '@' || lower(c_mktsegment) || '.org' END AS email FROM customer"""


def stable_ids(spark, sf):
    c = T.table(spark, sf, "customer")
    return c.select("c_custkey", S.stable_id("submission", F.col("c_name"), F.col("c_nationkey"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))).alias("id"))


def provisional_public_ids(spark, sf):
    o = T.observations(spark, sf)
    return o.select("source_key", "record_id", S.public_id("record", F.col("source_key"), F.col("record_id")).alias("public_id")).distinct()


def source_record_id_validation(spark, sf):
    k = F.col("o_orderkey")
    raw = F.when(k % 6 == 0, F.lit(None).cast("string")).when(k % 6 == 1, "   ").when(k % 6 == 2, F.repeat(F.lit("x"), 256)).when(k % 6 == 3, "inf").otherwise(F.format_string("%08d", k))
    kind = F.when(k % 12 == 4, "boolean").otherwise("string")
    return T.table(spark, sf, "orders").select("o_orderkey", S.source_id_problem(raw, kind).alias("problem"))


def content_fingerprints(spark, sf):
    return T.table(spark, sf, "orders").select("o_orderkey", S.fingerprint(F.col("o_custkey"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")), F.col("o_orderpriority")).alias("fingerprint"))


def chained_digest(spark, sf):
    """A fold of digests over each customer's orders in order."""
    o = T.table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    return o.select("o_custkey", S.chained_digest(F.transform("keys", lambda k: F.sha2(k.cast("string"), 256))).alias("digest"))


_CHAIN = """WITH RECURSIVE o AS (SELECT o_custkey, sha256(o_orderkey::VARCHAR) AS h, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
c AS (SELECT o_custkey, rn, n, sha256(h) AS digest FROM o WHERE rn = 1 UNION ALL SELECT o.o_custkey, o.rn, o.n, sha256(c.digest || o.h) FROM c JOIN o ON o.o_custkey = c.o_custkey AND o.rn = c.rn + 1)
SELECT o_custkey, digest FROM c WHERE rn = n"""


def set_seal_digest(spark, sf):
    """A digest of the sorted (id, content) lines of each order's artifacts."""
    line = F.concat_ws(":", F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"))
    return T.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("seal"), F.count(F.lit(1)).alias("items"))


def artifact_keys(spark, sf):
    sha = F.sha2(F.coalesce("html", F.lit("")), 256)
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("long")
    return T.table(spark, sf, "pages").select("page_id", S.blob_key(sha).alias("blob_key"), size.alias("bytes"), F.ceil(size / 1024).alias("parts"), S.artifact_id(F.lit("pages"), F.lit("html"), F.col("url")).alias("artifact_id"))


def lock_keys(spark, sf):
    return T.table(spark, sf, "nation").select("n_name", S.lock_key(F.col("n_name")).alias("lock_key"))


def excerpts(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", S.excerpt(F.regexp_replace("text", r"[^ -~\n]", "?")).alias("excerpt"))


def json_nesting(spark, sf):
    k = (F.col("event_id") % 40).cast("int")
    text = F.concat(F.repeat(F.lit('{"a":['), k), F.lit('"[[[\\"{{",'), F.col("props"), F.repeat(F.lit("]}"), k))
    depth = S.nesting_depth(text)
    return T.table(spark, sf, "events").select("event_id", depth.cast("int").alias("depth"), (depth > 32).alias("refused"))


def label_lookups(spark, sf):
    labels = F.create_map(*[F.lit(x) for x in ("layout", "Layout", "preliminary", "Preliminary", "final", "Final")])
    r = T.records(spark, sf)
    return r.select("public_id", labels[F.col("status")].alias("label"), S.acres((F.col("e") - F.col("w")) * 100.0).alias("area"))


def failure_backoff(spark, sf):
    e = T.table(spark, sf, "events")
    return e.select("event_id", S.backoff_seconds((F.col("user_id") % 14).cast("int")).alias("seconds"), S.is_retryable(F.format_string("%05d", F.col("event_id") % 60000)).alias("retryable"))


# --- geometry ------------------------------------------------------------------------------------


def _geoms(spark: SparkSession, sf: str) -> DataFrame:
    return T.records(spark, sf).select("rec_key", "public_id", "w", "s", "e", "n", T.square().alias("geom"))


def geo_bbox(spark, sf):
    b = G.bbox(T.triangle())
    return T.records(spark, sf).select("public_id", *[F.round(b[c] * 1000000).cast("long").alias(c) for c in "wsen"])


def geo_bbox_distance(spark, sf):
    """Distance of each record's box from that of its owner's wetland."""
    theirs = T.features(spark, sf).where("category = 'wetlands'").select(F.col("feature_order").alias("owner_key"), F.struct(*[T.degrees(F.col(c)).alias(c) for c in "wsen"]).alias("f"))
    box = F.struct(*[T.degrees(F.col(c)).alias(c) for c in "wsen"])
    return T.records(spark, sf).join(theirs, "owner_key").select("public_id", G.round_to(G.bbox_distance_m(box, F.col("f")), 1).alias("metres"))


_BBOX_DISTANCE = f"""{T.with_sql('records', 'features')}, g AS (SELECT feature_order, w AS fw, s AS fs, e AS fe, n AS fn FROM features WHERE category = 'wetlands'),
d AS (SELECT public_id, greatest(fw - e, w - fe, 0) / 1000000.0::DOUBLE AS dx, greatest(fs - n, s - fn, 0) / 1000000.0::DOUBLE AS dy, (s + n + fs + fn) / 4.0::DOUBLE / 1000000.0::DOUBLE AS lat FROM records JOIN g ON feature_order = owner_key)
SELECT public_id, floor(sqrt(power(dx * 111320 * cos(radians(lat)), 2) + power(dy * 110540, 2)) * 10 + 0.5) / 10 AS metres FROM d"""


def geo_centroid_vertex_mean(spark, sf):
    c = G.vertex_mean(F.col("geom"))
    return _geoms(spark, sf).select("public_id", G.round_to(c["x"], 6).alias("lon"), G.round_to(c["y"], 6).alias("lat"))


def geo_centroid_area(spark, sf):
    c = G.area_centroid(T.square())
    mid = G.bbox_centre(T.triangle(), G.point(F.lit(0.0), F.lit(0.0)))
    return T.records(spark, sf).select("public_id", G.round_to(c["x"], 5).alias("lon"), G.round_to(c["y"], 5).alias("lat"), G.round_to(mid["x"], 5).alias("box_lon"), G.round_to(mid["y"], 5).alias("box_lat"))


def geo_area(spark, sf):
    return T.records(spark, sf).select("public_id", (G.area_m2(T.square()) / 10).cast("long").alias("tens_m2"), G.area_m2(T.triangle()).isNotNull().alias("has_area"))


def geo_segment_distance(spark, sf):
    """Distance in degrees between a record's diagonal and the vertical line one box width to the right."""
    d = lambda x, y: G.point(T.degrees(x), T.degrees(y))
    w, s, e, n = (F.col(c) for c in "wsen")
    diagonal = F.struct(d(w, s).alias("a"), d(e, n).alias("b"))
    line = F.struct(d(e + (e - w), s).alias("a"), d(e + (e - w), n).alias("b"))
    return T.records(spark, sf).select("public_id", G.round_to(G.segment_distance(diagonal, line) * 1000000, 0).cast("long").alias("micro"))


def _measured_pairs(left: DataFrame, right: DataFrame, geom, margin: int, measure) -> DataFrame:
    """Pairs of rows with near boxes and a measure of their geometries, which is taken once for all copies of a pair of boxes."""
    from landsift.operators.spatial import candidate_pairs

    boxed = lambda df: df.withColumn("box", F.struct("w", "s", "e", "n"))
    left, right = boxed(left), boxed(right)
    shapes = lambda df: df.select("w", "s", "e", "n", "box").distinct().withColumn("geom", geom)
    pairs = candidate_pairs(shapes(left), shapes(right), 5000, margin).select("box", "r_box", measure)
    return left.select("public_id", "box").join(pairs, "box").join(right.select("feature_id", F.col("box").alias("r_box")), "r_box").drop("box", "r_box")


def geo_polygon_intersects(spark, sf):
    """Which triangle pairs of overlapping boxes truly meet."""
    records = T.records(spark, sf).where("development_type = 'subdivision'")
    p = _measured_pairs(records, T.features(spark, sf), T.triangle(), 0, G.intersects(F.col("geom"), F.col("r_geom")).alias("meets"))
    return p.select("public_id", "feature_id", "meets")


_TRIANGLES = f"""{T.with_sql('records', 'features')}
SELECT public_id, feature_id, (greatest(r.w, f.w) - r.w) + (greatest(r.s, f.s) - r.s) <= r.e - r.w AND (greatest(r.w, f.w) - f.w) + (greatest(r.s, f.s) - f.s) <= f.e - f.w AS meets
FROM records r JOIN features f ON r.development_type = 'subdivision' AND r.w <= f.e AND f.w <= r.e AND r.s <= f.n AND f.s <= r.n"""


def geo_point_in_polygon(spark, sf):
    """Points of a small lattice against each record's triangle; the boundary is inside."""
    k = F.col("rec_key")
    x, y = F.col("w") + (k % 5) * (F.col("e") - F.col("w")) / 4, F.col("s") + (k % 7 % 5) * (F.col("n") - F.col("s")) / 4
    unit = F.array(G.point(F.col("w"), F.col("s")), G.point(F.col("e"), F.col("s")), G.point(F.col("w"), F.col("n")), G.point(F.col("w"), F.col("s")))
    return T.records(spark, sf).select("public_id", G.point_in_polygon(G.point(x, y), F.array(unit)).alias("inside"))


def geo_distance(spark, sf):
    """Pair distances of separate squares within two cells of each other, in tenths of metres."""
    records, features = T.records(spark, sf).where("development_type = 'subdivision'"), T.features(spark, sf).where("category = 'floodplain'")
    p = _measured_pairs(records, features, T.square(), 2000, G.round_to(G.distance_m(F.col("geom"), F.col("r_geom")), 1).alias("metres"))
    return p.select("public_id", "feature_id", "metres")


_DISTANCE = f"""{T.with_sql('records', 'features')}, d AS (SELECT public_id, feature_id, greatest(f.w - r.e, r.w - f.e, 0) / 1000000.0::DOUBLE AS dx, greatest(f.s - r.n, r.s - f.n, 0) / 1000000.0::DOUBLE AS dy, (3 * r.s + 2 * r.n + 3 * f.s + 2 * f.n) / 10.0::DOUBLE / 1000000.0::DOUBLE AS lat
 FROM records r JOIN features f ON f.category = 'floodplain' AND r.development_type = 'subdivision' AND r.w - 2000 <= f.e AND f.w <= r.e + 2000 AND r.s - 2000 <= f.n AND f.s <= r.n + 2000)
SELECT public_id, feature_id, floor(sqrt(power(dx * 111320 * cos(radians(lat)), 2) + power(dy * 110540, 2)) * 10 + 0.5) / 10 AS metres FROM d"""


def geo_validate_structure(spark, sf):
    """Rings that are sound or broken in six ways by key."""
    k = F.col("rec_key") % 7
    w, s, e, n = (T.degrees(F.col(c)) for c in "wsen")
    ring = G.box_ring(w, s, e, n)
    # a bow tie whose lobes differ, so that its areas don't cancel
    bow = F.array(G.point(w, s), G.point(e, n + 0.01), G.point(e, s), G.point(w, n), G.point(w, s))
    flat = F.array(G.point(w, s), G.point(e, s), G.point(w, s), G.point(w, s))
    made = F.when(k == 0, ring).when(k == 1, F.slice(ring, 1, 3)).when(k == 2, F.slice(ring, 1, 4)).when(k == 3, bow).when(k == 4, flat).when(k == 5, G.box_ring(w + 200, s, e + 400, n)).otherwise(G.box_ring(F.lit(-170.0), s, F.lit(170.0), n))
    return T.records(spark, sf).select("public_id", G.ring_problem(made).alias("problem"))


_STRUCTURE = f"""{T.with_sql('records')} SELECT public_id, CASE rec_key % 7 WHEN 1 THEN 'too_few_points' WHEN 2 THEN 'not_closed' WHEN 3 THEN 'self_intersection' WHEN 4 THEN 'zero_area' WHEN 5 THEN 'out_of_range' WHEN 6 THEN 'antimeridian' END AS problem FROM records"""


def geo_ring_canonical(spark, sf):
    """Start and direction of a ring don't change its canonical form."""
    k = F.col("rec_key")
    ring = G.box_ring(*(F.col(c) for c in "wsen"))
    open_ = F.slice(ring, 1, 4)
    shift = (k % 4 + 1).cast("int")
    turned = F.concat(F.slice(open_, shift, 5 - shift), F.slice(open_, F.lit(1), shift - 1))
    turned = F.when(k % 2 == 0, F.reverse(turned)).otherwise(turned)
    closed = F.concat(turned, F.slice(turned, 1, 1))
    text = F.array_join(F.transform(G.canonical_ring(closed), lambda p: F.concat_ws(" ", p["x"].cast("long").cast("string"), p["y"].cast("long").cast("string"))), ",")
    return T.records(spark, sf).select("public_id", text.alias("ring"))


_CANONICAL = f"{T.with_sql('records')} SELECT public_id, w || ' ' || s || ',' || e || ' ' || s || ',' || e || ' ' || n || ',' || w || ' ' || n AS ring FROM records"


def mercator_transform(spark, sf):
    p = M.forward(G.point(T.degrees(F.col("w")), T.degrees(F.col("s"))))
    return T.records(spark, sf).select("public_id", G.round_to(p["x"], 2).alias("x"), G.round_to(p["y"], 2).alias("y"))


_MERCATOR = f"""{T.with_sql('records')} SELECT public_id, floor(radians(w / 1000000.0::DOUBLE) * 6378137 * 100 + 0.5) / 100 AS x, floor(ln(tan(pi() / 4 + radians(s / 1000000.0::DOUBLE) / 2)) * 6378137 * 100 + 0.5) / 100 AS y FROM records"""


def tile_west_edges(spark, sf):
    return T.table(spark, sf, "nation").select("n_nationkey", M.tile_west_edge(F.lit(12), F.col("n_nationkey") + 1061).alias("west"))


def geo_counts(spark, sf):
    """Vertices, holes and components of a square with a hole."""
    w, s, e, n = (T.degrees(F.col(c)) for c in "wsen")
    hole = G.box_ring(w + 0.00005, s + 0.00005, e - 0.00005, n - 0.00005)
    g = F.when(F.col("rec_key") % 2 == 0, G.polygon(G.box_ring(w, s, e, n), hole)).otherwise(G.polygon(G.box_ring(w, s, e, n)))
    return T.records(spark, sf).select("public_id", F.size(G.positions(g)).alias("vertices"), G.hole_count(g).alias("holes"), G.component_count(g).alias("components"))


def geojson_round_trip(spark, sf):
    """Boxes through GeoJSON text of four types."""
    w, s, e, n = (F.col(c) for c in "wsen")
    ring = F.format_string("[[%d,%d],[%d,%d],[%d,%d],[%d,%d],[%d,%d]]", w, s, e, s, e, n, w, n, w, s)
    k = F.col("rec_key") % 4
    body = F.when(k == 0, F.format_string('{"type":"Polygon","coordinates":[%s]}', ring)).when(k == 1, F.format_string('{"type":"MultiPolygon","coordinates":[[%s]]}', ring)).when(k == 2, F.format_string('{"type":"LineString","coordinates":%s}', ring)).otherwise(F.format_string('{"type":"Point","coordinates":[%d,%d]}', w, s))
    boxed = T.records(spark, sf).select("public_id", G.bbox(G.from_geojson(body)).alias("b"))  # its own step: four columns would each read the text
    return boxed.select("public_id", *[F.col(f"b.{c}").cast("long").alias(c) for c in "wsen"])


# --- agenda and links ------------------------------------------------------------------------------


def _agenda_texts(spark, sf) -> DataFrame:
    """A text a brand: numbered parts with a status line, a count and a developer."""
    k = F.col("p_partkey")
    status = F.when(k % 4 == 0, "Layout").when(k % 4 == 1, "Preliminary and Final").when(k % 4 == 2, "Final").otherwise("Discussion")
    block = F.concat(k.cast("string"), F.lit(". "), F.upper("p_name"), F.lit("\n  "), status, F.lit("   plat ( "), "p_size", F.lit(" lots )\nDeveloper: Dev "), (k % 9).cast("string"), F.lit(" Engineer: Eng "), (k % 5).cast("string"), F.lit("\n"))
    parts = F.array_sort(F.collect_list(F.struct(k.alias("k"), block.alias("t"))))
    return T.table(spark, sf, "part").groupBy(F.col("p_brand").alias("doc")).agg(F.concat(F.lit("Preface\n"), F.array_join(F.transform(parts, lambda s: s["t"]), "")).alias("text"))


def agenda_blocks(spark, sf):
    return agenda.blocks(_agenda_texts(spark, sf))


def agenda_fields(spark, sf):
    i = agenda.items(agenda.blocks(_agenda_texts(spark, sf)))
    return i.select("doc", "block", "title", "source_status", "normalized_status", "lot_count", "developer", "engineer", "parse_confidence")


_BLOCKS = """b AS (SELECT p_brand AS doc, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INTEGER AS block, upper(p_name) AS head, p_partkey AS k, p_size,
 CASE p_partkey % 4 WHEN 0 THEN 'Layout' WHEN 1 THEN 'Preliminary and Final' WHEN 2 THEN 'Final' ELSE 'Discussion' END AS st FROM part)"""


def agenda_status_precedence(spark, sf):
    i = agenda.items(agenda.blocks(_agenda_texts(spark, sf)))
    return i.groupBy("normalized_status", "source_status").agg(F.count(F.lit(1)).alias("n"), F.sum("lot_count").alias("lots"))


def agenda_descriptions(spark, sf):
    i = agenda.items(agenda.blocks(_agenda_texts(spark, sf)))
    return i.select("doc", "block", agenda.description(F.col("source_status"), F.col("lot_count"), F.col("unit_count"), F.col("location")).alias("description"))


def links_discover(spark, sf):
    """Addresses of each page's links that hold '/' and 'e' but not 'th', the first of each."""
    found = agenda.wanted_links(agenda.links(T.table(spark, sf, "pages")), ("/", "e"), ("th",))
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.min("href").alias("least"))


def source_features(o: DataFrame) -> DataFrame:
    """Records as features of three sources, dealt by key."""
    k = F.col("rec_key")
    ring = F.format_string("[[%s,%s],[%s,%s],[%s,%s],[%s,%s],[%s,%s]]", *(T.degrees(F.col(c)).cast("string") for c in ("w", "s", "e", "s", "e", "n", "w", "n", "w", "s")))
    props = F.create_map(F.lit("SubdID"), F.col("rec_key").cast("string"), F.lit("Subdivision"), F.col("title"), F.lit("Phase"), F.when(F.col("rec_key") % 100 == 0, "Phase 2"), F.lit("Status"), F.initcap("status"), F.lit("HousingUnits"), F.lit("12"), F.lit("HousingUnitType"), F.lit("Homes"))
    day = F.col("date_discovered").cast("date")
    permit = F.create_map(F.lit("PermitID"), k.cast("string"), F.lit("Subdivision"), F.when(k % 2 == 0, F.col("title")), F.lit("OccupancyType"), F.when(k % 6 == 1, F.lit("Single Family")), F.lit("Permit_Issue_DateTime"), (F.unix_date(day).cast("long") * 86400000).cast("string"))
    county = F.create_map(F.lit("Subd_ID"), k.cast("string"), F.lit("Subd_Name"), F.when(k % 5 != 0, F.col("title")), F.lit("Parcels"), (k % 9).cast("string"), F.lit("YearFiled"), F.year(day).cast("string"), F.lit("DateFiled"), F.when(k % 4 != 0, F.date_format(day, "M/d/yyyy")))
    point = F.format_string('{"type":"Point","coordinates":[%s,%s]}', T.degrees(F.col("w")).cast("string"), T.degrees(F.col("s")).cast("string"))
    polygon = F.format_string('{"type":"Polygon","coordinates":[%s]}', ring)
    left = F.coalesce(k % 3, F.lit(2))
    dealt = (("city_subdivisions", left == 0, props, polygon), ("city_permits", left == 1, permit, point), ("county_subdivisions", ~left.isin(0, 1), county, polygon))
    # a select a source: a normalizer that asks for one source then plans that one alone, and its code is small enough to be compiled
    parts = [o.where(mine).select("rec_key", F.lit(name).alias("source"), p.alias("properties"), g.alias("geometry_json")) for name, mine, p, g in dealt]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def normalize_features(spark, sf):
    """Each feature by its own source's normalizer."""
    f = source_features(T.records(spark, sf))
    n = normalize.normalize_all(f, "2024-02-01T00:00:00Z")
    return n.select("source_key", "source_record_id", "public_id", "title", "status", "source_status", "description", "permit_issue_date", "approval_date", "confidence_level", "date_discovered")


_FEATURES = f"""{T.with_sql('records')},
c AS (SELECT *, 'city-subdivision-' || rec_key || '-' || substr(sha256('city_subdivisions' || chr(0) || rec_key), 1, 16) AS a, 'city-permit-' || rec_key || '-' || substr(sha256('city_permits' || chr(0) || rec_key), 1, 16) AS b,
 'county-subdivision-' || rec_key || '-' || substr(sha256('county_subdivisions' || chr(0) || rec_key), 1, 16) AS c, concat_ws(' / ', CASE WHEN rec_key % 2 = 0 THEN title END, CASE WHEN rec_key % 6 = 1 THEN 'Single Family' END) AS named,
 CASE WHEN rec_key % 4 <> 0 THEN date_discovered ELSE date_discovered[1:4] END AS filed FROM records)
SELECT CASE rec_key % 3 WHEN 0 THEN 'city_subdivisions' WHEN 1 THEN 'city_permits' ELSE 'county_subdivisions' END AS source_key, rec_key::VARCHAR AS source_record_id, CASE rec_key % 3 WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS public_id,
 CASE rec_key % 3 WHEN 0 THEN concat_ws(' ', title, CASE WHEN rec_key % 100 = 0 THEN 'Phase 2' END) WHEN 1 THEN coalesce(nullif(named, ''), 'Building Permit ' || rec_key) ELSE CASE WHEN rec_key % 5 <> 0 THEN title ELSE 'Unnamed subdivision' END END AS title,
 CASE rec_key % 3 WHEN 0 THEN status WHEN 1 THEN 'issued_permit' ELSE 'completed' END AS status,
 CASE rec_key % 3 WHEN 0 THEN upper(status[1]) || status[2:] WHEN 1 THEN 'Issued' ELSE 'Filed subdivision (' || filed || ')' END AS source_status,
 CASE rec_key % 3 WHEN 0 THEN upper(status[1]) || status[2:] || ' subdivision record with 12 homes.' WHEN 1 THEN 'Issued building permit; its point isn''t a parcel.' ELSE 'Recorded county subdivision polygon. Source parcel count: ' || (rec_key % 9) || '. Filed: ' || filed || '.' END AS description,
 CASE WHEN rec_key % 3 = 1 THEN date_discovered END AS permit_issue_date, CASE WHEN rec_key % 3 = 2 AND rec_key % 4 <> 0 THEN date_discovered END AS approval_date, 'high' AS confidence_level, '2024-02-01' AS date_discovered FROM c"""

QUERIES = {
    "normalize_titles": (normalize_titles, _TITLES),
    "normalize_status": (normalize_status, "SELECT CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'layout' ELSE 'proposed' END AS status, CASE o_orderstatus WHEN 'F' THEN ' Final ' WHEN 'O' THEN 'LAYOUT' ELSE o_orderpriority END AS source_status, count(*) AS n FROM orders GROUP BY 1, 2"),
    "normalize_dates_epoch": (normalize_dates_epoch, _EPOCH),
    "normalize_dates_text": (normalize_dates_text, "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders"),
    "meeting_dates": (meeting_dates, "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders"),
    "normalize_features": (normalize_features, _FEATURES),
    "public_fields_allowlist": (public_fields_allowlist, "SELECT event_id, 'Status,location' AS keys, json_extract_string(props, '$.k') AS location FROM events"),
    "url_sanitize": (url_sanitize, "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/?#@:][^/?#@]*([/?#]|$)') THEN regexp_replace(url, '[?#].*$', '') END AS public_url FROM pages"),
    "email_hints": (email_hints, _EMAIL),
    "stable_ids": (stable_ids, "SELECT c_custkey, 'submission-' || trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') || '-' || substr(sha256(c_name || '|' || c_nationkey || '|' || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'None' END), 1, 10) AS id FROM customer"),
    "provisional_public_ids": (provisional_public_ids, f"{T.with_sql('observations')} SELECT DISTINCT source_key, record_id, 'record-' || record_id || '-' || substr(sha256(source_key || chr(0) || record_id), 1, 16) AS public_id FROM observations"),
    "source_record_id_validation": (source_record_id_validation, "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'missing' WHEN o_orderkey % 12 = 4 THEN 'not_scalar' WHEN o_orderkey % 6 = 1 THEN 'blank' WHEN o_orderkey % 6 = 2 THEN 'too_long' WHEN o_orderkey % 6 = 3 THEN 'not_finite' END AS problem FROM orders"),
    "content_fingerprints": (content_fingerprints, "SELECT o_orderkey, sha256(o_custkey || chr(31) || CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus ELSE chr(0) END || chr(31) || o_orderpriority) AS fingerprint FROM orders"),
    "chained_digest": (chained_digest, _CHAIN),
    "set_seal_digest": (set_seal_digest, "SELECT l_orderkey, sha256(string_agg(line, chr(10) ORDER BY line)) AS seal, count(*) AS items FROM (SELECT l_orderkey, l_linenumber || ':' || l_partkey || ':' || l_suppkey AS line FROM lineitem) GROUP BY 1"),
    "artifact_keys": (artifact_keys, "SELECT page_id, 'sha256/' || substr(sha256(coalesce(html, '')), 1, 2) || '/' || substr(sha256(coalesce(html, '')), 3, 2) || '/' || sha256(coalesce(html, '')) AS blob_key, octet_length(encode(coalesce(html, ''))) AS bytes, ceil(octet_length(encode(coalesce(html, ''))) / 1024)::BIGINT AS parts, substr(sha256('pages:html:' || url), 1, 24) AS artifact_id FROM pages"),
    "lock_keys": (lock_keys, "SELECT n_name, (CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE v END)::BIGINT AS lock_key FROM (SELECT n_name, ('0x' || substr(sha256(n_name), 1, 8))::BIGINT::HUGEINT * 4294967296 + ('0x' || substr(sha256(n_name), 9, 8))::BIGINT AS v FROM nation)"),
    "excerpts": (excerpts, "SELECT doc_id, nullif(substr(trim(regexp_replace(regexp_replace(text, '[^ -~\\n]', '?', 'g'), '\\s+', ' ', 'g')), 1, 700), '') AS excerpt FROM documents"),
    "json_nesting": (json_nesting, "SELECT event_id, (event_id % 40 * 2 + length(regexp_replace(props, '[^{]', '', 'g')))::INTEGER AS depth, event_id % 40 * 2 + length(regexp_replace(props, '[^{]', '', 'g')) > 32 AS refused FROM events"),
    "label_lookups": (label_lookups, f"{T.with_sql('records')} SELECT public_id, upper(status[1]) || status[2:] AS label, printf('%.1f acres', (e - w) * 100.0::DOUBLE / 4046.8564224::DOUBLE) AS area FROM records"),
    "failure_backoff": (failure_backoff, "SELECT event_id, least(3600, 5 * power(2, least(user_id % 14, 10)))::BIGINT AS seconds, regexp_matches(lpad((event_id % 60000)::VARCHAR, 5, '0'), '^(08|40|53|54|57|58|72|F0)') AS retryable FROM events"),
    "geo_bbox": (geo_bbox, f"{T.with_sql('records')} SELECT public_id, w, s, e, n FROM records"),
    "geo_bbox_distance": (geo_bbox_distance, _BBOX_DISTANCE),
    "geo_centroid_vertex_mean": (geo_centroid_vertex_mean, f"{T.with_sql('records')} SELECT public_id, floor((3 * w + 2 * e) / 5.0 / 1000000.0::DOUBLE * 1000000 + 0.5) / 1000000 AS lon, floor((3 * s + 2 * n) / 5.0 / 1000000.0::DOUBLE * 1000000 + 0.5) / 1000000 AS lat FROM records"),
    "geo_centroid_area": (geo_centroid_area, f"{T.with_sql('records')} SELECT public_id, floor((w + e) / 2.0 / 1000000.0::DOUBLE * 100000 + 0.5) / 100000 AS lon, floor((s + n) / 2.0 / 1000000.0::DOUBLE * 100000 + 0.5) / 100000 AS lat, floor((w + e) / 2.0 / 1000000.0::DOUBLE * 100000 + 0.5) / 100000 AS box_lon, floor((s + n) / 2.0 / 1000000.0::DOUBLE * 100000 + 0.5) / 100000 AS box_lat FROM records"),
    "geo_area": (geo_area, f"{T.with_sql('records')} SELECT public_id, trunc(floor((e - w) / 1000000.0::DOUBLE * 111320 * cos(radians((3 * s + 2 * n) / 5.0::DOUBLE / 1000000.0::DOUBLE)) * ((n - s) / 1000000.0::DOUBLE * 110540) + 0.5) / 10)::BIGINT AS tens_m2, true AS has_area FROM records"),
    "geo_segment_distance": (geo_segment_distance, f"{T.with_sql('records')} SELECT public_id, e - w AS micro FROM records"),
    "geo_polygon_intersects": (geo_polygon_intersects, _TRIANGLES),
    "geo_point_in_polygon": (geo_point_in_polygon, f"{T.with_sql('records')} SELECT public_id, rec_key % 5 + rec_key % 7 % 5 <= 4 AS inside FROM records"),
    "geo_distance": (geo_distance, _DISTANCE),
    "geo_validate_structure": (geo_validate_structure, _STRUCTURE),
    "geo_ring_canonical": (geo_ring_canonical, _CANONICAL),
    "geo_counts": (geo_counts, f"{T.with_sql('records')} SELECT public_id, CASE WHEN rec_key % 2 = 0 THEN 10 ELSE 5 END AS vertices, CASE WHEN rec_key % 2 = 0 THEN 1 ELSE 0 END AS holes, 1 AS components FROM records"),
    "geojson_round_trip": (geojson_round_trip, f"{T.with_sql('records')} SELECT public_id, w, s, CASE WHEN rec_key % 4 < 3 THEN e ELSE w END AS e, CASE WHEN rec_key % 4 < 3 THEN n ELSE s END AS n FROM records"),
    "mercator_transform": (mercator_transform, _MERCATOR),
    "tile_west_edges": (tile_west_edges, "SELECT n_nationkey, (n_nationkey + 1061) / 4096.0::DOUBLE * 360 - 180 AS west FROM nation"),
    "agenda_blocks": (agenda_blocks, f"WITH {_BLOCKS} SELECT doc, block, head, st || ' plat ( ' || p_size || ' lots ) Developer: Dev ' || (k % 9) || ' Engineer: Eng ' || (k % 5) AS body FROM b"),
    "agenda_fields": (agenda_fields, f"WITH {_BLOCKS} SELECT doc, block, array_to_string(list_transform(string_split(lower(head), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title, replace(st, ' and ', ' / ') AS source_status, CASE WHEN st = 'Layout' THEN 'layout' WHEN st = 'Final' THEN 'final' ELSE 'preliminary' END AS normalized_status, p_size AS lot_count, 'Dev ' || (k % 9) AS developer, 'Eng ' || (k % 5) AS engineer, 'low' AS parse_confidence FROM b WHERE st <> 'Discussion'"),
    "agenda_status_precedence": (agenda_status_precedence, f"WITH {_BLOCKS} SELECT CASE WHEN st = 'Layout' THEN 'layout' WHEN st = 'Final' THEN 'final' ELSE 'preliminary' END AS normalized_status, replace(st, ' and ', ' / ') AS source_status, count(*) AS n, sum(p_size)::BIGINT AS lots FROM b WHERE st <> 'Discussion' GROUP BY 1, 2"),
    "agenda_descriptions": (agenda_descriptions, f"WITH {_BLOCKS} SELECT doc, block, 'Planning Commission agenda candidate for ' || lower(replace(st, ' and ', ' / ')) || CASE WHEN p_size > 0 THEN ' with ' || p_size || ' lots' ELSE '' END || '.' AS description FROM b WHERE st <> 'Discussion'"),
    "links_discover": (links_discover, r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["''][^"'']*["''][^>]*>.*?</a>')) AS anchor FROM pages),
l AS (SELECT page_id, regexp_extract(anchor, '(?is)href\s*=\s*["'']([^"'']*)["'']', 1) AS href, lower(trim(regexp_replace(regexp_replace(regexp_replace(anchor, '(?is)^<a\s[^>]*>|</a>$', '', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS label FROM a)
SELECT page_id, count(DISTINCT href) AS links, min(href) AS least FROM l WHERE href <> '' AND contains(label || ' ' || lower(href), '/') AND contains(label || ' ' || lower(href), 'e') AND NOT contains(label || ' ' || lower(href), 'th') GROUP BY 1"""),
}
