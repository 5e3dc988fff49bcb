"""One ingestion after another: repeats, unverified context, nothing at all, odd rows."""

import pyspark.sql.functions as F
import pytest

from landsift.functions import geometry as G
from landsift.operators import ingest

FEATURE = "source string, properties map<string,string>, geometry_json string"
FETCHED = "key string, status string, reported_count long, declared string"


@pytest.fixture
def context(spark):
    rows = spark.createDataFrame([("floodplain", 1, "f1", 0.0, 0.0, 2.0, 2.0)], "category string, feature_order long, feature_id string, w double, s double, e double, n double")
    return rows.withColumn("box", F.struct("w", "s", "e", "n")).withColumn("geom", G.polygon(G.box_ring(*[F.col(c) for c in "wsen"]))).select("category", "feature_order", "feature_id", "geom", "box")


def permit(number, at="[1.0,1.0]", **more):
    return ("city_permits", {"PermitID": number, **more} if number else {**more}, '{"type":"Point","coordinates":%s}' % at)


def told(tables):
    return {(r.record_id, r.change) for r in tables["registry"].collect()}


def test_runs_follow_each_other(spark, context, tmp_path):
    fetched = spark.createDataFrame([("city_permits", "healthy", None, "complete")], FETCHED)
    run = lambda rows, n, before=None, **k: ingest.ingest(spark.createDataFrame(rows, FEATURE), context, fetched, f"2024-01-0{n}T00:00:00Z", str(tmp_path / str(n)), before and str(tmp_path / str(before)), **k)
    first = run([permit("1"), permit("2", "[50.0,1.0]"), permit("3"), permit("3"), permit(None), ("city_permits", None, None), ("unknown", {"PermitID": "9"}, None)], 1)
    assert told(first) == {("1", "inserted"), ("2", "inserted")}
    assert {(r.record_id, r.problem) for r in first["quarantined"].collect()} == {("3", "duplicate_anchor"), (None, "missing")}
    h = first["health"].first()
    assert (h.status, h.coverage, h.records_seen, h.quarantined_count, h.records_created, h.flags, h.missing) == ("healthy", "partial", 6, 4, 2, 1, 0)
    again = run([permit("1"), permit("2", "[50.0,1.0]")], 2, 1)
    assert told(again) == {("1", "seen"), ("2", "seen")} and again["health"].first().coverage == "complete"
    later = run([permit("1", OccupancyType="Single"), permit("4")], 3, 2)
    assert told(later) == {("1", "changed"), ("2", "kept"), ("4", "inserted")}
    assert [r.record_id for r in later["missing"].collect()] == ["2"]
    kept = {r.record_id: (r.discovered_on, r.last_seen_on, r.title) for r in later["records"].collect()}
    assert kept == {"1": ("2024-01-01", "2024-01-03", "Single"), "2": ("2024-01-01", "2024-01-02", "Building Permit 2"), "4": ("2024-01-03", "2024-01-03", "Building Permit 4")}
    unsure = run([permit("1", OccupancyType="Other")], 4, 3, context_verified=False)
    assert told(unsure) == {("1", "kept"), ("2", "kept"), ("4", "kept")}
    assert ingest.overall(unsure["health"]).first().status == "degraded" and unsure["missing"].count() == 0
    ids = lambda t: {r.record_id: r.public_id for r in t["records"].collect()}
    assert ids(unsure) == ids(later) and ids(later)["1"].startswith("city-permit-1-")


def test_nothing_comes(spark, context, tmp_path):
    fetched = spark.createDataFrame([("city_permits", "failing", None, None), ("city_subdivisions", "healthy", 4, None)], FETCHED)
    got = ingest.ingest(spark.createDataFrame([], FEATURE), context, fetched, "2024-01-01T00:00:00Z", str(tmp_path / "1"))
    assert {(r.key, r.status, r.coverage, r.error_count) for r in got["health"].collect()} == {("city_permits", "failing", "failed", 1), ("city_subdivisions", "healthy", "partial", 0)}
    assert got["records"].count() == 0 and got["registry"].count() == 0
