"""What must hold when boxes are huge, keys are hot, or chains are long: results stay those of the plain computation."""

import hashlib
import random

import pyspark.sql.functions as F
import pytest

from landsift import scratch
from landsift.functions import pairs
from landsift.operators import reports, review, spatial, tables


def test_large_and_small_boxes_meet_once(spark):
    r = random.Random(1)

    def boxes(n):
        out = []
        for k in range(n):
            w, s, size = r.uniform(-20, 20), r.uniform(-20, 20), r.choice([0.001, 0.5, 5, 60])
            out.append((k, (w, s, w + size * r.random(), s + size * r.random())))
        return out

    left, right = boxes(60), boxes(60)
    schema = "id int, box struct<w:double,s:double,e:double,n:double>"
    for margin in (0.0, 0.3):
        got = spatial.candidate_pairs(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 0.1, margin)
        want = [(i, j) for i, a in left for j, b in right if a[0] - margin <= b[2] and b[0] <= a[2] + margin and a[1] - margin <= b[3] and b[1] <= a[3] + margin]
        assert sorted((x["id"], x["r_id"]) for x in got.collect()) == sorted(want)
    wide = spark.createDataFrame([(0, (-180.0, -90.0, 180.0, 90.0))], schema)
    assert spatial.placed(wide, "box", 0.01, 0.0, True, F.lit(spatial.EVERY_LEVEL)).where("place_.kind = 0").count() < 100


def test_one_box_over_all_adds_no_pairs_of_small_ones(spark):
    """The rows that the join forms, before any test of boxes, stay in proportion when one box covers everything."""
    def side(n, seed, more):
        r = random.Random(seed)
        found = [(k, (x := r.uniform(0, 2000), y := r.uniform(0, 2000), x + 1, y + 1)) for k in range(n)]
        return spark.createDataFrame(found + more, "id int, box struct<w:double,s:double,e:double,n:double>")

    def formed(left, right):
        every = [spatial.owned_levels(df, "box", 10.0) for df in (right, left)]
        a, b = spatial.placed(left, "box", 10.0, 0.0, True, every[0]), spatial.placed(right, "box", 10.0, 0.0, False, every[1])
        return a.join(b, "place_").count()

    over, n = [(-1, (-5.0, -5.0, 2005.0, 2005.0))], 3000
    left, right = side(n, 1, []), side(n, 2, [])
    plain = formed(left, right)
    assert formed(left, side(n, 2, over)) <= plain + 3 * n
    assert formed(side(n, 1, over), side(n, 2, over)) <= plain + 7 * n
    got = spatial.candidate_pairs(left, side(n, 2, over), 10.0)
    assert got.where("r_id = -1").count() == n


def test_no_job_while_a_spatial_join_is_planned(spark):
    boxes = spark.createDataFrame([(0, (0.0, 0.0, 1.0, 1.0))], "id int, box struct<w:double,s:double,e:double,n:double>")
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    spatial.candidate_pairs(boxes, boxes, 1.0).schema  # noqa: B018
    assert set(tracker.getJobIdsForGroup(None)) == before


def test_a_stream_of_records_meets_watches_of_any_size(spark, tmp_path):
    from landsift.streaming import quota

    kind = "public_id string, status string, development_type string, box struct<w:double,s:double,e:double,n:double>"
    records = spark.createDataFrame([(f"r{k}", "final", "x", (k * 0.5, 0.0, k * 0.5 + 0.1, 0.1)) for k in range(40)], kind)
    records.write.parquet(str(tmp_path / "in"))
    watches = spark.createDataFrame([("all", None, None, (-180.0, -90.0, 180.0, 90.0)), ("some", None, None, (1.0, 0.0, 3.0, 1.0)), ("none", ["layout"], None, (0.0, 0.0, 9.0, 9.0))], "watch_id string, statuses array<string>, types array<string>, box struct<w:double,s:double,e:double,n:double>")
    found = quota.alerts(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), watches)
    found.writeStream.format("memory").queryName("met_watches").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {r["watch_id"]: r["count"] for r in spark.table("met_watches").groupBy("watch_id").count().collect()}
    assert got == {"all": 40, "some": 5}


def test_revisions_of_a_hot_key_do_not_depend_on_parts(spark):
    r = random.Random(2)
    rows = [("hot" if k % 3 else None, k, r.choice("abc")) for k in range(500)]
    got = {x["k"]: (x["is_new"], x["revision"]) for x in review.content_revisions(spark.createDataFrame(rows, "source string, k int, print string"), "source", "print", "k").collect()}
    for key in ("hot", None):
        last, n = None, 0
        for s, k, p in rows:
            if s == key:
                n += p != last
                assert got[k] == (p != last, n)
                last = p


def test_rows_are_numbered_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = sorted((x["k"], x["number_"]) for x in tables.numbered_rows(df, "k").collect())
    assert got == [(k, k + 1) for k in range(1000)]


def test_a_band_is_chained_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(reports, "CHAIN", 3)
    rows = [(b, f"f{k:02d}", 4, 2, "x" if k == 3 else None) for b in ("p", "q") for k in range(11)]
    df = spark.createDataFrame(rows, "band string, feature_id string, vertices int, part_count int, error_code string").repartition(3)
    got = {x["band"]: x for x in reports.band_report(df).collect()}
    assert {b: (x["features"], x["parts"], x["failed"]) for b, x in got.items()} == {b: (11, 22, 1) for b in "pq"}
    again = {x["band"]: x["digest"] for x in reports.band_report(df.repartition(5)).collect()}
    assert again == {b: x["digest"] for b, x in got.items()} and again["p"] != again["q"]
    changed = reports.band_report(df.withColumn("vertices", F.when(F.col("feature_id") == "f07", 5).otherwise(F.col("vertices")))).collect()
    assert all(x["digest"] != again[x["band"]] for x in changed)
    assert all(len(d) == len(hashlib.sha256().hexdigest()) for d in again.values())


@pytest.mark.parametrize("rings,fault", [
    ([[(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)]], None),
    ([[(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(0, 0), (3, 1), (1, 3), (0, 0)]], None),  # touches in a corner
    ([[(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(8, 8), (11, 8), (11, 11), (8, 11), (8, 8)]], "rings_cross"),
    ([[(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(20, 20), (21, 20), (21, 21), (20, 20)]], "hole_outside"),
    ([[(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(1, 1), (8, 1), (8, 8), (1, 8), (1, 1)], [(3, 3), (4, 3), (4, 4), (3, 3)]], "holes_nest"),
])
def test_faults_between_rings(rings, fault):
    import numpy as np

    assert pairs.ring_fault([np.array(r, float) for r in rings]) == fault


def test_scratch_tables_can_be_deleted(spark):
    import os

    stored = scratch.stored(spark.range(5).toDF("a"), "test-clear")
    path = stored.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    os.environ.get("KEEP") or scratch.clear(spark)
    assert not os.path.exists(path)


def test_copies_of_shapes_are_compared_once(spark):
    """20,000 copies of a record beside as many of a feature: their pairs would be 400 million. The first in order is told to each record."""
    n, box = 20000, "named_struct('w', 0D, 's', 0D, 'e', 0.001D, 'n', 0.001D)"
    geom = spatial.G.polygon(spatial.G.box_ring(*(F.col(f"box.{c}") for c in "wsen")))
    records = spark.range(n).selectExpr("concat('rec-', id) AS public_id", f"{box} AS box").withColumn("geom", geom)
    features = spark.range(n).selectExpr("CASE id % 2 WHEN 0 THEN 'floodplain' ELSE 'wetlands' END AS category", f"{n} - id AS feature_order", "concat('f-', id) AS feature_id", f"{box} AS box").withColumn("geom", geom)
    got = spatial.flags(records, features).select("public_id", F.transform("proximity_flags", lambda f: f["source_feature_id"]).alias("ids"))
    assert [(r["n"], list(r["ids"])) for r in got.groupBy("ids").agg(F.count(F.lit(1)).alias("n")).collect()] == [(n, [f"f-{n - 2}", f"f-{n - 1}"])]


def test_a_public_id_of_two_shapes_has_one_flag_a_type(spark):
    schema = "public_id string, box struct<w:double,s:double,e:double,n:double>"
    geom = spatial.G.polygon(spatial.G.box_ring(*(F.col(f"box.{c}") for c in "wsen")))
    records = spark.createDataFrame([("a", (0.0, 0.0, 0.001, 0.001)), ("a", (0.1, 0.1, 0.101, 0.101)), ("b", (0.1, 0.1, 0.101, 0.101)), ("c", None)], schema).withColumn("geom", geom)
    features = spark.createDataFrame([(5, "near", (0.0, 0.0, 0.001, 0.001)), (2, "far", (0.1, 0.1, 0.101, 0.101))], "feature_order int, feature_id string, box struct<w:double,s:double,e:double,n:double>").withColumn("geom", geom).withColumn("category", F.lit("floodplain"))
    got = {r["public_id"]: [f["source_feature_id"] for f in r["proximity_flags"]] for r in spatial.flags(records, features).collect()}
    assert got == {"a": ["far"], "b": ["far"]}
