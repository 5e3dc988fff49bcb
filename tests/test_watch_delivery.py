"""Watches' matches over versions, and deliveries over events: table, stream and plain replay agree."""

import math
import random

import pyspark.sql.functions as F
import pytest

from landsift.functions import geometry as G
from landsift.operators import deliveries, watches
from landsift.streaming import outbox

EVENT = "delivery string, seq long, kind string, at long, token long"


def test_matches_enter_stay_exit_and_are_retracted(spark):
    versions = spark.createDataFrame([("a", 1, False), ("a", 2, False), ("a", 3, None), ("a", 4, True), ("a", 5, False), ("b", 1, False), ("c", 1, False), ("c", 2, True)], "key string, version int, retracted boolean")
    matches = spark.createDataFrame([("a", 1, "w"), ("a", 2, "w"), ("a", 2, "v"), ("a", 3, "v"), ("a", 4, "v"), ("a", 5, "v"), ("b", 1, "w"), ("c", 1, "w"), ("c", 2, "w")], "key string, version int, watch_id string")
    got = {(r.key, r.version, r.watch_id): r.transition for r in watches.match_transitions(versions, matches).collect()}
    assert got == {("a", 1, "w"): "enter", ("a", 2, "w"): "stay", ("a", 2, "v"): "enter", ("a", 3, "w"): "exit", ("a", 3, "v"): "stay", ("a", 4, "v"): "retract", ("a", 5, "v"): "enter", ("b", 1, "w"): "enter", ("c", 1, "w"): "enter", ("c", 2, "w"): "retract"}
    states = spark.createDataFrame([("w", "active", 10), ("v", "unsubscribed", 0)], "watch_id string, state string, confirmed_at int")
    occurred = versions.select("key", "version", (F.col("version") * 5).alias("occurred_at"))
    told = watches.notices(watches.match_transitions(versions, matches), states, occurred).collect()
    assert sorted((r.key, r.version, r.transition) for r in told) == [("a", 3, "exit"), ("c", 2, "retract")]


def some_events(seed, n):
    r = random.Random(seed)
    out = []
    for d in range(n):
        at = r.randrange(1000)
        for _ in range(r.randrange(1, 25)):
            at += r.choice([0, 1, 30, 61, 200, 901, 4000])
            kind = r.choices(deliveries.KINDS, [2, 6, 2, 5, 0.4])[0]
            out.append((f"d{d}", len(out), kind, at, r.choice([1, 1, 2])))
    return out


def plain(rows, policy):
    out, state = [], {}
    for d, seq, kind, at, token in sorted(rows, key=lambda r: (r[0], r[3], r[1])):
        state[d], outcome = state.get(d, deliveries.Delivery()).step(kind, at, token, policy)
        out.append((seq, state[d].state, state[d].attempts, outcome))
    return sorted(out)


@pytest.mark.parametrize("policy", [deliveries.Policy(), deliveries.Policy(lease=60, delay=30, longest=100, attempts=2)])
def test_replay_is_that_of_single_steps(spark, policy):
    rows = some_events(1, 120)
    got = deliveries.replay(spark.createDataFrame(rows, EVENT).repartition(3), policy).collect()
    want = plain(rows, policy)
    assert sorted((r.seq, r.state, r.attempts, r.outcome) for r in got) == want
    assert {w[1] for w in want} >= {"queued", "leased", "retry", "sent", "suppressed", *(["dead"] if policy.attempts < 5 else [])}


def test_the_rules_one_by_one():
    p = deliveries.Policy(lease=10, delay=4, longest=6, attempts=2)
    d, _ = deliveries.Delivery().step("queue", 0, 0, p)
    d, _ = d.step("claim", 1, 7, p)
    assert d.step("claim", 5, 8, p)[1] == "refused"  # leased
    assert d.step("sent", 5, 8, p)[1] == "refused" and d.step("sent", 5, 7, p)[0].state == "sent"
    late, outcome = d.step("sent", 11, 7, p)  # the lease ran out at 11
    assert (late.state, late.next_at, outcome) == ("retry", 15, "refused")
    assert late.step("claim", 14, 9, p)[1] == "refused"
    again, _ = late.step("claim", 15, 9, p)
    assert again.step("failed", 16, 9, p)[0].state == "dead" and again.step("unsubscribe", 16, 0, p)[0].state == "suppressed"


def test_a_stream_ends_leases_by_timers(spark, tmp_path):
    policy = deliveries.Policy(lease=60, delay=30, longest=100, attempts=2)
    rows = some_events(2, 40)
    kind = "delivery string, seq long, kind string, ts timestamp, token long"
    cut = sorted({r[3] for r in rows})
    bounds = [-1, cut[len(cut) // 3], cut[2 * len(cut) // 3], cut[-1]]
    for low, high in zip(bounds, bounds[1:]):
        part = [r for r in rows if low < r[3] <= high]
        spark.createDataFrame(part, EVENT).select("delivery", "seq", "kind", F.timestamp_seconds("at").alias("ts"), "token").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("end", -1, "queue", 10**6, 0)], EVENT).select("delivery", "seq", "kind", F.timestamp_seconds("at").alias("ts"), "token").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    outbox.outbox(stream, "0 seconds", policy).writeStream.format("memory").queryName("outbox_told").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = spark.table("outbox_told").collect()
    assert sorted((r.seq, r.state, r.attempts, r.outcome) for r in got if r.seq is not None and r.seq >= 0) == plain(rows, policy)
    timed = [r for r in got if r.kind == "expired"]
    assert timed and all(r.state in ("retry", "dead") for r in timed)


def test_areas_on_the_ellipsoid(one):
    def area(w, s, e, n):
        corners = [(w, s), (e, s), (e, n), (w, n), (w, s)]
        return one(G.geodesic_area_km2(F.array(*[G.point(F.lit(float(x)), F.lit(float(y))) for x, y in corners])))

    # strips between parallels, from the integral of the ellipsoid's radii of curvature
    a, f = 6378.137, 1 / 298.257223563
    e2 = f * (2 - f)
    for s, n in ((0, 1), (30, 31), (34, 35), (60, 62), (-35, -34)):
        steps = 2000
        inner = sum(math.cos(p) / (1 - e2 * math.sin(p) ** 2) ** 2 for p in (math.radians(s + (n - s) * (k + 0.5) / steps) for k in range(steps)))
        want = math.radians(0.01) * a * a * (1 - e2) * inner * math.radians(n - s) / steps
        assert area(10, s, 10.01, n) == pytest.approx(want, rel=1e-6)
    eighth = one(G.geodesic_area_km2(F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (90.0, 0.0), (90.0, 89.9999999), (0.0, 89.9999999), (0.0, 0.0))])))
    assert eighth * 8 == pytest.approx(510065621.724, rel=1e-6)
    big = [G.point(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (0.4516, 0.0), (0.4516, 0.4497), (0.0, 0.4497), (0.0, 0.0))]
    assert one(G.polygon_problem(F.array(F.array(*big)), 2490.0)) == "too_large" and one(G.polygon_problem(F.array(F.array(*big)), 2510.0)) is None
