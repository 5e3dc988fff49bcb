"""Digest trees and checkpoints against plain computations; each kind of damage has its own code."""

import hashlib

import pytest

from landsift.operators import digests as D


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves, fan):
    top, out = max(p for p, _ in leaves), []
    nodes, level, reach = [(p, 1, d or "") for p, d in leaves], 0, 1
    while level == 0 or reach <= top:
        level, reach = level + 1, reach * fan
        groups = {}
        for p, n, d in nodes:
            groups.setdefault(p // fan, []).append((p, n, d))
        nodes = [(k, sum(n for _, n, _ in g), sha("\n".join(f"{p}:{d}" for p, _, d in sorted((p, n, d) for p, n, d in g)))) for k, g in groups.items()]
        out += [(level, *n) for n in nodes]
    return sorted(out)


LEAVES = [(k * 3, sha(str(k))) for k in range(300)] + [(2**53 + 1, None)]


@pytest.mark.parametrize("leaves", [LEAVES, LEAVES[:1], LEAVES[:90]])
def test_tree_is_that_of_a_plain_computation(spark, leaves):
    rows = spark.createDataFrame([("k", *r) for r in leaves], "key string, position long, digest string").repartition(5)
    got = D.digest_tree(rows, ["key"], 16).collect()
    assert sorted((r.level, r.position, r.rows, r.digest) for r in got) == plain_tree(leaves, 16)


def test_no_leaves_no_tree(spark):
    rows = spark.createDataFrame([], "key string, position long, digest string")
    assert D.digest_tree(rows, ["key"]).count() == 0


def build(spark, n=100):
    """Results and parts of two bands; every seventh feature has no parts."""
    results, parts = [], []
    for band in "ab":
        for k in range(1, n + 1):
            made = [] if k % 7 == 0 else [sha(f"{band}{k}.{i}") for i in range(1, k % 4 + 2)]
            parts += [(band, k, i, d) for i, d in enumerate(made, 1)]
            results.append((band, k, len(made), k % 5 == 0, "hole_lost" if not made else None, sha("\n".join(f"{i}:{d}" for i, d in enumerate(made, 1)))))
    return results, parts


RESULT = "band string, position long, part_count int, collapsed boolean, error_code string, output_sha256 string"
PART = "band string, position long, part_number int, geometry_sha256 string"


def changed(rows, at, **new):
    names = [f.split()[0] for f in RESULT.split(", ")]
    return [tuple(new.get(c, v) for c, v in zip(names, r, strict=True)) if r[:2] == at else r for r in rows]


CASES = {
    None: lambda r, p: (r, p),
    "checkpoint_result_count_mismatch": lambda r, p: ([x for x in r if x[:2] != ("a", 40)], [x for x in p if x[:2] != ("a", 40)]),
    "checkpoint_feature_id_mismatch": lambda r, p: (changed(r, ("a", 100), position=101), [x if x[:2] != ("a", 100) else ("a", 101, *x[2:]) for x in p]),
    "checkpoint_checksum_mismatch": lambda r, p: (changed(r, ("a", 40), output_sha256=sha("other")), p),
    "checkpoint_part_count_mismatch": lambda r, p: (changed(r, ("a", 41), part_count=7), p),
    "checkpoint_collapse_count_mismatch": lambda r, p: (changed(r, ("a", 40), collapsed=False), p),
    "checkpoint_failure_count_mismatch": lambda r, p: (changed(r, ("a", 42), error_code=None), p),
    "checkpoint_parts_mismatch": lambda r, p: (r, p[1:]),
}


@pytest.mark.parametrize("code", CASES, ids=str)
def test_each_damage_has_its_code(spark, code):
    results, parts = build(spark)
    noted = D.checkpoints(spark.createDataFrame(results, RESULT), 8)
    r, p = CASES[code](results, parts)
    got = {x.band: x.code for x in D.checkpoint_problems(spark.createDataFrame(r, RESULT), spark.createDataFrame(p, PART), noted, 8).collect()}
    assert got == {"a": code, "b": None}


def test_bands_without_checkpoint_or_results(spark):
    results, parts = build(spark)
    frame, made = spark.createDataFrame(results, RESULT), spark.createDataFrame(parts, PART)
    noted = D.checkpoints(frame, 8)
    got = {x.band: x.code for x in D.checkpoint_problems(frame.where("band = 'a'"), made, noted.where("band = 'b'"), 8).collect()}
    assert got == {"a": "checkpoint_missing", "b": "checkpoint_result_count_mismatch"}


def test_problems_of_parts(spark):
    results, parts = build(spark, 8)
    odd = [x for x in parts if x[:3] != ("a", 2, 2)] + [("a", 7, 1, "z"), ("a", 99, 1, "z"), ("a", 1, 1, parts[0][3])]
    odd = [("a", 3, x[2], "z") if x[:3] == ("a", 3, 1) else x for x in odd]
    got = {(x.position, x.problem) for x in D.part_problems(spark.createDataFrame(results, RESULT), spark.createDataFrame(odd, PART)).collect()}
    assert got == {(1, "parts_missing"), (2, "parts_missing"), (3, "part_changed"), (7, "parts_missing"), (99, "orphan_parts")}


def test_ranges_that_differ_and_where_to_go_on(spark):
    results, _ = build(spark)
    leaf = lambda rows: D.digest_tree(spark.createDataFrame(rows, RESULT).selectExpr("band", "position", "output_sha256 as digest"), ["band"], 8)
    noted = D.checkpoints(spark.createDataFrame(results, RESULT), 8)
    now = [x for x in changed(results, ("a", 40), output_sha256="z") if x[:2] != ("a", 90)] + [("a", 101, 0, False, None, "n")]
    then = leaf(results)
    got = sorted(tuple(x) for x in D.differing_ranges(then, leaf(now), ["band"], 8).collect())
    assert got == [("a", 40, 47, "changed"), ("a", 88, 95, "lost"), ("a", 96, 103, "added")]
    assert {x.band: x.resume_at for x in D.resume_positions(then, leaf(now), noted, 8).collect()} == {"a": 40, "b": 101}
