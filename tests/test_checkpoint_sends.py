"""What checkpoint_codes sends: parts once, and a tree a state of the results. Doubled orders count as in its SQL."""

import hashlib

import duckdb

from landsift.operators import digests as D
from landsift.plans import proofs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_are_sent_once(spark):
    results = spark.createDataFrame([("a", 1, 1, "x")], "band string, position long, part_count int, output_sha256 string")
    parts = spark.createDataFrame([("a", 1, 1, "z")], "band string, position long, part_number int, geometry_sha256 string")
    assert plan(D.part_problems(results, parts)).count("Exchange hashpartitioning") == 2  # parts, results


def test_odd_part_numbers(spark):
    results = [("a", 1, 2, ""), ("a", 2, 3, ""), ("a", 3, None, ""), ("a", 4, 0, ""), ("a", 5, 2, hashlib.sha256(b"1:p\n2:q").hexdigest()), ("a", 6, 1, None)]
    parts = [("a", 1, 1, "p"), ("a", 1, None, "q"), ("a", 2, 1, "p"), ("a", 2, 1, "q"), ("a", 2, 3, "r"), ("a", 3, 1, "p"), ("a", 5, 2, "q"), ("a", 5, 1, "p"), ("a", 6, 1, None)]
    r = spark.createDataFrame(results, "band string, position long, part_count int, output_sha256 string")
    p = spark.createDataFrame(parts, "band string, position long, part_number int, geometry_sha256 string")
    got = {x.position: x.problem for x in D.part_problems(r, p).collect()}
    assert got == {1: "parts_missing", 2: "parts_missing", 3: "parts_missing", 6: "part_changed"}


def tables(tmp_path, doubled):
    con, bands = duckdb.connect(), "['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']"
    con.execute(f"CREATE TABLE orders AS SELECT i::BIGINT AS o_orderkey, (i % 50)::BIGINT AS o_custkey, CASE WHEN i % 2 = 0 THEN 'F' ELSE 'O' END AS o_orderstatus, ({bands})[i % 5 + 1] AS o_orderpriority FROM range(400) r(i)")
    if doubled:
        con.execute("INSERT INTO orders SELECT o_orderkey, o_custkey + 1, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 3 = 0")
    con.execute("CREATE TABLE lineitem AS SELECT i % 420 AS l_orderkey, (i // 420 + 1)::INTEGER AS l_linenumber, i AS l_partkey, i % 7 AS l_suppkey, (i % 5)::DOUBLE AS l_quantity, i * 1.5::DOUBLE AS l_extendedprice FROM range(1500) r(i) WHERE i % 420 % 11 <> 0")
    for t in ("orders", "lineitem"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    return con


def test_codes_of_doubled_orders_and_one_tree_a_state(spark, tmp_path, monkeypatch):
    built, make = [], D.digest_tree
    monkeypatch.setattr(D, "digest_tree", lambda *a: built.append(a) or make(*a))
    for doubled in (False, True):
        folder = tmp_path / str(doubled)
        folder.mkdir()
        con, built[:] = tables(folder, doubled), []
        query, sql = proofs.QUERIES["checkpoint_codes"]
        got = query(spark, str(folder))
        rows = sorted(tuple(r[c] for c in ("band", "code", "bad_features", "resume_at")) for r in got.collect())
        assert rows == sorted(con.execute(f"SELECT band, code, bad_features, resume_at FROM ({sql})").fetchall())
        assert len(built) == 2  # what was built, what is found
