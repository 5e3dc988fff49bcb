"""An import that is stopped and goes on gives what one that isn't stopped gives."""

import random

import pyspark.sql.functions as F
import pytest

from landsift.operators import reports
from landsift.streaming import imports

SCHEMA = "source string, identity string, content string, ordinal long"


def staged(spark, folder, batches=5, each=60):
    r = random.Random(4)
    rows = [("R" if r.random() < 0.1 else "A", None if r.random() < 0.02 else f"k{r.randrange(90)}", r.choice("xyz"), n) for n in range(batches * each)]
    for k in range(batches):
        spark.createDataFrame(rows[k * each : (k + 1) * each], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return rows


def plain(rows):
    known, out = {}, []
    for source, identity, content, n in rows:
        if source == "R" or identity is None:
            out.append((n, "rejected"))
        elif identity not in known:
            known[identity] = content
            out.append((n, "accepted"))
        else:
            out.append((n, "duplicate" if known[identity] == content else "conflict"))
    return out


@pytest.mark.parametrize("stops", [[], [0], [2], [1, 1, 3], [4]])
def test_stopped_and_resumed(spark, tmp_path, stops):
    rows = staged(spark, str(tmp_path / "in"))
    schema, target, valid = spark.read.parquet(str(tmp_path / "in")).schema, str(tmp_path / "out"), F.col("source") != "R"

    def stopping(at):
        def watch(number):
            if number == at:
                raise RuntimeError("stopped before its commit")

        return watch

    for at in stops:
        with pytest.raises(Exception, match="stopped before its commit"):
            imports.run(spark, str(tmp_path / "in"), schema, target, valid, watch=stopping(at))
    got = imports.run(spark, str(tmp_path / "in"), schema, target, valid)
    assert sorted((r.ordinal, r.fate) for r in got.collect()) == plain(rows)
    assert got.select("batch").distinct().count() == 5
    again = imports.run(spark, str(tmp_path / "in"), schema, target, valid)  # nothing is left to do
    assert sorted((r.ordinal, r.fate) for r in again.collect()) == plain(rows)
    counts = {r.source: r for r in imports.report(got).collect()}
    assert counts["R"].status == "failed" and sum(r.seen for r in counts.values()) == len(rows)
    whole = reports.import_rows(spark.createDataFrame(rows, SCHEMA), "identity", "content", "ordinal", (F.col("source") != "R") & F.col("identity").isNotNull())
    assert sorted((r.ordinal, r.fate) for r in whole.collect()) == plain(rows)


def test_files_that_come_later_are_imported_later(spark, tmp_path):
    first = staged(spark, str(tmp_path / "in"), 2)
    schema, target, valid = spark.read.parquet(str(tmp_path / "in")).schema, str(tmp_path / "out"), F.lit(True)
    imports.run(spark, str(tmp_path / "in"), schema, target, valid, files_a_batch=10)
    more = [("A", "k1", "new", 1000), ("A", "unseen", "x", 1001)]
    spark.createDataFrame(more, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = imports.run(spark, str(tmp_path / "in"), schema, target, valid)
    assert {r.ordinal: r.fate for r in got.collect() if r.ordinal >= 1000} == {1000: "conflict", 1001: "accepted"}
    assert got.count() == len(first) + 2


def test_python_is_called_by_slices_of_identities(spark, tmp_path):
    """Five thousand identities in two batches, one call of Python a slice and batch: with one an identity there would be as many groups as identities."""
    spark.range(10000).select(F.lit("A").alias("source"), F.concat(F.lit("k"), F.col("id") % 5000).alias("identity"), F.when(F.col("id") < 9000, "x").otherwise("y").alias("content"), F.col("id").alias("ordinal")).repartitionByRange(2, "ordinal").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    kept, imports.SLICES = imports.SLICES, 16
    try:
        got = imports.run(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), F.lit(True))
    finally:
        imports.SLICES = kept
    assert {r.fate: r["count"] for r in got.groupBy("fate").count().collect()} == {"accepted": 5000, "duplicate": 4000, "conflict": 1000}
    state = spark.read.format("statestore").load(str(tmp_path / "out" / "checkpoint"))
    assert state.count() <= 16


def test_an_import_of_many_files_has_the_fates_of_its_order(spark, tmp_path):
    """Lines in files that aren't in the order of their dates: with one file as the first batch, later lines came before earlier ones."""
    from landsift.plans import files

    lines = spark.range(4000).select(F.col("id").alias("n"), (F.col("id") % 40).alias("k")).select(
        F.col("k").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("n") % 3).alias("l_partkey"), F.lit(1).alias("l_suppkey"),
        F.expr("timestamp'1992-01-01' + make_interval(0, 0, 0, cast(n * 7919 % 2500 AS int))").alias("l_shipdate"),
        F.when(F.col("k") % 5 == 0, "R").otherwise(F.when(F.col("n") % 2 == 0, "A").otherwise("N")).alias("l_returnflag"), F.lit(1.0).alias("l_quantity"), F.col("n").cast("double").alias("l_extendedprice"))
    folder = str(tmp_path / "sf")
    lines.repartition(16).write.parquet(f"{folder}/lineitem.parquet")
    import duckdb

    got = files.import_resumed(spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    assert sorted((r.source, r.fate, r.rows, r.identities) for r in got.collect()) == sorted(con.execute(f"SELECT source, fate, rows, identities FROM ({files._RESUMED})").fetchall())


def test_contents_are_kept_short(spark, tmp_path):
    """Short contents are kept as they are, long ones as 32 bytes; both tell duplicates from conflicts over batches."""
    long = "x" * 40
    batches = [[("A", "a", "p|1", 1), ("A", "b", long + "1", 2), ("A", "c", None, 3)], [("A", "a", "p|1", 4), ("A", "a", "p|2", 5), ("A", "b", long + "1", 6), ("A", "b", long + "2", 7), ("A", "c", "", 8)]]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = imports.run(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, str(tmp_path / "out"), F.lit(True))
    rows = {r.ordinal: r for r in got.collect()}
    assert {n: r.fate for n, r in rows.items()} == {1: "accepted", 2: "accepted", 3: "accepted", 4: "duplicate", 5: "conflict", 6: "duplicate", 7: "conflict", 8: "duplicate"}
    assert bytes(rows[1].content) == b"p|1" and {len(rows[n].content) for n in (2, 6, 7)} == {32}


def test_numbered_rows_are_dealt_once(spark):
    from landsift.operators import tables

    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(7)
    got = tables.numbered_rows(rows, "k")
    assert [r.number_ for r in got.orderBy("k").collect()] == list(range(1, 5001))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window") == 1  # over the parts, not over the rows
