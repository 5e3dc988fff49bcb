"""Mixing, WARC, top-k search, the pipeline and the registered queries."""

import gzip
import hashlib
import math
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from landsift.llm import mixing, queries, topk, warc

SF = "/root/testdata/sf0.001"


def test_rates_meet_the_weights(documents):
    r = {x["source"]: x["rate"] for x in mixing.rates(documents).collect()}
    n = {x["source"]: x["count"] for x in documents.groupBy("source").count().collect()}
    total = sum(n.values())
    assert sum(r[s] * n[s] for s in n) == pytest.approx(total)
    assert r["s0"] * n["s0"] / (r["s1"] * n["s1"]) == pytest.approx(math.sqrt(n["s0"] / n["s1"]))


def test_copies_follow_a_poisson_distribution(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 10 == 0, "rare").otherwise("often").alias("source"))
    weights = spark.createDataFrame([("rare", 1.0), ("often", 1.0)], "source string, weight double")
    counts = mixing.replicate(df, weights).groupBy("doc_id", "source").count().toPandas()
    rare = np.concatenate((counts[counts.source == "rare"]["count"], np.zeros(2000 - (counts.source == "rare").sum())))
    assert abs(rare.mean() - 5) < 0.25 and abs(rare.var() - 5) < 0.6
    again = mixing.replicate(df.repartition(7), weights).groupBy("doc_id", "source").count().toPandas()
    assert sorted(map(tuple, again.values.tolist())) == sorted(map(tuple, counts.values.tolist()))


def test_large_rates_are_sums(spark):
    df = spark.range(4).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "a").otherwise("b").alias("source"))
    out = mixing.replicate(df, spark.createDataFrame([("a", 1.0), ("b", 0.0)], "source string, weight double"), epochs=500.0)
    n = out.count()
    assert out.where("source = 'b'").count() == 0 and abs(n - 2000) < 250


def test_mixing_stands_odd_rows(documents, empty, clashing, spark):
    assert mixing.mixed(empty).count() == 0
    out = mixing.mixed(clashing)
    assert {"copy_no", "mix_key"} <= set(out.columns) and out.count() > 0
    odd = spark.createDataFrame([(None, None, None), (1, "", None)], "doc_id bigint, text string, source string")
    assert set(mixing.replicate(odd, epochs=20.0).select("source").distinct().collect()) == {(None,)}
    keys = [r["mix_key"] for r in mixing.mixed(documents).collect()]
    assert keys == sorted(keys)


def pages(spark):
    body = "<p>" + "x" * 1200 + "</p>"
    rows = [(5, "http://a/5", body), (9, "http://a/9", body), (2, "http://a/2\r\nX: y", body), (3, None, "short"), (4, "u", "short"), (7, "u", None), (8, "u", "é" * 600), (4001, "u", ""), (None, "u", body), (9, "http://a/9", body), (11, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 100)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_warc_round_trip(spark, tmp_path):
    df = pages(spark).withColumn("shard", F.lit("clash")).withColumn("payload", F.lit("clash"))
    folder = str(tmp_path / "warc")
    manifest = warc.write(df, folder, roll=1)
    got = warc.read(manifest, folder).collect()
    assert len(got) == df.count() and not list(Path(folder, "_temporary").iterdir())
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    for p, html in [(r["page_id"], (r["html"] or "").encode()) for r in df.collect()]:
        assert all(r["payload_bytes"] == len(html) and r["payload_digest"] == hashlib.sha1(html).hexdigest() for r in by[p])
    assert [(r["record_type"], r["refers_to"]) for p in (2, 3, 4, 5, 7, 8, 11, None) for r in by[p]] == [("revisit", 9), ("response", None), ("response", None), ("revisit", 9), ("response", None), ("response", None), ("response", None), ("response", None)]
    assert sorted(r["record_type"] for r in by[9]) == ["response", "revisit"]
    assert {bytes(r["payload"]) for r in by[11]} == {b"\r\n\r\nWARC/1.1\r\n\r\n" * 100}
    names = sorted(x["name"] for x in manifest.collect())
    again = str(tmp_path / "again")
    twice = warc.write(df.repartition(5), again, roll=1)
    assert sorted(x["name"] for x in twice.collect()) == names
    for n in names:
        assert Path(folder, n).read_bytes() == Path(again, n).read_bytes()
        assert gzip.decompress(Path(folder, n).read_bytes()).startswith(b"WARC/1.1\r\n")
    broken = Path(folder, names[0])
    broken.write_bytes(broken.read_bytes()[:-10])
    with pytest.raises(Exception, match="ends within|zlib|Error"):
        warc.read(manifest, folder).collect()


def test_warc_of_no_pages(spark):
    assert warc.archived(pages(spark).limit(0)).count() == 0


def brute_top_k(rows, k, every):
    v = {i: np.floor(1024 * np.array(x, dtype=np.float32).astype(np.float64)).astype(np.int64) for i, x in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)}
    out = []
    for q in v:
        if q % every == 0:
            best = sorted((-int(v[q] @ v[x]), x) for x in v if x != q)[:k]
            out += [(q, r + 1, x, -s) for r, (s, x) in enumerate(best)]
    return sorted(out)


def test_top_k_is_that_of_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16))
    rows = [(i, (centres[i % 8] + 0.1 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(600)]
    rows += [(700 + i, rows[0][1]) for i in range(50)]  # equal vectors: ties
    rows += [(900, None), (901, [float("nan")] * 16), (902, [None] + [0.0] * 15), (903, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("v", F.lit("clash")).withColumn("block", F.lit(1))
    for options in ({"pivots": 16, "block": 40}, {"pivots": 1}, {"pivots": 500, "block": 3}):
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 10, **options).collect())
        assert got == brute_top_k(rows, 10, 20)


def test_top_k_of_few_or_no_rows(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert topk.digest(spark.createDataFrame([], schema)).count() == 0
    assert topk.digest(spark.createDataFrame([(0, [1.0, 2.0])], schema)).count() == 0
    assert topk.digest(spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.0, -1.0])], schema)).collect()[0]["score"] == -2 * 1024 * 1024


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_pipeline(spark):
    """Its first and later stages against brute force, stage by stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert clean.columns == docs.columns
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in clean.collect()}
    assert len(gone - toxic) <= 0.02 * docs.count()
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "source", "n_tokens", "token_ids"]
    rows = out.collect()
    assert rows and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in clean.collect()}
    assert all(r["n_tokens"] == len(r["token_ids"]) for r in rows)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_give_the_rows_of_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    names = sorted(d[0] for d in cursor.description)
    at = [[d[0] for d in cursor.description].index(n) for n in names]
    theirs = sorted(tuple(str(r[i]) for i in at) for r in cursor.fetchall())
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == names
    assert sorted(tuple(str(r[n]) for n in names) for r in got.collect()) == theirs


def test_every_operator_has_its_query():
    names = queries.queries()
    assert len([n for n in names if n.startswith("op")]) == 13 and "pipeline" in names
