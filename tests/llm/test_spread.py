"""Weights, ids and sizes that would land in one place: defined results, and spread over shards."""

import pytest
from pyspark.sql import functions as F

from landsift.llm import mixing, topk, warc


def test_missing_and_repeated_weights(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}") for i in range(300)], "doc_id bigint, source string")
    weights = spark.createDataFrame([("s0", 1.0), ("s0", 1.0), ("s1", 1.0), ("s9", 5.0), ("s2", None)], "source string, weight double")
    rates = {r["source"]: r["rate"] for r in mixing.rates(docs, weights).collect()}
    assert rates == pytest.approx({"s0": 300 * 2 / 3 / 100, "s1": 300 / 3 / 100, "s2": 0.0})
    out = mixing.replicate(docs, weights)
    assert out.where("source = 's2'").isEmpty() and out.count() > 200
    none = spark.createDataFrame([], "source string, weight double")
    assert mixing.replicate(docs, none).count() == 0


def test_rows_without_an_id_and_negative_ids_have_shards_like_others(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "sizes", lambda _: (10, 1 << 20, 8, 4))
    rows = [(None, f"u{i}", f"page {i}") for i in range(40)] + [(i - 20, "u", f"text {i}") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    manifest = warc.write(pages, str(tmp_path / "w"), ids_a_shard=10)
    names = [r["name"] for r in manifest.collect()]
    assert sum(n.startswith("none-") for n in names) == 4
    assert sorted(n for n in names if not n.startswith("none-")) == ["0000000000-00000.warc.gz", "0000000001-00000.warc.gz", "m0000000001-00000.warc.gz", "m0000000002-00000.warc.gz"]
    got = sorted((r["page_id"] is None, r["page_id"] or 0, bytes(r["payload"]).decode()) for r in warc.read(manifest, str(tmp_path / "w")).collect())
    assert got == sorted((p is None, p or 0, h) for p, _, h in rows)


def test_sizes_follow_from_the_bytes(spark):
    page = lambda n: spark.range(n).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("x" * 1000).alias("html"))
    assert warc.sizes(page(0)) == (1 << 24, 1 << 20, 8, 1)
    ids, roll, tasks, shards = warc.sizes(page(100_000))
    assert (ids, roll, tasks, shards) == (16384, 1 << 20, 8, 6)


def test_files_roll_by_compressed_size(spark, tmp_path):
    import random

    r = random.Random(3)
    pages = spark.createDataFrame([(i, "u", r.randbytes(20_000).hex()) for i in range(200)], "page_id bigint, url string, html string").repartition(4)
    manifest = warc.write(pages, str(tmp_path / "w")).collect()
    assert len(manifest) > 3 and all((1 << 20) <= m["bytes"] < (1 << 20) + 50_000 for m in sorted(manifest, key=lambda m: m["seq"])[:-1])


def test_vectors_of_the_first_length_only(spark):
    rows = [(100, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [1.0]), (3, [3.0, 1.0]), (3, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.digest(df).orderBy("rank").collect()]
    assert got == [(100, 1, 3, 5 << 20), (100, 2, 3, 5 << 20), (100, 3, 1, 3 << 19)]


def test_sparse_ids_make_no_more_files_than_dense_ones(spark, tmp_path):
    from pyspark.sql import functions as F

    pages = spark.range(20_000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("page "), F.col("id")).alias("html"))
    files = []
    for k, page_id in enumerate((F.col("page_id"), F.xxhash64("page_id"), F.when(F.col("page_id") < 10, F.lit(-(2**62)) + F.col("page_id")).otherwise(F.lit(2**61) + F.col("page_id")))):
        folder = str(tmp_path / f"w{k}")
        manifest = warc.write(pages.withColumn("page_id", page_id), folder)
        files.append(manifest.count())
        assert warc.read(manifest, folder).select("page_id").distinct().count() == 20_000
    assert files[0] == files[1] == files[2]


def test_shards_follow_the_ids(spark):
    ids = [0, 1, 2, 3, 10**15, 10**15 + 1, 10**15 + 2, -(2**63), 2**63 - 1, *range(5000, 5400)]
    df = spark.createDataFrame([(i,) for i in ids], "page_id bigint")
    shards = warc.id_shards(df, 50)
    got = {r.page_id: r.shard for r in warc._with_shard(df, shards).collect()}
    order = [got[i] for i in sorted(ids)]
    assert order == sorted(order) and max(order.count(s) for s in set(order)) <= 50 and len(set(order)) <= 18
    assert warc.id_shards(df.limit(0), 50) == {}
