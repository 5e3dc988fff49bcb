"""Near-dedup where ids repeat, texts are long, and keys are frequent."""

import random

import numpy as np
from pyspark.sql import functions as F

from landsift.llm import near
from landsift.llm.common import told


def test_texts_of_one_id_are_one_document(spark):
    r = random.Random(2)
    a, b, c = (" ".join(f"{x}{r.randrange(300)}" for _ in range(60)) for x in "abc")
    rows = [(1, a), (2, b), (3, c), (7, a), (7, b), (9, b + " more"), (8, "alone words here"), (8, "alone words here")]
    got = sorted((x["doc_id"], x["component_id"], x["kept"]) for x in near.components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(1, 1, True), (2, 1, False), (3, 3, True), (7, 1, False), (7, 1, False), (8, 8, True), (8, 8, True), (9, 1, False)]


def test_frequent_keys_are_told_like_others(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 400).alias("key"), "id")
    one = near.stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("m")).where("key <> 5"), "test-told")
    got = told(rows, one, ["key"])
    assert got.count() == rows.where("key <> 5").count()
    assert got.exceptAll(rows.join(one, "key").select(got.columns)).isEmpty()


def test_signatures_of_runs_are_those_of_the_whole(monkeypatch):
    rng = np.random.default_rng(3)
    h, sizes = rng.integers(0, 2**63, 5000).astype(np.uint64), np.array([0, 10, 2990, 1, 1999, 0])
    whole = near.superminhash(h, sizes)
    monkeypatch.setattr(near, "RUN", 700)
    assert (near.superminhash(h, sizes) == whole).all()


def test_a_text_of_megabytes_and_its_near_copy(spark):
    words = [f"w{i % 70_000}x{i % 11}" for i in range(300_000)]
    other = list(words)
    other[1000:1100] = ["changed"] * 100
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "short")], "doc_id bigint, text string")
    got = sorted((x["doc_id"], x["component_id"]) for x in near.components(df).collect())
    assert got == [(1, 1), (2, 1), (3, 3)]
