"""The factorization machine against plain arithmetic, and pairs that lean to a label only together."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from landsift.llm import toxicity
from landsift.llm.features import WordTable, labelled_sample


def test_margins_are_those_of_all_pairs():
    rng = np.random.default_rng(1)
    lists = [rng.choice(50, n, replace=False) for n in (0, 1, 2, 7, 0, 20)]
    model = {"w0": 0.3, "w": rng.normal(size=1 << toxicity.BITS).astype(np.float32), "v": rng.normal(size=(1 << toxicity.BITS, toxicity.FACTORS)).astype(np.float32)}
    got = toxicity.margins(model, np.concatenate(lists).astype(np.int64), np.array([len(x) for x in lists]))
    for x, g in zip(lists, got):
        pairs = sum(float(model["v"][i] @ model["v"][j]) for k, i in enumerate(x) for j in x[k + 1 :])
        assert g == pytest.approx(0.3 + sum(float(model["w"][i]) for i in x) + min(1, toxicity.PAIRED / max(len(x), 1)) * pairs, abs=1e-4)


def texts(seed, n):
    """Each of four terms stands in 4 of 100 rows and is toxic in half of them: only the pairs tell which."""
    r, out = random.Random(seed), []
    for _ in range(n):
        w = [f"w{r.randrange(500)}" for _ in range(10)]
        kind = int(r.random() * 50)
        if kind < 4:
            w[3], w[7] = (("axe", "bow"), ("dog", "cow"), ("axe", "cow"), ("dog", "bow"))[kind]
        out.append((" ".join(w), float(kind < 2)))
    return out


def test_rare_pairs_are_learned():
    rows = texts(1, 8000)
    found = lambda part: toxicity.terms([t for t, _ in part], WordTable(toxicity._buckets))
    y = np.array([x for _, x in rows])
    model = toxicity.fit(*found(rows[:6000]), y[:6000])
    told = toxicity.margins(model, *found(rows[6000:])) >= 0
    assert (told & (y[6000:] == 1)).sum() / y[6000:].sum() > 0.9
    assert (told & (y[6000:] == 0)).mean() < 0.01
    # weights alone can't say it
    plain = toxicity.margins(model | {"v": np.zeros_like(model["v"])}, *found(rows[6000:])) >= 0
    assert (plain == y[6000:]).mean() < (told == y[6000:]).mean()


def test_the_sample_is_bounded_under_repeated_ids(spark):
    docs = spark.createDataFrame([(i % 7, f"text {i}") for i in range(300)] + [(3, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)] * 2, "doc_id bigint, toxic int")
    rows = labelled_sample(docs, labels, "toxic", lambda i: F.lit(True), 5).collect()
    assert len(rows) == 5 and len({r["doc_id"] for r in rows}) == 5
    assert all(r["text"] == ("" if r["doc_id"] == 3 else min(f"text {i}" for i in range(r["doc_id"], 300, 7))) for r in rows)


def test_terms_bound_the_sample_too(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(50))) for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    assert toxicity.train(docs, labels, lambda i: F.lit(True), max_terms=500)["w"].shape == (1 << toxicity.BITS,)


def test_a_text_of_megabytes(spark):
    long = " ".join(f"w{i % 4000}" for i in range(600_000))
    docs = spark.createDataFrame([(1, long), (2, "short"), (2, "short")], "doc_id bigint, text string")
    out = toxicity.scores(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id bigint, toxic int")).collect()
    assert len(out) == 3 and all(0 <= r["score"] <= 1 for r in out)
