"""A task holds one block of queries and one block of vectors, whatever the bounds let through."""

import numpy as np
from pyspark.sql import functions as F

from landsift.llm import topk


def test_queries_are_dealt_to_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=32).astype(np.float32).tolist()) for i in range(400)]  # nothing is pruned
    solve = topk._solve

    def counting(k):
        run = solve(k)

        def bounded(queries, data):
            if max(queries.num_rows, data.num_rows) > 120:
                raise ValueError(f"{queries.num_rows} queries and {data.num_rows} vectors in a task")
            return run(queries, data)

        return bounded

    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    want = sorted(topk.top_k(df, F.col("vec_id") >= 0, 10, pivots=8, block=10_000).collect())
    monkeypatch.setattr(topk, "_solve", counting)
    assert sorted(topk.top_k(df, F.col("vec_id") >= 0, 10, pivots=8, block=60).collect()) == want
    assert len(want) == 4000
