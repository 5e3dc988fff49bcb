"""Queries of zero vectors, and groups with fewer than k + 1 vectors."""

import numpy as np
from pyspark.sql import functions as F

from landsift.llm import topk


def brute(rows, k, every):
    v = {i: np.floor(1024 * np.array(x, np.float32).astype(np.float64)).astype(np.int64) for i, x in rows}
    found = {q: sorted((-int(v[q] @ v[x]), x) for x in v if x != q)[:k] for q in v if q % every == 0}
    return sorted((q, r + 1, x, -s) for q, best in found.items() for r, (s, x) in enumerate(best))


def test_zero_queries_keep_their_results(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) + 9 * (i % 3)).astype(np.float32).tolist()) for i in range(1, 90)]
    rows += [(200 + i, (1000.0 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(4)]  # outliers: small groups
    rows += [(i, [0.0] * 8) for i in (100, 120, 140)]
    for chosen in (rows, rows[-5:]):
        df = spark.createDataFrame(chosen, "vec_id bigint, embedding array<float>")
        for options in ({"pivots": 16, "block": 10}, {"pivots": 200}):
            got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 10, **options).collect())
            assert got == brute(chosen, 10, 20)
