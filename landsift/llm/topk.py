"""Exact top-k search: a Voronoi kNN join.

Pivots are a bounded sample of the vectors. Each vector joins the group of its nearest pivot. A
group's summary is its pivot, its size, its largest distance and its k + 1 smallest distances. By
Cauchy and Schwarz the inner product of query q with vector x of pivot p lies within |q| * |x - p|
of q * p; so the summaries give each query a score that its k-th best reaches at least, and a query
is sent only to groups whose upper bound reaches it. A group of more than ``block`` vectors is dealt
to blocks by a hash of the id, so no task holds a whole hot group; the queries are dealt to blocks in
the same way, and a task holds one block of queries and one of vectors. Each block is solved locally with
integer products, and the partial lists of a query are merged.

Rows: vectors that are null, hold null or non-finite components, or have another length than the
first valid vector by id take no part. Ties go to the smaller vec_id, then to repeated rows as they
are. Rows with a null id take no part: they couldn't be named in a result.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landsift.llm.common import stored

SCALE, MOST_PIVOTS = 1024, 8192


def _scaled(vectors: DataFrame) -> DataFrame:
    """vec_id, v: whole numbers floor(SCALE * component) of valid vectors."""
    v = F.col("embedding")
    good = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x, pivots = x.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(axis=1), 0))


def _assign(shared):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                d = _distances(_matrix(batch.column("v")), shared.value)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(d[np.arange(len(near)), near])], names=[*batch.schema.names, "group", "distance"])

    return run


def _nearest(k: int):
    """Partial summaries: of each group in a part, size, largest distance and its k + 1 smallest."""

    def run(batches):
        held = {}
        for batch in batches:
            group, d = batch.column("group").to_numpy(), batch.column("distance").to_numpy()
            for g in np.unique(group):
                own = np.sort(d[group == g])
                n, most, least = held.get(g, (0, 0.0, np.zeros(0)))
                held[g] = n + len(own), max(most, own[-1]), np.sort(np.concatenate((least, own[: k + 1])))[: k + 1]
        if held:
            yield pa.record_batch({"group": pa.array(list(held), pa.int32()), "n": pa.array([x[0] for x in held.values()], pa.int64()), "most": pa.array([x[1] for x in held.values()], pa.float64()), "least": pa.array([x[2].tolist() for x in held.values()], pa.list_(pa.float64()))})

    return run


def _route(shared, k: int):
    """(query, block) for each block whose bound reaches what the query's k-th best has at least."""

    def run(batches):
        pivots, n, most, least, blocks = shared.value
        first = np.concatenate(([0], np.cumsum(blocks)[:-1]))
        known = np.where(np.isfinite(least), least, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column("v")).astype(np.float64)
            length = np.sqrt((q * q).sum(axis=1))
            middle = q @ pivots.T.astype(np.float64)
            rows, targets = [], []
            for i in range(len(q)):
                floors = np.where(np.isfinite(least), middle[i][:, None] - length[i] * known, -np.inf).ravel()  # -inf where a group has fewer vectors
                # one more than k: the query itself may be among them
                floor = np.partition(floors, len(floors) - k - 1)[len(floors) - k - 1] if len(floors) > k else -np.inf
                slack = 1e-6 * (1 + length[i] * (np.abs(most).max() + 1)) + 1e-3
                for g in np.flatnonzero((middle[i] + length[i] * most + slack >= floor) & (n > 0)):
                    targets.append(first[g] + np.arange(blocks[g]))
                    rows.append(np.full(blocks[g], i))
            if not rows:
                continue
            rows, targets = np.concatenate(rows), np.concatenate(targets)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), batch.column("v").take(pa.array(rows)), pa.array(targets, pa.int64())], names=["vec_id", "v", "block"])

    return run


def _solve(k: int):
    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if queries.num_rows and data.num_rows:
            q, x = _matrix(queries.column("v")), _matrix(data.column("v"))
            qid, xid = queries.column("vec_id").to_numpy(), data.column("vec_id").to_numpy()
            order = np.argsort(xid, kind="stable")
            x, xid = x[order], xid[order]
            exact = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * x.shape[1] < 2**52  # then doubles hold the products exactly
            for a in range(0, len(q), 256):
                part = q[a : a + 256]
                scores = (part.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if exact else part @ x.T
                for i in range(len(part)):
                    own = scores[i]
                    take = min(len(own), k + 1)
                    least = np.partition(own, len(own) - take)[len(own) - take]
                    at = np.flatnonzero(own >= least)
                    at = at[xid[at] != qid[a + i]]
                    at = at[np.argsort(-own[at], kind="stable")][:k]
                    if len(at) < min(k, int((xid != qid[a + i]).sum())):  # the query's id stands in several rows
                        at = np.flatnonzero(xid != qid[a + i])
                        at = at[np.argsort(-own[at], kind="stable")][:k]
                    out_q.append(np.full(len(at), qid[a + i]))
                    out_v.append(xid[at])
                    out_s.append(own[at])
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.table({"query_id": pa.array(join(out_q), pa.int64()), "vec_id": pa.array(join(out_v), pa.int64()), "score": pa.array(join(out_s), pa.int64())})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, pivots: int | None = None, block: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query with the other rows.

    ``pivots`` are the first by a hash of the id: the square root of the number of vectors, from 128 to MOST_PIVOTS, where
    it isn't given; MOST_PIVOTS bounds what is broadcast.
    """
    spark = vectors.sparkSession
    rows = _scaled(vectors)
    schema = "query_id bigint, vec_id bigint, score bigint"
    count, least_row = rows.agg(F.count(F.lit(1)), F.min(F.struct("vec_id", F.size("v").alias("width")))).first()
    if not count:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    width = least_row["width"]
    pivots = min(pivots or max(128, int(np.ceil(np.sqrt(count)))), MOST_PIVOTS)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()  # ``pivots`` rows
    rows = rows.where(F.size("v") == width)
    chosen = np.array(sorted({tuple(r["v"]) for r in sample if len(r["v"]) == width}), np.int64)
    if not len(chosen):
        chosen = np.zeros((1, width), np.int64)
    assigned = stored(rows.mapInArrow(_assign(spark.sparkContext.broadcast(chosen)), "vec_id bigint, v array<bigint>, group int, distance double"), "voronoi")
    n, most = np.zeros(len(chosen), np.int64), np.zeros(len(chosen))
    least = np.full((len(chosen), k + 1), np.inf)
    near = F.slice(F.array_sort(F.flatten(F.collect_list("least"))), 1, k + 1)
    for r in assigned.mapInArrow(_nearest(k), "group int, n bigint, most double, least array<double>").groupBy("group").agg(F.sum("n").alias("n"), F.max("most").alias("most"), near.alias("least")).collect():  # a row a pivot
        n[r["group"]], most[r["group"]] = r["n"], r["most"]
        least[r["group"], : len(r["least"])] = r["least"]
    blocks = np.maximum(-(-n // block), 1)
    first = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    places = spark.createDataFrame([(g, int(first[g]), int(blocks[g])) for g in range(len(chosen))], "group int, first_ bigint, blocks_ bigint")  # a row a pivot
    data = assigned.join(F.broadcast(places), "group").select("vec_id", "v", (F.col("first_") + F.pmod(F.xxhash64("vec_id"), F.col("blocks_"))).alias("block"))
    shared = spark.sparkContext.broadcast((chosen, n, most, least, blocks))
    queries = assigned.where(is_query).select("vec_id", "v").mapInArrow(_route(shared, k), "vec_id bigint, v array<bigint>, block bigint")
    turns = max(1, -(-assigned.where(is_query).count() // block))
    queries = queries.withColumn("turn", F.pmod(F.xxhash64("vec_id"), F.lit(turns)))
    met = queries.select("block", "turn").distinct()
    data = data.join(met, "block").select("vec_id", "v", *[F.col(c).alias(c) for c in ("block", "turn")])  # new columns, else both sides share them
    parts = queries.groupBy("block", "turn").cogroup(data.groupBy("block", "turn")).applyInArrow(_solve(k), schema)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)  # k rows a block that the query reached
    ranked = parts.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("pos", "hit"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score"))


def digest(vectors: DataFrame) -> DataFrame:
    return top_k(vectors.select("vec_id", "embedding"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)
