"""A resumable import: checkpointed batches, each committed once, however often it is tried.

Staged files are read as a stream, some files a batch. What an identity was first accepted with is keyed state, in slices of identities by
hash: a call of Python serves a slice, not an identity. A batch reads and writes the slices that it meets. A batch's rows are written to a
folder of its number, which a repeat overwrites; state, offsets and commits are in the checkpoint beside it, and both are in one shared
folder. An import that was stopped is called again and goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

#: Rejected rows have no state; they are dealt to so many groups of a batch. Slices of identities; fixed, as the state of an import is kept by them.
REJECTED_GROUPS, SLICES = 64, 1 << 12
DIGEST = 32
FATES = ("accepted", "rejected", "duplicate", "conflict")


def _fates(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if key[0] < 0:
        for rows in frames:
            yield rows.drop(columns=["group_", "name_"]).assign(fate="rejected")
        return
    names, contents = state.get if state.exists else ([], [])
    known = dict(zip(names, contents, strict=True))
    # which row of a new identity came first is told by all of the slice's rows in this batch: short contents or digests, and numbers
    rows = pd.concat(list(frames)).sort_values("ordinal", kind="stable")
    identity, content = rows["name_"].to_numpy(), rows["content"].to_numpy()
    fate = np.empty(len(rows), object)
    before = len(known)
    for k, (name, said) in enumerate(zip(identity, content, strict=True)):
        first = known.get(name)
        if first is None:
            known[name] = said
            fate[k] = "accepted"
        else:
            fate[k] = "duplicate" if said == first else "conflict"
    if len(known) > before:
        state.update((list(known), list(known.values())))
    yield rows.drop(columns=["group_", "name_"]).assign(fate=fate)


def fates(stream: DataFrame, valid: Column) -> DataFrame:
    """source, identity, content, ordinal and fate of each row of a stream of (source, identity, content, ordinal).

    The first valid row of an identity is accepted; later ones are duplicates or, with other content, conflicts. Contents of DIGEST bytes or more are
    compared, kept and returned as digests of DIGEST bytes, shorter ones as they are.
    """
    said = F.coalesce("content", F.lit(""))
    kept = F.when(F.octet_length(said) < DIGEST, said.cast("binary")).otherwise(F.unhex(F.sha2(said, 256)))
    rows = stream.select("source", "identity", kept.alias("content"), F.col("ordinal").cast("long").alias("ordinal"))
    name = F.col("identity").cast("string")
    ok = F.coalesce(valid & F.col("identity").isNotNull(), F.lit(False))
    slot = lambda of, *cols: F.pmod(F.xxhash64(*cols), F.lit(of)).cast("int")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    rows = rows.withColumn("name_", name).withColumn("group_", F.when(ok, slot(SLICES, name)).otherwise(-1 - slot(REJECTED_GROUPS, "identity", "ordinal")))
    return rows.groupBy("group_").applyInPandasWithState(_fates, f"{columns}, fate string", "names array<string>, contents array<binary>", "append", GroupStateTimeout.NoTimeout)


def run(spark: SparkSession, staged: str, schema: StructType, target: str, valid: Column, files_a_batch: int = 1, watch: Callable[[int], None] | None = None) -> DataFrame:
    """Imports what is staged and not yet imported, and returns all that is.

    ``watch`` is called with the number of each batch once its rows are written and before it is committed; what it raises stops the import.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(staged)

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/rows/batch={number}")
        if watch:
            watch(number)

    query = fates(stream, valid).writeStream.foreachBatch(write).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return imported(spark, target)


def imported(spark: SparkSession, target: str) -> DataFrame:
    """The rows of all batches, with their batch."""
    return spark.read.option("basePath", f"{target}/rows").parquet(f"{target}/rows")


def report(rows: DataFrame) -> DataFrame:
    """source, seen, a count of each fate, checkpoint (the last ordinal) and status of an import."""
    counts = [F.count_if(F.col("fate") == f).alias(f) for f in FATES]
    found = rows.groupBy("source").agg(F.count(F.lit(1)).alias("seen"), *counts, F.max("ordinal").alias("checkpoint"))
    return found.withColumn("status", F.when(F.col("rejected") > 0, "failed").otherwise("validated"))
