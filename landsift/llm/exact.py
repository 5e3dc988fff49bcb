"""Exact dedup against history with a minimal perfect hash.

The digests of the history are dealt to shards by their own bytes; of each shard's distinct digests
a minimal perfect hash is built, level by level: a digest that has a cell of its own is placed, the
others go on to the next level, and the rank of its cell is its slot. A slot holds the whole digest,
how often it occurs and where its winner is. A digest of the new rows looks up one slot and compares
all 32 bytes: members join the group of the slot, nonmembers are grouped separately.

Rows are summed up by digest before anything is dealt by digest, so a text that a third of the rows
hold is one row a partition. The last join, back to the rows, is a plain one that Spark splits when
a key is hot.

Rows: null counts as empty, and empty texts are equal. A null doc_id comes after all others. Of rows
that are wholly repeated (same id, same text) one stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from landsift.llm.common import NO_ID, SPACE, crc_of_id, mix, parts_for, stored, told

GAMMA, LEVELS = 1.5, 60
GROUP = "digest binary, size bigint, chars bigint, id bigint, row bigint"


def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = np.ascontiguousarray(digests).view(np.uint64).reshape(-1, 4)
    return words[:, 0] ^ words[:, 2], words[:, 1] ^ words[:, 3]


def _cell(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(a + b * np.uint64(2 * level + 1)) % np.uint64(size)).astype(np.int64)


def build(digests: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Level sizes and cells of a minimal perfect hash of distinct 32-byte digests, an (n, 32) array."""
    a, b = _halves(digests)
    sizes, cells = [], []
    while len(a):
        if len(sizes) == LEVELS:
            raise ValueError("digests that aren't distinct")
        size = max(8, int(len(a) * GAMMA))
        cell = _cell(a, b, len(sizes), size)
        alone = np.bincount(cell, minlength=size) == 1
        sizes.append(size)
        cells.append(alone)
        rest = ~alone[cell]
        a, b = a[rest], b[rest]
    return sizes, np.concatenate(cells) if cells else np.zeros(0, bool)


def lookup(sizes: list[int], cells: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """The slot of each digest, -1 if it has none; a slot must still be compared."""
    a, b = _halves(digests)
    slot, open_, base = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
    rank = np.cumsum(cells) - 1
    for level, size in enumerate(sizes):
        cell = base + _cell(a[open_], b[open_], level, size)
        hit = cells[cell]
        slot[open_[hit]] = rank[cell[hit]]
        open_, base = open_[~hit], base + size
    return slot


def _digests(table: pa.Table, column: str = "digest") -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), np.uint8).reshape(-1, 32)


def _numbers(table: pa.Table) -> np.ndarray:
    return np.column_stack([table.column(c).to_numpy() for c in ("size", "chars", "id", "row")]).astype(np.int64).reshape(-1, 4)


def _build_shard(table: pa.Table) -> pa.Table:
    digests, numbers = _digests(table), _numbers(table)
    sizes, cells = build(digests)
    slot = lookup(sizes, cells, digests)
    kept, told = np.empty_like(digests), np.empty_like(numbers)
    kept[slot], told[slot] = digests, numbers
    return pa.table({"shard": table.column("shard").slice(0, 1), "sizes": pa.array([sizes], pa.list_(pa.int64())), "cells": pa.array([np.packbits(cells).tobytes()], pa.binary()), "digests": pa.array([kept.tobytes()], pa.binary()), "winners": pa.array([told.tobytes()], pa.binary())})


INDEX = "shard bigint, sizes array<bigint>, cells binary, digests binary, winners binary"


def _shard(shards: int) -> Column:
    return F.pmod(F.crc32("digest"), F.lit(shards)).cast("long")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row a shard of the distinct digests in ``history`` (columns of GROUP)."""
    return history.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(_build_shard, INDEX)


def _probe_shard(index: pa.Table, new: pa.Table) -> pa.Table:
    """All groups of a shard: slots with what joined them, then the nonmembers."""
    digests, numbers = (_digests(new), _numbers(new)) if new.num_rows else (np.zeros((0, 32), np.uint8), np.zeros((0, 4), np.int64))
    kept, told = np.zeros((0, 32), np.uint8), np.zeros((0, 4), np.int64)
    member = np.zeros(len(digests), bool)
    if index.num_rows:
        sizes, (kept, told) = index.column("sizes")[0].as_py(), (np.frombuffer(index.column(c)[0].as_py(), k) for c, k in (("digests", np.uint8), ("winners", np.int64)))
        kept, told = kept.reshape(-1, 32), told.reshape(-1, 4).copy()
        cells = np.unpackbits(np.frombuffer(index.column("cells")[0].as_py(), np.uint8), count=sum(sizes)).astype(bool)
        slot = lookup(sizes, cells, digests)
        at = np.flatnonzero(slot >= 0)
        at = at[(kept[slot[at]] == digests[at]).all(axis=1)]
        member[at] = True
        mine, theirs = told[slot[at]], numbers[at]
        # the longest text, then the smallest id, then the first row
        better = (theirs[:, 1] > mine[:, 1]) | ((theirs[:, 1] == mine[:, 1]) & ((theirs[:, 2] < mine[:, 2]) | ((theirs[:, 2] == mine[:, 2]) & (theirs[:, 3] < mine[:, 3]))))
        total = mine[:, 0] + theirs[:, 0]
        joined = np.where(better[:, None], theirs, mine)
        joined[:, 0] = total
        told[slot[at]] = joined
    digests, numbers = np.concatenate((kept, digests[~member])), np.concatenate((told, numbers[~member]))
    return pa.table({"digest": pa.array([d.tobytes() for d in digests], pa.binary()), **{c: pa.array(numbers[:, k]) for k, c in enumerate(("size", "chars", "id", "row"))}})


def probe(index: DataFrame, new: DataFrame, shards: int) -> DataFrame:
    """The groups (columns of GROUP) of the history in ``index`` together with the distinct digests of ``new``."""
    return index.groupBy("shard").cogroup(new.withColumn("shard", _shard(shards)).groupBy("shard")).applyInArrow(_probe_shard, GROUP)


def _distinct(rows: DataFrame) -> DataFrame:
    """A row a digest: how often it occurs, and its winner."""
    best = F.min(F.struct((-F.col("chars")).alias("fewer"), "id", "row")).alias("best")
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("size"), best).select("digest", "size", (-F.col("best.fewer")).alias("chars"), "best.id", "best.row")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE + "+", "")


def group_exact(docs: DataFrame, in_history: Column, tie: Column | None = None, *more: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, row and the columns ``more`` of every row.

    ``in_history`` says which rows make up the history; the result doesn't depend on it. ``row`` is a number of the row, or ``tie``,
    which then picks among rows of one id and length; rows that are alike in it are kept together.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("id"),
        F.coalesce(F.char_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("chars"),
        F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"),
        F.coalesce(in_history, F.lit(False)).alias("old"),
        (F.monotonically_increasing_id() if tie is None else tie).alias("row"),
        *more,
    )
    rows = stored(rows, "exact-rows")  # reads the texts once, and fixes the numbers of the rows
    shards = parts_for(rows.count(), 50_000)
    index = build_index(_distinct(rows.where("old")), shards)
    groups = probe(index, _distinct(rows.where("not old")), shards)
    groups = groups.select("digest", "size", F.col("id").alias("best_id"), F.col("row").alias("best_row"))
    keep = F.when(F.col("best_id") != int(NO_ID), F.col("best_id"))
    return told(rows, stored(groups, "exact-groups"), ["digest"]).select("doc_id", keep.alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("best_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "row", *more)


def half(doc_id: Column) -> Column:
    """The history of the query: every other id by crc32."""
    return F.pmod(crc_of_id(doc_id), F.lit(2)) == 0


def groups(docs: DataFrame) -> DataFrame:
    return group_exact(docs, half(F.col("doc_id"))).drop("row")


def keep_first(docs: DataFrame, most_broadcast: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns; one row a text.

    Of rows of one id, text and length a hash of all columns picks, so the result doesn't depend on how the rows lie. Texts
    are written once and not shuffled: rows that go are told by number, broadcast while they are ``most_broadcast`` at most.
    """
    number, columns = "keep_row", docs.columns
    while number.lower() in {c.lower() for c in columns}:
        number += "_"
    texts = stored(docs.withColumn(number, F.monotonically_increasing_id()), "exact-texts")
    content = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, MapType)])
    told_rows = stored(group_exact(texts, half(F.col("doc_id")), content, number).select(number, "kept", "text_sha256"), "exact-told")
    first = told_rows.where("kept").groupBy("text_sha256").agg(F.min(number).alias(number))  # of wholly repeated rows one
    gone = stored(told_rows.select(number).join(first, number, "left_anti"), "exact-gone")
    gone = F.broadcast(gone) if gone.count() <= most_broadcast else gone.hint("shuffle_merge")
    return texts.join(gone, number, "left_anti").select(*[f"`{c}`" for c in columns])
