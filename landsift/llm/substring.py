"""Substring dedup: remove words covered by a window of words that starts earlier elsewhere.

1. The texts are stored in parts of some PART_BYTES. Each part makes a count-min sketch of its windows: two rows
   of cells, counters that stop at 2. The sketches are merged by segments of SEGMENT cells; a segment
   answers each part which of its cells were counted twice. A cell below 2 proves
   that its windows occur once; the estimate never falls short, so no repeat is lost.
2. Only windows estimated as repeated are grouped exactly, by 96 hash bits in shards of their hashes, after each part
   has kept the earliest start of each; a shard answers each part which of its windows start first overall.
3. Each document drops the estimated windows that aren't an earliest start.

The sketch has ``cells_per_window`` cells a window in each row at every size. It is never put together and
nothing is broadcast: what a part asks and what it is told travels by shuffles, a row a part and segment (or shard)
that meet, at most one a window. A task holds one part, one segment or one shard.

Rows: a null text has no words; a null doc_id comes after all others. Rows of one doc_id count as
one document read twice: a window that starts first in that document stays in each of them. Other columns don't matter.
A text longer than a part is a part of its own (some 150 bytes a word while it is worked on).
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landsift.llm.common import Windows, as_bytes, gathered, ids_of, pack_numbers, pack_sorted, parts_for, starts_of, stored, text_size, unpack_numbers, unpack_sorted

PART_BYTES, SEGMENT = 4 << 20, 1 << 24

PARTS = "part bigint, docs int, ids binary, lengths binary, texts binary"


def _packed(batches):
    """The texts of each part, compressed, under a number of its own."""
    partition = TaskContext.get().partitionId()
    for seq, batch in enumerate(gathered(batches, PART_BYTES)):
        texts, none = as_bytes(batch), batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        lengths = np.array([len(t) for t in texts], np.uint64)
        ids = ids_of(batch).astype(np.int64).tobytes() + np.packbits(none).tobytes()
        blob = pa.compress(b"".join(texts), "zstd", asbytes=True)
        del texts
        yield pa.record_batch({"part": pa.array([(partition << 32) + seq], pa.int64()), "docs": pa.array([len(lengths)], pa.int32()), "ids": pa.array([ids], pa.binary()), "lengths": pa.array([pack_numbers(lengths)], pa.binary()), "texts": pa.array([blob], pa.binary())})


def _words(docs: int, lengths: bytes, texts: bytes) -> list[list[bytes]]:
    ends = np.cumsum(unpack_numbers(lengths, docs)).astype(np.int64)
    whole = pa.decompress(texts, int(ends[-1]) if docs else 0, "zstd", asbytes=True)
    return [whole[a:b].split() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _cells(h: np.ndarray, bits: int) -> np.ndarray:
    return h >> np.uint64(64 - bits)


def _segments(bits: int) -> tuple[int, int]:
    """(segments of a row, cells of each)"""
    size = min(SEGMENT, 1 << bits)
    return (1 << bits) // size, size


def _sketches(n: int, bits: int):
    """Of each part: a row a segment that it meets, with its cells there in order; a counter that stops at 2 needs no third entry."""
    count, size = _segments(bits)

    def run(batches):
        windows = Windows(n)
        for batch in batches:
            for part, docs, lengths, texts in zip(*(batch.column(c).to_pylist() for c in ("part", "docs", "lengths", "texts")), strict=True):
                found = windows(_words(docs, lengths, texts))[:2]
                rows = []
                for row, h in enumerate(found):
                    cells = np.sort(_cells(h, bits))
                    if len(cells) > 2:
                        cells = cells[np.concatenate(([True, True], (cells[2:] != cells[1:-1]) | (cells[1:-1] != cells[:-2])))]
                    edges = np.searchsorted(cells, np.arange(count + 1, dtype=np.uint64) * np.uint64(size))
                    for k in np.flatnonzero(np.diff(edges)).tolist():
                        own = cells[edges[k] : edges[k + 1]] - np.uint64(k * size)
                        rows.append((row * count + k, len(own), pack_sorted(own)))
                if rows:
                    yield pa.record_batch({"part": pa.array([part] * len(rows), pa.int64()), "segment": pa.array([r[0] for r in rows], pa.int32()), "n": pa.array([r[1] for r in rows], pa.int32()), "cells": pa.array([r[2] for r in rows], pa.binary())})

    return run


def _merged(bits: int):
    """Of a segment, for each part: a bit for each of its distinct cells there, whether the merged counter reached 2."""
    _, size = _segments(bits)

    def run(table: pa.Table) -> pa.Table:
        asked = list(zip(table.column("n").to_pylist(), table.column("cells").to_pylist(), strict=True))
        seen, repeated = np.zeros(size, bool), np.zeros(size, bool)
        for n, blob in asked:
            cells = unpack_sorted(blob, n).astype(np.int64)
            repeated[cells[1:][cells[1:] == cells[:-1]]] = True
            repeated[cells[seen[cells]]] = True
            seen[cells] = True
        bits_ = []
        for n, blob in asked:
            cells = unpack_sorted(blob, n).astype(np.int64)
            bits_.append(np.packbits(repeated[cells[np.concatenate(([True], cells[1:] != cells[:-1]))]]).tobytes())
        return pa.table({"part": table.column("part"), "segment": table.column("segment"), "repeated": pa.array(bits_, pa.binary())})

    return run


def _estimated(hashes, answers: pa.Table, bits: int) -> np.ndarray:
    """Whether the count-min estimate of each window is 2 or more."""
    count, size = _segments(bits)
    told = dict(zip(answers.column("segment").to_pylist(), answers.column("repeated").to_pylist(), strict=True))
    found = np.ones(len(hashes[0]), bool)
    for row, h in enumerate(hashes):
        cells, at = np.unique(_cells(h, bits), return_inverse=True)
        edges = np.searchsorted(cells, np.arange(count + 1, dtype=np.uint64) * np.uint64(size))
        twice = [np.zeros(0, np.uint8)] + [np.unpackbits(np.frombuffer(told[row * count + k], np.uint8), count=int(edges[k + 1] - edges[k])) for k in np.flatnonzero(np.diff(edges)).tolist()]
        found &= np.concatenate(twice)[at] == 1
    return found


CANDIDATES = "part bigint, shard int, n int, h1 binary, h2 binary, doc binary, start binary, estimated binary, windows int, entries binary"
_COLUMNS = [x.split() for x in CANDIDATES.split(", ")]
_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _order(h1, h2, doc, start):
    """(order by window, then by where it starts; whether each in that order starts where its window starts first)"""
    order = np.lexsort((start, doc, h2, h1))
    h1, h2, doc, start = h1[order], h2[order], doc[order], start[order]
    new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order, (doc == doc[first]) & (start == start[first])


def _candidates(n: int, bits: int, shards: int):
    """Of a part: a row a shard, with the earliest starts in the part of windows estimated as repeated, and a row with what is kept for its own use."""
    width = (1 << 64) // shards

    def run(parts: pa.Table, answers: pa.Table) -> pa.Table:
        rows, key = [], None
        for part, docs, ids, lengths, texts in zip(*(parts.column(c).to_pylist() for c in ("part", "docs", "ids", "lengths", "texts")), strict=True):
            key = part
            h1, h2, doc, start = Windows(n)(_words(docs, lengths, texts))
            estimated = _estimated((h1, h2), answers, bits)
            found = np.flatnonzero(estimated)
            own = np.frombuffer(ids, np.int64, docs)[doc[found]]
            h1, h2, start = h1[found], h2[found].astype(np.uint32), start[found]
            if len(found):
                order, first = _order(h1, h2, own, start)
                order = order[first]
                found, h1, h2, own, start = found[order], h1[order], h2[order], own[order], start[order]
            edges = np.append(np.searchsorted(h1, (np.arange(shards, dtype=object) * width).astype(np.uint64)), len(h1))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                a, b = edges[k], edges[k + 1]
                rows.append((part, k, b - a, pack_sorted(h1[a:b]), pack_numbers(h2[a:b]), pack_numbers(own[a:b].view(np.uint64)), pack_numbers(start[a:b]), None, None, None))
            rows.append((part, (part ^ (part >> 32)) % shards, len(found), None, None, None, None, pa.compress(np.packbits(estimated).tobytes(), "zstd", asbytes=True), len(estimated), pack_numbers(found)))
        return pa.table({c: pa.array([r[k] for r in rows], _KINDS[t]) for k, (c, t) in enumerate(_COLUMNS)})

    return run


REPLIES = "part bigint, shard int, n int, first binary, estimated binary, windows int, entries binary"


def _earliest(table: pa.Table) -> pa.Table:
    """Of a shard, for each part: a bit for each of its candidates, whether it starts first overall. What parts keep for their own use passes through."""
    own = table.filter(table.column("estimated").is_valid())
    table = table.filter(table.column("estimated").is_null())
    sizes, out = table.column("n").to_numpy().astype(np.int64), []
    if len(sizes):
        read = lambda c, f: np.concatenate([f(x, n) for x, n in zip(table.column(c).to_pylist(), sizes.tolist(), strict=True)])
        h1, h2, doc, start = read("h1", unpack_sorted), read("h2", unpack_numbers), read("doc", unpack_numbers).view(np.int64), read("start", unpack_numbers)
        order, at = _order(h1, h2, doc, start)
        first = np.empty(len(order), bool)
        first[order] = at
        ends = np.cumsum(sizes)
        out = [np.packbits(first[a:b]).tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    none = pa.nulls(len(out), pa.binary())
    told = pa.table({"part": table.column("part"), "shard": table.column("shard"), "n": table.column("n"), "first": pa.array(out, pa.binary()), "estimated": none, "windows": pa.nulls(len(out), pa.int32()), "entries": none})
    kept = pa.table({"part": own.column("part"), "shard": own.column("shard"), "n": own.column("n"), "first": pa.nulls(own.num_rows, pa.binary()), "estimated": own.column("estimated"), "windows": own.column("windows"), "entries": own.column("entries")})
    return pa.concat_tables([told, kept])


SCHEMA = pa.schema({"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_text": pa.string()})


def _drop(n: int):
    def run(parts: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for docs, ids, lengths, texts in zip(*(parts.column(c).to_pylist() for c in ("docs", "ids", "lengths", "texts")), strict=True):
            words = _words(docs, lengths, texts)
            own = replies.filter(replies.column("estimated").is_valid()).select(["n", "estimated", "windows", "entries"]).to_pylist()[0]
            told = replies.filter(replies.column("first").is_valid()).sort_by("shard").select(["n", "first"]).to_pylist()
            estimated = pa.decompress(own["estimated"], -(-own["windows"] // 8), "zstd", asbytes=True) if own["windows"] else b""
            gone = np.unpackbits(np.frombuffer(estimated, np.uint8), count=own["windows"]).astype(bool)
            first = np.concatenate([np.zeros(0, np.uint8)] + [np.unpackbits(np.frombuffer(r["first"], np.uint8), count=r["n"]) for r in told]) == 1
            gone[unpack_numbers(own["entries"], own["n"]).astype(np.int64)[first]] = False
            size = np.array([len(w) for w in words], np.int64)
            per = np.maximum(size - n + 1, 0)
            begin = np.repeat(starts_of(size), per) + np.arange(int(per.sum())) - np.repeat(starts_of(per), per)
            edge = np.zeros(int(size.sum()) + 1, np.int32)
            np.add.at(edge, begin[gone], 1)
            np.add.at(edge, begin[gone] + n, -1)
            keep = np.cumsum(edge[:-1]) == 0
            at = starts_of(size)
            removed = np.add.reduceat(np.append(~keep, False), at, dtype=np.int64) * (size > 0) if docs else size
            kept = [b" ".join(compress(w, keep[f : f + len(w)].tolist())) if r else b" ".join(w) for w, f, r in zip(words, at.tolist(), removed.tolist(), strict=True)]
            none = np.unpackbits(np.frombuffer(ids, np.uint8, -1, 8 * docs), count=docs).astype(bool)
            out.append(pa.record_batch({"doc_id": pa.array(np.frombuffer(ids, np.int64, docs), mask=none), "n_words": pa.array(size), "n_removed": pa.array(removed), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())}))
        return pa.Table.from_batches(out, SCHEMA)

    return run


def sketch_bits(windows: float, cells_per_window: float, least: int) -> int:
    """Bits of a cell's number, for a row of ``cells_per_window`` cells a window, and of ``least``, or more."""
    return max(int(cells_per_window * windows), least).bit_length()


def dedup_substrings(docs: DataFrame, n: int = 20, cells_per_window: float = 2.0, least_cells: int = 1 << 16) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of each row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    likely = text_size(docs)[1] / 6.2  # a word a window; only the size of the sketch and of shards follows from it
    bits, shards = sketch_bits(likely, cells_per_window, least_cells), parts_for(likely, 2e6, 16)
    parts = stored(docs.mapInArrow(_packed, PARTS), "substring-parts")
    asked = parts.select("part", "docs", "lengths", "texts").mapInArrow(_sketches(n, bits), "part bigint, segment int, n int, cells binary")
    answers = asked.groupBy("segment").applyInArrow(_merged(bits), "part bigint, segment int, repeated binary")
    found = parts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_candidates(n, bits, shards), CANDIDATES)
    replies = found.groupBy("shard").applyInArrow(_earliest, REPLIES)
    columns = [F.col(c).alias(c) for c in parts.columns]  # new columns, else both sides share them
    return parts.select(*columns).groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(_drop(n), "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def digests(docs: DataFrame, **options) -> DataFrame:
    out = dedup_substrings(docs, **options)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
