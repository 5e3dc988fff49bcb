"""Stretches of words that repeat with a period (runs), found by way of the longest previous factors.

A batch of documents is one array of word numbers. Its suffixes are sorted by doubling, documents apart;
the ranks of each doubling are kept, and answer how far two places agree, forward and backward. Suffix
array and LCP give the longest previous factor (LPF) of each place whose first two words occur twice in the document; all other places
have one of at most a word, which makes a block of one word either way. The LPF array deals a document into LZ blocks.
A run that touches a block's border is found by extending from the border both ways, for each period that the two
blocks beside it allow; a run strictly inside of a block is a copy of a run in the block's earlier occurrence, and is copied from
the bucket of its start. Together these are all runs.

Documents are rows and nothing is exchanged between them, so no group, host or copy is gathered. A task holds a batch of about
4 MB of text, or one longer document, with some 200 bytes a word and 4 more for each doubling of its longest repeat.

Rows: a null or empty text has no words and no run. Repeated rows and ids are answered each; an empty table gives no row. Of other
columns none is read, so names can't clash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landsift.llm.common import SPACE, as_bytes, crc_of_id, slices, starts_of

#: A run has at least so many words, and at least two periods.
LEAST = 12
RUN = "struct<start: bigint, length: bigint, period: bigint>"
OUT = f"doc_id bigint, n_words bigint, runs array<{RUN}>, collapsed string"


class Places:
    """The places of a batch: suffix ranks, and how far two places of a document agree."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        self.n = n = len(codes)
        self.start = starts_of(lengths)
        self.end = np.repeat(self.start + lengths, lengths)
        self.levels: list[np.ndarray] = []
        self.twice = np.zeros(n, bool)  # places whose first two words occur again in the document
        key = np.repeat(np.arange(len(lengths)), lengths) * (int(codes.max()) + 1 if n else 1) + codes
        act = np.argsort(key, kind="stable")
        rank = np.zeros(n, np.int32)
        act = self._split(rank, act, key[act], np.zeros(n, np.int32))
        step = 1
        while len(act):
            self.levels.append(rank.copy())
            if step == 2:
                self.twice[act] = True
            behind = act + step
            second = np.where(behind < self.end[act], rank[np.minimum(behind, n - 1)] + np.int64(1), 0)
            key = rank[act] * np.int64(n + 1) + second
            order = np.argsort(key, kind="stable")
            act = act[order]
            act = self._split(rank, act, key[order], rank[act])
            step *= 2
        self.rank = rank

    @staticmethod
    def _split(rank: np.ndarray, act: np.ndarray, key: np.ndarray, old: np.ndarray) -> np.ndarray:
        """Gives the sorted places ``act`` the ranks that ``key`` parts them into; returns those that still share one."""
        if not len(act):
            return act
        at = np.arange(len(act))
        first = np.concatenate(([True], key[1:] != key[:-1]))
        old_first = np.concatenate(([True], old[1:] != old[:-1]))
        rank[act] = old + (np.maximum.accumulate(np.where(first, at, 0)) - np.maximum.accumulate(np.where(old_first, at, 0)))
        return act[~(first & np.concatenate((first[1:], [True])))]

    def ahead(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from x and from y on are the same."""
        out = np.zeros(len(x), np.int64)
        for k in reversed(range(len(self.levels))):
            a, b = x + out, y + out
            fits = np.maximum(a, b) < self.n
            a, b = np.where(fits, a, 0), np.where(fits, b, 0)
            out += (fits & (self.levels[k][a] == self.levels[k][b])).astype(np.int64) << k
        return out

    def behind(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words up to x and up to y, themselves included, are the same."""
        out = np.zeros(len(x), np.int64)
        for k in reversed(range(len(self.levels))):
            a, b = x - out - (1 << k) + 1, y - out - (1 << k) + 1
            fits = np.minimum(a, b) >= 0
            a, b = np.where(fits, a, 0), np.where(fits, b, 0)
            out += (fits & (self.levels[k][a] == self.levels[k][b])).astype(np.int64) << k
        return out


def previous_factors(places: Places) -> tuple[list[int], list[int], list[int]]:
    """(place, longest previous factor, where that factor occurs before) of the places marked ``twice``, by place.

    Factors of two words or more are meant: one of a single word may be told as 0.
    """
    marked = np.flatnonzero(places.twice)
    if not len(marked):
        return [], [], []
    by_rank = marked[np.argsort(places.rank[marked])]  # their part of the suffix array
    m = len(by_rank)
    lcp = np.zeros(m + 1, np.int64)
    two = places.levels[1]
    same = np.flatnonzero(two[by_rank[1:]] == two[by_rank[:-1]])
    lcp[same + 1] = places.ahead(by_rank[same], by_rank[same + 1])
    # from the last place on, each leaves the list; its neighbours then are the nearest suffixes that start before it
    common, before, after = lcp.tolist(), list(range(-1, m)), list(range(1, m + 2))
    factor, source, at = [0] * m, [-1] * m, by_rank.tolist()
    order = np.argsort(by_rank)
    for k in order[::-1].tolist():
        up, down, p, q = common[k], common[after[k]], before[k], after[k]
        if up >= down:
            factor[k], common[q] = up, down
            source[k] = at[p] if up else -1
        else:
            factor[k], source[k], common[q] = down, at[q], up
        before[q] = p
        if p >= 0:
            after[p] = q
    return [at[k] for k in order], [factor[k] for k in order], [source[k] for k in order]


def blocks(places: Places) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Where the LZ blocks of all documents start, and (start, length, earlier start) of those of two words or more."""
    long, free = [], 0
    for i, size, source in zip(*previous_factors(places), strict=True):
        if i >= free and size >= 2:
            long.append((i, size, source))
            free = i + size
    inner = np.zeros(places.n + 1, np.int64)
    if long:
        at, size, _ = np.array(long, np.int64).T
        inner[at + 1] += 1
        inner[at + size] -= 1
    return np.flatnonzero(np.cumsum(inner[:-1]) == 0), long


def _periods(border: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each border with each period from 1 to its ``most``."""
    most = np.maximum(most, 0)
    return np.repeat(border, most), np.arange(int(most.sum())) - np.repeat(starts_of(most), most) + 1


def border_runs(places: Places, start: np.ndarray, least: int) -> np.ndarray:
    """(start, length, period) of the runs of ``least`` words or more that touch a border between blocks; smallest periods."""
    if len(places.levels) < 2:
        return np.zeros((0, 3), np.int64)
    n, end = places.n, places.end
    size = np.diff(np.append(start, n))
    first = np.isin(start, places.start)
    left = np.where(first, 0, np.concatenate(([0], size[:-1])))
    last = np.append(first[1:], True)  # the end of a document is a border too, without a block behind it
    border, left, right = np.concatenate((start, end[start[last]])), np.concatenate((left, size[last])), np.concatenate((size, np.zeros(int(last.sum()), np.int64)))
    low = np.concatenate((places.start[np.searchsorted(places.start, start, "right") - 1], places.start[np.searchsorted(places.start, start[last], "right") - 1]))
    # A run of 12 words with two periods agrees with itself for six or more, three of them on one side of the border.
    near = np.minimum(border, n - 1)
    worth = (left > 0) & (((border < n) & places.twice[near]) | ((border >= 2) & places.twice[np.maximum(border - 2, 0)]))
    border, left, right, low = border[worth], left[worth], right[worth], low[worth]
    found, two = [], places.levels[1]
    for most, back in ((right, 0), (np.minimum(left + right - 1, border - low), 1)):
        b, q = _periods(border, most)
        x, y = (b - q, b) if back else (b, b + q)
        forth = (y < n) & (two[np.minimum(x, n - 1)] == two[np.minimum(y, n - 1)])
        hind = (x >= 2) & (two[np.maximum(x - 2, 0)] == two[np.maximum(y - 2, 0)])
        keep = forth | hind
        x, y, q = x[keep], y[keep], q[keep]
        back_by, ahead_by = places.behind(x - 1, y - 1), places.ahead(x, y)
        length = q + back_by + ahead_by
        good = length >= np.maximum(least, 2 * q)
        found.append(np.column_stack((x - back_by, length, q))[good])
    found = np.concatenate(found)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    return found[np.concatenate(([True], (found[1:, :2] != found[:-1, :2]).any(axis=1)))] if len(found) else found


def find(docs: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs of each document as (start, length, period), by start, then period. ``least`` is 12 or more."""
    if least < LEAST:
        raise ValueError(f"runs of fewer than {LEAST} words aren't looked for")
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    lengths = np.array([len(d) for d in docs], np.int64)
    codes = np.fromiter(map(numbers.__getitem__, chain.from_iterable(docs)), np.int64, int(lengths.sum()))
    if not len(codes):
        return [[] for _ in docs]
    at = np.flatnonzero(lengths)
    places = Places(codes, lengths[at])
    start, long = blocks(places)
    buckets: dict[int, list[tuple[int, int]]] = {}
    for a, size, period in border_runs(places, start, least).tolist():
        buckets.setdefault(a, []).append((size, period))
    if buckets:
        owner = np.searchsorted(places.start, list(buckets), "right") - 1
        with_runs = set(owner.tolist())  # a document without a run at a border has none at all
        of_block = (np.searchsorted(places.start, [b[0] for b in long], "right") - 1).tolist()
        for (a, size, source), doc in zip(long, of_block, strict=True):
            if size < least + 2 or doc not in with_runs:
                continue
            shift, stop = a - source, a + size - 1
            for place in range(a + 1, stop - least + 1):
                for length, period in buckets.get(place - shift, ()):
                    if place + length <= stop:
                        buckets.setdefault(place, []).append((length, period))
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    for a in sorted(buckets):
        doc = int(np.searchsorted(places.start, a, "right")) - 1
        base = int(places.start[doc])
        out[at[doc]] += [(a - base, length, period) for length, period in sorted(buckets[a], key=lambda r: r[1])]
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]


def _batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    for batch in slices(batches):
        docs = [x.split() for x in as_bytes(batch)]
        found = find(docs)
        runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in found], kind)
        kept = pa.array([b" ".join(collapse(d, r)) for d, r in zip(docs, found, strict=True)], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(d) for d in docs], pa.int64()), runs, kept], ["doc_id", "n_words", "runs", "collapsed"])


def periodic(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period of each, by start, then period) and the collapsed text of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_batches, OUT)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth document, by the crc32 of its id, repeats some of its words to its end."""
    h = crc_of_id(F.col("doc_id"))
    docs = docs.select("doc_id", "text", F.when(h % 10 == 0, F.filter(F.split("text", SPACE + "+"), lambda w: w != "")).alias("words"), F.floor(h / 10).cast("long").alias("g"))
    docs = docs.withColumn("n", F.size("words")).withColumn("a", F.col("g") % F.greatest("n", F.lit(1)))
    docs = docs.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    turned = F.expr("array_join(transform(sequence(0L, n - 1L), i -> words[int(if(i < a, i, a + (i - a) % p))]), ' ')")
    return docs.select("doc_id", F.when(F.col("n") > 0, turned).otherwise(F.col("text")).alias("text"))


def _hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256 and collapsed_sha256."""
    found = periodic(docs)
    best = F.expr("element_at(array_sort(transform(runs, r -> struct(-r.length AS less, r.start AS start, r.period AS period))), 1)")
    said = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    found = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.less") / F.col("best.period")).cast("long").alias("exponent_milli"),
        _hex(said).alias("runs_sha256"),
        _hex(F.col("collapsed")).alias("collapsed_sha256"),
    )
