"""Helpers that the training-data operators share.

Everything here is small: how a text becomes words, how numbers are packed, and
how arrow batches are cut so that a worker's memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landsift.scratch import fresh_dir, stored  # noqa: F401  scratch tables of the operators

#: Java regex class of the six ASCII white-space characters that part words.
SPACE = r"[\x20\x09-\x0D]"
NO_ID = np.iinfo(np.int64).max


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def text_size(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """(rows, bytes of text); sizes shards and buckets, never results."""
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    return int(row[0]), int(row[1])


def parts_for(total: float, each: float, least: int = 64) -> int:
    """How many shards hold ``total`` when each may hold ``each``."""
    return max(least, int(-(-total // each)))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``column``; one longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def gathered(batches: Iterable[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold about ``most`` bytes of text: the fewer parts, the less is sent."""
    held, size = [], 0
    for batch in slices(batches, most=most):
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def as_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def ids_of(batch: pa.RecordBatch, column: str = "doc_id") -> np.ndarray:
    """int64 ids; a null id sorts after all others."""
    return pc.fill_null(batch.column(column).cast(pa.int64()), int(NO_ID)).to_numpy(zero_copy_only=False)


class _Ids(dict):
    """word -> small number, given on first sight; keeps a 16-byte digest of each word."""

    def __init__(self):
        super().__init__()
        self.digests = bytearray()

    def __missing__(self, word):
        n = self[word] = len(self)
        self.digests += blake2b(word, digest_size=16).digest()
        return n


class WordHasher:
    """Two independent 64-bit hashes a word, through a dictionary that is emptied when it gets large."""

    def __init__(self, most: int = 400_000):
        self.most, self.ids = most, _Ids()

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word in ``ids``; numbers given before may no longer hold."""
        if len(self.ids) > self.most:
            self.ids = _Ids()
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    def table(self) -> np.ndarray:
        """The two hashes of each word in ``ids``."""
        return np.frombuffer(bytes(self.ids.digests), np.uint64).reshape(-1, 2)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        at = self.numbers(words)
        table = self.table()
        return table[at, 0], table[at, 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Where each run of ``lengths`` starts in their concatenation."""
    return np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)


class Windows:
    """Hashes of each ``n`` consecutive words of each document of a batch."""

    BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

    def __init__(self, n: int):
        self.n, self.hasher, self.powers = n, WordHasher(), [np.zeros(0, np.uint64)] * 4

    def _powers(self, size: int) -> list[np.ndarray]:
        if len(self.powers[0]) < size:
            bases = [b for q in self.BASES for b in (q, pow(q, -1, 1 << 64))]
            self.powers = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64)))) for b in bases]
        return self.powers

    def __call__(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first hash, second hash, number of the document, start in it) of each window."""
        lengths = np.array([len(d) for d in docs], np.int64)
        h = self.hasher([w for d in docs for w in d])
        n, total = self.n, int(lengths.sum())
        per = np.maximum(lengths - n + 1, 0)
        doc = np.repeat(np.arange(len(docs)), per)
        start = np.arange(int(per.sum())) - np.repeat(starts_of(per), per)
        at = np.repeat(starts_of(lengths), per) + start
        if not len(at):
            none = np.zeros(0, np.uint64)
            return none, none, doc, start
        powers, out = self._powers(total + 1), []
        for k in (0, 1):
            sums = np.concatenate(([np.uint64(0)], np.cumsum(h[k] * powers[2 * k][:total])))
            out.append(mix((sums[at + n] - sums[at]) * powers[2 * k + 1][at]))
        return out[0], out[1], doc, start


def pack_numbers(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes as the largest needs, like bytes beside each other, compressed."""
    if not len(values):
        return b""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack_numbers(blob: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    width = blob[0]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(blob[1:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Rising uint64 numbers by their gaps."""
    return pack_numbers(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack_numbers(blob, n), dtype=np.uint64)


def columns_after(df: DataFrame, more: str) -> str:
    """DDL of all of ``df``'s columns, then ``more``."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema) + f", {more}"


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add, whatever their case."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def told(rows: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with what ``one`` (stored, a row a key, with the key's ``size``) says of their keys; rows of other keys go.

    Keys with many rows are broadcast, 20,000 of them at most, so that no task gets all rows of one.
    """
    total = one.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    frequent = F.col("size") > max(100, int(total) // 20_000)
    hot, cold = one.where(frequent), one.where(~frequent)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.hint("shuffle_merge"), keys))
