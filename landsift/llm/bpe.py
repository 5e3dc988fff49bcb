"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

The rank file is read by the driver and sent to the workers (its size is checked: a vocabulary is
fixed, it doesn't grow with the data). Long texts are cut before encoding at safe boundaries, each
where a space or line feed follows a character that isn't white space: no match of the pattern can
span such a place, so the ids are those of the whole text. Decoding joins the raw bytes of the ids;
it doesn't pass through strings, so ids that split a character come back exactly.

Rows: a null text counts as empty and has no ids; null ids decode to no bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landsift.llm.common import columns_after, slices, without

#: Texts of more characters than this are cut; a cut piece is as long as this or a little longer.
PIECE = 50_000
MOST_RANK_BYTES = 32 << 20
#: Python's \s holds every character that the pattern's \s holds.
_SAFE = re.compile(r"(?<=\S)(?=[ \n])")


def pieces(text: str, size: int = PIECE) -> list[str]:
    """``text`` in pieces whose matches are those of the whole; one piece where no safe place is found."""
    out, at = [], 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    out.append(text[at:])
    return out


@lru_cache(maxsize=4)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding(hashlib.sha256(ranks).hexdigest()[:16], pat_str=pattern, mergeable_ranks=table, special_tokens={})


def encode_text(enc, text: str) -> list[int]:
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    return [i for piece in pieces(text) for i in enc.encode_ordinary(piece)]


def encode_array(enc, text: str) -> np.ndarray:
    """The ids as an array: no Python number is held for each."""
    parts = [text] if len(text) <= PIECE else pieces(text)
    return np.concatenate([enc.encode_to_numpy(p, disallowed_special=()).astype(np.int32) for p in parts])


def _lists(values: list[list[int]]) -> pa.ListArray:
    return pa.array(values, pa.list_(pa.int32()))


def _shared(df: DataFrame, rank_file: str, pattern: str):
    ranks = Path(rank_file).read_bytes()
    if len(ranks) > MOST_RANK_BYTES:
        raise ValueError(f"{rank_file} has {len(ranks)} bytes; a rank file has {MOST_RANK_BYTES} at most")
    return df.sparkSession.sparkContext.broadcast((ranks, pattern))


def encode(df: DataFrame, rank_file: str, pattern: str, column: str = "text") -> DataFrame:
    """``df`` with n_tokens and token_ids of ``column``."""
    df = without(df, "n_tokens", "token_ids")
    shared = _shared(df, rank_file, pattern)

    def run(batches):
        enc = _encoding(*shared.value)
        for batch in slices(batches, column):
            ids = [encode_text(enc, t or "") for t in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(len, ids), pa.int64()), _lists(ids)], names=[*batch.schema.names, "n_tokens", "token_ids"])

    return df.mapInArrow(run, columns_after(df, "n_tokens bigint, token_ids array<int>"))


def decode(df: DataFrame, rank_file: str, pattern: str, column: str = "token_ids") -> DataFrame:
    """``df`` with decoded, the raw bytes of the ids in ``column``; an unknown id fails the job."""
    df = without(df, "decoded")
    shared = _shared(df, rank_file, pattern)

    def run(batches):
        enc = _encoding(*shared.value)
        for batch in batches:
            found = [enc.decode_bytes(ids or []) for ids in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "decoded"])

    return df.mapInArrow(run, columns_after(df, "decoded binary"))


def round_trip(df: DataFrame, rank_file: str, pattern: str, column: str = "text") -> DataFrame:
    """Encode and decode in one pass: n_tokens, token_ids (decimal, joined by commas) and decoded bytes of each row."""
    df = without(df, "n_tokens", "token_ids", "decoded")
    shared = _shared(df, rank_file, pattern)

    def run(batches):
        enc = _encoding(*shared.value)
        decimal = [str(i) for i in range(enc.max_token_value + 1)]
        for batch in slices(batches, column):
            ids = [encode_text(enc, t) for t in pc.fill_null(batch.column(column), "").to_pylist()]
            more = [pa.array(map(len, ids), pa.int64()), pa.array([",".join([decimal[i] for i in x]) for x in ids], pa.string()), pa.array([enc.decode_bytes(x) for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "n_tokens", "token_ids", "decoded"])

    return df.mapInArrow(run, columns_after(df, "n_tokens bigint, token_ids string, decoded binary"))


def checked(df: DataFrame, rank_file: str, pattern: str, column: str = "text") -> DataFrame:
    """``encode``, and a job that fails where the decoded bytes of a row aren't those of its text."""
    df = without(df, "n_tokens", "token_ids")
    shared = _shared(df, rank_file, pattern)

    def run(batches):
        enc = _encoding(*shared.value)
        for batch in slices(batches, column, most=1 << 20):
            texts = pc.fill_null(batch.column(column), "").to_pylist()
            ids = [encode_array(enc, t) for t in texts]
            if any(enc.decode_bytes(x.tolist()) != t.encode() for x, t in zip(ids, texts, strict=True)):
                raise ValueError("ids that don't decode to their text")
            lengths = np.array([len(x) for x in ids], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths), lists], names=[*batch.schema.names, "n_tokens", "token_ids"])

    return df.mapInArrow(run, columns_after(df, "n_tokens bigint, token_ids array<int>"))


def digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    out = round_trip(docs.select("doc_id", F.col("text").cast("string").alias("text")), rank_file, pattern)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
