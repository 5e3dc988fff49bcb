"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its distinct words in lower case and, for words of six letters or more, their
first four and five letters (an inflected insult shares them). Besides a weight a term has a short
vector; the product of two vectors is what the pair adds, such as an insult beside the mention of a
group, which the weights alone can't say. Weights and vectors are learned together from a bounded sample of labelled rows (``max_rows`` rows and ``max_terms`` terms of
them at most, parameters); scoring takes the fixed table of weights to every row.

Rows: a null or empty text has no terms and gets the score of the bias. Without labelled rows the
bias is that of clean rows alone, so nothing is called toxic. Repeated rows are scored each on its
own; of several labelled texts of one doc_id the least is learned from, of several labels the largest
counts. A very long text is one batch of its own and has 2 ** BITS terms at most.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landsift.llm.common import columns_after, crc_of_id, slices, starts_of, stored, without
from landsift.llm.features import WordTable, labelled_sample, sigmoid

BITS, FACTORS, PAIRED = 18, 4, 16.0
_WORD = re.compile(r"\w+")


def _buckets(word: str) -> tuple[int, int, int]:
    """Of the word and of its two prefixes; a short word has itself thrice."""
    own = crc32(word.encode("utf-8", "replace")) & ((1 << BITS) - 1)
    if len(word) < 6:
        return own, own, own
    return own, crc32(b"4" + word[:4].encode("utf-8", "replace")) & ((1 << BITS) - 1), crc32(b"5" + word[:5].encode("utf-8", "replace")) & ((1 << BITS) - 1)


def terms(texts: list[str], table: WordTable, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all texts one after the other, how many each has); each bucket once a text, of those that are ``wanted``."""
    sets = [list(set(_WORD.findall(t.lower()))) for t in texts]
    found = table([w for s in sets for w in s])
    doc = np.repeat(np.arange(len(texts)), [len(s) for s in sets])
    width = found.shape[1]
    doc, found = np.repeat(doc, width), found.ravel()
    if wanted is not None and len(doc):
        doc, found = doc[wanted[found]], found[wanted[found]]
    keys = np.unique((doc << BITS) | found) if len(doc) else np.zeros(0, np.int64)
    return keys & ((1 << BITS) - 1), np.bincount(keys >> BITS, minlength=len(texts))


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; 0 for an empty run."""
    out = np.zeros((len(lengths), *values.shape[1:]), np.float64)
    full = lengths > 0
    if full.any():
        out[full] = np.add.reduceat(values, starts_of(lengths)[full], axis=0)
    return out


def _pair_share(lengths: np.ndarray) -> np.ndarray:
    """What pairs count in a text: all of it up to PAIRED terms, less in longer texts, whose pairs grow with the square."""
    return PAIRED / np.maximum(lengths, PAIRED)


def margins(model: dict, buckets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """w0 + sum of weights + the pairs' share of half of (square of the sum of vectors - sum of their squares), over terms that the model knows."""
    v = model["v"][buckets]
    pairs = 0.5 * (_sums(v, lengths) ** 2 - _sums(v * v, lengths)).sum(axis=1)
    return model["w0"] + _sums(model["w"][buckets], lengths) + _pair_share(lengths) * pairs


def _chunks(lengths: np.ndarray, most: int = 1 << 20):
    """(first row, last row, first entry, last entry) of runs of rows with about ``most`` entries, so that the driver holds no large copies."""
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        start = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, start + most, "right")))
        yield at, to, start, int(ends[to - 1])
        at = to


def rows_with(buckets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many rows have each term."""
    n = np.zeros(1 << BITS, np.int64)
    for _, _, first, last in _chunks(lengths):
        n += np.bincount(buckets[first:last], minlength=1 << BITS)
    return n


def fit(buckets: np.ndarray, lengths: np.ndarray, y: np.ndarray, steps: int = 600, rate: float = 0.1, pair_rate: float = 5.0, least: int = 3, batch: int = 256, seed: int = 7, l1: float = 2e-3, decay: float = 3e-3) -> dict:
    """Logistic loss, batches of rows in a seeded order; weights and vectors of all terms of ``least`` rows or more are learned together.

    Weights by AdaGrad with a proximal L1 step. Vectors by momentum with L2 ``decay``: what a pair that isn't
    in step with the labels gains is less than what it loses. A term's vector counts by its rarity, a quarter at least, which is folded into the model.
    """
    model = {"w0": 0.0, "w": np.zeros(1 << BITS, np.float32), "v": np.zeros((1 << BITS, FACTORS), np.float32)}
    if not len(y) or y.min() == y.max():
        model["w0"] = 4.0 if len(y) and y[0] else -4.0
        return model
    rows_of = rows_with(buckets, lengths)
    often = np.flatnonzero(rows_of >= least)
    rarity = np.maximum(np.log((len(y) + 1) / rows_of[often]) / np.log((len(y) + 1) / min(least, len(y))), 0.25)
    number = np.full(1 << BITS, -1, np.int32)
    number[often] = np.arange(len(often))
    parts, sizes = [], []
    for a, b, start, end in _chunks(lengths):
        part = number[buckets[start:end]]
        parts.append(part[part >= 0])
        sizes.append(np.bincount(np.repeat(np.arange(b - a), lengths[a:b])[part >= 0], minlength=b - a))
    ids, lengths = np.concatenate(parts), np.concatenate(sizes)
    first, n = starts_of(lengths), len(often)
    rng = np.random.default_rng(seed)
    w0, w, v = float(np.log(y.mean() / (1 - y.mean()))), np.zeros(n), rng.normal(0, 0.05, (n, FACTORS))
    g0, gw, moved = 1e-6, np.full(n, 1e-6), np.zeros((n, FACTORS))
    weight = np.where(y == 1, 2.0, 1.0)
    for _ in range(max(4, -(-steps // -(-len(y) // batch)))):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            size = lengths[rows]
            x = ids[np.repeat(first[rows] - starts_of(size), size) + np.arange(int(size.sum()))]
            held = v[x] * rarity[x][:, None]
            total, share = _sums(held, size), _pair_share(size)
            margin = w0 + _sums(w[x], size) + share * 0.5 * (total**2 - _sums(held * held, size)).sum(axis=1)
            error = (sigmoid(margin) - y[rows]) * weight[rows] / len(rows)
            of = np.repeat(np.arange(len(rows)), size)
            g0 += error.sum() ** 2
            w0 -= rate * error.sum() / np.sqrt(g0)
            dw = np.bincount(x, error[of], n)
            gw += dw * dw
            step = rate / np.sqrt(gw)
            w = w - step * dw
            w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
            paired = (error * share)[of] * rarity[x]
            for f in range(FACTORS):
                dv = np.bincount(x, paired * (total[of, f] - held[:, f]), n) + decay * v[:, f]
                moved[:, f] = 0.9 * moved[:, f] + 0.1 * dv
                v[:, f] -= pair_rate * moved[:, f]
    model["w0"], model["w"][often], model["v"][often] = w0, w, v * rarity[:, None]
    return model


def _rows_of_terms(batches):
    table = WordTable(_buckets)
    for batch in slices(batches):
        buckets, lengths = terms(pc.fill_null(batch.column("text"), "").to_pylist(), table)
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts_of(lengths), len(buckets)), pa.int32()), pa.array(buckets, pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), lists], names=["doc_id", "label", "terms"])


def train(docs: DataFrame, labels: DataFrame, learns, max_rows: int = 20_000, max_terms: int = 30_000_000) -> dict:
    """Fit on at most ``max_rows`` labelled rows, the first by a hash of the id that have ``max_terms`` terms together; only their term numbers reach the driver."""
    sample = labelled_sample(docs, labels, "toxic", learns, max_rows)
    found = stored(sample.mapInArrow(_rows_of_terms, "doc_id bigint, label int, terms array<int>"), "toxicity-terms")
    sizes = found.select("doc_id", F.size("terms").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # ``max_rows`` rows
    most, all_ = len(sizes), 0
    for k, r in enumerate(sizes):
        all_ += r["n"]
        if all_ > max_terms:
            most = k
            break
    rows = (found if most == len(sizes) else found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)).toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    label = rows.column("label").to_numpy().astype(np.float64)[order]
    lengths = pc.fill_null(pc.list_value_length(rows.column("terms")), 0).to_numpy().astype(np.int64)[order]
    parts = [pc.list_flatten(rows.column("terms").take(pa.array(order[a:b]))).to_numpy() for a, b, _, _ in _chunks(lengths)]
    del rows
    return fit(np.concatenate([*parts, np.zeros(0, np.int32)]), lengths, label)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with toxicity, 0 to 1."""
    docs = without(docs, "toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS rows whatever the data

    def run(batches):
        table, model = WordTable(_buckets), shared.value
        wanted = (model["w"] != 0) | (model["v"] != 0).any(axis=1)  # the terms that were learned
        for batch in slices(batches, most=1 << 20):
            found = margins(model, *terms(pc.fill_null(batch.column("text"), "").to_pylist(), table, wanted))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(found), pa.float64())], names=[*batch.schema.names, "toxicity"])

    return docs.mapInArrow(run, columns_after(docs, "toxicity double"))


def learns(doc_id):
    """Rows that may be learned from: crc32 of the id mod 5 isn't 0."""
    return F.pmod(crc_of_id(doc_id), F.lit(5)) != 0


def scores(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = score(docs, train(docs, labels, learns, max_rows))
    held = F.coalesce(~learns(F.col("doc_id")), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, limit: float = 0.5, max_rows: int = 20_000) -> DataFrame:
    """The rows of ``docs`` scored below ``limit``, with their own columns."""
    model = train(docs, labels, learns, max_rows)
    return score(docs, model).where(F.col("toxicity") < limit).select(*docs.columns)
