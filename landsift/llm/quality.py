"""Quality: random-indexing word vectors pooled a document, then a two-layer numpy network.

Random indexing: every term (a word in a hashed bucket, the shape of a word) has a fixed sparse
vector of +1 and -1 drawn from its number. The vector of a word is the sum of those of the terms
near it, over all documents; a neighbour that is the word itself counts as the term SAME, so runs of
one word show. Sums are made a partition (only words that stand in it are sent) and merged in steps; the
table has a fixed size.

A document is the mean of its words' vectors (scaled to length 1) and the mean of the fixed vectors
of what stands in it. A network of two layers is trained on a bounded sample of labelled rows
(``max_rows``, a parameter); a fifth of the sample is held back to fit the temperature that
calibrates its probabilities.

Rows: a null or empty text is the zero vector and gets the network's score of it. Without labelled
rows every score is 0.5. Repeated rows are scored each on its own; of several labelled texts of one
doc_id the least is learned from. A very long text is one batch of its own.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landsift.llm.common import columns_after, crc_of_id, parts_for, slices, starts_of, stored, text_size, without
from landsift.llm.features import WordTable, labelled_sample, sigmoid

WORDS, SHAPES, DIM, ONES, NEAR, BLOCKS, FAN = 1 << 15, 1 << 10, 64, 2, 2, 32, 64
SAME = WORDS + SHAPES
_TAIL = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def _terms(word: str) -> tuple[int, int]:
    """Buckets of the word and of its shape: case, how it starts, what follows its letters, about how long it is."""
    core = word.rstrip(_TAIL)
    shape = f"{core.isupper() and len(core) > 1}|{core[:1].isupper()}|{core[:1].isalnum()}|{word[len(core) :][:3]}|{min(len(word), 20) // 5}"
    return crc32(word.encode("utf-8", "replace")) % WORDS, WORDS + crc32(shape.encode("utf-8", "replace")) % SHAPES


def fixed_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the ONES entries of each term's fixed vector."""
    rng = np.random.default_rng(20)
    return rng.integers(0, DIM, (SAME + 1, ONES)), rng.choice([-1, 1], (SAME + 1, ONES))


def _tokens(batch: pa.RecordBatch, table: WordTable):
    """(word bucket, shape bucket, repeats its predecessor, number of the document, lengths)"""
    texts = [t.split() for t in pc.fill_null(batch.column("text"), "").to_pylist()]
    lengths = np.array([len(t) for t in texts], np.int64)
    found = table([w for t in texts for w in t])
    if not len(found):
        found = np.zeros((0, 2), np.int64)
    doc = np.repeat(np.arange(len(texts)), lengths)
    return found[:, 0], found[:, 1], doc, lengths


def _word_sums(batches):
    places, signs = fixed_vectors()
    table, total = WordTable(_terms), np.zeros(WORDS * DIM, np.float64)
    for batch in slices(batches):
        word, shape, doc, _ = _tokens(batch, table)
        for off in range(1, NEAR + 1):
            a, b = np.arange(len(word) - off), np.arange(off, len(word))
            if not len(a):
                continue
            within = doc[a] == doc[b]
            a, b = a[within], b[within]
            for x, y in ((a, b), (b, a)):
                near = np.where(word[x] == word[y], SAME, word[y])
                base = word[x] * DIM
                for term in (near, shape[y]):
                    for k in range(ONES):
                        total += np.bincount(base + places[term, k], signs[term, k], WORDS * DIM)
    if total.any():
        yield from _rows_of_sums(total.astype(np.int64).reshape(WORDS, DIM))


SUMS = "block int, words binary, sums binary"


def _rows_of_sums(total: np.ndarray):
    """By block: the words that have a sum, and their sums; int32 where all fit."""
    for block, own in enumerate(np.split(total, BLOCKS)):
        words = np.flatnonzero(own.any(axis=1))
        if len(words):
            sums = own[words]
            small = np.abs(sums).max() < 1 << 31
            yield pa.record_batch({"block": pa.array([block], pa.int32()), "words": pa.array([words.astype(np.uint16).tobytes()], pa.binary()), "sums": pa.array([sums.astype(np.int32 if small else np.int64).tobytes()], pa.binary())})


def _merge(batches):
    """Sums of the rows of a part, row by row: memory is that of one table, however many rows there are."""
    total = np.zeros((WORDS, DIM), np.int64)
    for batch in batches:
        for block, words, sums in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "sums")), strict=True):
            at = np.frombuffer(words, np.uint16).astype(np.int64) + block * (WORDS // BLOCKS)
            total[at] += np.frombuffer(sums, np.int32 if len(sums) == 4 * DIM * len(at) else np.int64).reshape(-1, DIM)
    if total.any():
        yield from _rows_of_sums(total)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """WORDS vectors of length 1 (0 for a bucket without words) learned from all of ``docs``.

    The tables of the partitions are merged in steps: first FAN of them in a task, spread over as many tasks
    as that takes, then FAN of those, and so on; the last step is dealt by blocks. No task takes more than some FAN tables.
    """
    sums = docs.select("text").mapInArrow(_word_sums, SUMS)
    parts = parts_for(text_size(docs)[1], 16 << 20, 1)  # about how many partitions the scan has; only the number of steps follows from it
    while parts > FAN:
        parts = -(-parts // FAN)
        salted = sums.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(parts)))
        sums = stored(salted.repartition(parts * BLOCKS, "salt", "block").drop("salt").mapInArrow(_merge, SUMS), "quality-sums")
    merged = sums.repartition(BLOCKS, "block").mapInArrow(_merge, SUMS)
    total = np.zeros((WORDS, DIM), np.float64)
    for block, words, blob in merged.collect():  # a row a block, 16 MB in all, whatever the data
        at = np.frombuffer(words, np.uint16).astype(np.int64) + block * (WORDS // BLOCKS)
        total[at] = np.frombuffer(blob, np.int32 if len(blob) == 4 * DIM * len(at) else np.int64).reshape(-1, DIM)
    return (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _fixed_table() -> np.ndarray:
    places, signs = fixed_vectors()
    out = np.zeros((SAME + 1, DIM), np.float32)
    for k in range(ONES):
        np.add.at(out, (np.arange(SAME + 1), places[:, k]), signs[:, k])
    return out


def pooled(batch: pa.RecordBatch, table: WordTable, vectors: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """A row of 3 * DIM numbers a document."""
    word, shape, doc, lengths = _tokens(batch, table)
    out = np.zeros((len(lengths), 3 * DIM), np.float32)
    full = lengths > 0
    if full.any():
        first = starts_of(lengths)[full]
        out[full, :DIM] = np.add.reduceat(vectors[word], first, axis=0)
        shapes = np.bincount(doc * SHAPES + shape - WORDS, minlength=len(lengths) * SHAPES).reshape(len(lengths), SHAPES) if len(lengths) * SHAPES < 1 << 24 else None
        out[full, DIM : 2 * DIM] = (shapes @ fixed[WORDS:SAME])[full] if shapes is not None else np.add.reduceat(fixed[shape], first, axis=0)
        again = np.concatenate(([False], (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])))
        out[full, 2 * DIM :] = np.add.reduceat(again.astype(np.float32), first)[:, None] * fixed[SAME]
        out[full] /= lengths[full, None]
    return out


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, steps: int = 4000, batch: int = 128, seed: int = 3) -> dict:
    """Two layers, Adam, L2; then the temperature that gives the held-back fifth the least log loss."""
    if not len(y) or y.min() == y.max():
        return {"constant": 0.5 if not len(y) else (0.98 if y[0] else 0.02)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-3
    z = (x - mean) / scale
    p = {"w1": rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, np.sqrt(1 / hidden), hidden), "b2": np.zeros(1)}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for _ in range(max(5, -(-steps // -(-len(used) // batch)))):
        rng.shuffle(used)
        for at in range(0, len(used), batch):
            rows = used[at : at + batch]
            h = np.maximum(z[rows] @ p["w1"] + p["b1"], 0)
            error = (sigmoid(h @ p["w2"] + p["b2"]) - y[rows]) / len(rows)
            back = np.outer(error, p["w2"]) * (h > 0)
            grads = {"w1": z[rows].T @ back + 1e-4 * p["w1"], "b1": back.sum(axis=0), "w2": h.T @ error + 1e-4 * p["w2"], "b2": error.sum(keepdims=True)}
            step += 1
            for k, g in grads.items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model = p | {"mean": mean, "scale": scale, "t": 1.0}
    if len(held):
        logits, truth, temps = margins(model, x[held]), y[held], np.geomspace(0.5, 10, 60)
        loss = [-np.mean(np.log(np.clip(np.where(truth == 1, sigmoid(logits / t), 1 - sigmoid(logits / t)), 1e-9, 1))) for t in temps]
        model["t"] = float(temps[int(np.argmin(loss))])
    return model


def margins(model: dict, x: np.ndarray) -> np.ndarray:
    return np.maximum((x - model["mean"]) / model["scale"] @ model["w1"] + model["b1"], 0) @ model["w2"] + model["b2"][0]


def probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    return sigmoid(margins(model, x) / model["t"])


def train(docs: DataFrame, labels: DataFrame, learns, max_rows: int = 20_000) -> dict:
    """Word vectors from all of ``docs``, the network from at most ``max_rows`` labelled rows."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    sample = labelled_sample(docs, labels, "quality", learns, max_rows)

    def run(batches):
        table, fixed = WordTable(_terms), _fixed_table()
        for batch in slices(batches, most=1 << 20):
            x = pooled(batch, table, shared.value, fixed)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "label": batch.column("label"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    rows = sample.mapInArrow(run, "doc_id bigint, label int, x binary").toArrow()
    rows = rows.take(pa.array(np.argsort(rows.column("doc_id").to_numpy(), kind="stable")))
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, 3 * DIM)
    return fit(x.astype(np.float64), rows.column("label").to_numpy().astype(np.float64)) | {"vectors": vectors}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with quality_score, 0 to 1."""
    docs = without(docs, "quality_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: WORDS * DIM floats and a small network

    def run(batches):
        table, fixed = WordTable(_terms), _fixed_table()
        for batch in slices(batches, most=1 << 20):
            found = probabilities(shared.value, pooled(batch, table, shared.value["vectors"], fixed))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "quality_score"])

    return docs.mapInArrow(run, columns_after(docs, "quality_score double"))


def learns(doc_id):
    """Rows that may be learned from: crc32 of the id mod 4 isn't 2."""
    return F.pmod(crc_of_id(doc_id), F.lit(4)) != 2


def scores(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = score(docs, train(docs, labels, learns, max_rows))
    held = F.coalesce(~learns(F.col("doc_id")), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))
