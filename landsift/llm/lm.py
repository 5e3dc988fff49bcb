"""LM scoring: a log-frequency Bloom filter of quantised n-gram counts, kept by shards of n-grams.

Training counts all words and pairs of words, single ones too. A count c is quantised to the level 1 + floor(log c / log
BASE), and the n-gram is inserted once for each level from 1 to its own; so a count is read back by
probing level after level until one is missing. The filter has BITS_EACH bits an insertion or more at every size, so
it grows with the n-grams of the corpus, and for that reason it isn't broadcast: the probes travel to the
segments. Each part of the corpus (some PART_BYTES of text) sends its distinct words and pairs, with their training
counts, to their shards; a shard sums the counts, makes its segments of the filter and answers each
part with the levels that it reads there. A missing n-gram may be found by chance, so a count is never
read too low, now and then too high.

The probability of a word after another is LAMBDA * c(h, w) / c(h) (at most LAMBDA) + (1 - LAMBDA) * u, with u =
(c(w) + 1) / (N + V + 1) and the counts read from the filter. Where h wasn't seen in training, or there is none, it is u.

The base score needs exact counts: a shard knows its words byte for byte, and its answer holds their exact
counts too. A part keeps its texts as numbers of its own distinct words meanwhile, so a word that stands in every
document costs no more than another: an entry a part.

What is sent is a row a part and shard that meet, at most one an n-gram of the part, so it grows in
proportion to the corpus. A task holds one part, or one shard (n-grams of some SHARD_BYTES of text); a text longer
than a part is a part of its own.

Rows: null counts as empty; a text of no words has the one token end. Rows with a null id aren't
learned from and are not held out. Rows of one id are scored each on its own. Other columns don't matter.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landsift.llm.common import WordHasher, as_bytes, crc_of_id, gathered, ids_of, mix, parts_for, starts_of, stored, text_size

BASE, LAMBDA, HASHES, BITS_EACH = 1.5, 0.7, 4, 10
KEY_BITS = 48
LAST = np.uint64(1 << (64 - KEY_BITS))
END = b"\n"  # no word holds a line feed
PART_BYTES, SHARD_BYTES = 4 << 20, 16 << 20
SEGMENTS = 16  # of the filter a shard


def _level(counts: np.ndarray) -> np.ndarray:
    return (1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9)).astype(np.int64)


def _count_of(level: np.ndarray) -> np.ndarray:
    """About the middle of what a level stands for; 0 for level 0."""
    low = np.ceil(BASE ** np.maximum(level - 1, 0) - 1e-9)
    high = np.maximum(np.ceil(BASE ** np.maximum(level, 0) - 1e-9) - 1, low)
    return np.where(level > 0, (low + high) / 2, 0.0)


COUNTS = _count_of(np.arange(256))


def _tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]  # bytes.lower() is A-Z only


def _bytes(values, kind) -> bytes:
    return np.asarray(values, kind).tobytes()


def word_keys(hashes: np.ndarray) -> np.ndarray:
    """KEY_BITS bits of the hashes of words; words are even numbers, pairs odd."""
    return (hashes >> np.uint64(64 - KEY_BITS) & ~np.uint64(1)).astype(np.int64)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Numbers of pairs of words that have these keys."""
    mixed = mix(first.astype(np.uint64) * np.uint64(3) + mix(second.astype(np.uint64)))
    return (mixed >> np.uint64(64 - KEY_BITS) | np.uint64(1)).astype(np.int64)


def _local_pairs(place: np.ndarray, lengths: np.ndarray, keys: np.ndarray):
    """(which tokens have a predecessor, the pair of each of these, the sorted keys of the pairs); ``place`` numbers the tokens by words with ``keys``."""
    inner = np.ones(len(place), bool)
    inner[starts_of(lengths)] = False
    second = np.flatnonzero(inner)
    pairs, at = np.unique(place[second - 1] * len(keys) + place[second], return_inverse=True)
    found = pair_keys(keys[pairs // len(keys)], keys[pairs % len(keys)])
    order = np.argsort(found, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return inner, rank[at], found[order]


def _positions(keys: np.ndarray, level: int, width: int) -> np.ndarray:
    """HASHES places of each (n-gram, level) in a segment of ``width`` bits, a power of two."""
    a = mix(keys.astype(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    b = mix(a ^ np.uint64(0xD6E8FEB86659FD93))
    return ((a[None, :] + np.arange(HASHES, dtype=np.uint64)[:, None] * b[None, :]) & np.uint64(width - 1)).astype(np.int64)


def _segment(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The segment of the filter that holds ``keys``, sized from the number of their insertions."""
    keys, levels = keys[counts > 0], _level(counts[counts > 0])
    segment, level = np.zeros(1 << max(6, int(levels.sum() * BITS_EACH).bit_length()), bool), 1
    while len(keys):
        segment[_positions(keys, level, len(segment)).ravel()] = True
        level += 1
        keys, levels = keys[levels >= level], levels[levels >= level]
    return np.packbits(segment, bitorder="little")


def _read(keys: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """The levels found in ``segment`` for ``keys``."""
    level, alive, step = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 1
    while len(alive) and step < 128:
        hit = np.ones(len(alive), bool)
        for place in _positions(keys[alive], step, len(segment) * 8):
            hit &= (segment[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        alive = alive[hit]
        level[alive] = step
        step += 1
    return level


def _edges(keys: np.ndarray, segments: int) -> np.ndarray:
    """Where each segment starts and ends in sorted ``keys``."""
    return np.searchsorted(keys, np.arange(segments + 1) * ((1 << KEY_BITS) // segments))


def _gapped(keys: np.ndarray) -> bytes:
    """The gaps between sorted numbers: their low 32 bits, then the next 16, which are mostly 0."""
    gaps = np.diff(keys, prepend=0)
    return _bytes(gaps & 0xFFFFFFFF, np.uint32) + _bytes(gaps >> 32, np.uint16)


def _ungapped(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, np.uint32, n).astype(np.int64) + (np.frombuffer(blob, np.uint16, n, 4 * n).astype(np.int64) << 32))


def _shards(size: int) -> int:
    return 1 << (parts_for(size, SHARD_BYTES, 16) - 1).bit_length()


def _counts(values: np.ndarray) -> bytes:
    """Counts of up to 64 bits, all of the width that the largest needs."""
    most = int(values.max()) if len(values) else 0
    return _bytes(values, np.uint8 if most < 1 << 8 else np.uint32 if most < 1 << 32 else np.uint64)


def _uncounted(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, {1: np.uint8, 4: np.uint32, 8: np.uint64}[len(blob) // n if n else 1]).astype(np.int64)


def _summed(at: np.ndarray, counts: list[np.ndarray], n: int) -> np.ndarray:
    """The sums of ``counts`` by ``at``, whole numbers throughout."""
    out = np.zeros(n, np.int64)
    np.add.at(out, at, np.concatenate([np.zeros(0, np.int64), *counts]))
    return out


def _parts(shards: int):
    """Of each part of the corpus: a row a shard that it meets, with its words and pairs there, and a row (shard null) with its texts."""

    def run(batches):
        hasher, partition, seq = WordHasher(), TaskContext.get().partitionId(), 0
        width = (1 << KEY_BITS) // shards
        for batch in gathered(batches, PART_BYTES):
            texts = [_tokens(t) for t in as_bytes(batch)]
            lengths = np.array([len(t) for t in texts], np.int64)
            at = hasher.numbers([w for t in texts for w in t])
            del texts
            used = np.flatnonzero(np.bincount(at))
            keys = word_keys(hasher.table()[used, 0])
            order = np.argsort(keys, kind="stable")
            used, keys = used[order], keys[order]  # the part's own words, by shard
            number = np.empty(used.max() + 1, np.int64)
            number[used] = np.arange(len(used))
            place = number[at]
            every = list(hasher.ids)
            words = [every[k] for k in used.tolist()]
            learned = np.repeat(batch.column("training").to_numpy(zero_copy_only=False).astype(bool), lengths)
            inner, pair, pairs = _local_pairs(place, lengths, keys)
            word_counts = np.bincount(place, learned, len(keys)).astype(np.int64)
            pair_counts = np.bincount(pair, learned[inner], len(pairs)).astype(np.int64)
            bounds = np.arange(shards + 1) * width
            heads, tails = np.searchsorted(keys, bounds), np.searchsorted(pairs, bounds)
            part, rows = (partition << 32) + seq, []
            for s in np.flatnonzero((np.diff(heads) > 0) | (np.diff(tails) > 0)).tolist():
                a, b, p, q = heads[s], heads[s + 1], tails[s], tails[s + 1]
                rows.append((s, int(b - a), b" ".join(words[a:b]), _counts(word_counts[a:b]), int(q - p), _gapped(pairs[p:q] - s * width), _counts(pair_counts[p:q]), None, None))
            members = _bytes(ids_of(batch), np.int64) + _bytes(batch.column("doc_id").is_null().to_numpy(zero_copy_only=False), np.uint8) + _bytes(batch.column("held_out").to_numpy(zero_copy_only=False), np.uint8) + _bytes(lengths, np.int64)
            planes = place.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()  # like bytes beside each other pack better
            rows.append((None, len(keys), None, None, None, None, None, members, _gapped(keys) + pa.compress(planes, "zstd", asbytes=True)))
            yield pa.record_batch({"part": pa.array([part] * len(rows), pa.int64()), **{c: pa.array([r[k] for r in rows], _KINDS[t]) for k, (c, t) in enumerate(x.split() for x in SENT.split(", ")[1:])}})
            seq += 1

    return run


_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
SENT = "part bigint, shard int, words int, names binary, word_counts binary, pairs int, gaps binary, pair_counts binary, members binary, texts binary"
ANSWERS = "part bigint, shard int, exact binary, word_levels binary, pair_levels binary, tokens bigint, types bigint"


def _shard(table: pa.Table, shards: int):
    """Of a shard: (its distinct words, their exact counts, which of them each entry is, its distinct keys, their counts, which of them each distinct word and each pair entry is)."""
    width = (1 << KEY_BITS) // shards
    rows = table.select(["shard", "words", "names", "word_counts", "pairs", "gaps", "pair_counts"]).to_pylist()
    named = pa.array([w for r in rows if r["words"] for w in r["names"].split(b" ")], pa.binary()).dictionary_encode()
    words, at = named.dictionary.to_pylist(), named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    exact = _summed(at, [_uncounted(r["word_counts"], r["words"]) for r in rows], len(words))
    hashes = np.frombuffer(b"".join(blake2b(w, digest_size=16).digest() for w in words), np.uint64)[::2]
    keys = [word_keys(hashes)] + [_ungapped(r["gaps"], r["pairs"]) + r["shard"] * width for r in rows]
    counts = [exact] + [_uncounted(r["pair_counts"], r["pairs"]) for r in rows]
    keys, which = np.unique(np.concatenate(keys), return_inverse=True)
    return words, exact, at, keys, _summed(which, counts, len(keys)), which


def _segments(shard: int, shards: int, keys: np.ndarray, counts: np.ndarray):
    """(keys, segment of the filter) for each segment of a shard, in order."""
    edges = _edges(keys, shards * SEGMENTS)
    for k in range(shard * SEGMENTS, (shard + 1) * SEGMENTS):
        own = slice(edges[k], edges[k + 1])
        yield keys[own], _segment(keys[own], counts[own])


def _answers(shards: int):
    """Of a shard, for each part: exact counts and levels of its words, levels of its pairs; then the shard's tokens and types."""

    def run(table: pa.Table) -> pa.Table:
        words, exact, at, keys, counts, which = _shard(table, shards)
        shard = table.column("shard")[0].as_py()
        levels = np.concatenate([_read(k, bits) for k, bits in _segments(shard, shards, keys, counts)])
        word_levels, pair_levels = levels[which[: len(words)]], levels[which[len(words) :]]
        heads, tails = (np.concatenate(([0], np.cumsum(table.column(c).to_numpy()))) for c in ("words", "pairs"))
        rows = []
        for i, part in enumerate(table.column("part").to_pylist()):
            own = at[heads[i] : heads[i + 1]]
            rows.append((part, shard, _counts(exact[own]), word_levels[own].tobytes(), pair_levels[tails[i] : tails[i + 1]].tobytes(), None, None))
        rows.append((-1, shard, None, None, None, int(exact.sum()), int((exact > 0).sum())))
        return pa.table({c: pa.array([r[k] for r in rows], _KINDS[t]) for k, (c, t) in enumerate(x.split() for x in ANSWERS.split(", "))})

    return run


def bloom(training: DataFrame, size: int) -> tuple[int, np.ndarray, list[np.ndarray], int, int]:
    """(segments, bytes of each, the segments, tokens, distinct words) of ``training``, put together on the driver: to look into, for small corpora only."""
    shards = _shards(size)

    def segments(table: pa.Table) -> pa.Table:
        _, exact, _, keys, counts, _ = _shard(table, shards)
        shard = table.column("shard")[0].as_py()
        bits, rest = [x.tobytes() for _, x in _segments(shard, shards, keys, counts)], [0] * (SEGMENTS - 1)
        return pa.table({"segment": pa.array(range(shard * SEGMENTS, (shard + 1) * SEGMENTS), pa.int64()), "bits": pa.array(bits, pa.binary()), "tokens": pa.array([int(exact.sum()), *rest], pa.int64()), "types": pa.array([int((exact > 0).sum()), *rest], pa.int64())})

    rows = training.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("training"), F.lit(False).alias("held_out"))
    packed = rows.mapInArrow(_parts(shards), SENT).where("shard is not null")
    table = [np.zeros(8, np.uint8)] * (shards * SEGMENTS)
    tokens = types = 0
    for k, bits, n, v in packed.groupBy("shard").applyInArrow(segments, "segment bigint, bits binary, tokens bigint, types bigint").collect():
        table[k], tokens, types = np.frombuffer(bits, np.uint8), tokens + n, types + v
    return len(table), np.array([len(x) for x in table]), table, tokens, types


def probe(keys: np.ndarray, segments: int, bits: np.ndarray, table: list[np.ndarray]) -> np.ndarray:
    """The counts read from the filter for the keys of words or pairs."""
    distinct, at = np.unique(keys, return_inverse=True)
    edges = _edges(distinct, segments)
    level = np.concatenate([_read(distinct[edges[k] : edges[k + 1]], table[k]) for k in range(segments)]).astype(np.int64)
    return _count_of(level)[at]


def _scores(count: np.ndarray, lengths: np.ndarray, types: int) -> np.ndarray:
    """log10 of the probability of each text, from the counts of its words, then of its pairs; ``types`` is N + V + 1."""
    one, two, inner = count[: lengths.sum()], np.zeros(lengths.sum()), np.ones(lengths.sum(), bool)
    inner[starts_of(lengths)] = False
    two[inner] = count[len(one) :]
    before = np.concatenate(([0.0], one[:-1]))
    unigram = np.minimum((one + 1) / types, 1.0)
    p = np.where(inner & (before > 0), LAMBDA * np.minimum(two / np.maximum(before, 1e-9), 1.0) + (1 - LAMBDA) * unigram, unigram)
    return np.add.reduceat(np.log10(p), starts_of(lengths))


def _sum_up(types: int):
    """The texts of a part, from the answers of all shards."""

    def run(parts: pa.Table, answers: pa.Table) -> pa.Table:
        members, texts, words = parts.column("members")[0].as_py(), parts.column("texts")[0].as_py(), parts.column("words")[0].as_py()
        size = len(members) // 18
        member = lambda kind, before: np.frombuffer(members, kind, size, before * size)
        lengths = member(np.int64, 10)
        keys = _ungapped(texts, words)
        planes = np.frombuffer(pa.decompress(texts[6 * words :], 4 * int(lengths.sum()), "zstd", asbytes=True), np.uint8)
        place = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
        answers = answers.sort_by("shard")
        of = lambda c: answers.column(c).to_pylist()
        word_levels = np.frombuffer(b"".join(of("word_levels")), np.uint8)
        exact = np.concatenate([_uncounted(x, len(y)) for x, y in zip(of("exact"), of("word_levels"), strict=True)])
        _, pair, _ = _local_pairs(place, lengths, keys)
        pair_counts = COUNTS[np.frombuffer(b"".join(of("pair_levels")), np.uint8)][pair]
        score = _scores(np.concatenate((COUNTS[word_levels][place], pair_counts)), lengths, types)
        first = starts_of(lengths)
        gain = np.add.reduceat(np.log10(exact + 1.0)[place], first)
        known = np.add.reduceat((exact > 0)[place], first, dtype=np.int64)
        return pa.table({"doc_id": pa.array(member(np.int64, 0), mask=member(np.uint8, 8) == 1), "held_out": pa.array(member(np.uint8, 9) == 1), "n_tokens": pa.array(lengths), "n_known": pa.array(known), "gain": pa.array(gain), "score": pa.array(score)})

    return run


def score_texts(docs: DataFrame, learns) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``.

    ``learns(doc_id)`` says which rows are learned from.
    """
    learned = learns(F.col("doc_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", "text", F.coalesce(learned, F.lit(False)).alias("training"), F.coalesce(~learned, F.lit(False)).alias("held_out"))
    _, size = text_size(rows)
    shards = _shards(size)
    sent = stored(rows.mapInArrow(_parts(shards), SENT), "lm-parts")
    asked = sent.where("shard is not null").drop("members", "texts")
    answers = stored(asked.groupBy("shard").applyInArrow(_answers(shards), ANSWERS), "lm-answers")
    n, v = answers.where("part = -1").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    kept = sent.where("shard is null").select("part", "words", "members", "texts")
    replies = answers.where("part >= 0").drop("tokens", "types")
    out = kept.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(_sum_up(n + v + 1), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, gain double, score double")
    base = F.col("gain") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1.0)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def learns(doc_id):
    """Rows that the query learns from: crc32 of the id mod 7 isn't 2."""
    return F.pmod(crc_of_id(doc_id), F.lit(7)) != 2


def scores(docs: DataFrame) -> DataFrame:
    return score_texts(docs, learns)
