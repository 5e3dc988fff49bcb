"""The language model knows all n-grams, single ones too, at every size; unseen histories get the whole lower-order mass."""

import random
from collections import Counter

import numpy as np
import pytest

from landsift.llm import lm


def texts(n):
    r = random.Random(3)
    return [(i, " ".join(f"w{r.randrange(40) if r.random() < 0.6 else 1000 + r.randrange(10**6)}" for _ in range(80))) for i in range(n)]


def test_single_ngrams_are_kept(spark):
    words = [f"once{k}".encode() for k in range(3000)]
    df = spark.createDataFrame([(0, " ".join(w.decode() for w in words))], "doc_id bigint, text string")
    shards, bits, table, tokens, types = lm.bloom(df, 1000)
    h, _ = lm.WordHasher()(words)
    keys = lm.word_keys(h)
    assert (tokens, types) == (3001, 3001)
    assert (lm.probe(keys, shards, bits, table) >= 1).all() and (lm.probe(lm.pair_keys(keys[:-1], keys[1:]), shards, bits, table) >= 1).all()
    other, _ = lm.WordHasher()([f"never{k}".encode() for k in range(3000)])
    assert (lm.probe(lm.word_keys(other), shards, bits, table) == 0).mean() > 0.95


def test_scores_are_those_of_all_counts(spark):
    rows = texts(60)
    tok = [[*t.encode().split(), b"\n"] for _, t in rows]
    one, two = Counter(w for t in tok[:50] for w in t), Counter(p for t in tok[:50] for p in zip(t, t[1:]))
    total = sum(one.values()) + len(one) + 1
    read = lambda c: float(lm._count_of(lm._level(np.array([c])))[0]) if c else 0.0

    def p(h, w):
        u = (read(one[w]) + 1) / total
        return 0.7 * min(read(two[h, w]) / read(one[h]), 1) + 0.3 * u if h is not None and one[h] else u

    want = {i: sum(np.log10(p(h, w)) for h, w in zip([None, *t], t)) for (i, _), t in zip(rows, tok)}
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), lambda i: i < 50).collect()}
    off = [abs(got[i] - want[i]) / len(t) for (i, _), t in zip(rows, tok)]
    assert np.median(off) < 0.005 and max(off) < 0.1  # by chance a count is read too high


def test_an_unseen_history_leaves_the_whole_lower_order_mass():
    got = lm._scores(np.array([5.0, 0.0, 3.0, 0.0, 0.0]), np.array([3]), 100)  # seen, unseen, seen
    assert got[0] == pytest.approx(np.log10(6 / 100) + np.log10(0.3 * 1 / 100) + np.log10(4 / 100))


def test_counts_do_not_depend_on_what_else_the_corpus_holds(spark):
    """What is read for an n-gram is its own level, whether the filter holds hundreds or hundreds of thousands of others."""
    words = [f"own{k % 50}".encode() for k in range(1275) if k % 50 <= k // 25]
    r = random.Random(8)
    rest = [(k, " ".join(f"x{r.randrange(10**9)}" for _ in range(1000))) for k in range(1, 151)]
    h, _ = lm.WordHasher()(words)
    keys = lm.word_keys(h)
    true = Counter(words)
    want = lm._count_of(lm._level(np.array([true[w] for w in words])))
    for rows in ([], rest):
        df = spark.createDataFrame([(0, b" ".join(words).decode()), *rows], "doc_id bigint, text string")
        segments, bits, table, _, _ = lm.bloom(df, 1000)
        found = lm.probe(keys, segments, bits, table)
        assert (found >= want).all() and (found == want).mean() > 0.97
        assert sum(bits) * 8 >= lm.BITS_EACH * 1000 * len(rows)  # the filter grows with the n-grams


def test_a_text_longer_than_a_part(spark):
    long = " ".join(f"w{i % 3000}" for i in range(1_000_000))
    rows = [(1, long), (2, "w1 w2"), (None, "w1"), (4, None), (2, "w1 w2 w3")]
    out = lm.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), lambda i: i != 2).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["held_out"]) for r in out) == [(0, 2, 2, False), (1, 1_000_001, 1_000_001, False), (2, 3, 3, True), (2, 4, 4, True), (4, 1, 1, False)]


@pytest.mark.parametrize("most", [0, 255, 256, 2**32 - 1, 2**32, 2**32 + 5, 2**60])
def test_counts_of_any_size_are_packed_whole(most):
    values = np.array([most, 1, 0])
    assert lm._uncounted(lm._counts(values), 3).tolist() == values.tolist()
    assert lm._uncounted(lm._counts(values[:0]), 0).tolist() == []
    assert lm._summed(np.array([1, 1, 0]), [values], 2).tolist() == [0, most + 1]
