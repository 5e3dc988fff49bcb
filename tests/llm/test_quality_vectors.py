"""Word vectors of the quality classifier: the merge in steps against one sum over everything."""

import random

import numpy as np
import pytest

from landsift.llm import quality
from landsift.llm.features import WordTable


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(4)
    rows = [(i, " ".join(f"w{r.randrange(60)}" for _ in range(r.randrange(25)))) for i in range(200)] + [(200, None), (201, ""), (202, "a a a a b")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9).cache()


def plain(docs):
    """The sum, for each word, of the fixed vectors of the words and shapes up to NEAR places away."""
    places, signs = quality.fixed_vectors()
    fixed = np.zeros((quality.SAME + 1, quality.DIM))
    for k in range(quality.ONES):
        np.add.at(fixed, (np.arange(quality.SAME + 1), places[:, k]), signs[:, k])
    total = np.zeros((quality.WORDS, quality.DIM))
    for row in docs.collect():
        t = [quality._terms(w) for w in (row["text"] or "").split()]
        for i, (w, _) in enumerate(t):
            for j in range(max(0, i - quality.NEAR), min(len(t), i + quality.NEAR + 1)):
                if i != j:
                    total[w] += fixed[quality.SAME if t[j][0] == w else t[j][0]] + fixed[t[j][1]]
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)


@pytest.mark.parametrize("fan", [2, 64])
def test_merging_in_steps_is_one_sum(docs, monkeypatch, fan):
    monkeypatch.setattr(quality, "FAN", fan)
    monkeypatch.setattr(quality, "text_size", lambda _: (203, 9 * (16 << 20)))
    assert np.allclose(quality.word_vectors(docs), plain(docs), atol=1e-5)


def test_no_words_no_vectors(spark):
    assert not quality.word_vectors(spark.createDataFrame([(1, None), (2, "alone")], "doc_id bigint, text string")).any()


def test_probabilities_are_those_of_the_plain_network(docs):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(300, 3 * quality.DIM)), (rng.random(300) < 0.4).astype(float)
    m = quality.fit(x, y, steps=50)
    got = quality.probabilities(m, x[:5])
    for a, g in zip(x[:5], got):
        z = (a - m["mean"]) / m["scale"]
        hidden = [max(sum(z[i] * m["w1"][i, j] for i in range(len(z))) + m["b1"][j], 0) for j in range(len(m["b1"]))]
        margin = sum(h * w for h, w in zip(hidden, m["w2"])) + m["b2"][0]
        assert g == pytest.approx(1 / (1 + np.exp(-margin / m["t"])))


def test_repeated_ids_with_other_texts_are_scored_each(spark):
    docs = spark.createDataFrame([(1, "good words here"), (1, "BAD!!! BAD!!!"), (2, "x " * 200_000)], "doc_id bigint, text string")
    out = quality.scores(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id bigint, quality int")).collect()
    assert len(out) == 3 and all(0 <= r["score"] <= 1 for r in out)
    assert WordTable(quality._terms)(["a", "b"]).shape == (2, 2)
