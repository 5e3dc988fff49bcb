"""BPE, toxicity, language model and quality: exact round trips, brute force, held-out accuracy."""

import hashlib
import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from landsift.llm import bpe, lm, quality, toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def whole():
    from pathlib import Path

    return bpe._encoding(Path(RANKS).read_bytes(), public_tokenizers.PATTERN)


def test_bpe_is_that_of_whole_texts(documents, whole):
    got = {r["doc_id"]: r for r in bpe.digests(documents, RANKS, public_tokenizers.PATTERN).collect()}
    for r in documents.collect():
        ids = whole.encode_ordinary(r["text"] or "")
        g = got[r["doc_id"]]
        assert g["n_tokens"] == len(ids)
        assert g["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


@pytest.mark.parametrize("text", ["ab cd " * 50, "x" * 500, "a\n\n b  c\t d" * 40, "日本語 テキスト " * 60, "it's  we'll\r\n " * 40, "a  b  c " * 40, " " * 300 + "a" + " " * 300])
def test_pieces_do_not_change_ids(whole, text):
    for size in (1, 7, 50):
        parts = bpe.pieces(text, size)
        assert "".join(parts) == text
        assert [i for p in parts for i in whole.encode_ordinary(p)] == whole.encode_ordinary(text)


def test_decode_restores_split_characters(spark, whole):
    ids = whole.encode_ordinary("é日")
    df = spark.createDataFrame([(1, ids[:1], "x"), (2, None, "y"), (3, [], "z")], "k int, token_ids array<int>, decoded string")
    got = {r["k"]: bytes(r["decoded"]) for r in bpe.decode(df, RANKS, public_tokenizers.PATTERN).collect()}
    assert got == {1: whole.decode_bytes(ids[:1]), 2: b"", 3: b""}


def test_encode_keeps_other_columns(clashing, empty):
    out = bpe.encode(clashing, RANKS, public_tokenizers.PATTERN)
    assert out.columns == [*[c for c in clashing.columns if c != "token_ids"], "n_tokens", "token_ids"]
    assert out.count() == clashing.count()
    assert bpe.checked(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def labelled(spark, n=400):
    """Texts of common words; a toxic one has an insult."""
    r = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{r.randrange(300)}" for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            w[r.randrange(40)] = r.choice(["fooling", "foolish", "badly"])
        good = i % 3 != 0
        text = " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)
        rows.append((i, text, "en", "s", 0))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_learn_and_hold_out(spark, module, label):
    docs, labels = labelled(spark)
    out = module.scores(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    mod, rest = (5, 0) if label == "toxic" else (4, 2)
    assert {r["doc_id"] for r in held} == {i for i in range(400) if crc32(str(i).encode()) % mod == rest}
    assert all(0 <= r["score"] <= 1 for r in out)
    assert np.mean([r["predicted"] == r[label] for r in held]) > 0.9
    # labels of held-out rows teach nothing
    other = labels.withColumn(label, F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod)) == rest, 1 - F.col(label)).otherwise(F.col(label)))
    again = {r["doc_id"]: r["score"] for r in module.scores(docs, other).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in out)


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_stand_odd_rows(documents, empty, clashing, spark, module, label):
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 1), (4, 1, 1), (None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")
    assert module.scores(documents, labels).count() == documents.count()
    assert module.scores(empty, labels).count() == 0
    assert module.scores(documents, labels.limit(0)).where("score is null").count() == 0
    assert module.scores(clashing, labels).count() == clashing.count()


def test_pairs_matter():
    """Two terms that mean something only together: weights alone can't tell, the factorization machine can."""
    rng = np.random.default_rng(0)
    a, b = rng.random(3000) < 0.5, rng.random(3000) < 0.5
    y = (a ^ b).astype(float)
    lists = [[0, *([1] if p else [2]), *([3] if q else [4])] for p, q in zip(a, b)]
    buckets, lengths = np.array([x for r in lists for x in r]), np.array([len(r) for r in lists])
    m = toxicity.fit(buckets, lengths, y, steps=3000)
    p = toxicity.sigmoid(toxicity.margins(m, buckets, lengths))
    assert ((p >= 0.5) == y).mean() > 0.95


def test_keep_clean_keeps_columns(documents, spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    out = toxicity.keep_clean(documents, labels)
    assert out.columns == documents.columns


def brute_base(rows):
    tok = lambda t: [w for w in bytes((t or "").encode()).lower().split()] + [b"\n"]
    counts = Counter(w for i, t in rows if i is not None and crc32(str(i).encode()) % 7 != 2 for w in tok(t))
    n, v = sum(counts.values()), len(counts)
    return {i: (len(tok(t)), sum(counts[w] > 0 for w in tok(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tok(t))) for i, t in rows}


def test_base_scores_are_exact(documents):
    want = brute_base([(r["doc_id"], r["text"]) for r in documents.collect()])
    got = lm.scores(documents).collect()
    assert len(got) == documents.count()
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3]
        assert r["base_score"] == pytest.approx(w[3], abs=1e-6)
        assert r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert r["score"] <= 0 and math.isfinite(r["score"])


def test_the_model_prefers_what_it_has_seen(spark):
    r = random.Random(1)
    follow = {f"a{k}": f"a{(k * 7 + 3) % 50}" for k in range(50)}

    def text(ordered):
        w = [f"a{r.randrange(50)}"]
        for _ in range(60):
            w.append(follow[w[-1]] if ordered else f"a{r.randrange(50)}")
        return " ".join(w)

    rows = [(i, text(True)) for i in range(300)] + [(1000 + i, text(False)) for i in range(20)]
    out = lm.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), lambda i: i < 250).collect()
    seen = np.mean([x["score"] for x in out if 250 <= x["doc_id"] < 1000])
    odd = np.mean([x["score"] for x in out if x["doc_id"] >= 1000])
    assert seen > odd * 0.5  # far likelier
    assert seen > np.mean([x["base_score"] for x in out if 250 <= x["doc_id"] < 1000])


def test_lm_of_no_rows(empty, clashing):
    assert lm.scores(empty).count() == 0
    assert lm.scores(clashing).count() == clashing.count()


def test_filter_counts_are_never_too_low(spark):
    texts = [(i, " ".join(f"t{j}" for j in range(i + 1))) for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    shards, bits, table, tokens, types = lm.bloom(df, 1000)
    h, _ = lm.WordHasher()([f"t{j}".encode() for j in range(40)])
    counts = lm.probe(lm.word_keys(h), shards, bits, table)
    true = np.array([40 - j for j in range(40)])
    assert tokens == sum(true) + 40 and types == 41
    low = lm._count_of(lm._level(np.maximum(true, 1)))
    assert (counts[true > 1] >= low[true > 1] - 1e-9).all()
    assert isinstance(tiktoken, object)
