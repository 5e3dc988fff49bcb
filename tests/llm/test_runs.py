"""Runs against a search for every period at every place."""

import random
from hashlib import sha256
from pathlib import Path
from zlib import crc32

import pytest

from landsift.llm import queries, runs

SF = "/root/testdata/sf0.001"


def brute(words, least=12):
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                out.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = j + 1 if j == i else j
    return sorted(((i, n, q) for (i, n), q in out.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    if doc_id is None or not words:
        return words
    h = crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def answer(doc_id, text):
    words = planted(doc_id, (text or "").encode().split())
    found = brute(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    said = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha256(said.encode()).hexdigest(), sha256(kept).hexdigest())


def some(r):
    n, k = r.choice([0, 1, 11, 12, 13, 40, 90, 200]), r.choice([1, 2, 2, 3, 5, 60])
    words = [b"%d" % r.randrange(k) for _ in range(n)]
    if n and r.random() < 0.5:
        a = r.randrange(n)
        p = 1 + (n - a) // (3 + r.randrange(8))
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words + words[: r.randrange(n + 1)] + words if r.random() < 0.3 else words


@pytest.mark.parametrize("seed", range(6))
def test_all_runs_of_random_words(seed):
    r = random.Random(seed)
    for _ in range(120):
        docs = [some(r) for _ in range(r.randrange(1, 6))]
        assert runs.find(docs) == [brute(d) for d in docs]


def test_words_of_fibonacci():
    a, b = "0", "01"
    while len(b) < 700:
        a, b = b, b + a
    words = [c.encode() for c in b]
    assert runs.find([words, words]) == [brute(words)] * 2


def test_longest_previous_factors():
    import numpy as np

    r = random.Random(9)
    words = [r.randrange(3) for _ in range(300)]
    places = runs.Places(np.array(words), np.array([300]))
    at, size, source = runs.previous_factors(places)
    for i, n, s in zip(at, size, source, strict=True):
        best = max(next((k for k in range(300 - i) if words[j + k] != words[i + k]), 300 - i) for j in range(i)) if i else 0
        assert (n == best or best == 1) and (not n or (s < i and words[s : s + n] == words[i : i + n]))


def test_query_on_odd_documents(spark, documents, clashing, empty):
    more = spark.createDataFrame([(None, "a b " * 20, "en", "s", 0), (77, "x " * 2500, "en", "s", 0), (78, "p q r " * 800 + "s", "en", "s", 0)], documents.schema)
    docs = documents.unionByName(more)
    expected = sorted((answer(r.doc_id, r.text) for r in docs.where("doc_id is null or doc_id <> 11").collect()), key=str)
    for d in (docs, clashing.unionByName(more, allowMissingColumns=True)):
        got = runs.digests(runs.planted(d)).where("doc_id is null or doc_id <> 11").collect()
        assert sorted(map(tuple, got), key=str) == expected
    assert runs.digests(runs.planted(empty)).collect() == []


def test_a_text_of_megabytes(spark):
    import re

    text = "\t".join(f"w{i}" for i in range(250_000)) + " tail of the text" * 5
    got = runs.periodic(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert [tuple(x) for x in got.runs] == [(250_000, 20, 4)] and got.n_words == 250_020
    assert got.collapsed == re.sub(r"\s", " ", text.removesuffix(" tail of the text" * 4))


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_query_against_brute_force(spark):
    got = {r.doc_id: tuple(r) for r in queries.queries()["op11_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        if len(d.text or "") < 8000:  # the brute force is quadratic
            assert got[d.doc_id] == answer(d.doc_id, d.text)
