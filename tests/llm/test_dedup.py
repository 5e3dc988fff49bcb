"""Substring, exact and near dedup against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from landsift.llm import exact, near, substring
from landsift.llm.common import Windows, pack_numbers, pack_sorted, unpack_numbers, unpack_sorted

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute_substrings(rows, n):
    seen, gone = {}, {}
    docs = sorted({(i, t) for i, t in rows}, key=lambda x: x[0])
    words = {i: SPLIT.findall(t or "") for i, t in docs}
    for i, w in words.items():
        for s in range(len(w) - n + 1):
            key = tuple(w[s : s + n])
            if key in seen:
                gone.setdefault(i, set()).update(range(s, s + n))
            else:
                seen[key] = (i, s)
    out = {}
    for i, w in words.items():
        g = gone.get(i, set())
        kept = " ".join(x for k, x in enumerate(w) if k not in g)
        out[i] = (len(w), len(g), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("options", [{}, {"cells_per_window": 1e-9, "least_cells": 1 << 6}])
def test_substrings_are_those_of_brute_force(documents, options):
    """Also with a sketch so small that every window is estimated as repeated."""
    want = brute_substrings([(r["doc_id"], r["text"]) for r in documents.collect()], 20)
    got = substring.digests(documents, **options).collect()
    assert len(got) == documents.count()
    assert all(want[r["doc_id"]] == (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got)


def test_substrings_of_no_rows_and_clashing_columns(empty, clashing):
    assert substring.digests(empty).count() == 0
    assert substring.digests(clashing).count() == clashing.count()


@pytest.mark.parametrize("bits", [6, 16])
def test_segments_answer_what_a_dense_count_says(documents, bits, monkeypatch):
    """For each part and segment: whether each distinct cell was counted twice, over all parts."""
    monkeypatch.setattr(substring, "SEGMENT", 1 << 5)
    parts = [{"docs": 1, "text": (r["text"] or "").encode()} for r in documents.collect()]
    counts, rows = np.zeros((2, 1 << bits), int), []
    for k, p in enumerate(parts):
        h = Windows(20)([p["text"].split()])[:2]
        for row in (0, 1):
            np.add.at(counts[row], substring._cells(h[row], bits).astype(int), 1)
        batch = pa.record_batch({"part": [k], "docs": pa.array([1], pa.int32()), "lengths": pa.array([pack_numbers(np.array([len(p["text"])], np.uint64))]), "texts": pa.array([pa.compress(p["text"], "zstd", asbytes=True)])})
        rows += list(substring._sketches(20, bits)([batch]))
    sent = pa.Table.from_batches(rows)
    segments, size = substring._segments(bits)
    for segment in range(2 * segments):
        own = sent.filter(pc.equal(sent.column("segment"), segment))
        if own.num_rows:
            told = substring._merged(bits)(own)
            for n, blob, answer in zip(own.column("n").to_pylist(), own.column("cells").to_pylist(), told.column("repeated").to_pylist()):
                cells = np.unique(unpack_sorted(blob, n)).astype(int)
                row, k = divmod(segment, segments)
                assert (np.unpackbits(np.frombuffer(answer, np.uint8), count=len(cells)) == (counts[row, k * size + cells] > 1)).all()


def test_the_sketch_grows_with_the_windows():
    """Few single windows pass at every size, as the cells a window stay the same: 2 rows of 2 to 4 cells pass 16 in 100 at most."""
    assert all(2 <= (1 << substring.sketch_bits(w, 2.0, 1 << 16)) / w <= 4 for w in (1e6, 1e9, 1e12))
    rng = np.random.default_rng(1)
    bits = substring.sketch_bits(300_000, 2.0, 1 << 16)
    twice = [np.bincount(c, minlength=1 << bits)[c] > 1 for c in (rng.integers(0, 1 << bits, 300_000) for _ in range(2))]
    assert (twice[0] & twice[1]).mean() < 0.16


def test_packed_numbers():
    for values in (np.array([0, 0, 3, 254, 509, 100_000, 100_000], np.uint64), np.array([2**64 - 1], np.uint64), np.zeros(0, np.uint64)):
        assert unpack_sorted(pack_sorted(values), len(values)).tolist() == values.tolist()
        assert unpack_numbers(pack_numbers(values[::-1]), len(values)).tolist() == values[::-1].tolist()


def test_null_and_repeated_ids_and_long_texts(spark):
    base = " ".join(f"w{k}" for k in range(50))
    long = " ".join(f"x{k % 9000}y{k // 9000}" for k in range(400_000)) + " " + base
    rows = [(None, base), (None, base), (5, base), (5, base), (7, base + " tail"), (9, long), (9, None), (11, "")]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect())
    assert got == [(0, 50, 50), (0, 50, 50), (5, 50, 0), (5, 50, 0), (7, 51, 50), (9, 0, 0), (9, 400_050, 50), (11, 0, 0)]


def test_windows_hash_words_not_places():
    h1, h2, doc, start = Windows(3)([[b"a", b"b", b"c", b"d"], [b"x"], [b"z", b"b", b"c", b"d"]])
    assert doc.tolist() == [0, 0, 2, 2] and start.tolist() == [0, 1, 0, 1]
    assert h1[1] == h1[3] and h2[1] == h2[3] and len(set(h1.tolist())) == 3


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return {i: (min(v)[1], len(v), hashlib.sha256(k.encode()).hexdigest()) for k, v in groups.items() for _, i in v}


@pytest.mark.parametrize("history", ["doc_id % 2 = 0", "true", "false", "cast(null as boolean)"])
def test_exact_groups_do_not_depend_on_the_history(documents, history):
    want = brute_exact([(r["doc_id"], r["text"]) for r in documents.collect()])
    got = exact.group_exact(documents, F.expr(history)).collect()
    assert len(got) == documents.count()
    assert all(want[r["doc_id"]] == (r["keep_id"], r["group_size"], r["text_sha256"]) for r in got)
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == len({w[2] for w in want.values()})


def test_exact_keeps_one_row_a_text(documents, clashing, empty, spark):
    want = {w[0] for w in brute_exact([(r["doc_id"], r["text"]) for r in documents.collect()]).values()}
    kept = exact.keep_first(documents)
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    assert exact.keep_first(clashing).columns == clashing.columns
    assert exact.groups(empty).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b")], "doc_id bigint, text string")
    assert sorted(r["text"] for r in exact.keep_first(nulls).collect()) == ["a", "b"]


def test_minimal_perfect_hash():
    keys = np.frombuffer(b"".join(hashlib.sha256(str(k).encode()).digest() for k in range(3000)), np.uint8).reshape(-1, 32)
    sizes, cells = exact.build(keys[:2000])
    slots = exact.lookup(sizes, cells, keys[:2000])
    assert sorted(slots.tolist()) == list(range(2000))
    others = exact.lookup(sizes, cells, keys[2000:])
    assert others.max() < 2000
    with pytest.raises(ValueError):
        exact.build(np.concatenate((keys[:2], keys[:1])))


def brute_near(rows, n):
    sets = {}
    for i, t in rows:
        if i is not None:
            w = SPLIT.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
            sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    least = {i: i for i in sets}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                least[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("n", [2, 5])
def test_components_are_those_of_brute_force(documents, n):
    want = brute_near([(r["doc_id"], r["text"]) for r in documents.collect()], n)
    for r in near.components(documents, n).collect():
        assert want[r["doc_id"]] == (r["n_shingles"], r["component_id"])
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_components_where_buckets_are_solved_in_chunks(spark, monkeypatch):
    """Chains whose ends aren't alike, with the limits so low that all ways of comparing are taken."""
    monkeypatch.setattr(near, "SMALL", 2)
    monkeypatch.setattr(near, "CHUNK", 4)
    words = [f"v{k}" for k in range(200)]
    rows = [(k, " ".join(words[k * 2 : k * 2 + 60])) for k in range(40)] + [(100 + k, " ".join([*words[:50], *[f"y{k}_{j}" for j in range(2 + k % 5)]])) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = brute_near(rows, 2)
    got = near.components(df).collect()
    assert all(want[r["doc_id"]] == (r["n_shingles"], r["component_id"]) for r in got)
    assert len({w[1] for w in want.values()}) < 20


def test_near_of_no_rows_null_ids_and_clashing_columns(empty, clashing, spark):
    assert near.components(empty).count() == 0
    assert near.keep_one(clashing).columns == clashing.columns
    nulls = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, None)], "doc_id bigint, text string")
    assert sorted((r["component_id"], r["kept"]) for r in near.components(nulls).collect() if r["doc_id"]) == [(1, True)]
    assert near.components(nulls).where("kept").count() == 3


def test_signatures_estimate_similarity():
    a = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sig = near.superminhash(np.concatenate((a[:800], a[100:900])), np.array([800, 800]))
    assert abs((sig[0] == sig[1]).mean() - 700 / 900) < 0.12
    assert (near.superminhash(a[:1], np.array([1])) != 0xFFFFFFFF).all()
