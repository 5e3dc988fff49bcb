"""The pipeline stage by stage against plain computations on what its predecessor kept."""

import hashlib
import math
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from test_dedup import brute_exact, brute_near

import corpus_pipeline
from landsift.llm import bpe, toxicity
from landsift.llm.common import stored

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage gives, from the documents on."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = stored(stage(spark, docs, SF), f"test-{name}")
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_toxicity_keeps_what_the_plain_machine_calls_clean(spark, stages):
    model = toxicity.train(stages["documents"], spark.read.parquet(f"{SF}/labels.parquet"), toxicity.learns)
    known = (model["w"] != 0) | (model["v"] != 0).any(axis=1)

    def margin(text):
        found = sorted({b for w in set(toxicity._WORD.findall((text or "").lower())) for b in toxicity._buckets(w) if known[b]})
        v = [model["v"][b].astype(float) for b in found]
        pairs = sum(float(v[i] @ v[j]) for i in range(len(v)) for j in range(i)) if len(v) < 300 else 0.5 * float((np.sum(v, axis=0) ** 2 - np.sum(np.square(v), axis=0)).sum())
        return model["w0"] + sum(float(model["w"][b]) for b in found) + min(1.0, toxicity.PAIRED / max(len(found), 1)) * pairs

    told = {r["doc_id"]: margin(r["text"]) for r in rows(stages["documents"])}
    kept = {r["doc_id"] for r in rows(stages["toxicity"])}
    assert all((told[i] < 0) == (i in kept) for i in told if abs(told[i]) > 1e-3)
    assert stages["toxicity"].columns == stages["documents"].columns


def test_exact_keeps_one_row_a_text(stages):
    before = rows(stages["toxicity"])
    want = sorted({k[0] for k in brute_exact([(r["doc_id"], r["text"]) for r in before]).values()})
    after = rows(stages["exact"])
    assert sorted(r["doc_id"] for r in after) == want
    by = {r["doc_id"]: r for r in before}
    assert all(r == by[r["doc_id"]] for r in after)


def test_near_keeps_one_document_a_component(stages):
    before = rows(stages["exact"])
    found = brute_near([(r["doc_id"], r["text"]) for r in before], 5)
    want = sorted(i for i, (size, component) in found.items() if size == 0 or i == component)
    assert sorted(r["doc_id"] for r in rows(stages["near"])) == want


def test_mixing_draws_the_inverse_poisson_numbers(stages):
    before = rows(stages["near"])
    counts = Counter(r["source"] for r in before)
    weight = {s: math.sqrt(n) for s, n in counts.items()}
    rate = {s: weight[s] / sum(weight.values()) * len(before) / n for s, n in counts.items()}

    def copies(r):
        u, k, p = int(hashlib.md5(f"17:{r['doc_id']}:1".encode()).hexdigest()[:13], 16) / 2.0**52, 0, math.exp(-rate[r["source"]])
        total = p
        while total <= u:
            k += 1
            p *= rate[r["source"]] / k
            total += p
        return k

    want = Counter({r["doc_id"]: copies(r) for r in before})
    assert Counter(r["doc_id"] for r in rows(stages["mixing"])) == Counter({i: n for i, n in want.items() if n})
    assert stages["mixing"].columns == stages["documents"].columns


def test_tokens_are_those_of_whole_texts(stages):
    whole = bpe._encoding(Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes(), public_tokenizers.PATTERN)
    want = sorted((r["doc_id"], whole.encode_ordinary(r["text"] or "")) for r in rows(stages["mixing"]))
    assert sorted((r["doc_id"], r["token_ids"]) for r in rows(stages["tokens"])) == want


def test_run_applies_all_stages(spark, stages):
    got = sorted((r["doc_id"], r["source"], r["n_tokens"], tuple(r["token_ids"])) for r in rows(corpus_pipeline.run(spark, SF)))
    assert got == sorted((r["doc_id"], r["source"], r["n_tokens"], tuple(r["token_ids"])) for r in rows(stages["tokens"]))
