"""The content-addressed store: what is stored, told tampered, left by failures and resumed; canonical text in blocks."""

import hashlib
from pathlib import Path

import pyspark.sql.functions as F
import pytest

from landsift.operators import digests as D
from landsift.sources import blobs as B

SCHEMA = "name string, content binary"


def sha(data):
    return hashlib.sha256(data).hexdigest()


def files(root):
    return sorted(str(p.relative_to(root)) for p in Path(root).rglob("*") if p.is_file() and "manifests" not in p.parts and not p.name.startswith("."))


SOME = [("a", b"x" * 2500), ("b", b""), ("c", None), ("d", b"y" * 1000), ("e", b"x" * 2500), ("e", b"another"), ("ü", "ü".encode())]


def test_blobs_are_kept_once_by_digest_with_their_parts(spark, tmp_path):
    manifest = B.put(spark.createDataFrame(SOME, SCHEMA).repartition(3), str(tmp_path), 1000)
    got = sorted((r.name, r.sha256, r.bytes, tuple((p.sha256, p.bytes) for p in r.parts)) for r in manifest.collect())
    cut = lambda d: tuple((sha(d[k : k + 1000]), len(d[k : k + 1000])) for k in range(0, max(len(d), 1), 1000))
    assert got == sorted((n, sha(d or b""), len(d or b""), cut(d or b"")) for n, d in SOME)
    assert files(tmp_path) == sorted({"/".join(("sha256", h[:2], h[2:4], h)) for h in (sha(d or b"") for _, d in SOME)})
    assert {(r.state, r.bad_part) for r in B.audit(manifest, str(tmp_path), 1000).collect()} == {("verified", None)}
    back = {}
    for r in B.contents(manifest.where("name <> 'e'"), str(tmp_path)).orderBy("name", "at").collect():
        back[r.name] = back.get(r.name, b"") + bytes(r.content)
    assert back == {n: d or b"" for n, d in SOME if n != "e"}


def test_a_second_job_leaves_what_is_there(spark, tmp_path):
    rows = spark.createDataFrame(SOME, SCHEMA)
    B.put(rows, str(tmp_path))
    before = {p: (tmp_path / p).stat().st_mtime_ns for p in files(tmp_path)}
    B.put(rows, str(tmp_path))
    assert {p: (tmp_path / p).stat().st_mtime_ns for p in files(tmp_path)} == before


def test_nothing_to_store(spark, tmp_path):
    manifest = B.put(spark.createDataFrame([], SCHEMA), str(tmp_path))
    assert manifest.count() == 0 and B.audit(manifest, str(tmp_path)).count() == 0 and files(tmp_path) == []


def test_tampering_is_told(spark, tmp_path):
    manifest = B.put(spark.createDataFrame([(c, c.encode() * 2500) for c in "abcd"], SCHEMA), str(tmp_path), 1000)
    where = {r.name: tmp_path / r.blob_key for r in manifest.collect()}
    where["a"].unlink()
    where["b"].write_bytes(b"b" * 2499)
    where["c"].write_bytes(b"c" * 1500 + b"!" + b"c" * 999)
    names = {r.blob_key: r.name for r in manifest.collect()}
    assert {names[r.blob_key]: (r.state, r.bad_part) for r in B.audit(manifest, str(tmp_path), 1000).collect()} == {"a": ("missing", None), "b": ("size_mismatch", None), "c": ("digest_mismatch", 2), "d": ("verified", None)}
    with pytest.raises(Exception, match="part 2 isn't what was stored"):
        B.contents(manifest.where("name = 'c'"), str(tmp_path)).collect()


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    bad = spark.createDataFrame([*SOME, (None, b"nameless")], SCHEMA).repartition(4)
    with pytest.raises(Exception, match="no name"):
        B.put(bad, str(tmp_path))
    assert files(tmp_path) == []


def test_slices_in_any_order_and_a_gap(spark, tmp_path):
    text = bytes(range(256)) * 30
    rows = [("t", k, text[k : k + 700]) for k in range(0, len(text), 700)]
    make = lambda some: spark.createDataFrame(some, "name string, at long, content binary").repartition(5, "at")
    (got,) = B.put_slices(make(rows[::-1]), str(tmp_path), 1000).collect()
    assert (got.sha256, got.bytes) == (sha(text), len(text))
    with pytest.raises(Exception, match="content for place"):
        B.put_slices(make(rows[:3] + rows[4:]), str(tmp_path))


def test_a_job_stopped_between_commit_and_the_last_move_is_resumed(spark, tmp_path):
    rows = spark.createDataFrame(SOME, SCHEMA).repartition(2)
    job = B.stage(rows.select("name", F.lit(0).alias("at"), "content"), str(tmp_path))
    assert not any(p.startswith("sha256") for p in files(tmp_path))
    moved = sha(b"y" * 1000)
    held = next(p for p in (tmp_path / "pending" / job).rglob("*") if p.is_file() and p.read_bytes() == b"y" * 1000)
    (tmp_path / "sha256" / moved[:2] / moved[2:4]).mkdir(parents=True)
    held.rename(tmp_path / "sha256" / moved[:2] / moved[2:4] / moved)
    stray = tmp_path / "pending" / job / "dead"  # an attempt that was lost before it could commit
    stray.mkdir()
    (stray / "1").write_bytes(b"half")
    for _ in range(2):
        manifest = B.install(spark, str(tmp_path), job)
        assert manifest.count() == len(SOME) and {r.state for r in B.audit(manifest, str(tmp_path)).collect()} == {"verified"}
    assert all(p.startswith("sha256") for p in files(tmp_path))


def test_a_job_that_was_not_committed_is_not_installed(spark, tmp_path):
    with pytest.raises(B.BlobMissing):
        B.install(spark, str(tmp_path), "0" * 32)


LINES = [(k % 17, f"{k}:" + "é" * (k % 50)) for k in range(400)] + [(3, None), (3, None), (5, "z" * 5000), (5, "z" * 5000)]


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_blocks_are_those_of_one_writer_at_any_partitioning(spark, tmp_path, parts):
    whole = "".join(t + "\n" for _, t in sorted((k, t or "") for k, t in LINES)).encode()
    rows = spark.createDataFrame(LINES, "k int, t string").repartition(parts)
    manifest, tree = D.write_canonical(rows, ["k"], "t", str(tmp_path), "all", 777, len(whole))
    got = b"".join(bytes(r.content) for r in B.contents(manifest, str(tmp_path)).orderBy("name").collect())
    assert got == whole
    assert [r.sha256 for r in manifest.orderBy("block").collect()] == [sha(whole[k : k + 777]) for k in range(0, len(whole), 777)]
    root = D.roots(tree, ["text"]).first()
    assert root.digest == sha("\n".join(f"{n}:{sha(whole[k : k + 777])}" for n, k in enumerate(range(0, len(whole), 777))).encode())


def test_a_text_over_its_budget_is_refused_before_anything_is_written(spark, tmp_path):
    rows = spark.createDataFrame(LINES, "k int, t string")
    with pytest.raises(D.BudgetExceeded):
        D.write_canonical(rows, ["k"], "t", str(tmp_path), "all", 777, 1000)
    assert list(tmp_path.iterdir()) == []


def test_an_empty_text_has_no_block(spark, tmp_path):
    manifest, tree = D.write_canonical(spark.createDataFrame([], "k int, t string"), ["k"], "t", str(tmp_path), "none")
    assert manifest.count() == 0 and tree.count() == 0
