"""A content-addressed store as a Spark sink: blobs staged by tasks, committed, installed under their digests, re-hashed on read.

A store is a folder that driver and executors share. ``sha256/aa/bb/<digest>`` holds a blob, ``pending/<job>`` what a job has staged
and not installed, ``manifests/<job>`` what it installed: a table with a row a blob. A job goes through three steps:

* stage: each task streams its blobs to files of its own attempt, hashing them whole and by parts of PART_BYTES, and writes a
  manifest of them. A task that fails removes its files, a job that fails all of its own; nothing of it is seen in the store.
* commit: the driver notes which attempts count, one line a task.
* install: a Spark job moves the files of these attempts to their digests. A blob that is there already stays as it is. Moving
  twice does what moving once does, so a stopped job is resumed by ``install``.

Content null is an empty blob. A blob without a name fails the job. Repeated names are blobs of their own. An empty frame gives an
empty manifest. Blobs of any length are streamed; a row of content must fit in a row of Spark.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from landsift.functions.scalars import blob_key

PART_BYTES = 8 << 20
#: How much of a file is read at once.
CHUNK = 1 << 20
#: Bytes that a task of an audit hashes, and blobs that a task of an installation moves.
AUDIT_BYTES, INSTALL_BLOBS = 1 << 30, 10_000
_PARTS = pa.list_(pa.struct([("sha256", pa.string()), ("bytes", pa.int64())]))
_MANIFEST = pa.schema([("name", pa.string()), ("sha256", pa.string()), ("bytes", pa.int64()), ("parts", _PARTS), ("attempt", pa.string()), ("staged", pa.string())])
_SCHEMA = "name string, sha256 string, bytes bigint, parts array<struct<sha256:string,bytes:bigint>>, attempt string, staged string"


class BlobMissing(ValueError):
    """Neither staged nor installed."""


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, as Spark itself resolves it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def _files(uri: str):
    """The file system of a qualified folder and the folder's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


class _Hashes:
    """Digests of a stream, whole and by parts."""

    def __init__(self, size: int):
        self.size, self.bytes, self.parts = size, 0, []
        self.whole, self.part, self.left = hashlib.sha256(), hashlib.sha256(), size

    def add(self, data) -> None:
        view = memoryview(data)
        self.bytes += len(view)
        self.whole.update(view)
        while len(view):
            now = view[: self.left]
            self.part.update(now)
            self.left -= len(now)
            view = view[len(now) :]
            if not self.left:
                self._cut()

    def _cut(self) -> None:
        self.parts.append({"sha256": self.part.hexdigest(), "bytes": self.size - self.left})
        self.part, self.left = hashlib.sha256(), self.size

    def done(self) -> tuple[str, int, list[dict]]:
        if self.left < self.size or not self.parts:  # an empty blob has one empty part
            self._cut()
        return self.whole.hexdigest(), self.bytes, self.parts


@dataclass
class Staged(WriterCommitMessage):
    """What a task tells the driver: its attempt, whatever it wrote."""

    attempt: str


class _Attempt:
    """The files of one attempt: what follows under one name, from place 0 on, is a blob."""

    def __init__(self, files, folder: str, attempt: str, part: int):
        from pyarrow import parquet

        self.files, self.folder, self.attempt, self.part = files, folder, attempt, part
        files.create_dir(folder, recursive=True)
        self.manifest = parquet.ParquetWriter(f"{folder}/manifest.parquet", _MANIFEST, filesystem=files)
        self.rows, self.n, self.name, self.out, self.hashes = [], 0, None, None, None

    def add(self, name: str | None, at: int, content) -> None:
        if name is None:
            raise ValueError("a blob has no name")
        if name != self.name or at == 0:
            self._end()
            self.name, self.hashes, self.n = name, _Hashes(self.part), self.n + 1
            self.out = self.files.open_output_stream(f"{self.folder}/{self.n}")
        if at != self.hashes.bytes:
            raise ValueError(f"{name}: content for place {at} after {self.hashes.bytes} bytes")
        if content is not None:
            self.hashes.add(content)
            self.out.write(content)

    def _end(self) -> None:
        if self.out is None:
            return
        self.out.close()
        sha, size, parts = self.hashes.done()
        self.rows.append({"name": self.name, "sha256": sha, "bytes": size, "parts": parts, "attempt": self.attempt, "staged": f"{self.attempt}/{self.n}"})
        self.out = None
        if len(self.rows) >= 10_000:
            self._flush()

    def _flush(self) -> None:
        self.manifest.write_table(pa.Table.from_pylist(self.rows, _MANIFEST))
        self.rows = []

    def close(self) -> None:
        self._end()
        self._flush()
        self.manifest.close()

    def drop(self) -> None:
        if self.out is not None:
            self.out.close()
        self.manifest.close()
        self.files.delete_dir(self.folder)


class _Writer(DataSourceArrowWriter):
    def __init__(self, uri: str, job: str, part: int):
        self.uri, self.job, self.part = uri, job, part

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        files, root = _files(self.uri)
        attempt = uuid.uuid4().hex
        stage = _Attempt(files, f"{root}/pending/{self.job}/{attempt}", attempt, self.part)
        try:
            for batch in iterator:
                name, at, content = (batch.column(batch.schema.get_field_index(c)) for c in ("name", "at", "content"))
                for k in range(batch.num_rows):
                    stage.add(name[k].as_py(), at[k].as_py(), content[k].as_buffer())
            stage.close()
        except BaseException:
            stage.drop()
            raise
        return Staged(attempt)

    def commit(self, messages) -> None:
        files, root = _files(self.uri)
        files.create_dir(f"{root}/pending/{self.job}", recursive=True)
        with files.open_output_stream(f"{root}/pending/{self.job}/attempts.txt") as out:
            out.write("".join(m.attempt + "\n" for m in messages if m).encode())

    def abort(self, messages) -> None:
        files, root = _files(self.uri)
        folder = f"{root}/pending/{self.job}"
        if files.get_file_info(folder).type.name != "NotFound":
            files.delete_dir(folder)


class Blobs(DataSource):
    """The sink: rows (name, at, content) whose blobs follow each other in their partitions. Options: path, job, part_bytes."""

    @classmethod
    def name(cls):
        return "blobs"

    def schema(self):
        return "name string, at bigint, content binary"

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("blobs are never replaced")
        return _Writer(self.options["path"], self.options.get("job") or uuid.uuid4().hex, int(self.options.get("part_bytes", PART_BYTES)))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stage(rows: DataFrame, root: str, part_bytes: int = PART_BYTES) -> str:
    """Stage the blobs of rows (name, at, content), each blob's rows together and in order, and commit; the job's number."""
    spark, job = rows.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(Blobs)
    rows.select(F.col("name").cast("string"), F.col("at").cast("long"), F.col("content").cast("binary")).write.format("blobs").mode("append").option("job", job).option("part_bytes", part_bytes).save(qualified(spark, root))
    return job


def _move(uri: str, batches: Iterable[pa.RecordBatch], job: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    files, root = _files(uri)
    for batch in batches:
        for row in batch.to_pylist():
            sha, size = row["sha256"], row["bytes"]
            folder = f"{root}/sha256/{sha[:2]}/{sha[2:4]}"
            target, staged = f"{folder}/{sha}", f"{root}/pending/{job}/{row['staged']}"
            there, waiting = files.get_file_info([target, staged])
            if there.type == fs.FileType.NotFound or there.size != size:
                if waiting.type == fs.FileType.NotFound:
                    raise BlobMissing(f"{row['name']}: {sha}")
                files.create_dir(folder, recursive=True)
                files.move(staged, target)
            elif waiting.type != fs.FileType.NotFound:
                files.delete_file(staged)
        yield batch


def install(spark: SparkSession, root: str, job: str) -> DataFrame:
    """Move what a committed job staged to its place: name, blob_key, sha256, bytes, parts of its blobs. May be called again at any time."""
    uri = qualified(spark, root)
    done, pending = f"{uri}/manifests/{job}", f"{uri}/pending/{job}"
    if not _exists(spark, f"{done}/_SUCCESS"):
        if not _exists(spark, f"{pending}/attempts.txt"):
            raise BlobMissing(f"job {job} isn't committed")
        counted = spark.read.text(f"{pending}/attempts.txt").select(F.col("value").alias("attempt"))
        staged = spark.read.schema(_SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.parquet").parquet(pending).join(counted, "attempt", "left_semi").select(*_MANIFEST.names)
        tasks = max(spark.sparkContext.defaultParallelism, staged.count() // INSTALL_BLOBS + 1)
        # equal blobs meet in one task, one after the other; a blob held many times is moved once and costs a look a copy then
        moved = staged.repartition(tasks, "sha256").mapInArrow(lambda batches: _move(uri, batches, job), staged.schema)
        moved.select("name", blob_key(F.col("sha256")).alias("blob_key"), "sha256", "bytes", "parts").write.mode("overwrite").parquet(done)
        path = spark._jvm.org.apache.hadoop.fs.Path(pending)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return spark.read.parquet(done)


def put(rows: DataFrame, root: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Store rows (name, content), a blob each, where they are: no shuffle of contents. The manifest."""
    return install(rows.sparkSession, root, stage(rows.select("name", F.lit(0).alias("at"), "content"), root, part_bytes))


def put_slices(rows: DataFrame, root: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Store blobs that come in slices (name, at, content), in any order. The manifest.

    The slices of a blob meet in one task that streams them; a gap or an overlap fails the job.
    """
    placed = rows.repartition("name").sortWithinPartitions("name", "at")
    return install(rows.sparkSession, root, stage(placed, root, part_bytes))


def _audited(uri: str, batches: Iterable[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    files, root = _files(uri)
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            path, state, bad = f"{root}/{row['blob_key']}", "verified", None
            info = files.get_file_info(path)
            if info.type == fs.FileType.NotFound:
                state = "missing"
            elif info.size != row["bytes"]:
                state = "size_mismatch"
            else:
                hashes = _Hashes(part)
                with files.open_input_stream(path) as source:
                    while data := source.read(CHUNK):
                        hashes.add(data)
                sha, _, parts = hashes.done()
                if sha != row["sha256"]:
                    state = "digest_mismatch"
                bad = next((k for k, (a, b) in enumerate(zip(parts, row["parts"], strict=False), 1) if a != b), None)
                if bad and state == "verified":
                    state = "part_mismatch"
            out.append({"blob_key": row["blob_key"], "state": state, "bad_part": bad})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("blob_key", pa.string()), ("state", pa.string()), ("bad_part", pa.int32())]))


def audit(manifest: DataFrame, root: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Each blob of a manifest hashed anew: blob_key, state (verified, missing, size_mismatch, digest_mismatch, part_mismatch), bad_part (the first, from 1)."""
    spark = manifest.sparkSession
    uri = qualified(spark, root)
    blobs = manifest.groupBy("blob_key").agg(*[F.first(c).alias(c) for c in ("sha256", "bytes", "parts")])
    total = blobs.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, total // AUDIT_BYTES + 1)  # rows are small, the files behind them aren't
    return blobs.repartition(tasks, "blob_key").mapInArrow(lambda batches: _audited(uri, batches, part_bytes), "blob_key string, state string, bad_part int")


def _slices(uri: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files, root = _files(uri)
    schema = pa.schema([("name", pa.string()), ("at", pa.int64()), ("content", pa.binary())])
    for batch in batches:
        for row in batch.to_pylist():
            at = 0
            with files.open_input_stream(f"{root}/{row['blob_key']}") as source:
                for number, part in enumerate(row["parts"], 1):
                    data = source.read(part["bytes"])
                    if hashlib.sha256(data).hexdigest() != part["sha256"]:
                        raise ValueError(f"{row['name']}: part {number} isn't what was stored")
                    yield pa.RecordBatch.from_arrays([pa.array([row["name"]]), pa.array([at], pa.int64()), pa.array([data], pa.binary())], schema=schema)
                    at += len(data)


def contents(manifest: DataFrame, root: str) -> DataFrame:
    """The blobs of a manifest in slices (name, at, content), a part each. A part is hashed before it is handed on; one that differs fails the job."""
    uri = qualified(manifest.sparkSession, root)
    return manifest.select("name", "blob_key", "parts").mapInArrow(lambda batches: _slices(uri, batches), "name string, at bigint, content binary")
