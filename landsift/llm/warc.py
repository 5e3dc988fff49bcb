"""WARC: a deterministic sharded writer, and a reader.

Records are dealt to shards by ranges of page_id (about the same number of pages a shard, by a histogram of the ids, which may be
sparse) and sorted by it in each shard, so the same pages give the same archives on any cluster. How many pages a shard has and where
files roll follows from the pages' bytes alone: shards of a 256th of them, from 16 MB to 4 GB, files of a sixteenth of a shard, and
as many tasks as there are shards. A shard is written as files of
gzip members, one a record; a file is closed when its compressed size reaches ``roll``. Headers are
made anew: lengths, ids that follow from the payload's digest and page_id, sha1 digests of block and
payload. A task writes under a temporary name of its own attempt; its manifest rows (file, size,
records, sha256) are stored first, and a second job renames the files that the manifest names, so a
lost or repeated task leaves no half archive. Reading checks every record's digest.

Of records with equal payloads of at least ``least`` bytes the one with the largest page_id is the
response; the others are revisit records that name it. Equality is that of SHA-1 and length.

Folders are named as Hadoop resolves them and opened by pyarrow, so they must be in a file system that both know.

Rows: an empty table gives archives of no record; a payload of any length is one record, which a task holds whole. A null html is an empty payload, a null url an empty target. Rows with a null page_id are
responses, in shards of their own (named none-) to which a hash of the payload deals them; negative ids have shards like others (named m). Repeated rows of one page_id and payload: the one
that is kept as response is the first in the shard, the others revisit it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import math
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landsift.llm.common import fresh_dir, parts_for, stored, text_size

DATE = "2024-01-01T00:00:00Z"
#: Shards of rows without an id have numbers from here on, below those of all ids.
NO_ID_SHARDS = -(1 << 62)
MANIFEST = "shard bigint, seq int, temporary string, name string, records bigint, bytes bigint, sha256 string"


def _file_system(uri: str):
    """The file system of a folder that driver and executors share, and the folder's path in it."""
    from pyarrow import fs

    if re.match(r"[a-z][a-z0-9+.-]*:", uri):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return fs.LocalFileSystem(), uri


def qualified(spark, folder: str) -> str:
    """The folder with the scheme that Spark itself would read it by."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes of each page."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    return rows.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))


def revisits(rows: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, payload_digest, refers_to of the records that revisit another one; only digests are shuffled, no payload."""
    keys = rows.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", "payload_digest", "payload_bytes")
    groups = keys.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups.where("n > 1").drop("n"), "warc-groups")  # the join deals both sides anew, so that Spark can split a hot digest
    found = keys.join(groups, ["payload_digest", "payload_bytes"]).where("page_id <> refers_to")
    return stored(found.select("page_id", "payload_digest", "refers_to").distinct(), "warc-revisits")


def _sha1_32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record of a page; a revisit has only the HTTP header."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}:{digest}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{name}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url)),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Block-Digest", _sha1_32(block)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if kind == "revisit":
        head += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}:{digest}')}>"),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


class _Roller:
    """Writes the members of a shard, in files of about ``roll`` bytes, under temporary names."""

    def __init__(self, folder: str, roll: int):
        self.files, self.folder = _file_system(folder)
        self.roll, self.out, self.rows, self.key = roll, None, [], None

    def add(self, shard: int, data: bytes):
        if self.out is not None and (self.key[0] != shard or self.size >= self.roll):
            self.close()
        if self.out is None:
            seq = self.key[1] + 1 if self.key and self.key[0] == shard else 0
            self.key, self.size, self.records, self.sha = (shard, seq), 0, 0, hashlib.sha256()
            self.temporary = f"_temporary/{shard}-{seq}-{uuid.uuid4().hex}"
            self.out = self.files.open_output_stream(f"{self.folder}/{self.temporary}", compression=None)
        member = gzip.compress(data, 6, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1

    def close(self):
        if self.out is not None:
            self.out.close()
            shard, seq = self.key
            own = f"none-{shard - NO_ID_SHARDS:05d}" if shard < NO_ID_SHARDS // 2 else f"{'m' if shard < 0 else ''}{abs(shard):010d}"
            name = f"{own}-{seq:05d}.warc.gz"
            self.rows.append((shard, seq, self.temporary, name, self.records, self.size, self.sha.hexdigest()))
            self.out = None


def _writer(folder: str, roll: int, least: int):
    def run(batches):
        held = _Roller(folder, roll)
        held.files.create_dir(f"{held.folder}/_temporary", recursive=True)
        known, refers = None, None  # the record that was seen or decided on last, and what another such record refers to
        for batch in batches:
            for row in batch.to_pylist():
                key = row["page_id"], row["payload_digest"]
                if row["payload"] is None:  # a decision; it stands before its records
                    known, refers = key, row["refers_to"]
                    continue
                if key != known:
                    known, refers = key, None
                kind = "response" if refers is None else "revisit"
                held.add(row["shard"], record(row["page_id"], row["url"], row["payload"], row["payload_digest"], kind, refers))
                if refers is None and row["page_id"] is not None and row["payload_bytes"] >= least:
                    refers = row["page_id"]  # a repeated row of the response revisits it
        held.close()
        if held.rows:
            names = [x.split()[0] for x in MANIFEST.split(", ")]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held.rows], pa.schema([("shard", pa.int64()), ("seq", pa.int32()), ("temporary", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    return run


def _commit(folder: str):
    def run(batches):
        files, root = _file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                to = f"{root}/{row['name']}"
                if files.get_file_info(f"{root}/{row['temporary']}").is_file:  # not there: a repeated task has moved it
                    files.move(f"{root}/{row['temporary']}", to)
                if files.get_file_info(to).size != row["bytes"]:
                    raise OSError(f"{to} isn't the file that the manifest names")
            yield batch

    return run


def sizes(pages: DataFrame) -> tuple[int, int, int, int]:
    """(pages a shard, where files roll, tasks, shards of rows without an id) for these pages."""
    rows, total = text_size(pages, "html")
    shard_bytes = min(max(total // 256, 16 << 20), 4 << 30)
    ids = 1 << max(round(math.log2(max(shard_bytes * max(rows, 1) / max(total, 1), 1))), 0)
    shards = -(-total // shard_bytes) or 1
    return min(ids, 1 << 40), min(max(shard_bytes // 16, 1 << 20), 1 << 30), max(shards, 8), shards


def _prefix(shift: int) -> Column:
    """The leading bits of an id, in the order of ids, negative ones first."""
    return F.shiftrightunsigned(F.col("page_id").bitwiseXOR(F.lit(-(1 << 63))), shift)


def id_shards(ids: DataFrame, each: int) -> dict[int, list[tuple[int, int]]]:
    """Shards of about ``each`` of the ids (page_id): for each number of bits left out, the leading bits and their shard.

    A histogram by leading bits is refined where more than ``each`` ids share them; shards are runs of its cells. The driver
    holds a few thousand cells, and at most 256 more a shard and round.
    """
    low, high = ids.agg(F.min("page_id"), F.max("page_id")).first()
    if low is None:
        return {}
    shift = max(((low + (1 << 63)) ^ (high + (1 << 63))).bit_length() - 12, 0)
    cells, rows = [], ids
    while True:
        found = rows.groupBy(_prefix(shift).alias("prefix")).count().collect()
        heavy = [r.prefix for r in found if r["count"] > each and shift]
        cells += [((r.prefix % (1 << 64)) << shift, shift, r.prefix, r["count"]) for r in found if not (r["count"] > each and shift)]
        if not heavy:
            break
        crowded = ids.sparkSession.createDataFrame([(h,) for h in heavy], "prefix bigint")
        rows = rows.join(F.broadcast(crowded), _prefix(shift) == F.col("prefix"), "left_semi")
        shift = max(shift - 8, 0)
    out: dict[int, list[tuple[int, int]]] = {}
    shard = held = 0
    for _, bits, prefix, n in sorted(cells):
        if held and held + n > each:
            shard, held = shard + 1, 0
        held += n
        out.setdefault(bits, []).append((prefix, shard))
    return out


def _with_shard(rows: DataFrame, shards: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """``rows`` with the shard of their page_id: a broadcast join for each length of leading bits, mostly one."""
    found = []
    for bits, pairs in shards.items():
        table = rows.sparkSession.createDataFrame(pairs, f"prefix_{bits} bigint, shard_{bits} bigint")
        rows = rows.join(F.broadcast(table), _prefix(bits) == F.col(f"prefix_{bits}"), "left_outer").drop(f"prefix_{bits}")
        found.append(f"shard_{bits}")
    return rows.withColumn("shard", F.coalesce(*found, F.lit(0).cast("long"))).drop(*found)


def write(pages: DataFrame, folder: str, ids_a_shard: int | None = None, roll: int | None = None, least: int = 1000) -> DataFrame:
    """Write the archives of ``pages`` into ``folder``; the manifest, a row a file. ``ids_a_shard`` deals by numbers of ids instead of pages."""
    folder = qualified(pages.sparkSession, folder)
    pages_a_shard, own_roll, count, empty_shards = sizes(pages)
    roll = roll or own_roll
    rows = payloads(pages)
    # a decision travels as a row without payload that sorts before its records; the payloads are shuffled once
    none = F.lit(None)
    decided = revisits(rows, least).select("page_id", none.cast("string").alias("url"), none.cast("binary").alias("payload"), "payload_digest", none.cast("long").alias("payload_bytes"), "refers_to")
    rows = rows.withColumn("refers_to", none.cast("long")).unionByName(decided)
    if ids_a_shard:
        rows = rows.withColumn("shard", F.floor(F.col("page_id") / F.lit(ids_a_shard)).cast("long") if ids_a_shard > 1 else F.col("page_id"))
    else:
        rows = _with_shard(rows, id_shards(pages.select(F.col("page_id").cast("long").alias("page_id")).where("page_id IS NOT NULL"), pages_a_shard))
    none_shard = F.lit(NO_ID_SHARDS) + F.pmod(F.crc32(F.col("payload_digest").cast("binary")), F.lit(empty_shards))
    rows = rows.withColumn("shard", F.when(F.col("page_id").isNull(), none_shard).otherwise(F.col("shard")))
    dealt = rows.repartitionByRange(count, "shard").sortWithinPartitions("shard", "page_id", "payload_digest", F.col("payload").isNotNull(), "url")
    manifest = stored(dealt.mapInArrow(_writer(folder, roll, least), MANIFEST), "warc-manifest")
    done = stored(manifest.repartition(count).mapInArrow(_commit(folder), MANIFEST), "warc-committed")
    done.write.mode("overwrite").json(f"{folder}/manifest.json")
    return done


def parse(data: io.BufferedIOBase):
    """(header, block) of each record in a stream of gzip members, one record in memory at a time."""
    unzip, held, rest = zlib.decompressobj(31), [], b""
    while True:
        chunk = rest or data.read(1 << 20)
        rest = b""
        if not chunk:
            break
        held.append(unzip.decompress(chunk))
        if unzip.eof:
            rest, raw = unzip.unused_data, b"".join(held)
            unzip, held = zlib.decompressobj(31), []
            head, _, block = raw.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
            yield fields, block[: int(fields["Content-Length"])]
    if any(held):
        raise ValueError("an archive that ends within a record")


RECORDS = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _reader(folder: str):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        files, root = _file_system(folder)
        held, size = [], 0
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for head, block in parse(stream):
                        if _sha1_32(block) != head["WARC-Block-Digest"]:
                            raise ValueError(f"a record of {name} doesn't have its digest")
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        kind = head["WARC-Type"]
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"a payload of {name} doesn't have its digest")
                        page, refers = head["X-Page-ID"], head.get("X-Refers-To-Page-ID")
                        held.append((int(page) if page else None, head["WARC-Target-URI"], payload, int(head["X-Payload-Length"]), digest, kind, int(refers) if refers else None))
                        size += len(payload)
                        if size > 8 << 20 or len(held) > 5000:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)

    return run


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the archives that ``manifest`` names; a revisit has an empty payload."""
    folder = qualified(manifest.sparkSession, folder)
    total = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    count = parts_for(total, 4 << 20, 8)
    return manifest.select("name").repartition(count).mapInArrow(_reader(folder), RECORDS)


def archived(pages: DataFrame) -> DataFrame:
    """Write all of ``pages``, read the archives back, and say what each page became."""
    folder = fresh_dir(pages.sparkSession, "warc")
    manifest = write(pages, folder)
    return read(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

