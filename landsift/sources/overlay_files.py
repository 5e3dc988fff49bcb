"""Overlay files read in splits: JSON arrays of layers, each with a collection of features, of any size and on any line structure.

Spark reads a file by byte ranges, as text that ends at closing braces. A range doesn't know whether it starts in a string, or how deep.
The first pass scans each range for both cases and tells what it does to the open objects: how many it closes, which it
opens, under which keys. These steps, a row a range, are put in order on the driver, which plans the ranges anyway, and give each range
its start. The second pass then cuts out the features; one that lies across a border comes in pieces, which are put
together by the range it starts in. Both passes digest what they read, and a range that reads otherwise the second time fails the job.

Features over MOST_BYTES, and elements that are no objects, are rows with an error instead of a text. A file that
is no such array, is cut off, or lacks a layer's metadata is refused when it is inspected.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

#: What a layer must say of itself; fixed values, as are the limits.
METADATA = ("id", "name", "category", "source_url", "attribution", "caveat", "geom_type")
GEOMETRIES = ("polygon", "line", "point")
MOST_LAYERS, MOST_BYTES = 100, 16 << 20
_BUFFER = 1 << 20
_TOKEN = re.compile(r'"((?:[^"\\]|\\.)*+)(?:(")(\s*:)?|\Z)|[{}]', re.S)
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*+("?)', re.S)
_COLON = re.compile(r"\s*:")
PARTLY = "\0"  # a key that lies across a border; it is none of those looked for
_ELEMENT = re.compile(r'"(?:[^"\\]|\\.)*+"|[^\s,\[\]"]+')
FEATURES = ("features", "features")


class InputChanged(ValueError):
    """A file didn't read the same twice."""


@dataclass
class Step:
    """What a range does to the open objects, which are named by the keys they stand under."""

    closed: int = 0
    key: str | None = None  # the last key at the lowest level that was reached
    opened: list[list[str | None]] = field(default_factory=list)  # [key it stands under, last key in it]
    roots: dict[int, int] = field(default_factory=dict)  # objects opened, by the level below the start at which they were
    in_string: str = ""  # "value" or "key", or "some" while it is the one in which the range starts

    def read(self, text: str) -> None:
        at = 0
        if self.in_string:
            m = _STRING_END.match(text)
            at, self.in_string = m.end(), "" if m[1] else self.in_string
            if m[1] and _COLON.match(text, at):
                self.named(PARTLY)
        for m in _TOKEN.finditer(text, at):
            found = m[0]
            if found == "{":
                level = len(self.opened) - self.closed
                self.roots[level] = self.roots.get(level, 0) + 1
                self.opened.append([self.opened[-1][1] if self.opened else self.key, None])
            elif found == "}":
                if self.opened:
                    self.opened.pop()
                else:
                    self.closed, self.key = self.closed + 1, None
            elif m[3]:
                self.named(m[1])
            elif not m[2]:
                self.in_string = _role(text, m.start())

    def named(self, key: str) -> None:
        if self.opened:
            self.opened[-1][1] = key
        else:
            self.key = key


def _role(text: str, at: int) -> str:
    """Whether the string that opens at ``at`` is a value or a key (or an element, which doesn't matter)."""
    while at and text[at - 1].isspace():
        at -= 1
    return "value" if at and text[at - 1] == ":" else "key"


def _applied(stack: list[list[str | None]], step: Step) -> list[list[str | None]]:
    if step.closed > len(stack) - 1:
        raise ValueError("invalid_overlay_json")
    stack = [list(f) for f in stack[: len(stack) - step.closed]]
    if step.key is not None:
        stack[-1][1] = step.key
    for name, last in step.opened:
        stack.append([stack[-1][1] if name is None else name, last])
    return stack


@dataclass
class Start:
    """Where a range starts: the open objects, whether in a string, layers before it, and the range in which the open feature starts."""

    stack: list[list[str | None]]
    in_string: str
    layers: int
    owner: int
    digest: str


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """(path, start, texts) of each range of a task, in order; its texts must be read before the next."""
    held: list = []

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("path", "start", "value")), strict=True)

    source = rows()
    row = next(source, None)

    def texts(path, start):
        nonlocal row
        parts, size = [], 0
        while row is not None and row[:2] == (path, start):
            parts.append(row[2])
            size += len(row[2]) + 1
            row = next(source, None)
            if size >= _BUFFER:
                yield "}".join(parts) + "}"
                parts, size = [], 0
        if parts:
            yield "}".join(parts) + "}"

    while row is not None:
        held = [row[0], row[1]]
        yield held[0], held[1], texts(*held)


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for path, start, texts in _ranges(batches):
        steps, digest, size = [Step(), Step(in_string="some")], hashlib.sha256(), 0
        for text in texts:
            raw = text.encode()
            digest.update(raw)
            size += len(raw)
            for step in steps if start else steps[:1]:
                step.read(text)
        said = json.dumps([[s.closed, s.key, s.opened, sorted(s.roots.items()), s.in_string] for s in steps])
        out.append((path, start, said, digest.hexdigest(), size))
    yield pa.RecordBatch.from_pylist([dict(zip(("path", "start", "steps", "digest", "size"), r, strict=True)) for r in out], pa.schema([("path", pa.string()), ("start", pa.int64()), ("steps", pa.string()), ("digest", pa.string()), ("size", pa.int64())]))


def _is_feature(stack: list[list[str | None]]) -> bool:
    """Whether an object that is about to open stands among a layer's features."""
    return len(stack) == 3 and (stack[2][0], stack[2][1]) == FEATURES


def _starts(rows: list) -> dict[tuple[str, int], Start]:
    """The start of each range, by path and place; ``rows`` has their summaries, in order."""
    found: dict[tuple[str, int], Start] = {}
    state: dict[str, tuple] = {}
    for path, start, said, digest, size, file_size in rows:
        stack, in_string, layers, owner, read = state.get(path, ([[None, None]], "", 0, -1, 0))
        found[path, start] = Start(stack, in_string, layers, owner, digest)
        closed, key, opened, roots, ends_in_string = json.loads(said)[1 if in_string else 0]
        ends_in_string = in_string if ends_in_string == "some" else ends_in_string
        step = Step(closed, key, opened, dict(roots), ends_in_string)
        read += size
        if file_size is not None and read == file_size + 1:  # the file's last text ended without a brace
            step = Step(closed - 1, key, opened, dict(roots), ends_in_string) if closed else step
        after = _applied(stack, step)
        inside = len(after) > 3 and (after[2][0], after[3][0]) == FEATURES
        carried = inside and len(stack) > 3 and (stack[2][0], stack[3][0]) == FEATURES and closed <= len(stack) - 4
        state[path] = (after, ends_in_string, layers + step.roots.get(1 - len(stack), 0), owner if carried else start if inside else -1, read)
    for after, in_string, *_ in state.values():
        if in_string or len(after) != 1:
            raise ValueError("invalid_overlay_json")
    return found


class _Cutter:
    """Cuts the features and the metadata out of a range whose start is known."""

    def __init__(self, start: Start):
        self.stack, self.in_string = [list(f) for f in start.stack], start.in_string
        self.layer, self.rows, self.pos = start.layers - 1, [], 0
        self.open = len(self.stack) > 3 and (self.stack[2][0], self.stack[3][0]) == FEATURES
        self.pieces, self.size, self.begun = [], 0, False

    def add(self, kind: str, text: str | None, error: str | None = None, key: str | None = None) -> None:
        self.rows.append((self.layer, self.pos, kind, key, text, error))
        self.pos += 1

    def say(self, kind: str, text: str) -> None:
        """A value, or a part of one that lies across a border, as it is written."""
        if len(self.stack) == 2 and self.stack[1][1] in METADATA:
            self.add(kind, text, key=self.stack[1][1])

    def keep(self, text: str) -> None:
        self.size += len(text.encode())
        if self.size <= MOST_BYTES:
            self.pieces.append(text)

    def piece(self, kind: str) -> None:
        large = self.size > MOST_BYTES
        self.add(kind, None if large else "".join(self.pieces), "feature_too_large" if large else None)
        self.pieces, self.size = [], 0

    def read(self, text: str) -> None:
        at, since = 0, 0  # ``since``: from where the open feature, or what stands between features, isn't yet kept
        if self.in_string:
            m = _STRING_END.match(text)
            at = m.end()
            if self.in_string == "value":
                self.say("more", m[0][: len(m[0]) - len(m[1])])
            if m[1] and _COLON.match(text, at):
                self.stack[-1][1] = PARTLY
            self.in_string = "" if m[1] else self.in_string
        for m in _TOKEN.finditer(text, at):
            found = m[0]
            if found == "{":
                if _is_feature(self.stack) and not self.open:
                    self.between(text[since : m.start()])
                    self.open, self.begun, since = True, True, m.start()
                elif len(self.stack) == 1:
                    self.layer += 1
                    self.add("layer", None)
                self.stack.append([self.stack[-1][1], None])
            elif found == "}":
                self.stack.pop()
                if self.open and len(self.stack) == 3:
                    self.keep(text[since : m.end()])
                    self.piece("whole" if self.begun else "tail")
                    self.open, since = False, m.end()
                elif _is_feature(self.stack):
                    since = m.end()
                if not self.stack:
                    self.stack = [[None, None]]
            elif m[3]:
                self.stack[-1][1] = m[1]
                if _is_feature(self.stack) and not self.open:
                    self.add("array", None)
                    since = m.end()
            else:
                if not m[2]:
                    self.in_string = _role(text, m.start())
                if self.in_string != "key":
                    self.say("said", m[1])
        if self.open:
            self.keep(text[since:])
        elif _is_feature(self.stack):
            self.between(text[since:])

    def between(self, text: str) -> None:
        """What stands between features must be nothing."""
        for _ in _ELEMENT.finditer(text.split("]")[0]):
            self.add("whole", None, "feature_not_object")

    def end(self) -> None:
        if self.open:
            self.piece("head" if self.begun else "middle")


CUT = "path string, start bigint, owner bigint, layer int, pos bigint, kind string, key string, text string, error string"


def _cut(starts: dict[tuple[str, int], Start]) -> Callable:
    names = [c.split()[0] for c in CUT.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.string()] * 4]

    def run(batches):
        for path, start, texts in _ranges(batches):
            begin = starts.get((path, start))
            if begin is None:
                raise InputChanged(f"{path} has other ranges than before")
            cutter, digest = _Cutter(begin), hashlib.sha256()
            for text in texts:
                digest.update(text.encode())
                cutter.read(text)
                if len(cutter.rows) > 2000:
                    yield table(path, start, begin, cutter)
            cutter.end()
            if digest.hexdigest() != begin.digest:
                raise InputChanged(f"{path} changed between two passes")
            yield table(path, start, begin, cutter)

    def table(path, start, begin, cutter):
        rows, cutter.rows = cutter.rows, []
        owned = [begin.owner if r[2] in ("tail", "middle") else start for r in rows]
        columns = [[path] * len(rows), [start] * len(rows), owned, *([r[k] for r in rows] for k in range(6))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


@dataclass(frozen=True)
class Overlays:
    """Inspected files: ``parts`` are the cut features and metadata, ``checksum`` names what was read."""

    parts: DataFrame
    checksum: str

    def layers(self) -> DataFrame:
        """path, layer, its metadata, and features: how many elements its collection has."""
        parts = F.array_sort(F.collect_list(F.when(F.col("kind").isin("said", "more"), F.struct("key", "start", "pos", "kind", "text"))))
        written = lambda m: F.aggregate(F.filter("said", lambda p: p["key"] == m), F.lit(None).cast("string"), lambda t, p: F.when(p["kind"] == "said", p["text"]).otherwise(F.concat(t, p["text"])))
        read = lambda m: F.from_json(F.concat(F.lit('["'), written(m), F.lit('"]')), "array<string>")[0].alias(m)
        # an element that lies across ranges has one tail
        found = self.parts.groupBy("path", "layer").agg(parts.alias("said"), F.count_if(F.col("kind").isin("whole", "tail")).alias("features"), F.count_if(F.col("kind") == "array").alias("arrays"))
        return found.select("path", "layer", *[read(m) for m in METADATA], "features", "arrays")

    def features(self) -> DataFrame:
        """path, layer, start and pos (their order is that of the file), feature and error of each element."""
        whole = self.parts.where("kind = 'whole'").select("path", "layer", "start", "pos", F.col("text").alias("feature"), "error")
        pieces = self.parts.where("kind IN ('head', 'middle', 'tail')").groupBy("path", "owner").agg(
            F.max_by("layer", "start").alias("layer"),
            F.max(F.when(F.col("kind") == "head", F.col("pos"))).alias("pos"),
            F.sum(F.octet_length("text")).alias("size"),
            F.max("error").alias("error"),
            F.array_sort(F.collect_list(F.struct("start", "text"))).alias("pieces"),
        )
        large = F.col("error").isNotNull() | (F.col("size") > MOST_BYTES)
        text = F.when(~large, F.concat_ws("", F.transform("pieces", lambda p: p["text"])))
        return whole.unionByName(pieces.select("path", "layer", F.col("owner").alias("start"), "pos", text.alias("feature"), F.when(large, "feature_too_large").alias("error")))


def inspect(spark: SparkSession, path: str) -> Overlays:
    """The overlays in a file or folder. Raises ValueError where one isn't what it should be."""
    source = spark.read.option("lineSep", "}").text(path)
    rows = source.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    sizes = source.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("file_size")).distinct()
    steps = rows.mapInArrow(_summaries, "path string, start bigint, steps string, digest string, size bigint")
    said = steps.join(F.broadcast(sizes), "path").orderBy("path", "start").select("path", "start", "steps", "digest", "size", "file_size").collect()
    starts = _starts([tuple(r) for r in said])
    checksum = hashlib.sha256("".join(f"{r.path.rpartition('/')[2]},{r.start},{r.digest}\n" for r in said).encode()).hexdigest()
    found = Overlays(rows.mapInArrow(_cut(starts), CUT), checksum)
    _refuse(found.layers())
    return found


def _refuse(layers: DataFrame) -> None:
    """Raises the first thing that is wrong with a layer."""
    missing = F.col("arrays") == 0
    for m in METADATA:
        missing = missing | F.col(m).isNull()
    wrong = (F.length("id") == 0) | (F.length("id") > 100) | (F.length("name") > 255) | (F.length("category") > 100) | ~F.col("geom_type").isin(*GEOMETRIES)
    problem = F.when(missing, "Overlay metadata or feature array is missing").when(wrong, "invalid_overlay_metadata").when(F.col("layer") >= MOST_LAYERS, "Too many layers in the input")
    first = layers.select(problem.alias("problem")).where("problem IS NOT NULL").agg(F.min("problem")).first()[0]
    if first is None and not layers.groupBy("path", "id").count().where("count > 1").isEmpty():
        first = "Ambiguous duplicate overlay ID"
    if first:
        raise ValueError(first)


def _lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of one file: an array of layers, each opened by its metadata and closed behind its last feature."""
    current = None
    for batch in batches:
        out = []
        for head, feature in zip(batch.column("head").to_pylist(), batch.column("feature").to_pylist(), strict=True):
            if head != current:
                out.append(("[" if current is None else "]}},") + head[:-1] + ',"features":{"type":"FeatureCollection","features":[')
                first, current = True, head
            if feature is not None:
                out.append(feature if first else "," + feature)
                first = False
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array(["]}}]"], pa.string())], ["value"])


def write(features: DataFrame, path: str, order: str) -> None:
    """Writes overlay files from rows of a layer's metadata (the columns METADATA) and ``feature``, the JSON of one of its features or null.

    Rows are dealt by ranges of layer and ``order``, so a large layer is dealt to several files, each with that part of it.
    """
    head = F.to_json(F.struct(*METADATA))
    rows = features.select("id", order, head.alias("head"), "feature").repartitionByRange("id", order).sortWithinPartitions("id", order)
    rows.select("head", "feature").mapInArrow(_lines, "value string").write.text(path)
