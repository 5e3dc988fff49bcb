"""Digest trees over ordered rows, what a checkpoint says of them, and the canonical text of a frame in blocks.

A tree tells which range of rows differs by comparing nodes, a 256th of the rows, instead of building all rows again.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

from landsift.operators.tables import ranged
from landsift.scratch import stored
from landsift.sources import blobs

FAN = 256


class BudgetExceeded(ValueError):
    """The canonical text would have more bytes than are allowed."""


def _lines_digest(lines: Column) -> Column:
    return F.sha2(F.array_join(lines, "\n"), 256)


def ordered_digest(*order: str, digest: str = "digest") -> Column:
    """sha256 over lines "order:digest" in their order, as an aggregate. For groups of a bounded size."""
    line = lambda s: F.concat_ws(":", *[s[c].cast("string") for c in order], s[digest])
    return _lines_digest(F.transform(F.sort_array(F.collect_list(F.struct(*order, digest))), line))


def parts_digest(parts: Column) -> Column:
    """What ``ordered_digest`` gives for parts numbered from 1, of an array of their digests as bytes."""
    return _lines_digest(F.transform(parts, lambda p, k: F.concat_ws(":", (k + 1).cast("string"), F.lower(F.hex(p)))))


def digest_tree(leaves: DataFrame, keys: list[str], fan: int = FAN) -> DataFrame:
    """keys, level, position, rows, digest: nodes over leaves (keys, position, digest), ``fan`` positions a node at level 1, and so on to one node.

    Positions are whole numbers from 0, not null, that don't move when other rows come or go (ids, not ranks): a lost row changes the
    nodes above it alone. A node gathers ``fan`` digests; rows that share a position are all in it. All keys have as many levels.
    Empty leaves give no node. A null digest counts as an empty text.
    """
    top = leaves.agg(F.max("position").alias("top")).first()["top"]
    node = F.expr(f"position div {fan}").alias("position")
    gather = [F.sum("rows").alias("rows"), ordered_digest("position").alias("digest")]
    first = leaves.select(*keys, F.col("position").cast("long").alias("position"), F.lit(1).cast("long").alias("rows"), F.coalesce("digest", F.lit("")).alias("digest"))
    nodes = stored(first.groupBy(*keys, node).agg(*gather), "digest-tree")
    out, level, reach = nodes.withColumn("level", F.lit(1)), 1, fan
    while top is not None and reach <= top:
        level, reach = level + 1, reach * fan
        nodes = nodes.groupBy(*keys, node).agg(*gather)  # a 256th of the level below
        out = out.unionByName(nodes.withColumn("level", F.lit(level)))
    return out.select(*keys, "level", "position", "rows", "digest")


def roots(tree: DataFrame, keys: list[str]) -> DataFrame:
    """The top node of each key: keys, digest."""
    return tree.groupBy(*keys).agg(F.max_by("digest", "level").alias("digest"))


def differing_ranges(then: DataFrame, now: DataFrame, keys: list[str], fan: int = FAN) -> DataFrame:
    """keys, first, last, problem (lost, added or changed) of the lowest ranges of positions in which two trees differ."""
    side = lambda tree, name: tree.where("level = 1").select(*keys, "position", F.struct("rows", "digest").alias(name))
    both = side(then, "then_").join(side(now, "now_"), [*keys, "position"], "full_outer").where(~F.col("then_").eqNullSafe(F.col("now_")))
    before, after = (F.coalesce(F.col(f"{c}.rows"), F.lit(0)) for c in ("then_", "now_"))
    problem = F.when(after < before, "lost").when(after > before, "added").otherwise("changed")
    return both.select(*keys, (F.col("position") * fan).alias("first"), (F.col("position") * fan + fan - 1).alias("last"), problem.alias("problem"))


def results_tree(results: DataFrame, fan: int = FAN) -> DataFrame:
    """The digest tree of each band's results."""
    return digest_tree(results.select("band", "position", F.col("output_sha256").alias("digest")), ["band"], fan)


def checkpoints(results: DataFrame, fan: int = FAN, tree: DataFrame | None = None) -> DataFrame:
    """What a build notes of its results (band, position, part_count, collapsed, error_code, output_sha256) when it stops or ends.

    ``tree``: the results' tree, where it is built already.
    """
    tree = results_tree(results, fan) if tree is None else tree
    noted = results.groupBy("band").agg(
        F.count(F.lit(1)).alias("processed_count"), F.max("position").cast("long").alias("checkpoint_position"), F.sum(F.col("part_count").cast("long")).alias("part_count"),
        F.count_if("collapsed").alias("collapsed_count"), F.count_if(F.col("error_code").isNotNull()).alias("invalid_count"),
    )
    return noted.join(roots(tree, ["band"]), "band")


#: What may differ, and the code that tells it; the first that differs is told.
CODES = (
    ("processed_count", "checkpoint_result_count_mismatch"),
    ("checkpoint_position", "checkpoint_feature_id_mismatch"),
    ("digest", "checkpoint_checksum_mismatch"),
    ("part_count", "checkpoint_part_count_mismatch"),
    ("collapsed_count", "checkpoint_collapse_count_mismatch"),
    ("invalid_count", "checkpoint_failure_count_mismatch"),
)


def part_problems(results: DataFrame, parts: DataFrame) -> DataFrame:
    """band, position, problem of the features whose parts (band, position, part_number from 1, geometry_sha256) aren't those of their result: orphan_parts, parts_missing, part_changed."""
    at = ["band", "position"]
    rows = parts.select(*at, F.struct("part_number", F.concat_ws(":", F.col("part_number").cast("string"), "geometry_sha256").alias("line")).alias("part_"))
    made = rows.groupBy(*at).agg(F.sort_array(F.collect_list("part_")).alias("parts_"))
    numbers = F.array_compact("parts_.part_number")  # counted here: a distinct count beside the list would send or sort all parts once more
    made = made.select(*at, F.size("parts_").alias("n_"), F.array_max(numbers).alias("top_"), F.size(F.array_distinct(numbers)).alias("distinct_"), _lines_digest(F.col("parts_.line")).alias("digest_"))
    both = results.select(*at, "part_count", "output_sha256", F.lit(True).alias("there_")).join(made, at, "full_outer")
    n = F.coalesce("n_", F.lit(0))
    whole = (n == F.col("part_count")) & ((n == 0) | ((F.col("distinct_") == n) & (F.col("top_") == n)))
    problem = F.when(F.col("there_").isNull(), "orphan_parts").when(~F.coalesce(whole, F.lit(False)), "parts_missing").when((n > 0) & ~F.col("digest_").eqNullSafe(F.col("output_sha256")), "part_changed")
    return both.select(*at, problem.alias("problem")).where("problem is not null")


def checkpoint_problems(results: DataFrame, parts: DataFrame, noted: DataFrame, fan: int = FAN, tree: DataFrame | None = None) -> DataFrame:
    """band, code, bad_features of each band: null where the stored results and parts are what the checkpoint noted.

    A band with results and no checkpoint is checkpoint_missing; one whose parts alone differ is checkpoint_parts_mismatch.
    ``tree``: the results' tree, where it is built already.
    """
    now = checkpoints(results, fan, tree)
    then = noted.select("band", F.struct(*[c for c, _ in CODES]).alias("then_"))
    both = then.join(now.select("band", F.struct(*[c for c, _ in CODES]).alias("now_")), "band", "full_outer")
    bad = part_problems(results, parts).groupBy("band").agg(F.count(F.lit(1)).alias("bad_"))
    code = F.when(F.col("then_").isNull(), "checkpoint_missing").when(F.col("now_").isNull(), F.when(F.col("then_.processed_count") > 0, CODES[0][1]))
    for column, name in CODES:
        code = code.when(~F.col(f"then_.{column}").eqNullSafe(F.col(f"now_.{column}")), name)
    code = code.when(F.col("bad_").isNotNull(), "checkpoint_parts_mismatch")
    return both.join(bad, "band", "left").select("band", code.alias("code"), F.coalesce("bad_", F.lit(0)).alias("bad_features"))


def resume_positions(then: DataFrame, now: DataFrame, noted: DataFrame, fan: int = FAN) -> DataFrame:
    """band, resume_at: from where a build must go on, behind its checkpoint, or at the first range that isn't what was built."""
    first = differing_ranges(then, now, ["band"], fan).groupBy("band").agg(F.min("first").alias("first_"))
    behind = F.col("checkpoint_position") + 1
    return noted.join(first, "band", "left").select("band", F.least(behind, F.coalesce("first_", behind)).alias("resume_at"))


def canonical_slices(rows: DataFrame, order: list[str], line: str, size: int = blobs.PART_BYTES, most_bytes: int | None = None) -> DataFrame:
    """block, at, content: the text whose lines are ``line`` in ``order`` (ties by the line itself), each with a line feed, cut in blocks of ``size`` bytes.

    Whatever the partitioning, the blocks are those of one writer: a line's place is the sum of the lengths before it, in its stored
    range and in the ranges before, one number a range. A text of more than ``most_bytes`` is refused before any block is made.
    A null line is an empty one. No rows give no block.
    """
    text = rows.select(*[F.col(c).alias(f"o{k}_") for k, c in enumerate(order)], F.concat(F.coalesce(line, F.lit("")), F.lit("\n")).alias("line_"))
    by = [c for c in text.columns]
    placed = ranged(text, by)
    bytes_ = F.octet_length("line_").cast("long")
    sizes = stored(placed.groupBy("part_").agg(F.sum(bytes_).alias("size_")), "canonical-sizes")
    if most_bytes is not None and (sizes.agg(F.sum("size_")).first()[0] or 0) > most_bytes:
        raise BudgetExceeded(f"more than {most_bytes} bytes")
    before = sizes.select("part_", (F.sum("size_").over(W.orderBy("part_")) - F.col("size_")).alias("before_"))
    within = F.sum(bytes_).over(W.partitionBy("part_").orderBy(*by).rowsBetween(W.unboundedPreceding, 0)) - bytes_
    placed = placed.withColumn("in_", within).join(F.broadcast(before), "part_")
    placed = placed.select((F.col("before_") + F.col("in_")).alias("place_"), bytes_.alias("length_"), F.col("line_").cast("binary").alias("line_"))
    blocks = placed.withColumn("block", F.explode(F.expr(f"sequence(place_ div {size}, (place_ + length_ - 1) div {size})")))
    start = F.greatest(F.lit(0), F.col("block") * size - F.col("place_"))
    end = F.least(F.col("length_"), (F.col("block") + 1) * size - F.col("place_"))
    return blocks.select("block", (F.col("place_") + start - F.col("block") * size).alias("at"), F.substring("line_", (start + 1).cast("int"), (end - start).cast("int")).alias("content"))


def write_canonical(rows: DataFrame, order: list[str], line: str, root: str, name: str, size: int = blobs.PART_BYTES, most_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Store the canonical text of ``rows`` as blobs ``name``/block: (their manifest with the block's number, the tree of their digests)."""
    cut = canonical_slices(rows, order, line, size, most_bytes)
    named = cut.select(F.concat(F.lit(f"{name}/"), F.lpad(F.col("block").cast("string"), 12, "0")).alias("name"), "at", "content")
    manifest = blobs.put_slices(named, root, size).withColumn("block", F.substring_index("name", "/", -1).cast("long"))
    return manifest, digest_tree(manifest.select(F.lit(name).alias("text"), F.col("block").alias("position"), F.col("sha256").alias("digest")), ["text"])
