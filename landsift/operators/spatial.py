"""Spatial joins: an equi-join on grid cells, a box test, then the exact test.

Both sides are exploded to the cells their boxes touch, so the join shuffles on (i, j) and never
compares all pairs. A pair that shares several cells is kept once: in the cell that holds the lower
left corner of the boxes' common part, which needs no distinct afterwards. Cells of a dense place
are split by AQE's skew join. A large box isn't exploded to countless small cells: it stands in the finest of LEVELS
grids, each FACTOR times as coarse as the one before, where it touches MOST_CELLS at most.

In its own grid a row is an owner, in coarser ones a guest. Owners meet owners and guests, guests meet owners only: that is part of the
join's key, so two small boxes never meet in a large cell. Guests stand only in grids where the other side has an owner, which a
subquery of the join's own plan finds out, and are dealt to SALTS parts of a cell, in all of which its few owners stand.
"""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from landsift.functions import geometry as G


LEVELS, FACTOR, MOST_CELLS, SALTS = 6, 16, 64, 8
#: Who meets whom: owners each other, owners of the left side guests of the right one, and the reverse.
BOTH_OWN, LEFT_OWNS, RIGHT_OWNS = 0, 1, 2
EVERY_LEVEL = (1 << LEVELS) - 1


def level_of(box: str, cell: float, margin: float = 0.0) -> Column:
    """The finest grid in which a box touches few cells."""
    touched = lambda k: f"(({box}.e - {box}.w + {2 * margin}D) / {cell * FACTOR**k}D + 2) * (({box}.n - {box}.s + {2 * margin}D) / {cell * FACTOR**k}D + 2)"
    return F.expr("CASE " + " ".join(f"WHEN {touched(k)} <= {MOST_CELLS} THEN {k}" for k in range(LEVELS - 1)) + f" ELSE {LEVELS - 1} END")


def owned_levels(df: DataFrame, box: str, cell: float, margin: float = 0.0) -> Column:
    """The set of the levels of a table's boxes, as bits: a subquery."""
    return df.select(level_of(box, cell, margin).alias("level_")).select(F.expr("coalesce(bit_or(shiftleft(1, level_)), 0)")).scalar()


def placed(df: DataFrame, box: str, cell: float, margin: float, left: bool, others: Column) -> DataFrame:
    """A row a place of each box, with the key ``place_`` (kind, k, i, j, salt) on which two sides are joined. ``others``: levels that the other side owns."""
    owns, visits = (LEFT_OWNS, RIGHT_OWNS) if left else (RIGHT_OWNS, LEFT_OWNS)
    numbers = lambda low, high: f"sequence(floor(({box}.{low} - {margin}D) / size), floor(({box}.{high} + {margin}D) / size))"
    place = lambda kind, salt: f"named_struct('kind', {kind}, 'k', k, 'i', i, 'j', j, 'salt', int({salt}))"
    copies = f"transform(sequence(0, {SALTS - 1}), s -> {place(owns, 's')})"
    here = f"IF(k = level_, IF(k = 0, array({place(BOTH_OWN, 0)}), concat(array({place(BOTH_OWN, 0)}), {copies})), array({place(visits, f'pmod(xxhash64({box}), {SALTS})')}))"
    cells = f"flatten(transform({numbers('w', 'e')}, i -> flatten(transform({numbers('s', 'n')}, j -> {here}))))".replace("size", f"({cell}D * power({FACTOR}D, k))")
    levels = f"filter(sequence(level_, {LEVELS - 1}), k -> k = level_ OR (shiftright(others_, k) & 1) = 1)"
    df = df.withColumns({"level_": level_of(box, cell, margin), "others_": others}).where(F.col(box).isNotNull())
    return df.withColumn("place_", F.explode(F.expr(f"flatten(transform({levels}, k -> {cells}))"))).drop("level_", "others_")


def met_at_home(left: Column, right: Column, cell: float, place: Column, margin: float = 0.0) -> Column:
    """Whether two boxes that share ``place`` overlap or touch, and hold there the lower left corner of their common part."""
    wide = F.struct((left["w"] - margin).alias("w"), (left["s"] - margin).alias("s"), (left["e"] + margin).alias("e"), (left["n"] + margin).alias("n"))
    size = cell * F.pow(F.lit(float(FACTOR)), place["k"])
    return G.bboxes_intersect(wide, right) & (F.floor(F.greatest(wide["w"], right["w"]) / size) == place["i"]) & (F.floor(F.greatest(wide["s"], right["s"]) / size) == place["j"])


def candidate_pairs(left: DataFrame, right: DataFrame, cell: float, margin: float = 0.0, left_box: str = "box", right_box: str = "box") -> DataFrame:
    """All pairs whose boxes, the left one widened by ``margin``, overlap or touch; right columns get the prefix r_. A row without a box has no pair."""
    a = placed(left, left_box, cell, margin, True, owned_levels(right, right_box, cell))
    b = placed(right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]), f"r_{right_box}", cell, 0.0, False, owned_levels(left, left_box, cell, margin))
    return a.join(b, "place_").where(met_at_home(F.col(left_box), F.col(f"r_{right_box}"), cell, F.col("place_"), margin)).drop("place_")


def spatial_join(left: DataFrame, right: DataFrame, exact: Callable[[Column, Column], Column], cell: float, margin: float = 0.0) -> DataFrame:
    """Pairs of rows with geometry ``geom`` and box ``box`` for which ``exact`` holds."""
    return candidate_pairs(left, right, cell, margin).where(exact(F.col("geom"), F.col("r_geom")))


def first_match(pairs: DataFrame, keys: list[str], order: str, *columns: str) -> DataFrame:
    """For each key the match that comes first in input order: the first, not the nearest."""
    picked = F.min_by(F.struct(*columns), F.col(order)).alias("first_")
    return pairs.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"first_.{c}").alias(c) for c in columns])


def shaped(df: DataFrame, *parts: str) -> DataFrame:
    """With ``shape``, a digest of the columns that make a row's shape: rows of one shape meet the same others."""
    return df.withColumn("shape", F.unhex(F.md5(F.to_json(F.struct(*parts)))))


def first_of_shape(features: DataFrame, *parts: str) -> DataFrame:
    """Of features of a category with the same shape, the first in input order: none of the others is a record's first match."""
    first = F.min(F.struct("feature_order", "feature_id")).alias("first_")
    return features.groupBy("category", *parts).agg(first).select("category", *parts, "first_.feature_order", "first_.feature_id")


def flags_of_records(records: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """public_id and proximity_flags from matches (shape, flag_type, r_feature_order, the columns of a flag) of the shapes of ``records``."""
    first = first_match(found, ["shape", "flag_type"], "r_feature_order", "r_feature_order", *columns)
    own = records.select("public_id", "shape").join(first, "shape")
    own = first_match(own, ["public_id", "flag_type"], "r_feature_order", *columns)
    item = F.struct("flag_type", *columns)
    return own.groupBy("public_id").agg(F.array_sort(F.collect_list(item)).alias("proximity_flags"))


def flags(records: DataFrame, features: DataFrame, within_m: float = 500.0, cell: float = 0.01) -> DataFrame:
    """public_id and proximity_flags: at most one flag a type, from the first feature that meets the rule.

    ``records``: public_id, geom, box; ``features``: category, feature_order, feature_id, geom, box,
    all in degrees. Floodplains count where they intersect, wetlands within ``within_m``. Shapes are compared, not
    their copies: of features of one shape only the first can be a first match, and records of one shape have the same flags.
    """
    records, features = shaped(records, "geom", "box"), first_of_shape(features, "geom", "box")
    shapes = records.select("shape", "geom", "box").distinct()
    flood = spatial_join(shapes, features.where("category = 'floodplain'"), G.intersects, cell)
    flood = flood.select("shape", F.lit("intersects_floodplain").alias("flag_type"), F.lit("intersects").alias("relationship"), F.lit(0.0).alias("distance_m"), "r_feature_order", "r_feature_id")
    # a degree of longitude is shortest at the poles' side; the margin covers up to latitude 60
    near = candidate_pairs(shapes, features.where("category = 'wetlands'"), cell, within_m / (G.METRES_LON * 0.5))
    near = near.where(G.bbox_distance_m(F.col("box"), F.col("r_box")) <= within_m).withColumn("d", G.distance_m_once(F.col("geom"), F.col("r_geom"))).where(F.col("d") <= within_m)
    near = near.select("shape", F.lit("near_wetland").alias("flag_type"), F.when(F.col("d") == 0, "intersects").otherwise("within").alias("relationship"), G.round_to(F.col("d"), 1).alias("distance_m"), "r_feature_order", "r_feature_id")
    found = flood.unionByName(near).withColumnRenamed("r_feature_id", "source_feature_id")
    return flags_of_records(records, found, "relationship", "distance_m", "source_feature_id")


def point_screening(points: DataFrame, features: DataFrame, cell: float = 0.01) -> DataFrame:
    """How many features hold each point (point_id, p); those that no feature holds count 0."""
    boxed = points.withColumn("box", F.struct(F.col("p.x").alias("w"), F.col("p.y").alias("s"), F.col("p.x").alias("e"), F.col("p.y").alias("n")))
    hits = candidate_pairs(boxed, features, cell).where(F.exists(F.col("r_geom.polys"), lambda q: G.point_in_polygon(F.col("p"), q)))
    counts = hits.groupBy("point_id").agg(F.count(F.lit(1)).alias("hits"))
    return points.select("point_id").join(counts, "point_id", "left").fillna(0, ["hits"])


def assemble_rings(rings: DataFrame) -> DataFrame:
    """Shells and holes from flat rings (feature_id, ring_no, ring): even nesting is a shell, odd a hole of the smallest ring around it.

    Rings are compared within one feature only; a feature has few.
    """
    sized = rings.withColumn("area", F.abs(G.shoelace(F.col("ring"))) / 2)
    outer = sized.select("feature_id", F.col("ring_no").alias("o_no"), F.col("ring").alias("o_ring"), F.col("area").alias("o_area"))
    inside = (F.col("o_no") != F.col("ring_no")) & (F.col("o_area") > F.col("area")) & G.point_in_polygon(F.element_at("ring", 1), F.array("o_ring"))
    around = sized.join(outer, "feature_id").where(inside).groupBy("feature_id", "ring_no").agg(F.count(F.lit(1)).alias("depth"), F.min_by("o_no", "o_area").alias("parent"))
    out = sized.join(around, ["feature_id", "ring_no"], "left").fillna(0, ["depth"])
    return out.select("feature_id", "ring_no", "depth", F.when(F.col("depth") % 2 == 0, "shell").otherwise("hole").alias("role"), F.when(F.col("depth") % 2 == 1, F.col("parent")).alias("shell_no"), "ring")
