"""Declared scopes: areas that a source promises to cover, and which features lie in them."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from landsift.functions import geometry as G
from landsift.functions.cover import polygons_cover
from landsift.operators.spatial import candidate_pairs


def declared(scopes: DataFrame) -> DataFrame:
    """scope_id, geom, box, digest and problem of scopes (scope_id, geojson).

    ``digest`` is that of the rings in canonical form, so neither order, nor where a ring starts, nor white space show; ``problem`` is null for a
    scope that may be used.
    """
    rows = scopes.select("scope_id", G.from_geojson(F.col("geojson")).alias("geom")).withColumn("box", G.bbox(F.col("geom")))
    rings = F.array_sort(F.transform("geom.polys", lambda p: F.concat(F.slice(F.transform(p, lambda r: G.canonical_ring(r)), 1, 1), F.array_sort(F.slice(F.transform(p, lambda r: G.canonical_ring(r)), F.lit(2), F.greatest(F.size(p) - 1, F.lit(0)))))))
    own = F.get(F.array_compact(F.transform("geom.polys", lambda p: F.get(F.array_compact(F.transform(p, lambda r: G.ring_problem(r))), F.lit(0)))), F.lit(0))
    problem = F.when(F.col("geom").isNull() | (F.size("geom.polys") == 0), "no_polygon").otherwise(own)
    return rows.select("scope_id", "geom", "box", F.sha2(F.to_json(F.struct(rings.alias("polys"))), 256).alias("digest"), problem.alias("problem"))


def covered(features: DataFrame, scopes: DataFrame, cell: float = 0.05) -> DataFrame:
    """Pairs of features (feature_id, geom, box) and usable scopes that cover them: feature_id, scope_id, digest."""
    pairs = candidate_pairs(features.select("feature_id", "geom", "box"), scopes.where("problem IS NULL").select("scope_id", "digest", "geom", "box"), cell)
    inside = (F.col("box.w") >= F.col("r_box.w")) & (F.col("box.e") <= F.col("r_box.e")) & (F.col("box.s") >= F.col("r_box.s")) & (F.col("box.n") <= F.col("r_box.n"))
    return pairs.where(inside).where(polygons_cover(F.col("r_geom.polys"), F.col("geom.polys"))).select("feature_id", F.col("r_scope_id").alias("scope_id"), F.col("r_digest").alias("digest"))
