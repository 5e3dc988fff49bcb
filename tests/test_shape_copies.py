"""Geometry of copies is worked out once, and told to each row."""

import pyspark.sql.functions as F
import pytest
from pyspark.sql import types as K

from landsift.plans import fields, intake

RECORDS, FEATURES = 60, 40


@pytest.fixture
def folder(spark, tmp_path):
    """Orders on one place, two sizes and all remainders of six; suppliers and a customer on that place too."""
    step = 460 * 310 * 6
    spark.range(RECORDS).select((F.col("id") * step).alias("o_orderkey"), (F.col("id") % 2).alias("o_custkey"), F.lit("F").alias("o_orderstatus"), F.lit("1-URGENT").alias("o_orderpriority"), F.lit("1995-01-01").cast("date").alias("o_orderdate")).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(FEATURES).select((F.col("id") * 460 * 310).alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(1).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    return str(tmp_path)


def counting(spark, kind, value):
    """A function of columns that counts its calls."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf(kind)
    def told(*_):
        seen.add(1)
        return value

    return seen, told


def test_a_pair_of_shapes_is_compared_once(spark, folder, monkeypatch):
    seen, told = counting(spark, K.BooleanType(), True)
    monkeypatch.setattr(fields.G, "intersects", told)
    rows = fields.geo_polygon_intersects(spark, folder).collect()
    assert len(rows) == len({(r.public_id, r.feature_id) for r in rows}) == RECORDS * (FEATURES + 1) and seen.value == 2
    seen, told = counting(spark, K.DoubleType(), 1.0)
    monkeypatch.setattr(fields.G, "distance_m", told)
    rows = fields.geo_distance(spark, folder).collect()
    assert len(rows) == len({(r.public_id, r.feature_id) for r in rows}) == RECORDS * FEATURES and seen.value == 2


def test_a_polygon_is_checked_once(spark, folder, monkeypatch):
    seen, told = counting(spark, K.StringType(), "odd")
    monkeypatch.setattr(intake.G, "polygon_problem", lambda rings, most: told(rings))
    rows = intake.watch_topology(spark, folder).collect()
    assert len(rows) == len({r.public_id for r in rows}) == RECORDS and {r.problem for r in rows} == {"odd"} and seen.value == 2


def test_the_rings_of_a_polygon_are_built_once(spark, folder):
    """Where each check built the rings anew, the plan named the shell's corners thousands of times."""
    made = intake.watch_topology(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert made.count("array(array(struct(x") < 20
