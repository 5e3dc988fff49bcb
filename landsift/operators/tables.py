"""Collections as tables: dedupe variants, upserts, merges, set operations, audits and paging."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

from landsift.scratch import stored


def _key(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def first_wins(df: DataFrame, keys, order: str) -> DataFrame:
    """The first row of each key; an aggregate, so a hot key is combined before it is shuffled."""
    return df.groupBy(*_key(keys)).agg(F.min_by(F.struct(*df.columns), F.col(order)).alias("row_")).select("row_.*")


def last_wins(df: DataFrame, keys, order: str) -> DataFrame:
    """The last row of each key, at the place (position) of the first."""
    picked = df.groupBy(*_key(keys)).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("row_"), F.min(order).alias("position"))
    return picked.select("row_.*", "position")


def reject_all_duplicates(df: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """(rows whose key occurs once, all rows of keys that occur more often)."""
    keys = _key(keys)
    often = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1").drop("n_")
    return df.join(often, keys, "left_anti"), df.join(often, keys, "left_semi")


def upsert(current: DataFrame, new: DataFrame, keys, order: str = "sort_order") -> DataFrame:
    """New rows replace those of their key in place; rows of new keys follow after the largest order."""
    keys, columns = _key(keys), [c for c in current.columns if c != order]
    old = current.select(*keys, F.col(order).alias("old_"))
    placed = new.select(*columns).join(old, keys, "left")
    most = current.agg(F.coalesce(F.max(order), F.lit(-1)).alias("most_"))
    fresh = placed.where("old_ is null").drop("old_")
    # ranks within key ranges, then offsets of the ranges: no window over all rows in one task
    numbered = numbered_rows(fresh, keys).crossJoin(F.broadcast(most)).withColumn(order, F.col("most_") + F.col("number_")).drop("most_", "number_")
    kept = current.join(new.select(*keys), keys, "left_anti")
    return kept.select(*columns, order).unionByName(placed.where("old_ is not null").withColumnRenamed("old_", order).select(*columns, order)).unionByName(numbered.select(*columns, order))


def ranged(df: DataFrame, order) -> DataFrame:
    """The rows in stored parts (part_) that follow each other in ``order``."""
    return stored(df.repartitionByRange(*_key(order)).withColumn("part_", F.spark_partition_id()), "ranged")


def numbered_rows(df: DataFrame, order, name: str = "number_") -> DataFrame:
    """Rows numbered from 1 in ``order``, without gathering them in one task.

    Range partitions keep the order; they are stored sorted and with each row's place in its part, so that a row keeps both
    whatever is planned or computed anew later, and isn't dealt a second time. The sums of the parts before it, one row a part, are added.
    """
    sorted_ = df.repartitionByRange(*_key(order)).sortWithinPartitions(*_key(order))
    # the lower 33 bits of these ids count a part's rows as they come
    ranked = stored(sorted_.withColumns({"part_": F.spark_partition_id(), "in_": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1}), "numbered")
    sizes = ranked.groupBy("part_").agg(F.count(F.lit(1)).alias("size_"))
    before = sizes.select("part_", (F.sum("size_").over(W.orderBy("part_")) - F.col("size_")).alias("before_"))
    return ranked.join(F.broadcast(before), "part_").withColumn(name, F.col("before_") + F.col("in_")).drop("part_", "in_", "before_")


def delete(current: DataFrame, keys_gone: DataFrame, keys) -> DataFrame:
    return current.join(keys_gone, _key(keys), "left_anti")


def insert_or_ignore(current: DataFrame, new: DataFrame, keys) -> DataFrame:
    return current.unionByName(new.join(current.select(*_key(keys)), _key(keys), "left_anti"))


def conflicts(current: DataFrame, new: DataFrame, keys, values: list[str]) -> DataFrame:
    """Rows of ``new`` whose key exists with other values: what an immutable insert refuses."""
    keys = _key(keys)
    old = current.select(*keys, F.struct(*values).alias("old_"))
    return new.join(old, keys).where(~F.struct(*values).eqNullSafe(F.col("old_"))).drop("old_")


def replace_by_source(current: DataFrame, new: DataFrame, source: str = "source_key") -> DataFrame:
    """Old rows of other sources and all new rows."""
    return current.join(new.select(source).distinct(), source, "left_anti").unionByName(new, allowMissingColumns=True)


def override(old: DataFrame, new: DataFrame, keys) -> DataFrame:
    """Old and new by key; new wins."""
    return old.join(new.select(*_key(keys)), _key(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Empty where both hold the same rows as often: set equality as an audit."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    return df.where(F.col(key) > after).orderBy(key).limit(size)


def top(df: DataFrame, size: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(size)


def latest(df: DataFrame, keys, *order: str) -> DataFrame:
    """The row of each key that is largest by ``order``."""
    return df.groupBy(*_key(keys)).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("row_")).select("row_.*")


def running_budget(df: DataFrame, partition, order, size: Column, most: int) -> DataFrame:
    """The rows of each partition, in order, while the sum of their sizes stays within ``most``."""
    total = F.sum(size).over(W.partitionBy(*_key(partition)).orderBy(*_key(order)).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("total_", total).where(F.col("total_") <= most).drop("total_")


def item_id(keys: list[Column], index: Column) -> Column:
    """The first id that isn't empty, cut at 255 characters, else the position."""
    return F.substring(F.coalesce(*[F.nullif(k.cast("string"), F.lit("")) for k in keys], index.cast("string")), 1, 255)
