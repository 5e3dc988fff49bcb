"""Mixing sources to target weights by Poisson replication.

Each source gets a rate, the mean number of copies of its documents, so that the expected mix meets
its target weight. A uniform number hashed from a seed and the id is put through the inverse of the
source's Poisson distribution; the document is exploded by the count, and all copies are dealt by ranges of a
hash and sorted by it, which shuffles them globally. The same seed gives the same rows on any cluster.

A rate above ``MOST_RATE`` is drawn as the sum of several Poisson numbers of smaller rates, so that
no probability underflows. Everything is a built-in Spark function. The rates are joined back
broadcast while there are ``MOST_SOURCES`` sources at most (checked), by a shuffled join beyond that.

Weights: a source that isn't in ``weights``, or has a null weight, counts 0 and has no copies; several weights of one source
are added; weights of sources without documents don't matter; where all weights are 0 nothing is kept.

Rows: a null source is a source of its own; a null id hashes as 'null'; rows of one id have as many
copies each; null and empty texts are replicated like others. Columns that clash with copy_no or
mix_key are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landsift.llm.common import text_size, without

MOST_SOURCES, MOST_RATE = 10_000, 200.0
PART_BYTES = 256 << 20  # of text a part of the result, about


def uniform(seed: int, *parts: Column) -> Column:
    """52 bits of an md5 as a number from 0 to 1; any engine with md5 gets the same."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def distribution(rate: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, ... as an array, far beyond the mean."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("sum"), F.array(first).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        total = acc["sum"] + p
        return F.struct(p.alias("p"), total.alias("sum"), F.concat(acc["all"], F.array(total)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"])


def rates(docs: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """source, rate. ``weights`` (source, weight) sets the targets; without it a weight is count ** alpha."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        power = F.sqrt(F.col("n").cast("double")) if alpha == 0.5 else F.pow(F.col("n").cast("double"), F.lit(alpha))
        weighted = counts.withColumn("weight", power)
    else:
        told = weights.groupBy(F.col("source").alias("told")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        weighted = counts.join(told, F.col("source").eqNullSafe(F.col("told")), "left").drop("told").fillna(0.0, ["weight"])
    total = weighted.agg(F.sum("n").alias("rows"), F.sum("weight").alias("weights"))
    share = F.when(F.col("weights") > 0, F.col("weight") / F.col("weights")).otherwise(F.lit(0.0))
    return weighted.crossJoin(F.broadcast(total)).select("source", (share * F.col("rows") * F.lit(epochs) / F.col("n")).alias("rate"))  # one row


def replicate(docs: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """All columns of ``docs``, copy_no from 0, and mix_key; sorted by mix_key over all partitions."""
    docs = without(docs, "copy_no", "mix_key")
    columns = docs.columns
    pieces = F.greatest(F.ceil(F.col("rate") / MOST_RATE).cast("int"), F.lit(1))
    table = rates(docs, weights, alpha, epochs).withColumn("pieces_", pieces).select(F.col("source").alias("source_"), "pieces_", distribution(F.col("rate") / F.col("pieces_")).alias("sums_"))
    few = table.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES
    joined = docs.join(F.broadcast(table) if few else table, docs["source"].eqNullSafe(F.col("source_")))
    numbers = F.transform(F.sequence(F.lit(1), F.col("pieces_")), lambda i: uniform(seed, F.col("doc_id"), i))  # once a piece, not once a probability
    drawn = F.transform(numbers, lambda u: F.size(F.filter("sums_", lambda c: c <= u)))
    copies = F.aggregate(drawn, F.lit(0), lambda a, n: a + n)
    many = joined.withColumn("copies_", copies).where("copies_ > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("copies_") - 1)))
    key = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("copy_no").cast("string")).cast("binary"))
    out = many.select(*columns, "copy_no", key.alias("mix_key"))
    # the keys are md5s, so even ranges of their first 32 bits hold even shares: a total order without sampling the rows first
    rows, size = text_size(docs) if "text" in docs.columns else (docs.count(), 0)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // 200_000), -(-size // PART_BYTES))
    place = F.floor(F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("double") * parts / float(1 << 32)).cast("int")
    return out.repartitionById(parts, place).sortWithinPartitions("mix_key")


def oracle(table: str, alpha_is_half: bool = True, epochs: float = 1.0, seed: int = 17, columns: str = "doc_id, text, lang, source, n_chars") -> str:
    """The same rows in DuckDB, for rates up to MOST_RATE: the count is how many cumulative probabilities the number reaches."""
    assert alpha_is_half
    return f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n, sqrt(count(*)::DOUBLE) AS weight FROM {table} GROUP BY source),
r AS (SELECT source, weight / (SELECT sum(weight) FROM n) * (SELECT sum(n) FROM n) * {epochs} / n AS rate FROM n),
c(source, rate, k, p, total) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), total + p * rate / (k + 1) FROM c WHERE k + 1 <= ceil(rate + 12 * sqrt(rate) + 30)),
u AS (SELECT *, ('0x' || substr(md5(concat('{seed}:', coalesce(doc_id::VARCHAR, 'null'), ':1')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM {table}),
s AS (SELECT source, list(total ORDER BY k) AS sums FROM c GROUP BY source),
m AS (SELECT u.*, len(list_filter(s.sums, lambda x: x <= u.u)) AS copies FROM u JOIN s ON u.source IS NOT DISTINCT FROM s.source),
e AS (SELECT *, unnest(range(copies)) AS copy_no FROM m)
SELECT {columns}, copy_no::INTEGER AS copy_no, md5(concat('order{seed}:', coalesce(doc_id::VARCHAR, 'null'), ':', copy_no)) AS mix_key FROM e"""


def mixed(docs: DataFrame) -> DataFrame:
    return replicate(docs)
