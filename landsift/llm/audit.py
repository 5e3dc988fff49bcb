"""What five filters remove, alone and one after another, in every order: a relational word pipeline.

Documents are dealt by id once; their words are exploded there and aggregated by (document, word) and then by
document, for totals and distinct words, without another shuffle. These counts, the flags that need no
words, and the labels are outer-joined. The rule on repeated texts is decided between one row a text and part, so that a
group of copies, however large, is combined before the shuffle. What is left is one count for each of the 32 sets of
filters that a document can fail; all orders and steps of a part follow from its 32 counts.

Rows: a null text is empty (no words: it fails A, not B), a null source is the part ''. A document is a row; rows of one id and one
text are counted each, and none is a smaller id's. A null id comes after all others, and has no label. Of
several labels of one id the largest counts. An empty table gives no row. Other columns aren't read, so their names can't clash.
Texts of any length are read whole; a text's words stay in its task, which spills them.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landsift.llm.common import NO_ID, SPACE

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
SIGNS = "[#$%&*|]"


def word_counts(docs: DataFrame) -> DataFrame:
    """id, print (a hash of the text), words and different words of each document; repeated rows are one row."""
    texts = docs.select(_id().alias("id"), F.xxhash64(_text()).alias("print"), _text().alias("text")).repartition("id", "print")
    # the empty word stands once in every row: it counts the rows, and keeps documents that have no words
    each = texts.select("id", "print", F.explode(F.concat(F.split("text", SPACE + "+"), F.array(F.lit(" ")))).alias("word")).where("word <> ''")
    by_word = each.groupBy("id", "print", "word").agg(F.count(F.lit(1)).alias("n"))
    marker = F.col("word") == " "
    rows = F.max(F.when(marker, F.col("n")))
    return by_word.groupBy("id", "print").agg(
        F.floor(F.coalesce(F.sum(F.when(~marker, F.col("n"))), F.lit(0)) / rows).cast("long").alias("words"),
        F.count(F.when(~marker, 1)).alias("different"),
    )


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID)))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _bit(letter: str, fails: Column) -> Column:
    return F.when(fails, F.lit(1 << FILTERS.index(letter))).otherwise(F.lit(0))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """id, part, digest of the text, mask of the filters A to D that it fails, good and toxic (0 or 1) of every row."""
    capitals = F.char_length(F.regexp_replace(_text(), "[^A-Z]+", ""))
    plain = docs.select(
        _id().alias("id"),
        F.xxhash64(_text()).alias("print"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(_text(), 256)).alias("digest"),
        (_bit("C", 100 * capitals > 5 * F.char_length(_text())) + _bit("D", _text().rlike(SIGNS))).alias("signs"),
    )
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    joined = plain.join(word_counts(docs), ["id", "print"], "left_outer").join(marked, "id", "left_outer")
    few, repeated = F.col("words") < 50, 100 * F.col("different") < 65 * F.col("words")
    one = lambda c: F.when(F.col(c) == 1, F.lit(1)).otherwise(F.lit(0)).cast("long").alias(c)
    return joined.select("id", "part", "digest", (F.col("signs") + _bit("A", few) + _bit("B", repeated)).alias("mask"), one("quality"), one("toxic"))


def _by_text(rows: DataFrame) -> DataFrame:
    """part, mask (with E), n, good, toxic: two rows a text and part at most, those of the smallest id and the others."""
    rows = rows.groupBy("digest", "part", "id").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"), F.first("mask").alias("mask"))
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    texts = rows.groupBy("digest", "part").agg(F.min(F.struct("id", "n", "good", "toxic")).alias("first"), F.first("mask").alias("mask"), *sums)
    smallest = texts.groupBy("digest").agg(F.min("first.id").alias("smallest"))
    texts = texts.join(smallest, "digest")
    own = F.col("first.id") == F.col("smallest")
    kept = {c: F.when(own, F.col(f"first.{c}")).otherwise(F.lit(0)) for c in ("n", "good", "toxic")}
    first = F.struct(F.col("mask").alias("mask"), *(kept[c].alias(c) for c in kept))
    copies = F.struct((F.col("mask") + F.lit(1 << FILTERS.index("E"))).alias("mask"), *((F.col(c) - kept[c]).alias(c) for c in kept))
    return texts.select("part", F.inline(F.array(first, copies))).where("n > 0")


def conditional_counts(rows: DataFrame) -> DataFrame:
    """One row a part: for each of the 32 sets of failed filters the documents, those of good quality and the toxic ones."""
    columns = [F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).alias(f"{c}_{m}") for c in ("n", "good", "toxic") for m in range(MASKS)]
    return rows.groupBy("part").agg(*columns)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counts = conditional_counts(_by_text(failures(docs, labels)))
    arrays = [F.array(*(f"{c}_{m}" for m in range(MASKS))).alias(c) for c in ("n", "good", "toxic")]
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = counts.select("part", *arrays, F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = " + ".join(f"IF(instr(substring(filter_order, 1, step - 1), '{x}') > 0, {1 << k}, 0)" for k, x in enumerate(FILTERS))
    own = " + ".join(f"IF(substring(filter_order, step, 1) = '{x}', {1 << k}, 0)" for k, x in enumerate(FILTERS))
    steps = steps.withColumn("before", F.expr(bits)).withColumn("own", F.expr(own))
    total = lambda counted, said: F.expr(f"aggregate(sequence(0, {MASKS - 1}), 0L, (sum, m) -> sum + IF({said}, element_at({counted}, m + 1), 0L))")
    here = "(m & own) <> 0 AND (m & before) = 0"
    # of the 120 orders, a document that fails k filters meets each of them first in 120 / k
    share = F.expr(f"aggregate(sequence(0, {MASKS - 1}), 0L, (sum, m) -> sum + IF((m & own) <> 0, element_at(n, m + 1) * (120 div bit_count(m)), 0L))")
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("n", "(m & (own | before)) = 0").alias("kept"),
        total("n", here).alias("removed"),
        total("n", "(m & own) <> 0 AND (m & before) <> 0").alias("redundant"),
        total("n", "m = own").alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        share.alias("shapley"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[ \t-\r]+'), lambda x: x <> '') AS words FROM d),
f AS (SELECT doc_id, part,
    (len(words) < 50)::INT AS A,
    (100 * len(list_distinct(words)) < 65 * len(words))::INT AS B,
    (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text))::INT AS C,
    regexp_matches(text, '[#$%&*|]')::INT AS D,
    (min(doc_id) OVER (PARTITION BY text) < doc_id)::INT AS E FROM w),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, A + 2 * B + 4 * C + 8 * D + 16 * E AS mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM x a, x b, x c, x d, x e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step::INT AS step, x.bit AS own,
    (SELECT coalesce(sum(y.bit), 0)::INT FROM x y WHERE instr(filter_order, y.letter) < step) AS before
  FROM o, range(1, 6) r(step), x WHERE substr(filter_order, step, 1) = x.letter),
t AS (SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (mask & (own | before) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM t"""
