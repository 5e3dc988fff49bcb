"""Documents that hold what the operators must stand: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def rows():
    base = words(1, 120)
    passage = words(2, 60)
    out = [
        (0, " ".join(base)),
        (1, "  ".join(base) + "\n"),  # equal but for white space
        (2, " ".join([*base[:60], "odd", *base[61:]])),  # a near copy
        (3, " ".join(words(3, 80)) + " " + " ".join(passage)),
        (4, " ".join(passage) + "\t" + " ".join(words(4, 40))),
        (5, ""),
        (6, None),
        (7, "one"),
        (8, "ONE"),
        (9, " \n\t "),
        (10, "same same " * 30),
        (11, " ".join(words(5, 9000, 50_000))),
        (12, "Ünïcode ß text with   and \x1f inside é " * 4),
        (13, " ".join(base)),
        (13, " ".join(base)),  # a repeated row
        (14, " ".join(words(6, 19))),
        (15, " ".join(words(7, 20))),
        (16, " ".join(words(7, 20))),
    ]
    out += [(100 + k, " ".join([*words(50, 100)[: 99 - k % 3], f"x{k}"])) for k in range(30)]  # a group of near copies
    return [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in out]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(spark, documents):
    """The same rows with columns that operators might want to add."""
    from pyspark.sql import functions as F

    out = documents
    for name in ("id", "row", "bucket", "n", "key", "keep_key", "component", "copy_no", "mix_key", "Toxicity", "quality_score", "decoded", "token_ids", "copies_"):
        out = out.withColumn(name, F.lit("clash"))
    return out
