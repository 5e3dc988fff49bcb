"""The pipeline and its exact stage on rows of one id, null ids, clashing columns and empty tables."""

import pytest

import corpus_pipeline
from landsift.llm import exact

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"
ROWS = [
    (1, "a b", "en", "s", 3),
    (1, "a  b", "fr", "t", 4),
    (2, "a b ", "en", "s", 4),
    (3, "c  d", "en", "s", 4),
    (3, "c d ", "de", "s", 4),  # one id, one length, one text but for white space
    (4, "e", "en", "s", 1),
    (4, "e", "en", "s", 1),  # a repeated row
    (5, "f", "en", "s", 1),
    (5, "f", "fr", "t", 1),  # one id and text, another language and source
    (None, "g", "en", None, 1),
    (None, None, None, None, None),
    (6, "", "en", "s", 0),
    (None, "a    b", "en", "s", 6),
]


def test_the_longest_of_one_id_stays_wherever_it_lies(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    results = [sorted(map(tuple, exact.keep_first(d, most).collect()), key=str) for d in (docs.coalesce(1), docs.repartition(3), docs.repartition(7, "text")) for most in (2_000_000, 0)]
    assert all(r == results[0] for r in results)
    texts = sorted((t or "") for _, t, *_ in results[0])
    assert texts == sorted(["a    b", *[t for _, t, *_ in results[0] if t in ("c  d", "c d ")], "e", "f", "g", ""])
    assert [r for r in results[0] if r[1] in ("", None)] == [(6, "", "en", "s", 0)]
    alone = exact.keep_first(spark.createDataFrame(ROWS[:3], SCHEMA)).collect()
    assert [tuple(r) for r in alone] == [ROWS[1]]


def test_columns_of_any_name_come_through(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "'x' Keep_Row", "1 row", "map('a', 1) `odd.name`")
    got = exact.keep_first(docs)
    assert got.columns == docs.columns and {r["Keep_Row"] for r in got.collect()} == {"x"}


def test_no_text_is_shuffled(spark):
    plan = exact.keep_first(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def written(spark, folder, rows, labels):
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'own' copy_no", "7 id").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("case", ["odd", "no labels", "empty"])
def test_the_pipeline_on_odd_tables(spark, tmp_path, case):
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(12)] + [(None, 1, 1), (4, None, None)]
    folder = written(spark, tmp_path, ROWS if case != "empty" else [], labels if case == "odd" else [])
    got = corpus_pipeline.run(spark, folder).collect()
    if case == "empty":
        assert got == []
    elif case == "no labels":
        assert {r.doc_id for r in got} <= {1, 2, 3, 4, 5, 6, None}
    for r in got:
        assert r.n_tokens == len(r.token_ids)
