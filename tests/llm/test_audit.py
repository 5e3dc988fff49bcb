"""The filter audit against a plain walk through all orders, and against its SQL."""

from itertools import permutations
from pathlib import Path

import duckdb
import pytest

from landsift.llm import audit, queries

SF = "/root/testdata/sf0.001"


def walked(rows, labels):
    """Every count by removing documents step by step."""
    smallest, out = {}, {}
    for i, text, _ in rows:
        smallest[text or ""] = min(smallest.get(text or "", (i is None, i or 0)), (i is None, i or 0))
    docs = []
    for i, text, source in rows:
        text = text or ""
        w = text.translate({c: " " for c in range(9, 14)}).replace(" ", "\0").split("\0")
        w = [x for x in w if x]
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": smallest[text] < (i is None, i or 0),
        }
        docs.append((source or "", fails, *labels.get(i, (0, 0))))
    for part in {d[0] for d in docs}:
        own, total = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, x in enumerate(order):
                gone = [d for d in left if d[1][x]]
                left = [d for d in left if not d[1][x]]
                total[x] += len(gone)
                failing = [d for d in own if d[1][x]]
                alone = sum(sum(d[1].values()) == 1 for d in failing)
                out[part, order, k + 1] = [len(left), len(gone), len(failing) - len(gone), alone, sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(total[order[k - 1]])
    return out


LABELS = "doc_id bigint, quality int, toxic int"


def test_against_a_walk(spark, documents, clashing, empty):
    found = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    more = [(200, "A B " * 30, None), (201, "A B " * 30, "s1"), (None, "A B " * 30, "s1"), (None, None, "s2"), (202, "cost | 5 % " * 20, "s0")]
    labels = [(0, 1, 0), (1, 1, None), (2, None, 1), (201, 0, 1), (5, 1, 1), (5, 0, 0), (None, 1, 1), (102, 1, 0)]
    known = {i: (int(q == 1), int(t == 1)) for i, q, t in labels if i is not None}
    known[5] = (1, 1)
    extra = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in more], documents.schema)
    marks = spark.createDataFrame(labels, LABELS)
    expected = walked(found + more, known)
    for docs in (documents.unionByName(extra), clashing.unionByName(extra, allowMissingColumns=True)):
        got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in audit.audit(docs.repartition(5), marks).collect()}
        assert got == expected
    assert audit.audit(empty, marks).collect() == []
    assert len(audit.audit(documents, marks.limit(0)).collect()) == 3 * 600


def test_a_hot_text_and_a_hot_source(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "if(id % 3 = 0, 'one text', concat('text ', id)) text", "if(id % 3 = 1, 'rare', 'hot') source")
    got = audit.audit(docs, spark.createDataFrame([], LABELS)).where("filter_order = 'EABCD' and step = 1").collect()
    assert {r.part: r.removed for r in got} == {"hot": 999, "rare": 0}


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_words_take_one_shuffle_of_texts(spark):
    plan = audit.word_counts(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()["op13_filter_audit"](spark, SF)
    cursor = con.execute(audit.ORACLE)
    assert [d[0] for d in cursor.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(cursor.fetchall())
