"""Without a label that can be learned from nothing is called toxic, so no row is lost."""

import pytest

from landsift.llm import toxicity


@pytest.mark.parametrize("labels", [[], [(0, 1, None)], [(i, 1, 1) for i in range(200)]], ids=["none", "null", "held out"])
def test_no_usable_label_keeps_all_rows(documents, spark, labels):
    labels = spark.createDataFrame([x for x in labels if x[2] is None or x[0] in held()], "doc_id bigint, quality int, toxic int")
    assert sorted(map(str, toxicity.keep_clean(documents, labels).collect())) == sorted(map(str, documents.collect()))
    assert {r["predicted"] for r in toxicity.scores(documents, labels).collect()} == {0}


def held():
    from zlib import crc32

    return {i for i in range(200) if crc32(str(i).encode()) % 5 == 0}
