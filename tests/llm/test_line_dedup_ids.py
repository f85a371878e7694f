"""A line is common when enough distinct ids hold it."""

from assay.llm import line_dedup
from tests.llm.cases import SHARED


def dropped(spark, ids):
    docs = spark.createDataFrame([(i, f"{SHARED}\nown") for i in ids], "doc_id long, text string")
    return {r.doc_id: r.n_dropped for r in line_dedup.without_common_lines(docs).collect()}


def test_repeated_and_missing_ids_are_no_documents_of_their_own(spark):
    assert set(dropped(spark, [1, 1, 1, 1, 2]).values()) == {0}
    assert set(dropped(spark, [1, 2, 3, 4, None]).values()) == {0}
    got = dropped(spark, [1, 1, 2, 3, 4, 5, None])
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 0, None: 0}
