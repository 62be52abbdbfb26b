import pytest
from oracle import assert_same

from pagefold.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, small, name):
    assert_same(QUERIES[name](spark, small), SQL[name], small)


def test_found_columns(spark, small):
    want = {"p1_found": ["page_id"], "p4_found": ["figure_family", "difficulty"], "p5_found": ["doc_id_a", "doc_id_b"], "p7_found": ["source"], "p8_found": ["doc_id"]}
    for name, columns in want.items():
        assert QUERIES[name](spark, small).columns == columns


def test_found_repetition_evaluates_the_whole_threshold_table(spark, small):
    from pagefold.llm.repeat import THRESHOLDS

    plan = QUERIES["p8_found"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert [metric for _, metric, _, _ in THRESHOLDS if f"{metric}#" not in plan] == []


def test_every_row_gets_a_split(spark, small):
    out = QUERIES["p5_splits"](spark, small)
    assert out.count() == spark.read.parquet(f"{small}/page_index.parquet").count() and out.where("split IS NULL").count() == 0


def test_every_document_gets_ids(spark, small):
    out = QUERIES["p6_ids"](spark, small)
    assert out.columns == ["doc_id", "ids"] and out.count() == spark.read.parquet(f"{small}/documents.parquet").count() and out.where("ids IS NULL").count() == 0
