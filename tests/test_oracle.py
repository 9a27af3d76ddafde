import pytest

from quire.plans import catalog
from tests.compare import rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(name, spark, data):
    df = catalog.QUERIES[name](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "BatchEvalPython" not in plan
    assert rows_of(df) == rows_of_sql(catalog.ORACLE[name], data)


def test_scans_read_the_columns_they_need(spark, data):
    plan = catalog.token_count(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "IsNotNull(text)" in plan


def test_the_pipeline_keeps_its_promises(spark, data):
    rows = catalog.build_trees(spark, data).collect()
    nodes = [r for r in rows if r.node_id is not None]
    assert nodes
    assert all(r.start_index <= r.end_index for r in nodes)
    by_doc = {}
    for r in nodes:
        by_doc.setdefault(r.doc_id, []).append(int(r.node_id))
    assert all(sorted(ids) == list(range(1, len(ids) + 1)) for ids in by_doc.values())
    failed = {r.doc_id for r in rows if r.node_id is None}
    assert not failed & set(by_doc)


def test_entry_gives_rows(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
