import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tests.helpers import canon, duck

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
OWN = [n for n in QUERIES if not n.startswith("op") and n != "pipeline"]


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    want = duck(SMALL).sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 40


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    top = plan(QUERIES["vector_topk"](spark, SMALL))
    assert "WindowGroupLimit" in top and "CartesianProduct" not in top
    assert "BroadcastHashJoin" in plan(QUERIES["doc_lookup_default"](spark, SMALL))
    for name in ("boilerplate_lines", "markup_strip", "v0_chunks", "outline_chunks", "page_profile"):
        text = plan(QUERIES[name](spark, SMALL))
        assert "Python" not in text and "Arrow" not in text
    assert "ReadSchema: struct<doc_id:bigint>" in plan(QUERIES["keyword_cache_miss"](spark, SMALL))
