"""Features are made by many tasks, and offers are filtered before they are grouped."""

from pricelake.operators import similar as sm
from pricelake.sources import fixtures as fx

from conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_features_of_one_file_are_made_by_many_tasks(spark):
    p = fx.products(spark, SF_SMALL).coalesce(1)
    lines = plan(sm.sparse_embeddings(p)).splitlines()
    explode = max(i for i, x in enumerate(lines) if "Generate" in x)
    assert any("Exchange hashpartitioning(id" in x for x in lines[explode:])


def test_offers_of_other_products_are_not_grouped(spark, monkeypatch):
    p = fx.products(spark, SF_SMALL)
    got = sm.similar_products(p, None, fx.offers(spark, SF_SMALL), 0, cells=sm.sparse_embeddings(p))
    lines = optimized(got).splitlines()
    group = max(i for i, x in enumerate(lines) if "max_by" in x)
    assert any("Filter" in x and "l_partkey" in x and " IN " in x or " INSET " in x for x in lines[group:])
    assert got.count() == 12
