"""The driver contract of __spark_entry__.py."""

import re

import __spark_entry__ as entry_module


def test_entry_schema(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["product_id", "title", "brand", "category", "best_price_cents",
                          "median_price_cents", "retailer", "savings_pct"]
    assert df.count() > 0


def test_registry_contract():
    q, o = entry_module.queries(), entry_module.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50
    for name in q:
        assert re.fullmatch(r"[a-z][a-z0-9_]*", name), name
