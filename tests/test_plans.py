"""Plan-shape guards: no cartesian products, pushed-down scans, bounded broadcasts."""

import pytest

from pricelake.plans.registry import queries

from conftest import SF_SMALL

QS = queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QS))
def test_no_nested_loop_or_cartesian(spark, name):
    p = plan(QS[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p
    # Nested-loop joins only with a one-row side (scalar subquery / target vector).
    if "BroadcastNestedLoopJoin" in p:
        assert name in {"similar_products", "similar_vectors", "ivf_similar_vectors", "search",
                        "search_broad_capped", "search_all_of", "search_any_none",
                        "search_phrase", "search_filters_only", "search_terms_any_case",
                        "search_excludes_only", "search_uncapped", "coverage",
                        "normalize_outcomes", "normalized_items", "quarantine_rows",
                        "page_dedupe", "new_products", "retailer_freshness", "feed_positions"}, name


def test_deals_plan(spark):
    df = QS["deals"](spark, SF_SMALL)
    p = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "TakeOrderedAndProject" in p
    assert "BroadcastExchange" in p
    # Column pruning at the lineitem scan.
    assert "l_comment" not in p and "l_tax" not in p


def test_history_month_pruning(spark):
    df = QS["price_history"](spark, SF_SMALL)
    p = plan(df)
    assert "month" in p
