"""Written-table layouts: postings sorted by token (pushdown), history partitioned by month
(partition pruning)."""

import datetime as dt
import os

from pyspark.sql import functions as F

from pricelake.operators import history as hist
from pricelake.operators import search as se
from pricelake.sources import fixtures as fx
from pricelake.sources.tables import read_table

from conftest import SF_SMALL


def formatted(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_postings_lookup_pushes_token_filter(spark, tmp_dir):
    path = os.path.join(tmp_dir, "postings")
    se.write_postings(se.postings(read_table(spark, SF_SMALL, "documents"), "doc_id", "text"), path)
    p = spark.read.parquet(path)
    q = se.TextQuery(all_of=["eau", "le"])
    r = se.match_and_rank(p, q)
    plan = formatted(r)
    assert "In(token, [eau,le])" in plan and "PushedFilters" in plan
    direct = se.match_and_rank(se.postings(read_table(spark, SF_SMALL, "documents"), "doc_id",
                                           "text"), q)
    assert sorted(r.collect()) == sorted(direct.collect())


def test_history_prunes_month_partitions(spark, tmp_dir):
    path = os.path.join(tmp_dir, "price_daily")
    daily = hist.daily_rollup(fx.obs(spark, SF_SMALL), fx.obs_order_key())
    daily.write.partitionBy("month").parquet(path)
    stored = spark.read.parquet(path)
    today = dt.date(1998, 8, 2)
    h = hist.history(stored, fx.retailers(spark, SF_SMALL), today, 30)
    plan = formatted(h)
    assert "PartitionFilters: [isnotnull(month" in plan and "(month#" in plan
    assert h.filter(F.col("day") < "1998-07-03").count() == 0
