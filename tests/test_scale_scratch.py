"""A batch leaves no intermediate table behind, whether it ends or fails."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from pricelake.plans import ingest_runs
from pricelake.session import checkpoint_dir, freeze, scratch_tables
from pricelake.streaming import ingest

from conftest import SF_SMALL

ITEMS = [("a", 1, 0, '{"sku":"AB-001","title":"t","price_cents":100}'), ("a", 1, 1, '{"sku":"AB-002","price_cents":90}'),
         ("a", 2, 0, '{"sku":"AB001","price_cents":5000}'), ("b", 2, 1, "x")]


def kept(spark) -> set[str]:
    return {x for x in os.listdir(checkpoint_dir(spark).removeprefix("file:")) if not x.startswith("rdd-")}


def test_a_batch_removes_its_tables(spark, tmp_dir):
    items = spark.createDataFrame(ITEMS, "retailer string, page long, pos long, raw string")
    retailers = spark.createDataFrame([(7, "a")], "id int, slug string")
    before, paths = kept(spark), ingest.Paths(f"{tmp_dir}/root")
    out = ingest.process_batch(items, 0, paths, retailers, dt.datetime(2020, 1, 1))
    assert kept(spark) == before
    assert {c: out[7][c] for c in ("items", "accepted", "price_spike", "no_title")} == {"items": 3, "accepted": 1, "price_spike": 1, "no_title": 1}
    assert out[None]["unknown_retailer"] == 1
    assert out == {r["retailer_id"]: r.asDict() for r in spark.read.parquet(f"{paths.outcomes}/batch_id=0").collect()}
    spikes = spark.read.parquet(f"{paths.quarantine}/batch_id=0").where("reason = 'price_spike'").collect()
    assert [r["raw"] for r in spikes] == [ITEMS[2][3]]


def test_nested_and_failed(spark):
    before = kept(spark)
    with pytest.raises(ValueError), scratch_tables(spark):
        outer = freeze(spark.range(3), "outer")
        with scratch_tables(spark):
            freeze(spark.range(2), "inner")
        assert outer.count() == 3
        raise ValueError
    assert kept(spark) == before
    assert freeze(spark.range(4), "stays").count() == 4
    assert len(kept(spark) - before) == 1


def test_the_feed_of_items_without_a_part(spark, tmp_dir):
    for name in ("part", "supplier"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").write.parquet(f"{tmp_dir}/{name}.parquet")
    items = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").limit(200)
    part = F.when(F.col("l_linenumber") != 2, F.col("l_partkey"))
    items.withColumn("l_partkey", part).write.parquet(f"{tmp_dir}/lineitem.parquet")
    rows = ingest_runs.landed(spark, tmp_dir).agg(F.count("*"), F.count_if(~F.contains("raw", F.lit("/p/")))).first()
    assert rows[0] == 200 and rows[1] == spark.read.parquet(f"{tmp_dir}/lineitem.parquet").where("l_partkey IS NULL").count() > 0
