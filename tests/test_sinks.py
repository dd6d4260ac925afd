"""Sources and sinks: deals materialization, collections from JSON, quarantine replay, pages."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from pricelake.operators import collections as coll
from pricelake.operators import deals as dl
from pricelake.operators import normalize as nz
from pricelake.plans.read_side import deals_df
from pricelake.sources.feed import read_pages, retailer_config

from conftest import SF_SMALL


def test_deals_materialization_keeps_last_published(spark, tmp_dir):
    root = os.path.join(tmp_dir, "deals")
    d = deals_df(spark, SF_SMALL)
    dl.materialize(d, root, 1)
    d.limit(0).write.mode("overwrite").parquet(f"{root}/v=2")   # a refresh that never published
    got = dl.read_materialized(spark, root)
    assert got.count() == d.count()
    assert dl.deals_slice(got, 50).count() == min(50, d.count())


def test_collections_from_json(spark):
    rows = [("lamps-cheap", "Cheap lamps", '{"category": "lamps", "max_price_cents": 700}'),
            ("shared-finds", "Found in many shops", '{"max_price_cents": 1234, "min_offers": 6}')]
    c = coll.collections_from_json(spark.createDataFrame(rows, "slug string, title string, rules string"))
    r = {x["slug"]: x["rules"] for x in c.collect()}
    assert r["lamps-cheap"]["category"] == "lamps" and r["lamps-cheap"]["min_offers"] is None
    assert r["shared-finds"]["category"] is None and r["shared-finds"]["min_offers"] == 6
    seed = c.filter("slug = 'shared-finds'").withColumn("title", F.lit("New title"))
    up = {x["slug"]: x["title"] for x in coll.upsert_collections(c, seed).collect()}
    assert up == {"lamps-cheap": "Cheap lamps", "shared-finds": "New title"}


def test_quarantine_replay(spark):
    raws = [json.dumps({"sku": "DS-1234", "price_cents": 100, "currency": "EUR"}),
            json.dumps({"sku": "DS-1234", "price_cents": 100})]
    c = nz.classify(spark.createDataFrame([(r,) for r in raws], "raw string"),
                    dt.datetime(2026, 8, 17))
    q = nz.quarantined(c)
    assert q.count() == 1
    again = nz.replay_quarantine(q, dt.datetime(2026, 8, 17), ["unsupported_currency"])
    assert again.first()["reason"] == "unsupported_currency"


def test_pages_and_config(spark, tmp_dir):
    pages = os.path.join(tmp_dir, "pages")
    os.makedirs(pages)
    env = {"retailer": "northwind", "phase": "offers", "epoch": 9, "page": 3, "has_more": True,
           "items": [{"sku": "A1"}, 5, None, {"sku": "B2"}]}
    with open(os.path.join(pages, "p.json"), "w") as f:
        f.write(json.dumps(env) + "\n")
    items = read_pages(spark, pages).orderBy("pos").collect()
    assert [r["pos"] for r in items] == [0, 1, 2, 3]
    assert items[1]["raw"] == "5" and items[2]["raw"] == "null"
    assert items[0]["epoch"] == 9 and items[0]["has_more"] is True
    cfg = os.path.join(tmp_dir, "feedgen.json")
    with open(cfg, "w") as f:
        json.dump({"seed": 8, "universe_size": 55, "retailers": [
            {"slug": "northwind", "name": "Northwind", "carry_rate": 0.31},
            {"slug": "tallyho", "name": "Tallyho", "carry_rate": 0.77}]}, f)
    r = retailer_config(spark, cfg).collect()
    assert [(x["slug"], x["carry_rate"]) for x in r] == [("northwind", 0.31), ("tallyho", 0.77)]
