"""Catalog tables derived from the TPC-H-shaped test tables (FIXTURES.md §2).

Each function returns a lazily planned DataFrame over the parquet files, so the work of every query
grows with the tables. The same definitions exist as SQL in ``pricelake.plans.oracle`` for DuckDB.

* ``obs``: one price observation per line item. retailer = supplier mod 8.
* ``offers``: the latest observation per (product, retailer) by the observation order.
* ``products`` / ``retailers``: dimensions from ``part`` / ``supplier``.
* ``collections``: rules derived from the categories and brands of ``part``.
* ``request_log`` / ``outcomes`` / ``change_log``: operational views over ``events``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelake.schemas import COLLECTIONS
from pricelake.sources.tables import read_table

N_RETAILERS = 8

# Observation order inside one (product, retailer) key: unique there (FIXTURES.md §2).
OBS_ORDER = ("observed_at", "l_orderkey", "l_linenumber", "l_suppkey")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").alias("product_id"),
        (F.col("l_suppkey") % N_RETAILERS).cast("int").alias("retailer_id"),
        F.rint("l_extendedprice").cast("bigint").alias("price_cents"),
        (F.col("l_linestatus") == "O").alias("in_stock"),
        F.col("l_shipdate").alias("observed_at"),
        "l_orderkey", "l_linenumber", "l_suppkey",
    )


def obs_order_key(prefix: str = "") -> Column:
    """A struct that orders observations; used as the ordering argument of max_by/min_by."""
    return F.struct(*[F.col(prefix + c).alias(c) for c in OBS_ORDER])


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest observation per key.

    A hash aggregate with ``max_by``: partial aggregation runs map-side, so a key holding a third
    of all rows is pre-reduced in every task before the shuffle, unlike a ``row_number`` window,
    which would sort the whole key in one task.
    """
    o = obs(spark, sf_dir)
    latest = F.max_by(F.struct("price_cents", "in_stock", "observed_at"), obs_order_key())
    return (o.groupBy("product_id", "retailer_id")
             .agg(latest.alias("s"))
             .select("product_id", "retailer_id",
                     F.col("s.price_cents").alias("price_cents"),
                     F.col("s.in_stock").alias("in_stock"),
                     F.col("s.observed_at").alias("updated_at")))


def offers_denormalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers carrying the product's category and brand, as the ingest job writes them."""
    p = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_type").alias("category"), F.col("p_brand").alias("brand"))
    return offers(spark, sf_dir).join(p, "product_id", "left")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("DS"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("sku_norm"),
        F.concat_ws(" ", "p_brand", "p_name", "p_type", F.col("p_size").cast("string")).alias("title"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("attrs"),
    )


def retailers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    return (s.filter(F.col("s_suppkey") < N_RETAILERS)
             .select(F.col("s_suppkey").cast("int").alias("id"),
                     F.lower(F.regexp_replace("s_name", "#", "-")).alias("slug"),
                     F.col("s_name").alias("name"),
                     F.lit("active").alias("status")))


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection rules derived from ``part``: one per category, one per brand, one over everything."""
    part = read_table(spark, sf_dir, "part")
    none = F.lit(None)

    def rule(df: DataFrame, slug: Column, title: Column, category, brand, price, offers) -> DataFrame:
        rules = F.struct(category.alias("category"), brand.alias("brand"), price.alias("max_price_cents"),
                         offers.alias("min_offers")).cast(COLLECTIONS["rules"].dataType)
        return df.select(slug.alias("slug"), title.alias("title"), rules.alias("rules"))

    kind, maker = F.col("p_type"), F.col("p_brand")
    kinds = rule(part.select("p_type").distinct(), F.concat(F.lit("kind-"), F.replace(F.lower(kind), F.lit(" "), F.lit("-"))),
                 F.concat(F.lit("All of "), kind), kind, none, none, F.when(F.length(kind) % 2 == 0, F.lit(3)))
    makers = rule(part.select("p_brand").distinct(), F.concat(F.lit("maker-"), F.replace(F.lower(maker), F.lit("#"), F.lit("-"))),
                  F.concat(F.lit("Made by "), maker), none, maker, F.lit(20000) * F.length(maker), none)
    n = part.agg(F.count_distinct("p_type").cast("string").alias("n"))
    whole = rule(n, F.lit("often-sold"), F.concat(F.lit("Sold in "), F.col("n"), F.lit(" kinds")), none, none,
                 F.lit(2000000), F.lit(4))
    return kinds.unionByName(makers).unionByName(whole)


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests: route = event type, latency in seconds (value is milliseconds), hit unless an
    error."""
    e = read_table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("route"), (F.col("value") / 1000.0).alias("latency"),
                    F.col("ts").alias("at"), (F.col("event_type") != "error").alias("hit"),
                    "event_id")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % N_RETAILERS).cast("int").alias("retailer_id"),
                    F.col("event_type").alias("outcome"), F.col("ts").alias("newest"),
                    F.col("ts").alias("at"), "event_id", "value")


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update stream per feed epoch: epoch = user_id mod 8, seq dense from 1 within the epoch
    by (ts, event_id). Numbered with distributed dense ids (no window over an epoch)."""
    from pricelake.functions.ids import dense_index

    e = read_table(spark, sf_dir, "events").select(
        (F.col("user_id") % N_RETAILERS).cast("long").alias("epoch"), "ts", "event_id",
        "event_type", "value")
    g = dense_index(e, ["epoch", "ts", "event_id"], 0, "gid")
    first = g.groupBy("epoch").agg(F.min("gid").alias("g0"))
    return (g.join(F.broadcast(first), "epoch")   # one row per epoch
             .select("epoch", (F.col("gid") - F.col("g0") + 1).alias("seq"), "ts", "event_id",
                     "event_type", "value"))
