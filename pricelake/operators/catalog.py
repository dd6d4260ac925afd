"""Catalog reads: product detail, table statistics, string summaries, money formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.functions.joins import broadcast_if_small


def product_offers(offers: DataFrame, retailers: DataFrame) -> DataFrame:
    """J5 + C8 + F9: every product's offers with the retailer slug, in price order.

    ``offer_rank`` is the position in the product's price order (ties by retailer slug). The
    window is partitioned by product; a product has at most one offer per retailer, so no window
    partition grows with the data."""
    r = broadcast_if_small(retailers.select(F.col("id").alias("retailer_id"),
                                            F.col("slug").alias("retailer")))
    j = offers.join(r, "retailer_id", "inner")
    from pyspark.sql import Window as W
    w = W.partitionBy("product_id").orderBy("price_cents", "retailer")
    return j.select("product_id", "retailer", "price_cents", "in_stock", "updated_at",
                    F.row_number().over(w).cast("long").alias("offer_rank"))


def product_detail(products: DataFrame, offers: DataFrame, retailers: DataFrame) -> DataFrame:
    """One row per product with its offers as an array sorted by price.

    ``array_sort`` over a ``collect_list`` bounded by the retailer count per product."""
    po = product_offers(offers, retailers)
    arr = po.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct(
        "price_cents", "retailer", "in_stock", "updated_at"))).alias("offers"))
    p = products.select(F.col("id").alias("product_id"), "sku_norm", "title", "brand",
                        "category", "attrs")
    return p.join(arr, "product_id", "left")


def counts_by(df: DataFrame, key: str) -> DataFrame:
    """``groupBy(key).count()`` as (key, n)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def ordered_summary(counts: DataFrame, label: str, order: str) -> DataFrame:
    """One string ``label=n`` joined by spaces in ``order`` (a SQL ORDER BY list), '(none)'
    when empty: ``listagg ... WITHIN GROUP``. The input is an aggregate over a bounded key set
    (retailers, reasons)."""
    agg = F.expr(f"listagg(concat({label}, '=', cast(n AS STRING)), ' ') "
                 f"WITHIN GROUP (ORDER BY {order})")
    return counts.agg(F.coalesce(agg, F.lit("(none)")).alias("summary"))


def usd(cents: Column) -> Column:
    """``$d.cc`` with truncating division, as the page templates print it."""
    return F.format_string("$%d.%02d", (cents / 100).cast("long"), (cents % 100).cast("long"))


def bar_pct(best: Column, median: Column) -> Column:
    """Best as a truncated percentage of median; 100 when median <= 0."""
    return F.when(median <= 0, F.lit(100)).otherwise(
        (best * 100 / median).cast("int"))


def stamp(ts: Column) -> Column:
    """UTC minute stamp ``yyyy-MM-dd HH:mm UTC``."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit(" UTC"))
