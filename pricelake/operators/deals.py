"""Deals: cross-retailer price dislocations over the current offers (flagship query).

Per product over in-stock offers: best price, exact interpolated median, offer count; keep
products with at least three in-stock offers, a positive median and a best price at least 15 %
under the median (the unrounded ratio). The median includes the best offer itself (the SQL, not
the comment, is the contract). Median and savings round half to even (float8 rounding).

Plan shape, chosen for scale:

* one hash aggregate keyed by product_id. ``min``/``count`` combine map-side; the exact median
  buffers values per product, and a product's in-stock offers are bounded by the retailer
  dimension (one offer per (product, retailer)), so no group grows with the data;
* the retailer holding the best price is picked in the same aggregate with
  ``min_by(retailer_id, struct(price, retailer_id))`` instead of a correlated subquery;
* ``offers.product_id`` references ``products.id`` (a foreign key in the reference schema), so the
  inner join with products cannot drop a ranked row: the top ``limit`` is taken first
  (TakeOrderedAndProject) and only those rows are joined, the bounded side broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelake.functions.joins import broadcast_bounded

# Fixed values of the reference's deals rule.
MIN_OFFERS = 3
MIN_SAVINGS = 0.15
TOP_N = 500


def spread(offers: DataFrame, min_offers: int = MIN_OFFERS) -> DataFrame:
    """Best, median and count over in-stock offers per product, HAVING count >= n."""
    live = offers.filter(F.col("in_stock")).select("product_id", "retailer_id", "price_cents")
    agg = live.groupBy("product_id").agg(
        F.min("price_cents").alias("best"),
        F.percentile("price_cents", 0.5).alias("median"),
        F.count(F.lit(1)).alias("offers"),
        F.min_by("retailer_id", F.struct("price_cents", "retailer_id")).alias("best_retailer_id"),
    )
    return agg.filter(F.col("offers") >= min_offers)


def deals(offers: DataFrame, products: DataFrame, retailers: DataFrame,
          limit: int = TOP_N) -> DataFrame:
    """K1 + K2 + F4: the materialized deals list, ordered by savings desc, best asc, id."""
    sp = spread(offers)
    gap = F.col("median") - F.col("best")
    ranked = (sp.filter((F.col("median") > 0) & (gap / F.col("median") >= MIN_SAVINGS))
                .select("product_id", "best", "best_retailer_id",
                        F.rint("median").cast("bigint").alias("median_price_cents"),
                        F.rint(100 * gap / F.col("median")).cast("int").alias("savings_pct")))
    top = ranked.orderBy(F.col("savings_pct").desc(), F.col("best").asc(),
                         F.col("product_id").asc()).limit(limit)
    top = broadcast_bounded(top)
    p = products.select(F.col("id").alias("product_id"), "title", "brand", "category")
    r = retailers.select(F.col("id").alias("best_retailer_id"), F.col("slug").alias("retailer"))
    out = (p.join(top, "product_id", "inner")
            .join(broadcast_bounded(r), "best_retailer_id", "left"))
    return out.select("product_id", "title", "brand", "category",
                      F.col("best").alias("best_price_cents"), "median_price_cents",
                      "retailer", "savings_pct").orderBy(
        F.col("savings_pct").desc(), F.col("best_price_cents").asc(), F.col("product_id").asc())


def deals_slice(materialized: DataFrame, limit: int = 50) -> DataFrame:
    """the first ``limit`` deals (default 50, max 500) of the materialized list."""
    n = max(0, min(int(limit), TOP_N))
    return (materialized.orderBy(F.col("savings_pct").desc(), F.col("best_price_cents").asc(),
                                 F.col("product_id").asc())
                        .limit(n))


def materialize(deals_df: DataFrame, root: str, version: int) -> None:
    """Write the whole list as a new version, then publish it with a manifest row.

    A failed refresh leaves the previous version published (no TTL, never delete first); readers
    take the highest published version (``read_materialized``)."""
    spark = deals_df.sparkSession
    deals_df.write.mode("overwrite").parquet(f"{root}/v={version}")
    (spark.createDataFrame([(version,)], "version long")
          .write.mode("append").parquet(f"{root}/_published"))


def read_materialized(spark, root: str) -> DataFrame:
    """A12 read side: the last published deals list."""
    v = spark.read.parquet(f"{root}/_published").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root}/v={v}")
