"""Rule-based collections, evaluated for every rule row in one pass.

A rule filters live (in-stock) offers on the *offer's* category and brand (denormalized there), a
maximum price (absent or 0 means 2^40) and a minimum offer count (applies only when > 1). The
route's semantics are kept exactly: walk the cheapest 2,500 matching offers in price order (ties
by product, retailer), keep the first-seen product each (its best price), 100 of them or all 2,500
when a min_offers rule follows; count every offer (in stock or not) of the kept products; apply
min_offers; cut to 100. Titles shown are the product's.

Plan shape: offers are matched to rules by an equi-join on (category-or-'', brand-or-'') lookup
keys (each offer emits four keys), never by a nested-loop join, so the cost stays linear in offers
times matched rules however many rules exist. The walk is a per-rule top-k (WindowGroupLimit
prunes each task to 2,500 rows per rule before the shuffle). Counting and the title lookup touch
only the selected products, a side bounded by rules x 2,500.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricelake.functions.joins import broadcast_bounded, broadcast_if_small, fits

# Fixed values of the reference's collection route.
COLLECTION_SIZE = 100
SCAN_CAP = 2500
NO_MAX_PRICE = 1 << 40
# Rule rows are a measured dimension; up to this many, the per-rule selections (<= rules x 2,500
# ids, <= rules x 100 items) are small enough to broadcast.
MAX_RULES = 2000


def rule_rows(collections: DataFrame) -> DataFrame:
    r = F.col("rules")
    return collections.select(
        "slug", "title",
        F.coalesce(r.category, F.lit("")).alias("r_category"),
        F.coalesce(r.brand, F.lit("")).alias("r_brand"),
        F.coalesce(F.nullif(r.max_price_cents, F.lit(0)), F.lit(NO_MAX_PRICE)).alias("r_max"),
        F.coalesce(r.min_offers, F.lit(0)).alias("r_min_offers"))


def rule_matches(offers: DataFrame, collections: DataFrame) -> DataFrame:
    """Offers (in stock, under the rule's max price) joined to every rule they satisfy."""
    rules = broadcast_if_small(rule_rows(collections), MAX_RULES)
    keys = F.array(
        F.struct(F.col("category").alias("k_category"), F.col("brand").alias("k_brand")),
        F.struct(F.col("category").alias("k_category"), F.lit("").alias("k_brand")),
        F.struct(F.lit("").alias("k_category"), F.col("brand").alias("k_brand")),
        F.struct(F.lit("").alias("k_category"), F.lit("").alias("k_brand")))
    live = (offers.filter(F.col("in_stock"))
                  .select("product_id", "retailer_id", "price_cents",
                          F.explode(F.array_distinct(keys)).alias("k"))
                  .select("product_id", "retailer_id", "price_cents", "k.*"))
    j = live.join(rules, (live.k_category == rules.r_category) & (live.k_brand == rules.r_brand))
    return (j.filter(F.col("price_cents") <= F.col("r_max"))
             .select("slug", "r_min_offers", "product_id", "retailer_id", "price_cents"))


def collection_items(offers: DataFrame, products: DataFrame, collections: DataFrame,
                     size: int = COLLECTION_SIZE, scan_cap: int = SCAN_CAP) -> DataFrame:
    """The items page of every collection."""
    m = rule_matches(offers, collections)
    bounded = fits(collections, MAX_RULES)
    hint = broadcast_bounded if bounded else (lambda d: d)
    walk_w = W.partitionBy("slug").orderBy("price_cents", "product_id", "retailer_id")
    walk = (m.withColumn("rn", F.row_number().over(walk_w))
             .filter(F.col("rn") <= scan_cap))
    first = (walk.groupBy("slug", "r_min_offers", "product_id")
                 .agg(F.min("price_cents").alias("best_price_cents"), F.min("rn").alias("pos")))
    target = F.when(F.col("r_min_offers") > 1, F.lit(scan_cap)).otherwise(F.lit(size))
    sel = (first.withColumn("k", F.row_number().over(W.partitionBy("slug").orderBy("pos")))
                .filter(F.col("k") <= target))
    # At most rules x scan_cap rows.
    ids = hint(sel.select("product_id").distinct())
    counts = (offers.join(ids, "product_id", "left_semi")
                    .groupBy("product_id").agg(F.count(F.lit(1)).alias("offer_count")))
    kept = (sel.join(counts, "product_id", "inner")
               .filter((F.col("r_min_offers") <= 1) | (F.col("offer_count") >= F.col("r_min_offers"))))
    fin = (kept.withColumn("position", F.row_number().over(W.partitionBy("slug").orderBy("pos"))
                                        .cast("long"))
               .filter(F.col("position") <= size))
    p = products.select(F.col("id").alias("product_id"), "title", "brand", "category")
    return (p.join(hint(fin), "product_id", "inner")
             .select("slug", "position", "product_id", "title", "brand", "category",
                     "best_price_cents", "offer_count"))


def collection_members(offers: DataFrame, collections: DataFrame) -> DataFrame:
    """The uncapped meaning of every rule: all products with a matching live offer, their best
    matching price and their offer count, min_offers applied."""
    m = rule_matches(offers, collections)
    best = (m.groupBy("slug", "r_min_offers", "product_id")
             .agg(F.min("price_cents").alias("best_price_cents")))
    counts = offers.groupBy("product_id").agg(F.count(F.lit(1)).alias("offer_count"))
    return (best.join(counts, "product_id", "inner")
                .filter((F.col("r_min_offers") <= 1)
                        | (F.col("offer_count") >= F.col("r_min_offers")))
                .select("slug", "product_id", "best_price_cents", "offer_count"))


def collection_index(collections: DataFrame) -> DataFrame:
    """(slug, title) by slug."""
    return collections.select("slug", "title").orderBy("slug")


def collections_from_json(rows: DataFrame) -> DataFrame:
    """Rule rows (slug, title, rules JSON text) → typed collections; a missing rule field is
    NULL, which means "no filter" (the zero value of the reference's rule struct)."""
    from pricelake.schemas import COLLECTION_RULES
    return rows.select("slug", "title", F.from_json("rules", COLLECTION_RULES).alias("rules"))


def upsert_collections(current: DataFrame, seed: DataFrame) -> DataFrame:
    """A13 seed upsert by slug: the seed's title and rules replace the current ones."""
    s = seed.alias("s")
    c = current.alias("c")
    return (c.join(s, "slug", "full")
             .select("slug", F.coalesce("s.title", "c.title").alias("title"),
                     F.when(F.col("s.slug").isNotNull(), F.col("s.rules"))
                      .otherwise(F.col("c.rules")).alias("rules")))
