"""Read-side queries over the fixture catalog: deals, offers, history, collections, stats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelake.operators import catalog, collections as coll, deals as dl, history as hist
from pricelake.plans.oracle import COLLECTIONS_SQL, with_views as V
from pricelake.plans.registry import query
from pricelake.plans.stored import stored
from pricelake.sources import fixtures as fx

RETAILER_IDS = list(range(fx.N_RETAILERS))


def _today(spark: SparkSession, sf_dir: str):
    """'today' of the fixture history: the last observation day (a scalar, passed as a literal)."""
    return fx.obs(spark, sf_dir).agg(F.max(F.to_date("observed_at"))).first()[0]


# --- deals -----------------------------------------------------------------------------------

DEALS_CTE = V("obs", "offers", "products", "retailers") + """,
ranked AS (
  SELECT product_id, retailer_id, price_cents,
         quantile_cont(price_cents, 0.5) OVER (PARTITION BY product_id) AS median,
         count(*) OVER (PARTITION BY product_id) AS n,
         row_number() OVER (PARTITION BY product_id ORDER BY price_cents, retailer_id) AS place
  FROM offers WHERE in_stock),
gaps AS (
  SELECT product_id, retailer_id, price_cents AS best, median, (median - price_cents) / median AS gap
  FROM ranked WHERE place = 1 AND n >= 3 AND median > 0)
"""
DEALS_SELECT = """
SELECT g.product_id, p.title, p.brand, p.category, g.best AS best_price_cents,
       CAST(round_even(g.median, 0) AS BIGINT) AS median_price_cents, r.slug AS retailer,
       CAST(round_even(100 * (g.median - g.best) / g.median, 0) AS INTEGER) AS savings_pct
FROM gaps g JOIN products p ON p.id = g.product_id LEFT JOIN retailers r ON r.id = g.retailer_id
WHERE g.gap >= 0.15
ORDER BY savings_pct DESC, best_price_cents, g.product_id
LIMIT {limit}"""
DEALS_SQL = DEALS_CTE + DEALS_SELECT


def deals_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dl.deals(fx.offers(spark, sf_dir), fx.products(spark, sf_dir),
                    fx.retailers(spark, sf_dir))


@query("deals", DEALS_SQL.format(limit=500))
def q_deals(spark, sf_dir):
    return deals_df(spark, sf_dir)


@query("deals_slice", DEALS_SQL.format(limit=50))
def q_deals_slice(spark, sf_dir):
    return dl.deals_slice(deals_df(spark, sf_dir), 50)


@query("offer_spread", V("obs", "offers") + """
SELECT product_id, min(price_cents) AS best, quantile_cont(price_cents, 0.5) AS median,
       count(*) AS offers, min(retailer_id) FILTER (WHERE price_cents = pmin) AS best_retailer_id
FROM (SELECT *, min(price_cents) OVER (PARTITION BY product_id) AS pmin FROM offers WHERE in_stock)
GROUP BY product_id HAVING count(*) >= 3""")
def q_offer_spread(spark, sf_dir):
    return dl.spread(fx.offers(spark, sf_dir))


@query("deal_labels", DEALS_CTE + ", d AS (" + DEALS_SELECT.format(limit=500) + """)
SELECT product_id, printf('$%d.%02d', best_price_cents // 100, best_price_cents % 100) AS best_label,
       printf('$%d.%02d', median_price_cents // 100, median_price_cents % 100) AS median_label,
       CASE WHEN median_price_cents <= 0 THEN 100
            ELSE CAST(best_price_cents * 100 // median_price_cents AS INTEGER) END AS bar_pct
FROM d""")
def q_deal_labels(spark, sf_dir):
    d = deals_df(spark, sf_dir)
    return d.select("product_id", catalog.usd(F.col("best_price_cents")).alias("best_label"),
                    catalog.usd(F.col("median_price_cents")).alias("median_label"),
                    catalog.bar_pct(F.col("best_price_cents"),
                                    F.col("median_price_cents")).alias("bar_pct"))


# --- offers and products ---------------------------------------------------------------------

@query("current_offers", V("obs", "offers") + """
SELECT product_id, retailer_id, price_cents, in_stock, updated_at FROM offers""")
def q_current_offers(spark, sf_dir):
    return fx.offers(spark, sf_dir)


@query("product_offers", V("obs", "offers", "retailers") + """
SELECT o.product_id, r.slug AS retailer, o.price_cents, o.in_stock, o.updated_at,
       strftime(o.updated_at, '%Y-%m-%d %H:%M') || ' UTC' AS updated_stamp,
       row_number() OVER (PARTITION BY o.product_id ORDER BY o.price_cents, r.slug) AS offer_rank
FROM offers o JOIN retailers r ON r.id = o.retailer_id""")
def q_product_offers(spark, sf_dir):
    po = catalog.product_offers(fx.offers(spark, sf_dir), fx.retailers(spark, sf_dir))
    return po.select("product_id", "retailer", "price_cents", "in_stock", "updated_at",
                     catalog.stamp(F.col("updated_at")).alias("updated_stamp"), "offer_rank")


@query("product_detail", V("obs", "offers", "products", "retailers") + """
SELECT p.id AS product_id, p.sku_norm, p.title, p.brand, p.category,
       CAST(p.p_size AS VARCHAR) AS size_attr, count(o.product_id) AS n_offers,
       string_agg(r.slug || ':' || CAST(o.price_cents AS VARCHAR), ' '
                  ORDER BY o.price_cents, r.slug) AS offers_by_price
FROM products p LEFT JOIN offers o ON o.product_id = p.id
LEFT JOIN retailers r ON r.id = o.retailer_id
GROUP BY p.id, p.sku_norm, p.title, p.brand, p.category, p.p_size""")
def q_product_detail(spark, sf_dir):
    d = catalog.product_detail(fx.products(spark, sf_dir), fx.offers(spark, sf_dir),
                               fx.retailers(spark, sf_dir))
    parts = F.transform("offers", lambda o: F.concat(o.retailer, F.lit(":"),
                                                      o.price_cents.cast("string")))
    return d.select("product_id", "sku_norm", "title", "brand", "category",
                    F.col("attrs")["size"].alias("size_attr"),
                    F.coalesce(F.size("offers"), F.lit(0)).cast("long").alias("n_offers"),
                    F.when(F.size("offers") > 0, F.array_join(parts, " ")).alias("offers_by_price"))


@query("offers_by_retailer", V("obs", "offers", "retailers") + """
SELECT r.slug, count(*) AS n FROM offers o JOIN retailers r ON r.id = o.retailer_id
GROUP BY r.slug""")
def q_offers_by_retailer(spark, sf_dir):
    c = catalog.counts_by(fx.offers(spark, sf_dir), "retailer_id")
    r = F.broadcast(fx.retailers(spark, sf_dir).select(F.col("id").alias("retailer_id"), "slug"))
    return c.join(r, "retailer_id").select("slug", "n")


@query("offers_by_retailer_summary", V("obs", "offers", "retailers") + """
SELECT coalesce(string_agg(slug || '=' || CAST(n AS VARCHAR), ' ' ORDER BY slug), '(none)')
       AS summary
FROM (SELECT r.slug, count(*) AS n FROM offers o JOIN retailers r ON r.id = o.retailer_id
      GROUP BY r.slug)""")
def q_offers_by_retailer_summary(spark, sf_dir):
    c = q_offers_by_retailer(spark, sf_dir)
    return catalog.ordered_summary(c, "slug", "slug")


@query("table_counts", V("obs", "offers", "products", "retailers") + """
SELECT 'products' AS label, count(*) AS n FROM products
UNION ALL SELECT 'offers', count(*) FROM offers
UNION ALL SELECT 'price_events', count(*) FROM obs
UNION ALL SELECT 'retailers', count(*) FROM retailers""")
def q_table_counts(spark, sf_dir):
    def c(label, df):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("label"), "n")
    return (c("products", fx.products(spark, sf_dir))
            .unionByName(c("offers", fx.offers(spark, sf_dir)))
            .unionByName(c("price_events", fx.obs(spark, sf_dir)))
            .unionByName(c("retailers", fx.retailers(spark, sf_dir))))


# --- history ---------------------------------------------------------------------------------

ROLLUP_SQL = V("obs") + """,
d AS (SELECT *, CAST(observed_at AS DATE) AS day,
             row_number() OVER (PARTITION BY product_id, retailer_id, CAST(observed_at AS DATE)
               ORDER BY observed_at DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS rn
      FROM obs)
SELECT product_id, retailer_id, day, min(price_cents) AS min_price, max(price_cents) AS max_price,
       max(CASE WHEN rn = 1 THEN price_cents END) AS last_price,
       CAST(year(day) * 100 + month(day) AS INTEGER) AS month
FROM d GROUP BY product_id, retailer_id, day"""

ROLLUP_COLS = ["product_id", "retailer_id", "day", "min_price", "max_price", "last_price", "month"]


@query("daily_rollup", ROLLUP_SQL)
def q_daily_rollup(spark, sf_dir):
    o = fx.obs(spark, sf_dir)
    return hist.daily_rollup(o, fx.obs_order_key()).select(*ROLLUP_COLS)


@query("rollup_merge", ROLLUP_SQL)
def q_rollup_merge(spark, sf_dir):
    """Roll up two disjoint batches and a replay of the first, then merge the states."""
    o = fx.obs(spark, sf_dir)
    k = fx.obs_order_key()
    a = hist.daily_rollup(o.filter(F.col("l_linenumber") <= 3), k)
    b = hist.daily_rollup(o.filter(F.col("l_linenumber") > 3), k)
    return hist.merge_rollups(a.unionByName(b).unionByName(a)).select(*ROLLUP_COLS)


HISTORY_SQL = V("obs", "retailers") + """,
t AS (SELECT max(CAST(observed_at AS DATE)) AS today FROM obs),
d AS (SELECT *, CAST(observed_at AS DATE) AS day,
             row_number() OVER (PARTITION BY product_id, retailer_id, CAST(observed_at AS DATE)
               ORDER BY observed_at DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS rn
      FROM obs),
pts AS (
  SELECT d.product_id, strftime(d.day, '%Y-%m-%d') AS day, d.retailer_id,
         coalesce(r.slug, '') AS retailer, min(price_cents) AS min_cents,
         max(price_cents) AS max_cents, max(CASE WHEN rn = 1 THEN price_cents END) AS last_cents
  FROM d CROSS JOIN t LEFT JOIN retailers r ON r.id = d.retailer_id
  WHERE d.day >= t.today - {days}
  GROUP BY d.product_id, d.day, d.retailer_id, r.slug)
"""


def history_points(spark, sf_dir, days):
    o = fx.obs(spark, sf_dir)
    def build(path: str) -> None:
        hist.write_daily_rollup(o, fx.obs_order_key(), path)

    daily = spark.read.parquet(stored(spark, sf_dir, "price-daily", build))
    return hist.history(daily, fx.retailers(spark, sf_dir), _today(spark, sf_dir), days)


@query("price_history", HISTORY_SQL.format(days=30) + "SELECT * FROM pts")
def q_price_history(spark, sf_dir):
    return history_points(spark, sf_dir, 30)


@query("daily_series_pivot", HISTORY_SQL.format(days=365) + """
SELECT product_id, day, """ + ", ".join(
    f"max(CASE WHEN retailer_id = {r} THEN last_cents END) AS r{r}" for r in RETAILER_IDS) + """
FROM pts GROUP BY product_id, day""")
def q_daily_series_pivot(spark, sf_dir):
    return hist.series_pivot(history_points(spark, sf_dir, 365), RETAILER_IDS)


@query("daily_series_bounds", HISTORY_SQL.format(days=365) + """
SELECT product_id, min(day) AS first_day, max(day) AS last_day, count(DISTINCT day) AS n_days,
       count(DISTINCT retailer) AS n_retailers, min(last_cents) AS lo,
       CASE WHEN max(last_cents) = min(last_cents) THEN min(last_cents) + 1
            ELSE max(last_cents) END AS hi
FROM pts GROUP BY product_id""")
def q_daily_series_bounds(spark, sf_dir):
    return hist.series_bounds(history_points(spark, sf_dir, 365))


# --- collections -----------------------------------------------------------------------------

RULES_SQL = """,
""" + COLLECTIONS_SQL + """,
rules AS (SELECT slug, coalesce(category, '') AS cat, coalesce(brand, '') AS br,
                 coalesce(nullif(max_price_cents, 0), 1099511627776) AS maxp,
                 coalesce(min_offers, 0) AS mo FROM collections),
m AS (SELECT r.slug, r.mo, o.product_id, o.retailer_id, o.price_cents
      FROM offers_d o JOIN rules r ON o.in_stock AND o.price_cents <= r.maxp
       AND (r.cat = '' OR o.category = r.cat) AND (r.br = '' OR o.brand = r.br)),
cnt AS (SELECT product_id, count(*) AS n FROM offers GROUP BY product_id)
"""


@query("collection_index", "WITH " + COLLECTIONS_SQL
       + "\nSELECT slug, title FROM collections ORDER BY slug")
def q_collection_index(spark, sf_dir):
    return coll.collection_index(fx.collections(spark, sf_dir))


@query("collection_items", V("obs", "offers", "offers_d", "products") + RULES_SQL + """,
walk AS (SELECT *, row_number() OVER (PARTITION BY slug
                   ORDER BY price_cents, product_id, retailer_id) AS rn FROM m),
firsts AS (SELECT slug, mo, product_id, min(price_cents) AS best, min(rn) AS pos
           FROM walk WHERE rn <= 2500 GROUP BY slug, mo, product_id),
sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY pos) AS k
                       FROM firsts) WHERE k <= CASE WHEN mo > 1 THEN 2500 ELSE 100 END),
kept AS (SELECT sel.*, cnt.n FROM sel JOIN cnt USING (product_id) WHERE mo <= 1 OR cnt.n >= mo),
fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY pos) AS position
                       FROM kept) WHERE position <= 100)
SELECT fin.slug, fin.position, fin.product_id, p.title, p.brand, p.category,
       fin.best AS best_price_cents, fin.n AS offer_count
FROM fin JOIN products p ON p.id = fin.product_id""")
def q_collection_items(spark, sf_dir):
    return coll.collection_items(fx.offers_denormalized(spark, sf_dir), fx.products(spark, sf_dir),
                                 fx.collections(spark, sf_dir))


@query("collection_members", V("obs", "offers", "offers_d") + RULES_SQL + """
SELECT m.slug, m.product_id, min(m.price_cents) AS best_price_cents, any_value(cnt.n) AS offer_count
FROM m JOIN cnt USING (product_id)
GROUP BY m.slug, m.mo, m.product_id
HAVING max(m.mo) <= 1 OR any_value(cnt.n) >= max(m.mo)""")
def q_collection_members(spark, sf_dir):
    return coll.collection_members(fx.offers_denormalized(spark, sf_dir), fx.collections(spark, sf_dir))
