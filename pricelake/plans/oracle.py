"""DuckDB SQL for the fixture views (FIXTURES.md §2), used to build each query's oracle.

Every oracle query starts with ``WITH`` + the views it needs. They are written independently of
the Spark plans (windows where Spark uses ``max_by``, CASE chains where Spark parses JSON), so an
agreement checks the Spark plan rather than restating it. DuckDB's ``round_even`` is Spark's
``rint``; ``round`` is half away from zero in both.
"""

from __future__ import annotations

VIEWS = {
    "obs": """obs AS (
  SELECT l_partkey AS product_id, CAST(l_suppkey % 8 AS INTEGER) AS retailer_id,
         CAST(round_even(l_extendedprice, 0) AS BIGINT) AS price_cents,
         l_linestatus = 'O' AS in_stock, l_shipdate AS observed_at,
         l_orderkey, l_linenumber, l_suppkey
  FROM lineitem)""",
    "offers": """offers AS (
  SELECT product_id, retailer_id, price_cents, in_stock, observed_at AS updated_at
  FROM (SELECT *, row_number() OVER (PARTITION BY product_id, retailer_id
                   ORDER BY observed_at DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS rn
        FROM obs) WHERE rn = 1)""",
    "offers_d": """offers_d AS (
  SELECT o.*, p.p_type AS category, p.p_brand AS brand
  FROM offers o LEFT JOIN part p ON p.p_partkey = o.product_id)""",
    "products": """products AS (
  SELECT p_partkey AS id, 'DS' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS sku_norm,
         concat_ws(' ', p_brand, p_name, p_type, CAST(p_size AS VARCHAR)) AS title,
         p_brand AS brand, p_type AS category, p_size
  FROM part)""",
    "retailers": """retailers AS (
  SELECT CAST(s_suppkey AS INTEGER) AS id, lower(replace(s_name, '#', '-')) AS slug, s_name AS name
  FROM supplier WHERE s_suppkey < 8)""",
}

# Dependencies between the views, so a query names only what it uses.
DEPS = {"offers": ["obs"], "offers_d": ["offers"]}


def with_views(*names: str) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for d in DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(VIEWS[n] for n in order) + "\n"


#: The rules of ``fixtures.collections``: one per category, one per brand, one over everything.
COLLECTIONS_SQL = """collections(slug, title, category, brand, max_price_cents, min_offers) AS (
  SELECT 'kind-' || replace(lower(p_type), ' ', '-'), 'All of ' || p_type, p_type, NULL, NULL,
         CASE WHEN length(p_type) % 2 = 0 THEN 3 END FROM (SELECT DISTINCT p_type FROM part)
  UNION ALL
  SELECT 'maker-' || replace(lower(p_brand), '#', '-'), 'Made by ' || p_brand, NULL, p_brand,
         20000 * length(p_brand), NULL FROM (SELECT DISTINCT p_brand FROM part)
  UNION ALL
  SELECT 'often-sold', 'Sold in ' || CAST(count(DISTINCT p_type) AS VARCHAR) || ' kinds', NULL, NULL, 2000000, 4
  FROM part)"""
