"""Vector-side queries: embedding tokens, hashed embeddings, exact and approximate k-NN."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelake.functions.fnv import fnv1a64_hex
from pricelake.operators import neighbours as nb
from pricelake.operators import similar as sm
from pricelake.plans.oracle import with_views as V
from pricelake.plans.registry import query
from pricelake.plans.stored import stored
from pricelake.sources import fixtures as fx
from pricelake.sources.tables import read_table

TARGET_PRODUCT = 0
TARGET_VECTOR = 0

# DuckDB FNV-1a 64 over the bytes of an ASCII string (the fixture's feature strings are ASCII).
FNV_SQL = ("list_reduce(list_transform(range(1, length({s}) + 1), "
           "lambda i: CAST(ord(substr({s}, i, 1)) AS UHUGEINT)), "
           "lambda acc, b: (xor(acc, b) * CAST(1099511628211 AS UHUGEINT)) "
           "% CAST('18446744073709551616' AS UHUGEINT), "
           "CAST('14695981039346656037' AS UHUGEINT))")

FEATS_SQL = """,
toks AS (SELECT id, brand, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) AS t FROM products),
feats AS (
  SELECT id, 'cat:' || lower(category) AS f, 3.0 AS w FROM products
  UNION ALL SELECT id, 'brand:' || lower(brand), 2.0 FROM products
  UNION ALL SELECT id, 't:' || t, 1.0 FROM toks
    WHERE length(t) >= 2 AND NOT regexp_full_match(t, '[0-9]+') AND t <> lower(brand)
  UNION ALL SELECT id, 'a:size=' || lower(CAST(p_size AS VARCHAR)), 0.5 FROM products),
vocab AS (SELECT f, """ + FNV_SQL.format(s="f") + """ AS h FROM (SELECT DISTINCT f FROM feats)),
cells AS (
  SELECT id, CAST(h % 256 AS INTEGER) AS idx,
         sum(CASE WHEN h >= CAST('9223372036854775808' AS UHUGEINT) THEN -1.0 ELSE 1.0 END * w) AS s
  FROM feats JOIN vocab USING (f) GROUP BY id, idx),
norms AS (SELECT id, sum(s * s) AS nn FROM cells GROUP BY id),
emb AS (
  SELECT c.id, c.idx, CAST(c.s AS FLOAT) * CAST(1.0 / sqrt(n.nn) AS FLOAT) AS value
  FROM cells c JOIN norms n USING (id))
"""


@query("embedding_tokens", V("products") + """
SELECT id, t AS token, count(*) AS n FROM (
  SELECT id, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) AS t FROM products)
WHERE length(t) >= 2 AND NOT regexp_full_match(t, '[0-9]+') GROUP BY id, t""")
def q_embedding_tokens(spark, sf_dir):
    """H1 over product titles: (product, token, occurrences)."""
    p = fx.products(spark, sf_dir)
    return (p.select("id", F.explode(sm.embed_tokens(F.col("title"))).alias("token"))
             .groupBy("id", "token").agg(F.count(F.lit(1)).alias("n")))


@query("feature_hashes", V("products") + FEATS_SQL + """
SELECT f AS feature, printf('%016x', h) AS fnv, CAST(h % 256 AS INTEGER) AS idx,
       h >= CAST('9223372036854775808' AS UHUGEINT) AS negative FROM vocab""")
def q_feature_hashes(spark, sf_dir):
    """H2 hashing: every distinct feature string of the catalog with its FNV-1a digest, index and
    sign."""
    feats = sm.features(fx.products(spark, sf_dir))
    v = feats.select("f").distinct()
    h = sm.fnv1a64_limbs(F.col("f"))
    return v.select(F.col("f").alias("feature"), fnv1a64_hex(F.col("f")).alias("fnv"),
                    F.pmod(h["lo"], F.lit(sm.DIM)).cast("int").alias("idx"),
                    (h["hi"].bitwiseAND(0x80000000) != 0).alias("negative"))


@query("product_embeddings", V("products") + FEATS_SQL + """
SELECT id, idx, value FROM emb WHERE value <> 0""")
def q_product_embeddings(spark, sf_dir):
    """H2–H4: the non-zero cells of every product's normalized 256-float vector."""
    return sm.sparse_embeddings(fx.products(spark, sf_dir))


@query("similar_products", V("obs", "offers", "products") + FEATS_SQL + """,
vec AS (SELECT id, list(value ORDER BY idx) AS v, list(idx ORDER BY idx) AS ix FROM emb GROUP BY id),
t AS (SELECT v AS tv, ix AS tix FROM vec WHERE id = """ + str(TARGET_PRODUCT) + """),
dots AS (
  SELECT e.id, sum(CAST(e.value AS DOUBLE) * CAST(te.value AS DOUBLE)) AS dot
  FROM emb e JOIN emb te ON te.idx = e.idx AND te.id = """ + str(TARGET_PRODUCT) + """
  GROUP BY e.id),
nrm AS (SELECT id, sqrt(sum(CAST(value AS DOUBLE) * CAST(value AS DOUBLE))) AS nv FROM emb GROUP BY id),
dist AS (
  SELECT n.id, 1 - coalesce(d.dot, 0) / (n.nv * (SELECT nv FROM nrm WHERE id = """
    + str(TARGET_PRODUCT) + """)) AS distance
  FROM nrm n LEFT JOIN dots d USING (id) WHERE n.id <> """ + str(TARGET_PRODUCT) + """),
nn AS (SELECT * FROM dist ORDER BY distance, id LIMIT 12)
SELECT p.id, p.title, p.brand, p.category, round(nn.distance, 4) AS distance,
       min(o.price_cents) FILTER (WHERE o.in_stock) AS best_price_cents, count(*) AS offer_count
FROM nn JOIN products p ON p.id = nn.id JOIN offers o ON o.product_id = nn.id
GROUP BY p.id, p.title, p.brand, p.category, nn.distance""")
def q_similar_products(spark, sf_dir):
    """H6: the 12 nearest products to one product, with their live best offer."""
    p = fx.products(spark, sf_dir)
    return sm.similar_products(p, None, fx.offers(spark, sf_dir), TARGET_PRODUCT,
                               cells=sm.sparse_embeddings(p))


@query("similar_vectors", """WITH
t AS (SELECT embedding AS tv FROM embeddings WHERE vec_id = """ + str(TARGET_VECTOR) + """),
d AS (
  SELECT e.vec_id, e.label,
         1 - list_sum(list_transform(list_zip(e.embedding, t.tv),
                 lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))
           / (sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))
              * sqrt(list_sum(list_transform(t.tv, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))))
           AS distance
  FROM embeddings e CROSS JOIN t
  WHERE e.vec_id <> """ + str(TARGET_VECTOR) + """ AND e.embedding IS NOT NULL)
SELECT vec_id, label, round(distance, 4) AS distance FROM d ORDER BY distance, vec_id LIMIT 12""")
def q_similar_vectors(spark, sf_dir):
    """H5 + H6 + C11 on the embeddings table: 12 nearest vectors to vector 0 by cosine."""
    e = read_table(spark, sf_dir, "embeddings")
    nn = sm.nearest(e, "vec_id", "embedding", TARGET_VECTOR)
    return nn.select("vec_id", "label", F.round("distance", 4).alias("distance"))


def vector_index(spark, sf_dir):
    """H7: the inverted lists of the embeddings table, written once."""
    return stored(spark, sf_dir, "vector-index", lambda path: nb.write_index(
        read_table(spark, sf_dir, "embeddings"), path, "vec_id", "embedding"))


@query("ivf_lists")
def q_ivf_lists(spark, sf_dir):
    """H7 build: sizes of the stored lists over the embeddings table. The lists follow a fit, so there is no
    oracle; the tests hold them against the table."""
    return spark.read.parquet(f"{vector_index(spark, sf_dir)}/lists").select("list_id", "n")


def _near_target(spark, sf_dir, probes):
    e = read_table(spark, sf_dir, "embeddings").where(F.col("vec_id") == TARGET_VECTOR).select("embedding").limit(1).collect()
    near = nb.nearest(spark, vector_index(spark, sf_dir), e[0][0] if e else [0.0], probes, exclude=TARGET_VECTOR)
    labels = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return near.join(labels, "id").select(F.col("id").alias("vec_id"), "label", "distance")


@query("ivf_similar_vectors")
def q_ivf_similar_vectors(spark, sf_dir):
    """H7 probe: approximate 12 nearest to vector 0 from the three nearest stored lists."""
    return _near_target(spark, sf_dir, 3)


@query("ivf_nearest_vectors", """WITH
u AS (SELECT vec_id, label, embedding AS v,
      sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings WHERE embedding IS NOT NULL),
d AS (
  SELECT u.vec_id, u.label, round(1 - list_sum(list_transform(list_zip(u.v, t.v), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / (u.n * t.n), 6) + 0.0 AS distance
  FROM u JOIN u t ON t.vec_id = """ + str(TARGET_VECTOR) + """ AND u.vec_id <> t.vec_id WHERE u.n > 0)
SELECT vec_id, label, distance FROM d ORDER BY distance, vec_id LIMIT 12""")
def q_ivf_nearest_vectors(spark, sf_dir):
    """H7 exact: the 12 nearest to vector 0 from the stored lists that their radius cannot rule out."""
    return _near_target(spark, sf_dir, None)


@query("similar_items", V("products") + FEATS_SQL + """,
nrm AS (SELECT id, sqrt(sum(CAST(value AS DOUBLE) * CAST(value AS DOUBLE))) AS n FROM emb GROUP BY id HAVING n > 0),
dots AS (SELECT a.id, b.id AS other, sum(CAST(a.value AS DOUBLE) * CAST(b.value AS DOUBLE)) AS dot
         FROM emb a JOIN emb b ON a.idx = b.idx AND a.id <> b.id GROUP BY a.id, b.id),
dist AS (SELECT x.id, y.id AS neighbour, round(1 - coalesce(d.dot, 0) / (x.n * y.n), 6) + 0.0 AS distance
         FROM nrm x JOIN nrm y ON x.id <> y.id LEFT JOIN dots d ON d.id = x.id AND d.other = y.id)
SELECT id, CAST(rank AS INTEGER) AS rank, neighbour, distance
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM dist) WHERE rank <= 12""")
def q_similar_items(spark, sf_dir):
    """H8: the similar-items table, the 12 nearest products of every product."""
    return nb.similar_items(sm.embeddings(fx.products(spark, sf_dir)))
