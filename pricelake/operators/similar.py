"""Product embeddings (signed feature hashing) and nearest-neighbour queries.

H1 tokenizer: lower case, split on anything but [a-z0-9], drop tokens shorter than two and bare
numbers. H2 features and weights: ``cat:<category>`` 3, ``brand:<brand>`` 2, ``t:<token>`` 1 for
title tokens other than the brand (H3), ``a:<key>=<value>`` 0.5 per attribute; each feature adds
±weight at index FNV-1a-64 mod 256, the sign being the hash's top bit. H4: L2 normalization
(norm in double, the scale factor and the products in float32).

Plan shape: features are exploded per product, the *distinct* feature strings are hashed once
(the vocabulary is far smaller than the catalog) and joined back, then one aggregate per product
builds the dense vector. Nearest neighbours for one item broadcast the single target vector and
keep a distributed top-k (TakeOrderedAndProject), never a cross join of the catalog with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.functions.fnv import fnv1a64_limbs
from pricelake.functions.joins import broadcast_bounded, broadcast_if_small
from pricelake.session import freeze

# Fixed values of the reference's embedding.
DIM = 256
W_CATEGORY, W_BRAND, W_TITLE, W_ATTR = 3.0, 2.0, 1.0, 0.5
NEIGHBOURS = 12
VOCAB_BROADCAST_ROWS = 2_000_000


def embed_tokens(s: Column) -> Column:
    """H1: the embedding tokenizer."""
    toks = F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9]+"), 0)
    return F.filter(toks, lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$"))


def features(products: DataFrame) -> DataFrame:
    """H2 + H3: (id, feature, weight) rows, one per feature occurrence."""
    lb = F.lower(F.col("brand"))
    fs = F.concat(
        F.array(F.struct(F.concat(F.lit("cat:"), F.lower("category")).alias("f"),
                         F.lit(W_CATEGORY).alias("w")),
                F.struct(F.concat(F.lit("brand:"), lb).alias("f"), F.lit(W_BRAND).alias("w"))),
        F.transform(F.filter(embed_tokens(F.col("title")), lambda t: t != lb),
                    lambda t: F.struct(F.concat(F.lit("t:"), t).alias("f"),
                                       F.lit(W_TITLE).alias("w"))),
        F.transform(F.coalesce(F.map_entries("attrs"),
                               F.array().cast("array<struct<key:string,value:string>>")),
                    lambda e: F.struct(F.concat(F.lit("a:"), F.lower(e.key), F.lit("="),
                                                F.lower(e.value)).alias("f"),
                                       F.lit(W_ATTR).alias("w"))))
    return products.select("id", F.explode(fs).alias("x")).select("id", "x.f", "x.w")


def hashed_vocab(feats: DataFrame) -> DataFrame:
    """Distinct features with their (index, sign)."""
    h = fnv1a64_limbs(F.col("f"))
    return (feats.select("f").distinct()
                 .select("f", F.pmod(h["lo"], F.lit(DIM)).cast("int").alias("idx"),
                         F.when(h["hi"].bitwiseAND(0x80000000) != 0, F.lit(-1.0))
                          .otherwise(F.lit(1.0)).alias("sign")))


def sparse_embeddings(products: DataFrame) -> DataFrame:
    """(id, idx, value) of the normalized vectors, non-zero entries only.

    Products are dealt by id first: a catalog of millions is a file of a few megabytes, which one task would
    read, and the features of a product cost far more than its row. The cells, their norms and the join of
    both need no other exchange. The number is given, as AQE would join partitions that are small in bytes."""
    n = int(products.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    feats = features(products.repartition(n, "id"))
    vocab = broadcast_if_small(freeze(hashed_vocab(feats), "vocabulary"), VOCAB_BROADCAST_ROWS)
    cells = (feats.join(vocab, "f").groupBy("id", "idx")
                  .agg(F.sum(F.col("sign") * F.col("w")).alias("s")))
    norms = cells.groupBy("id").agg(F.sum(F.col("s") * F.col("s")).alias("nn"))
    inv = F.when(F.col("nn") > 0, (1.0 / F.sqrt("nn")).cast("float")).otherwise(F.lit(1.0).cast("float"))
    return (cells.join(norms, "id")
                 .select("id", "idx", (F.col("s").cast("float") * inv).alias("value"))
                 .filter(F.col("value") != 0))


def embeddings(products: DataFrame) -> DataFrame:
    """H2–H4: (id, embedding ARRAY<FLOAT>(256))."""
    sp = sparse_embeddings(products)
    m = sp.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "value"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)),
                        lambda i: F.coalesce(F.col("m")[i], F.lit(0.0).cast("float")))
    return m.select("id", dense.alias("embedding"))


def backfill(products: DataFrame) -> DataFrame:
    """H9: compute embeddings only where they are NULL and merge them back by id (idempotent)."""
    todo = products.filter(F.col("embedding").isNull()).drop("embedding")
    new = embeddings(todo).withColumnRenamed("embedding", "new_embedding")
    return (products.join(new, "id", "left")
                    .withColumn("embedding", F.coalesce("embedding", "new_embedding"))
                    .drop("new_embedding"))


def cosine_distance(a: Column, b: Column) -> Column:
    """H5: 1 − a·b / (‖a‖‖b‖), accumulated in double; NULL if one of them is the zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                      F.lit(0.0), lambda s, v: s + v)
    na = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    nb = F.aggregate(b, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return 1 - F.try_divide(dot, F.sqrt(na) * F.sqrt(nb))


def nearest(vectors: DataFrame, id_col: str, vec_col: str, target_id, k: int = NEIGHBOURS) -> DataFrame:
    """H6 core + C11 + F8: the k nearest vectors to one target (itself excluded, NULL vectors
    skipped), by unrounded distance then id."""
    target = broadcast_bounded(vectors.filter(F.col(id_col) == target_id)
                               .select(F.col(vec_col).alias("_t")).limit(1))
    cand = vectors.filter((F.col(id_col) != target_id) & F.col(vec_col).isNotNull())
    d = cand.crossJoin(target).withColumn("distance", cosine_distance(F.col(vec_col), F.col("_t")))
    return d.drop("_t").orderBy(F.col("distance").asc_nulls_last(), F.col(id_col)).limit(k)


def nearest_sparse(cells: DataFrame, target_id, k: int = NEIGHBOURS) -> DataFrame:
    """H5 + H6 core on sparse vectors (id, idx, value): dot products by an equi-join on idx with
    the target's cells (at most DIM rows, broadcast) and one hash aggregate per id — fully
    code-generated, no per-element higher-order functions. Ids sharing no index with the target
    have dot 0 (distance 1)."""
    t = broadcast_bounded(cells.filter(F.col("id") == target_id)
                          .select("idx", F.col("value").cast("double").alias("tv")))
    tnorm = t.agg(F.sqrt(F.sum(F.col("tv") * F.col("tv"))).alias("tn"))
    v = F.col("value").cast("double")
    # one pass: cells without a partner at the target count in the norm only
    sums = (cells.filter(F.col("id") != target_id).join(t, "idx", "left").groupBy("id")
                 .agg(F.sum(v * F.col("tv")).alias("dot"), F.sqrt(F.sum(v * v)).alias("nv")))
    d = (sums.crossJoin(broadcast_bounded(tnorm))                 # one-row scalar
              .select("id", (1 - F.try_divide(F.coalesce("dot", F.lit(0.0)), F.col("nv") * F.col("tn")))
                      .alias("distance")))
    return d.orderBy(F.col("distance").asc_nulls_last(), "id").limit(k)


def similar_products(products: DataFrame, emb: DataFrame | None, offers: DataFrame,
                     target_id, k: int = NEIGHBOURS, cells: DataFrame | None = None) -> DataFrame:
    """H6: nearest products with their live best offer; products without offers drop.
    Uses the sparse cells when given (``sparse_embeddings``), else the dense vectors."""
    if cells is not None:
        nn = nearest_sparse(cells, target_id, k)
    else:
        nn = nearest(emb, "id", "embedding", target_id, k).select("id", "distance")
    p = products.select("id", "title", "brand", "category")
    nn = freeze(nn.join(p, "id"), "nearest")
    ids = [r["id"] for r in nn.select("id").distinct().collect()]        # at most k: the offers are filtered before they are grouped
    o = offers.select(F.col("product_id").alias("id"), "price_cents", "in_stock").where(F.col("id").isin(ids))
    nn = broadcast_bounded(nn)
    return (o.join(nn, "id").groupBy("id", "title", "brand", "category", "distance")
             .agg(F.min(F.when(F.col("in_stock"), F.col("price_cents"))).alias("best_price_cents"),
                  F.count(F.lit(1)).alias("offer_count"))
             .orderBy(F.col("distance").asc_nulls_last(), "id")          # at most k rows
             .select("id", "title", "brand", "category",
                     F.round("distance", 4).alias("distance"), "best_price_cents", "offer_count"))


def ivf_index(vectors: DataFrame, vec_col: str, lists: int, seed: int = 1):
    """H7: k-means (cosine) over the vectors; returns (model, vectors with ``list_id``)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = vectors.filter(F.col(vec_col).isNotNull()).withColumn("_features", array_to_vector(vec_col))
    km = KMeans(k=lists, seed=seed, distanceMeasure="cosine", featuresCol="_features",
                predictionCol="list_id", maxIter=20)
    model = km.fit(v)
    return model, model.transform(v).drop("_features")


def ivf_nearest(model, assigned: DataFrame, id_col: str, vec_col: str, target_id,
                nprobe: int, k: int = NEIGHBOURS) -> DataFrame:
    """H7 probe: exact distances inside the ``nprobe`` lists whose centroids are nearest to the
    target; approximate overall (checked by recall against ``nearest``)."""
    spark = assigned.sparkSession
    cents = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in
                                   enumerate(model.clusterCenters())], "list_id int, c array<double>")
    target = broadcast_bounded(assigned.filter(F.col(id_col) == target_id)
                               .select(F.col(vec_col).alias("_t")).limit(1))
    probe = (cents.crossJoin(target)
                  .withColumn("cd", cosine_distance(F.col("c"), F.col("_t")))
                  .orderBy("cd", "list_id").limit(nprobe).select("list_id"))
    cand = assigned.join(broadcast_bounded(probe), "list_id", "left_semi")
    return nearest(cand.unionByName(assigned.filter(F.col(id_col) == target_id)),
                   id_col, vec_col, target_id, k)
