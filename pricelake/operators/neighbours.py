"""Inverted lists over unit vectors as a stored table (H7), and the k nearest items of every item (H8).

*Lists.* Centroids are fitted on a bounded sample (``SAMPLE`` vectors by hash of id); every vector goes
to its nearest centroid. The table is partitioned by list and sorted by id; a small second table
holds centroid, size and radius (the largest distance of a member) of each list. Distances of unit
vectors are Euclidean here, so a list cannot hold a vector within r of a target if the
target's distance to its centroid exceeds r plus its radius.

*One target.* ``nearest`` reads the lists with the nearest centroids (``probes`` of them), or, without a number of
probes, the nearest lists that hold k vectors and then each list that its radius cannot rule out: the
exact result. Lists are named to the scan as partition values, so the others are not opened.

*Every item.* ``similar_items``: equal vectors are one class, with their smallest ids (copies would be all at
distance zero). Lists are dealt into blocks of about ``BLOCK`` classes. A first round finds k
neighbours in a class's own block, and so a distance that its k-th neighbour cannot exceed. In the
second each class is sent to the lists that can hold something nearer; in a list, chunks of about
``BLOCK`` such queries meet its blocks, one task group per pair, which returns the best k of the
block for each query. A ranking window (pre-reduced per task) merges them. No group exceeds about
twice ``BLOCK`` rows, however many items share a list or a vector.

Defined results: distances are 1 - cosine in double precision, rounded to ``DIGITS`` digits before they are
compared; equal ones are ordered by id; null, zero and non-finite vectors have no neighbours
and are none; fewer than k other vectors give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelake.session import freeze

NEIGHBOURS = 12
#: Vectors that centroids are fitted on, lists at most, rounds of fitting, classes of a block.
SAMPLE, MAX_LISTS, ROUNDS, BLOCK = 1 << 14, 1024, 8, 2048
DIGITS = 6
#: Added to bounds, for rounding of distances.
SLACK = 2 * 10.0 ** -DIGITS


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows of doubles."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _column(rows: np.ndarray) -> pa.Array:
    n, dim = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(rows.reshape(-1)))


def unit_vectors(vectors: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(id, v): usable vectors scaled to length one. Vectors of another size than the first ones are an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(1))
                length = np.sqrt((m * m).sum(1))
                ok = np.isfinite(length) & (length > 0)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), _column(m[ok] / length[ok, None] + 0.0)], ["id", "v"])

    some = vectors.where(F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull())).select(
        F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return some.mapInArrow(run, some.schema)


def centroids(units: DataFrame, lists: int | None = None) -> np.ndarray:
    """Unit centroids fitted on the sample; about one per root of the vectors, ``MAX_LISTS`` at most."""
    n = units.count()
    lists = min(lists or max(1, int(n ** 0.5)), MAX_LISTS)
    sample = _matrix(units.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks())
    if not len(sample):
        return np.zeros((0, 0))
    found = np.unique(sample, axis=0)
    centre = found[np.random.default_rng(7).permutation(len(found))[:lists]]
    for _ in range(ROUNDS):
        own = np.argmax(sample @ centre.T, 1)
        total = np.zeros_like(centre)
        np.add.at(total, own, sample)
        length = np.sqrt((total * total).sum(1))
        centre = np.where(length[:, None] > 0, total / np.maximum(length, 1e-300)[:, None], centre)
    return centre


def assigned(units: DataFrame, centre: np.ndarray) -> DataFrame:
    """(id, v, list_id, away): every vector with its list and its distance to the centroid."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column("v"))
                dots = m @ centre.T
                own = np.argmax(dots, 1)
                away = np.sqrt(((m - centre[own]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(own.astype(np.int32)), pa.array(away)], ["id", "v", "list_id", "away"])

    return units.mapInArrow(run, f"id {units.schema['id'].dataType.simpleString()}, v array<double>, list_id int, away double")


def _radii(rows: DataFrame) -> dict[int, tuple[float, int]]:
    """Radius and size by list (at most ``MAX_LISTS`` rows)."""
    return {r["list_id"]: (r["radius"], r["n"]) for r in rows.groupBy("list_id").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect()}


def write_index(vectors: DataFrame, path: str, id_col: str = "id", vec_col: str = "embedding", lists: int | None = None) -> None:
    """H7: the inverted lists under ``path``/vectors, partitioned by list, and ``path``/lists."""
    spark = vectors.sparkSession
    units = freeze(unit_vectors(vectors, id_col, vec_col), "unit-vectors")
    centre = centroids(units, lists)
    rows = freeze(assigned(units, centre), "assigned") if len(centre) else units.withColumns({"list_id": F.lit(0), "away": F.lit(0.0)})
    radii = _radii(rows)
    rows.repartition("list_id", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("list_id", "id").write.partitionBy("list_id").parquet(f"{path}/vectors")
    spark.createDataFrame([(k, centre[k].tolist(), r, n) for k, (r, n) in sorted(radii.items())],
                          "list_id int, centroid array<double>, radius double, n long").coalesce(1).write.parquet(f"{path}/lists")


def members(spark: SparkSession, path: str, lists: list[int]) -> DataFrame:
    """The vectors of some lists; the scan opens only their partitions."""
    return spark.read.parquet(f"{path}/vectors").where(F.col("list_id").isin([int(x) for x in lists]))


def nearest(spark: SparkSession, path: str, target: list[float], probes: int | None = None, k: int = NEIGHBOURS, exclude=None) -> DataFrame:
    """(id, distance): the k nearest stored vectors to a target; exact unless ``probes`` is given."""
    t = np.array(target, np.float64)
    length = float(np.sqrt(t @ t))
    lists = spark.read.parquet(f"{path}/lists").orderBy("list_id").collect()     # at most MAX_LISTS rows
    if not lists or not (np.isfinite(length) and length > 0):
        return spark.createDataFrame([], "id long, distance double")
    t = t / length
    away = np.sqrt(((np.array([r["centroid"] for r in lists]) - t) ** 2).sum(1))
    order = np.argsort(away, kind="stable")
    ids = np.array([r["list_id"] for r in lists])

    def best(chosen) -> DataFrame:
        rows = members(spark, path, list(chosen)).where(F.lit(True) if exclude is None else F.col("id") != F.lit(exclude))
        dot = F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in t]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return rows.select("id", F.round(1 - dot, DIGITS).alias("distance")).orderBy("distance", "id").limit(k)

    if probes is not None:
        return best(ids[order[:probes]])
    need = np.cumsum([lists[i]["n"] for i in order])
    first = order[:int(np.searchsorted(need, k + (exclude is not None))) + 1]
    found = best(ids[first]).collect()                  # at most k rows
    reach = np.sqrt(2 * (found[-1]["distance"] + SLACK)) if len(found) == k else np.inf
    rest = [i for i in order if away[i] - lists[i]["radius"] <= reach]
    return best(ids[sorted({*rest, *first})])


def _classes(units: DataFrame, k: int) -> DataFrame:
    """(cid, v, ids): distinct vectors with their smallest id and their k + 1 smallest ids."""
    key = F.xxhash64("v")
    order = Window.partitionBy("h", "v").orderBy("id")
    few = units.withColumn("h", key).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    return few.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("cid"), "v", "ids")


def _best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int):
    """(query, id, distance) of the k nearest rows of each query, itself included, by distance and id."""
    d = np.round(1 - queries @ rows.T, DIGITS) + 0.0
    k = min(k, len(row_ids))
    if k < len(row_ids):                                # all that tie with the k-th stay until ids decide
        limit = np.partition(d, k - 1, 1)[:, k - 1]
        q, r = np.nonzero(d <= limit[:, None])
    else:
        q, r = (x.reshape(-1) for x in np.indices(d.shape))
    order = np.lexsort((row_ids[r], d[q, r], q))
    q, r = q[order], r[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    q, r = q[place < k], r[place < k]
    return query_ids[q], row_ids[r], d[q, r]


def similar_items(vectors: DataFrame, id_col: str = "id", vec_col: str = "embedding", k: int = NEIGHBOURS, lists: int | None = None) -> DataFrame:
    """H8: (id, rank, neighbour, distance), the k nearest other items of every item."""
    units = freeze(unit_vectors(vectors, id_col, vec_col).withColumn("id", F.col("id").cast("long")), "unit-vectors")
    classes = freeze(_classes(units, k), "vector-classes")
    centre = centroids(classes.select(F.col("cid").alias("id"), "v"), lists)
    out = "id long, rank int, neighbour long, distance double"
    if not len(centre):
        return vectors.sparkSession.createDataFrame([], out)
    own = freeze(assigned(classes.select(F.col("cid").alias("id"), "v"), centre), "class-lists")
    radii = _radii(own)
    blocks = F.element_at(F.create_map(*[F.lit(x) for q, (_, n) in radii.items() for x in (q, -(-n // BLOCK))]), F.col("list_id"))
    own = own.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))

    def inside(block: pa.Table) -> pa.Table:
        ids, m = block.column("id").to_numpy(), _matrix(block.column("v").combine_chunks())
        q, _, d = _best(m, ids, m, ids, k + 1)
        far = np.full(len(ids), np.inf)
        at = np.argsort(ids)
        full = np.bincount(np.searchsorted(ids[at], q), minlength=len(ids)) == k + 1
        last = np.zeros(len(ids))
        np.maximum.at(last, np.searchsorted(ids[at], q), d)
        far[at[full]] = last[full]
        return pa.table({"id": ids, "v": block.column("v"), "far": far})

    reached = own.groupBy("list_id", "block").applyInArrow(inside, "id long, v array<double>, far double")
    numbers = np.array(sorted(radii))
    radius = np.array([radii[i][0] for i in numbers])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column("v"))
                away = np.sqrt(np.maximum(2 - 2 * m @ centre[numbers].T, 0))
                row, to = np.nonzero(away - radius <= np.sqrt(2 * (b.column("far").to_numpy() + SLACK))[:, None] + 1e-7)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), b.column("v").take(pa.array(row)), pa.array(numbers[to].astype(np.int32))], ["id", "v", "list_id"])

    sent = freeze(reached.mapInArrow(spread, "id long, v array<double>, list_id int"), "queries")
    counts = {r["list_id"]: r["n"] for r in sent.groupBy("list_id").agg(F.count("*").alias("n")).collect()}     # at most MAX_LISTS rows
    chunks = F.element_at(F.create_map(*[F.lit(x) for q, n in counts.items() for x in (q, -(-n // BLOCK))]), F.col("list_id"))
    queries = (sent.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), chunks).cast("int"))
               .withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))))
    rows = own.select("id", "v", "list_id", "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("id", pa.int64()), ("cid", pa.int64()), ("distance", pa.float64()))})
        q, r, d = _best(_matrix(left.column("v").combine_chunks()), left.column("id").to_numpy(), _matrix(right.column("v").combine_chunks()), right.column("id").to_numpy(), k + 1)
        return pa.table({"id": q, "cid": r, "distance": d})

    key = ["list_id", "block", "chunk"]
    pairs = queries.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(meet, "id long, cid long, distance double")
    order = Window.partitionBy("id").orderBy("distance", "cid")
    near = pairs.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    listed = (near.join(classes.select("cid", "ids"), "cid").groupBy("id")
              .agg(F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("distance").alias("distance"), i.alias("id")))))).alias("near"))
              .select("id", F.slice("near", 1, k + 1).alias("near")))
    # every item takes the list of its class, without itself; the class is found by the vector
    cls = classes.select("v", F.col("cid"))
    items = units.join(cls, "v").select(F.col("id").alias("item"), F.col("cid").alias("id"))
    flat = items.join(listed, "id").select("item", F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("item")), 1, k)).alias("p", "n"))
    return flat.select(F.col("item").alias("id"), (F.col("p") + 1).cast("int").alias("rank"), F.col("n.id").alias("neighbour"), F.col("n.distance").alias("distance"))
