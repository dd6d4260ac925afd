"""Embedding near-dedup by product quantisation: inverted lists, table look-ups, exact rerank.

*Index.* Coarse centroids (k-means on a bounded sample of unit vectors) split the vectors into lists.
What is left of a vector after its centroid is cut into ``PARTS`` subspaces; each is coded by the
nearest of ``CODES`` centroids of its subspace. Every vector is indexed, in its nearest list.

*Search.* Let t be the distance of unit vectors at the threshold. A vector within t of a query q lies in
the cell of a centroid c only if q is at most t beyond the plane that halves the way from q's own centroid
to c, so exactly these lists are probed, as many as the data ask for. In a list, a table per query and
subspace holds the squared distances from the residual of the query to the subspace centroids; the
distance to an indexed vector's code is a sum of look-ups. Every vector carries its own coding error
e; a vector within t of the query has a code within t + e, so the look-ups drop no link. What they leave is
reranked by the exact cosine in double precision; pairs of at least the threshold are links, none
below it.

*Plan.* Equal vectors are one class first (an aggregate, so a group of copies is one row). Neighbouring
lists are packed into blocks of about ``BLOCK`` vectors, a list of more is dealt into several by hash. A
vector is sent once to each block that holds a list it probes, in one of the two directions (a ring
of blocks, half of it ahead), so a pair is met once and counts for both ends. Queries of a block come
in chunks of about ``BLOCK``, one group per block and chunk, so no task holds more. A group returns the number
of links per vector and a spanning forest of the links, not the pairs, so a dense group does not become
a square of rows. The number of lists grows with the square root of the classes, up to the bound of the sample.

Defined results: a vector that is null, empty, zero, or holds a null or non-finite component links
with nothing (0 links, its own component); vectors of another length than most are compared with none
of other length (a link needs equal length; each length is searched apart); copies link with each
other; rows that share a vec_id are rows of their own, and share the component; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelake.llm.common import col
from pricelake.llm.components import components
from pricelake.session import freeze

THRESHOLD = 0.95
#: Bound of the sample that centroids are fitted on.
SAMPLE = 16_384
MAX_LISTS = 1024
PARTS = 8
CODES = 64
#: Added to bounds, for rounding (look-ups are in single precision).
SLACK = 1e-4
BLOCK = 4096


def _nearest(x: np.ndarray, centers: np.ndarray, k: int = 1) -> np.ndarray:
    d = (centers * centers).sum(1) - 2 * (x @ centers.T)
    return np.argmin(d, 1) if k == 1 else np.argsort(d, 1, kind="stable")[:, :k]


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, centers)
        n = np.bincount(own, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, own, x)
        centers[n > 0] = total[n > 0] / n[n > 0, None]
    return centers


def _cuts(dims: int) -> list[slice]:
    edges = np.linspace(0, dims, min(PARTS, dims) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def fit(sample: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Coarse centroids and the code books of the subspaces, from a sample of n unit vectors."""
    lists = int(min(MAX_LISTS, max(1, len(sample) // 16), max(1, round(2 * n ** 0.5))))
    coarse = kmeans(sample, lists)
    rest = sample - coarse[_nearest(sample, coarse)]
    return coarse, [kmeans(rest[:, c], min(CODES, len(rest))) for c in _cuts(sample.shape[1])]


def encode(x: np.ndarray, own: np.ndarray, model) -> np.ndarray:
    coarse, books = model
    rest = x - coarse[own]
    return np.stack([_nearest(rest[:, c], b) for c, b in zip(_cuts(x.shape[1]), books, strict=True)], 1).astype(np.uint8)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _raw(column: pa.Array) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column.to_numpy(zero_copy_only=False)])


def probed(x: np.ndarray, own: np.ndarray, coarse: np.ndarray, reach: float) -> np.ndarray:
    """Which lists can hold a vector within ``reach`` of each row, whose nearest centroids are ``own``."""
    size = (coarse * coarse).sum(1)
    d = size - 2 * (x @ coarse.T)
    apart = np.sqrt(np.maximum(size[:, None] + size - 2 * coarse @ coarse.T, 0))
    return d - d[np.arange(len(x)), own][:, None] <= 2 * (reach + SLACK) * apart[own]


def packed(coarse: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each list: lists are halved along their principal axis until
    a part fits a block."""
    first, n, at = np.zeros(len(coarse), np.int64), np.ones(len(coarse), np.int64), 0
    todo = [np.arange(len(coarse))]
    while todo:
        part = todo.pop()
        if len(part) == 1 or sizes[part].sum() <= BLOCK:
            first[part] = at
            n[part] = -(-max(int(sizes[part].sum()), 1) // BLOCK)
            at += int(n[part].max())
            continue
        c = coarse[part] - coarse[part].mean(0)
        order = part[np.argsort(c @ np.linalg.svd(c, full_matrices=False)[2][0], kind="stable")]
        half = min(max(1, int(np.searchsorted(np.cumsum(sizes[order]), sizes[order].sum() / 2))), len(order) - 1)
        todo += [order[half:], order[:half]]
    return first, n


def _listed(model):
    """(node, n, vector, list, code, error) of a batch of (node, n, embedding)."""
    def run(batches):
        coarse, books, kind = model.value
        for b in batches:
            if b.num_rows:
                raw = _raw(b.column("embedding"))
                x = _units(raw)
                own = _nearest(x, coarse)
                code = encode(x, own, (coarse, books))
                rest = x - coarse[own]
                error = np.sqrt(sum(((rest[:, c] - book[code[:, k]]) ** 2).sum(1) for k, (c, book) in enumerate(zip(_cuts(x.shape[1]), books, strict=True))))
                yield pa.RecordBatch.from_arrays(
                    [b.column("node"), b.column("n"), pa.array([v.tobytes() for v in raw.astype(kind)], pa.binary()), pa.array(own.astype(np.int32)),
                     pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], ["node", "n", "vector", "list", "code", "error"])
    return run


def _vectors(column, kind: str) -> np.ndarray:
    return _units(np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64))


def _entries(model, first: np.ndarray, n_blocks: np.ndarray, reach: float):
    """Index and probe rows of a batch of listed vectors."""
    total = int((first + n_blocks).max())

    def run(batches):
        coarse, _, kind = model.value
        for b in batches:
            if not b.num_rows:
                continue
            x, own = _vectors(b.column("vector").to_pylist(), kind), b.column("list").to_numpy()
            node = b.column("node").to_numpy()
            home = first[own] + (node * 0x9E3779B1 >> 16) % n_blocks[own]
            row, to = np.nonzero(probed(x, own, coarse, reach))
            many = n_blocks[to]
            block = np.repeat(first[to] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            row = np.repeat(row, many)
            row, block = np.unique(np.stack([row, block]), axis=1)
            ahead = (block - home[row]) % total
            met = (ahead < total - ahead) | (ahead == 0) | ((2 * ahead == total) & (home[row] < block))
            row, block = row[met], block[met]
            index = b.append_column("block", pa.array(home.astype(np.int32))).append_column("probe", pa.array(np.zeros(len(x), bool)))
            ask = b.take(pa.array(row)).append_column("block", pa.array(block.astype(np.int32))).append_column("probe", pa.array(np.ones(len(row), bool)))
            yield index.select(_NAMES)
            nothing = pa.nulls(len(row), pa.binary())
            yield ask.set_column(ask.schema.get_field_index("code"), "code", nothing).select(_NAMES)
    return run


_LISTED = "node bigint, n bigint, vector binary, list int, code binary, error double"
_ENTRY = "block int, probe boolean, " + _LISTED
_NAMES = [c.split()[0] for c in _ENTRY.split(", ")]
_FOUND = "a bigint, b bigint, links bigint"


def _search(model, threshold: float, reach: float):
    """One chunk of queries in a block: per vector the links found (a, null, links), and forest links (a, b, null)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["probe"].to_numpy(bool)
        index, ask = pdf[~asks].sort_values("list", kind="stable"), pdf[asks]
        if not len(index) or not len(ask):
            return pd.DataFrame({"a": [], "b": [], "links": []}).astype("Int64")
        coarse, books, kind = model.value
        x, q = _vectors(index["vector"], kind), _vectors(ask["vector"], kind)
        codes = np.frombuffer(b"".join(index["code"]), np.uint8).reshape(len(index), -1)
        xn, qn, xw, qw = index["node"].to_numpy(), ask["node"].to_numpy(), index["n"].to_numpy(), ask["n"].to_numpy()
        lists, begin = np.unique(index["list"].to_numpy(), return_index=True)
        error, home = index["error"].to_numpy(), set(xn.tolist())
        mine = np.array([v in home for v in qn.tolist()])           # queries of this very block: each pair once
        may = probed(q, ask["list"].to_numpy(), coarse, reach)[:, lists]
        q_links, x_links = np.zeros(len(q), np.int64), np.zeros(len(x), np.int64)
        a, b, root, heads = [], [], np.arange(len(x)), {}

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        cuts = _cuts(x.shape[1])
        for k, (list_, i0) in enumerate(zip(lists, begin, strict=True)):
            i1 = begin[k + 1] if k + 1 < len(begin) else len(x)
            limit = ((reach + SLACK + error[i0:i1]) ** 2 + SLACK).astype(np.float32)
            asking = np.flatnonzero(may[:, k])
            for s in range(0, len(asking), 256):
                own = asking[s:s + 256]
                rest = q[own] - coarse[list_]
                far = np.zeros((len(own), i1 - i0), np.float32)
                for m, (c, book) in enumerate(zip(cuts, books, strict=True)):
                    part = rest[:, c]
                    table = ((part * part).sum(1)[:, None] + (book * book).sum(1) - 2 * part @ book.T).astype(np.float32)
                    far += table[:, codes[i0:i1, m]]
                i, j = np.nonzero(far <= limit)
                for t in range(0, len(i), 1 << 18):          # exact rerank, a bounded number at a time
                    ii, jj = own[i[t:t + (1 << 18)]], j[t:t + (1 << 18)] + i0
                    ok = (np.einsum("ij,ij->i", q[ii], x[jj]) >= threshold) & np.where(mine[ii], qn[ii] < xn[jj], qn[ii] != xn[jj])
                    ii, jj = ii[ok], jj[ok]
                    np.add.at(q_links, ii, xw[jj])
                    np.add.at(x_links, jj, qw[ii])
                    # links of one query join its index rows; only joins of different trees are returned
                    for g, h in zip(ii.tolist(), jj.tolist(), strict=True):
                        head = heads.setdefault(g, h)
                        if head == h:
                            a.append(qn[g])
                            b.append(xn[h])
                        else:
                            u, v = find(head), find(h)
                            if u != v:
                                root[u] = v
                                a.append(qn[g])
                                b.append(xn[h])
        got, met = np.flatnonzero(q_links), np.flatnonzero(x_links)
        return pd.DataFrame({"a": pd.array([*qn[got], *xn[met], *a], "Int64"), "b": pd.array([*[None] * (len(got) + len(met)), *b], "Int64"),
                             "links": pd.array([*q_links[got], *x_links[met], *[None] * len(a)], "Int64")})
    return run


def near_links(classes: DataFrame, threshold: float = THRESHOLD, kind: str = "<f8") -> DataFrame:
    """(a, b, links) of classes (node, n, embedding) of one length, see ``_search``. ``kind`` is the type that
    the components are sent as (it must hold them exactly)."""
    spark = classes.sparkSession
    n = classes.count()
    rows = classes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("embedding").toArrow()
    coarse, books = fit(_units(_raw(rows["embedding"].combine_chunks())), n)
    model, reach = spark.sparkContext.broadcast((coarse, books, kind)), float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    listed = freeze(classes.mapInArrow(_listed(model), _LISTED), "listed")
    sizes = np.zeros(len(coarse), np.int64)
    for list_, size in listed.groupBy("list").count().collect():          # at most MAX_LISTS rows
        sizes[list_] = size
    entries = freeze(listed.mapInArrow(_entries(model, *packed(coarse, sizes), reach), _ENTRY), "entries")
    chunks = entries.groupBy("block").agg(F.ceil(F.count_if("probe") / BLOCK).alias("chunks")).where("chunks > 0")
    by = F.when(F.col("probe"), F.array(F.pmod(F.xxhash64("node"), F.col("chunks")))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))
    return entries.join(chunks, "block").withColumn("by", F.explode(by)).groupBy("block", "by").applyInPandas(_search(model, threshold, reach), _FOUND)


def dedup(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    e = col(embedding).cast("array<double>")
    kind = "<f4" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "<f8"
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = F.coalesce((F.size(e) > 0) & finite & F.exists(e, lambda v: v != 0), F.lit(False))
    # -0.0 and 0.0 are one value
    rows = freeze(vectors.select(col(vec_id).cast("bigint").alias("vec_id"),
                                 F.when(valid, F.transform(e, lambda v: v + 0.0)).alias("embedding"))
                  .withColumn("key", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding"))), "vectors")
    classes = freeze(rows.where(F.col("key").isNotNull()).groupBy("key", "embedding").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()), "classes")
    found = None
    for (length,) in classes.select(F.size("embedding")).distinct().collect():
        part = near_links(classes.where(F.size("embedding") == length).select("node", "n", "embedding"), threshold, kind)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = freeze(found, "found")
    links = found.where(F.col("links").isNotNull()).groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    comp = components(found.where(F.col("links").isNull()).select("a", "b"))
    by_node = (classes.select("key", "embedding", "node", "least", "n").join(comp, "node", "left").join(links, "node", "left")
               .withColumn("component", F.coalesce("component", "node")))
    least = by_node.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = by_node.join(least, "component").select(
        "key", "embedding", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    # the few classes of a hash are told apart by the vector itself
    return (rows.alias("r").join(by_node.alias("c"), (F.col("r.key") == F.col("c.key")) & (F.col("r.embedding") == F.col("c.embedding")), "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
