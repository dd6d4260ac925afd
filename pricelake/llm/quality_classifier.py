"""Quality classifier: random-indexing word vectors, pooled, then a two-layer network.

*Word vectors.* Every token (a run of letters, digits or non-ASCII bytes, or a run of ASCII
punctuation) is hashed to one of ``BUCKETS`` rows. Each row has a fixed sparse ternary index vector
of ``DIMS`` dimensions; the context vector of a row is the sum of the index vectors of the tokens
at most ``WINDOW`` places away, over every document of the corpus. The counts are integers, so
their sum does not depend on the order of tasks. A partition reduces to at most ``BUCKETS`` rows
before the shuffle; the summed table has a fixed size and is broadcast.

*Pooling.* A document is the mean and the standard deviation of its tokens' unit vectors, the mean
dot product of neighbouring tokens, and the logarithm of its length.

*Network.* One hidden tanh layer and one output, fitted with numpy on the driver on at most
``TRAIN_ROWS`` labelled documents (chosen by a hash of the id, documented bound). A fifth of them is
kept apart to fit the temperature that divides the output before the sigmoid.

Defined results: null and empty texts get the score of a document without tokens; repeated rows are
scored one by one; labels that are null or not 0/1 are ignored; without usable labels every score
is 0.5 (predicted 1), with one class only the smoothed share of that class. Texts are used whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.llm.common import chunks, col, fresh, span_hashes, utf8

BUCKETS = 1 << 14
DIMS = 32
WINDOW = 2
#: Non-zero entries of an index vector.
NONZERO = 4
#: Bound of the labelled sample that the network is fitted on.
TRAIN_ROWS = 20_000
HIDDEN = 24
EPOCHS = 30

_CLASS = np.full(256, 2, np.uint8)       # 0 white space, 1 letters, digits and non-ASCII, 2 the rest
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _CLASS[_lo:_hi] = 1


def index_vectors() -> np.ndarray:
    """The fixed sparse ternary vector of each bucket."""
    rng = np.random.default_rng(20)
    out = np.zeros((BUCKETS, DIMS), np.int8)
    for k in range(NONZERO):
        out[np.arange(BUCKETS), rng.integers(0, DIMS, BUCKETS)] = 1 if k % 2 else -1
    return out


def tokens(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each token in order, and the index of each document's first token, plus the end."""
    kind = _CLASS[raw]
    edge = np.ones(len(raw), bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[offs[:-1][offs[:-1] < len(raw)]] = True
    at = np.flatnonzero(edge)
    ends = np.append(at[1:], len(raw))
    word = kind[at] > 0
    starts, ends = at[word], ends[word]
    h = span_hashes(raw, starts, ends)
    return (h >> np.uint64(50)).astype(np.int64) % BUCKETS, np.searchsorted(starts, offs)


def _neighbours(buckets: np.ndarray, first: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Sum of the index vectors around and at each token, inside its document."""
    own = index[buckets]
    out = own.copy()
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for k in range(1, WINDOW + 1):
        same = (doc[k:] == doc[:-k])[:, None]
        out[k:] += own[:-k] * same
        out[:-k] += own[k:] * same
    return out


def _context_sums(batches):
    index, total, seen = index_vectors(), np.zeros((BUCKETS, DIMS), np.int64), np.zeros(BUCKETS, bool)
    for batch in batches:
        raw, offs = utf8(batch.column(0))
        for i, j in chunks(offs):
            part, o = raw[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
            b, first = tokens(part, o)
            if not len(b):
                continue
            near = _neighbours(b, first, index)
            for d in range(DIMS):
                total[:, d] += np.bincount(b, near[:, d], BUCKETS).astype(np.int64)
            seen[b] = True
    rows = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array(rows.astype(np.int32)), *(pa.array(total[rows, d].astype(np.int32)) for d in range(DIMS))],
        ["bucket", *(f"d{d}" for d in range(DIMS))])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit context vector of every bucket over all documents; a fixed ``BUCKETS`` x ``DIMS`` table."""
    dims = [f"d{d}" for d in range(DIMS)]
    part = docs.select(col(text).cast("string")).mapInArrow(
        _context_sums, "bucket int, " + ", ".join(f"{d} int" for d in dims))
    rows = part.groupBy("bucket").agg(*(F.sum(d).alias(d) for d in dims)).toPandas()
    out = np.zeros((BUCKETS, DIMS), np.float32)
    if len(rows):
        v = rows[dims].to_numpy(np.float64)
        v = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1)
        out[rows["bucket"].to_numpy()] = v - v.mean(axis=0)
    return out


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """One row of pooled features per text."""
    raw, offs = utf8(column)
    out = np.zeros((len(offs) - 1, 2 * DIMS + 2), np.float32)
    for i, j in chunks(offs):
        b, first = tokens(raw[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
        n = np.diff(first)
        has = np.flatnonzero(n)
        if not len(has):
            continue
        v, at, m = vectors[b], first[has], n[has][:, None].astype(np.float32)
        mean = np.add.reduceat(v, at) / m
        dev = np.sqrt(np.maximum(np.add.reduceat(v * v, at) / m - mean * mean, 0))
        step = np.append((v[1:] * v[:-1]).sum(1), np.float32(0))
        step[first[1:][has] - 1] = 0
        lag = np.add.reduceat(step, at)[:, None] / np.maximum(m - 1, 1)
        out[i + has] = np.hstack([mean, dev, lag, np.log1p(m)])
    return out


def fit_network(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, seed: int = 8) -> dict:
    """Two-layer network by Adam on the rows outside ``calibrate``, temperature on those inside."""
    if len(y) == 0:
        return {"share": 0.5}
    if len(np.unique(y)) < 2 or len(y) < 8:
        return {"share": float((y.sum() + 1) / (len(y) + 2))}
    if len(np.unique(y[~calibrate])) < 2:
        calibrate = np.zeros(len(y), bool)
    mu, sd = x.mean(0), x.std(0) + 1e-3
    z, t = ((x - mu) / sd)[~calibrate], y[~calibrate].astype(np.float64)
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN),
         rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m1, m2, step, size = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0, 128
    rounds = max(EPOCHS, -(-1500 * size // len(t)))      # small samples: at least 1500 steps
    for _ in range(rounds):
        order = rng.permutation(len(t))
        for k in range(0, len(t), size):
            r = order[k:k + size]
            h = np.tanh(z[r] @ w[0] + w[1])
            g = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - t[r]) / len(r)
            gh = np.outer(g, w[2]) * (1 - h * h)
            grads = [z[r].T @ gh + 1e-4 * w[0], gh.sum(0), h.T @ g + 1e-4 * w[2], np.array([g.sum()])]
            step += 1
            for a, d, p, q in zip(w, grads, m1, m2, strict=True):
                p += 0.1 * (d - p)
                q += 0.001 * (d * d - q)
                a -= 0.003 * (p / (1 - 0.9 ** step)) / (np.sqrt(q / (1 - 0.999 ** step)) + 1e-8)
    net = {"mu": mu, "sd": sd, "w": w, "temperature": 1.0}
    if calibrate.any():
        logit, t = _logits(net, x[calibrate]), y[calibrate]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 80))
        loss = [np.mean(np.logaddexp(0, np.where(t == 1, -logit, logit) / g)) for g in grid]
        net["temperature"] = float(grid[int(np.argmin(loss))])
    return net


def _logits(net: dict, x: np.ndarray) -> np.ndarray:
    w = net["w"]
    return np.tanh(((x - net["mu"]) / net["sd"]) @ w[0] + w[1]) @ w[2] + w[3]


def scores(net: dict, x: np.ndarray) -> np.ndarray:
    if "share" in net:
        return np.full(len(x), net["share"])
    return 1 / (1 + np.exp(-np.clip(_logits(net, x) / net["temperature"], -500, 500)))


class Model:
    """Fitted word vectors and network; ``score`` is the column expression that applies them."""

    def __init__(self, spark, vectors: np.ndarray, net: dict):
        self.net, self._shared = net, spark.sparkContext.broadcast((vectors, net))

    def score(self, text: Column) -> Column:
        shared = self._shared

        @F.arrow_udf("double")
        def quality_score(texts: pa.Array) -> pa.Array:
            vectors, net = shared.value
            return pa.array(scores(net, pooled(texts, vectors)))

        return quality_score(text.cast("string"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        label: str = "quality") -> Model:
    """Word vectors from all documents, the network from labelled ones that are not held out."""
    spark = docs.sparkSession
    vectors = word_vectors(docs, text)
    ids = (labels.where(col(label).isin(0, 1) & ~held_out(col(doc_id)) & col(doc_id).isNotNull())
           .select(col(doc_id).alias("id"), col(label).cast("int").alias("y"),
                   (F.crc32(F.concat(col(doc_id).cast("string"), F.lit("/apart"))) % 5 == 0).alias("apart"))
           .distinct()
           .orderBy(F.xxhash64("id"), "id", "y").limit(TRAIN_ROWS))
    shared = spark.sparkContext.broadcast(vectors)

    @F.arrow_udf("binary")
    def features(texts: pa.Array) -> pa.Array:
        return pa.array([row.tobytes() for row in pooled(texts, shared.value)], pa.binary())

    # at most TRAIN_ROWS ids, so the hint has a proven bound
    rows = (docs.select(col(doc_id).alias("id"), col(text).cast("string").alias("t"))
            .join(F.broadcast(ids), "id")
            .select("id", "y", "apart", features("t").alias("x"))
            # one row per label, however many rows share the id
            .groupBy("id", "y", "apart").agg(F.min("x").alias("x")).toPandas())
    rows = rows.sort_values(["id", "y", "x"], kind="stable")
    x = (np.frombuffer(b"".join(rows["x"]), np.float32).reshape(len(rows), -1).astype(np.float64)
         if len(rows) else np.zeros((0, 2 * DIMS + 2)))
    return Model(spark, vectors, fit_network(x, rows["y"].to_numpy(np.int64), rows["apart"].to_numpy(bool)))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
             label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = fit(docs, labels, doc_id, text, label)
    return (docs.select(col(doc_id).alias("doc_id"), held_out(col(doc_id)).alias("held_out"),
                        model.score(col(text)).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns."""
    s = fresh(docs, "quality_score")
    return docs.withColumn(s, fit(docs, labels).score(col("text"))).where(col(s) >= 0.5).drop(s)
