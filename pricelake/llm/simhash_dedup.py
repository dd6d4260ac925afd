"""SimHash near-dedup with the general pigeonhole principle.

*Fingerprints.* ``A-Z`` are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; every run of three
words, repeats included, is hashed by XXH64 (seed 42). A bit of the 64-bit fingerprint is set where
over half the hashes have it. Fewer than three words are hashed as one piece; none give zero.

*Search.* Equal fingerprints are one class first (an aggregate, pre-reduced map-side), so copies
never meet in a join. The 64 bits are dealt into m groups by their correlations over all
classes, correlated bits together. If the thresholds t_i of the groups satisfy
sum(t_i + 1) = d + 1, two fingerprints within d bits differ by at most t_i bits in some group i
(t_i = -1 skips a group). A dynamic programme allocates the thresholds, and m itself, by the
probes and the estimated number of candidates (distances within each group on a bounded sample of
fingerprints; the estimate only steers cost, the search is exact for every allocation). Each class
is indexed once per used group by its bits there, and probes all values within t_i bits. Candidates
are verified by Hamming distance inside the join, so the join yields links only.

*Crowded buckets.* A bucket with more than ``CROWDED`` classes is cut into blocks of at most about
``BLOCK`` index rows and ``BLOCK`` probes. Each pair of blocks is verified with numpy in one task,
which returns a spanning forest of its links rather than all of them: components stay the same and
a group of thousands of near copies does not become millions of rows.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows
share a class; the component id is the smallest non-null doc_id reachable (null if there is none);
an empty table gives an empty result.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.llm.common import col, fresh, utf8
from pricelake.llm.components import components
from pricelake.session import freeze

BITS = 64
CROWDED = 64
BLOCK = 1024
#: Fingerprints of the sample on which candidate counts are estimated.
SAMPLE = 1024
GROUPS = (2, 3, 4)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    words = text.lower().split()          # bytes: only A-Z, and exactly \x20 \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(words) - shingle + 1].tolist()
    h = [xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1:].tolist(), strict=True)]
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 14):
        part = np.array(h[k:k + (1 << 14)], np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(shingle: int):
    @F.arrow_udf("bigint")
    def simhash(texts: pa.Array) -> pa.Array:
        raw, offs = utf8(texts)
        whole = raw.tobytes()
        out = [fingerprint(whole[a:b], shingle) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        return pa.array(np.array(out, np.uint64).view(np.int64))
    return simhash


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _bit_pairs(batches):
    total = np.zeros((BITS, BITS), np.int64)
    for b in batches:
        x = _bits(b.column(0).to_numpy()).astype(np.float32)
        total += (x.T @ x).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS, dtype=np.int32)), pa.array(total.ravel())], ["k", "n"])


def correlations(classes: DataFrame, n: int) -> np.ndarray:
    """Absolute correlation of each pair of bits over all classes."""
    rows = classes.select("fp").mapInArrow(_bit_pairs, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros(BITS * BITS)
    both[rows["k"].to_numpy(int)] = rows["n"].to_numpy(float) if len(rows) else 0
    both = both.reshape(BITS, BITS) / max(n, 1)
    q = both.diagonal()
    sd = np.sqrt(np.maximum(q * (1 - q), 1e-12))
    return np.abs((both - np.outer(q, q)) / np.outer(sd, sd))


def bit_groups(corr: np.ndarray, m: int) -> list[np.ndarray]:
    """m groups of nearly equal width: each starts at the free bit with the strongest ties and takes
    the free bit most correlated with it until it is full."""
    free, out = set(range(BITS)), []
    for g in range(m):
        width = BITS // m + (g < BITS % m)
        rest = sorted(free)
        ties = corr[np.ix_(rest, rest)].sum(1)
        group = [rest[int(np.argmax(ties))]]
        free.remove(group[0])
        while len(group) < width:
            rest = sorted(free)
            pick = rest[int(np.argmax(corr[np.ix_(rest, group)].sum(1)))]
            group.append(pick)
            free.remove(pick)
        out.append(np.array(sorted(group)))
    return out


def _mask(group: np.ndarray) -> int:
    return sum(1 << int(b) for b in group)


def allocate(groups: list[np.ndarray], sample: np.ndarray, n: int, d: int) -> tuple[float, list[int]]:
    """Least cost and thresholds with sum(t_i + 1) = d + 1, from the probes and the estimated
    candidates of each group and threshold."""
    i, j = np.triu_indices(len(sample), 1)
    diff = sample[i] ^ sample[j]
    cost = []
    for g in groups:
        away = np.bitwise_count(diff & np.uint64(_mask(g)))
        row = [0.0]                                            # threshold -1: the group is skipped
        for t in range(d + 1):
            ball = sum(comb(len(g), k) for k in range(t + 1))
            share = max(float((away <= t).mean()) if len(away) else 0.0, ball / 2.0 ** len(g))
            row.append(2.0 * n * (ball + 1) + n * (n / 2) * share)
        cost.append(row)
    best = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, t) in best.items():
            for k, more in enumerate(row):
                if used + k <= d + 1 and (used + k not in step or c + more < step[used + k][0]):
                    step[used + k] = (c + more, [*t, k - 1])
        best = step
    return best[d + 1]


def plan_search(classes: DataFrame, d: int) -> list[tuple[np.ndarray, int]]:
    """The bit groups that are used and their thresholds."""
    n = classes.count()
    corr = correlations(classes, n)
    rows = classes.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).toPandas()
    sample = rows["fp"].to_numpy(np.int64).view(np.uint64)
    found = []
    for m in GROUPS:
        groups = bit_groups(corr, m)
        cost, t = allocate(groups, sample, n, d)
        found.append((cost, m, [(g, k) for g, k in zip(groups, t, strict=True) if k >= 0]))
    return min(found, key=lambda x: x[:2])[2]


def _flips(group: np.ndarray, t: int) -> list[int]:
    """Every pattern of at most t bits of the group, as signed 64-bit numbers."""
    out, level = [0], [(0, 0)]
    for _ in range(t):
        level = [(v | 1 << int(group[k]), k + 1) for v, at in level for k in range(at, len(group))]
        out += [v for v, _ in level]
    return [v - (1 << 64) if v >> 63 else v for v in out]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _forest(d: int):
    """Spanning forest of the links between the index rows and the probes of one pair of blocks."""
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        probe = pdf["probe"].to_numpy(bool)
        x = np.unique(pdf["fp"].to_numpy(np.int64)[~probe])
        y = np.unique(pdf["fp"].to_numpy(np.int64)[probe])
        near = np.bitwise_count(x.view(np.uint64)[:, None] ^ y.view(np.uint64)[None, :]) <= d
        open_x, open_y, a, b = np.ones(len(x), bool), np.ones(len(y), bool), [], []
        for start in range(len(y)):
            if not open_y[start]:
                continue
            front = np.array([start])
            open_y[start] = False
            while len(front):                                  # breadth first, sides in turn
                step = near[:, front] & open_x[:, None]
                new = np.flatnonzero(step.any(1))
                a.append(y[front[step[new].argmax(1)]])
                b.append(x[new])
                open_x[new] = False
                step = near[new] & open_y
                front = np.flatnonzero(step.any(0))
                if len(front):
                    a.append(y[front])
                    b.append(x[new[step[:, front].argmax(0)]])
                    open_y[front] = False
        out = pd.DataFrame({"a": np.concatenate([np.zeros(0, np.int64), *a]), "b": np.concatenate([np.zeros(0, np.int64), *b])})
        return out[out["a"] != out["b"]]
    return links


def near_links(classes: DataFrame, d: int) -> DataFrame:
    """(a, b): links between fingerprints within ``d`` bits; in crowded buckets a spanning forest."""
    used = plan_search(classes, d)
    index = probes = None
    for k, (group, t) in enumerate(used):
        own = F.col("fp").bitwiseAND(F.lit(_signed(_mask(group))))
        x = classes.select(F.lit(k).alias("part"), own.alias("key"), "fp")
        y = x if t == 0 else classes.select(F.lit(k).alias("part"), F.explode(F.transform(
            F.array(*map(F.lit, _flips(group, t))), lambda v, own=own: own.bitwiseXOR(v))).alias("key"), "fp")
        index, probes = (x, y) if index is None else (index.unionByName(x), probes.unionByName(y))
    crowded = freeze(index.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED), "crowded")
    keys = ["part", "key"]
    few = index.join(crowded, keys, "left_anti")
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= d
    links = (few.alias("x").join(probes.alias("y"), (F.col("x.part") == F.col("y.part")) & (F.col("x.key") == F.col("y.key"))
                                 & (F.col("x.fp") > F.col("y.fp")) & near)
             .select(F.col("y.fp").alias("a"), F.col("x.fp").alias("b")))
    many = probes.join(crowded, keys)
    sizes = crowded.join(many.groupBy(*keys).agg(F.count("*").alias("np")), keys).select(
        *keys, F.ceil(F.col("n") / BLOCK).alias("nx"), F.ceil(F.col("np") / BLOCK).alias("ny"))
    at = lambda n: F.pmod(F.xxhash64("fp"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    xb = (index.join(sizes, keys).select(*keys, "fp", F.lit(False).alias("probe"), at("nx").alias("bx"), every("ny").alias("by")))
    yb = (probes.join(sizes, keys).select(*keys, "fp", F.lit(True).alias("probe"), at("ny").alias("by"), every("nx").alias("bx")))
    forest = xb.unionByName(yb).groupBy(*keys, "bx", "by").applyInPandas(_forest(d), "a bigint, b bigint")
    return links.unionByName(forest)


def fingerprint_components(prints: DataFrame, d: int) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of ``prints`` (id, fp); the root is a fingerprint of the component."""
    classes = freeze(prints.groupBy("fp").agg(F.min("id").alias("id")), "classes")
    found = components(near_links(classes, d))
    root = classes.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "id", F.coalesce("component", "fp").alias("root"))
    # a row per linked class only; all others are their own component
    least = root.where("fp != root").unionByName(
        root.where("fp = root").join(found.select(F.col("component").alias("root")).distinct(), "root", "left_semi")
        .select("fp", "id", "root")).groupBy("root").agg(F.min("id").alias("least"))
    return root.join(least, "root", "left").select("fp", "root", F.coalesce("least", "id").alias("component_id"))


def with_fingerprints(docs: DataFrame, doc_id: Column, text: Column, shingle: int) -> DataFrame:
    return docs.select(doc_id.alias("id"), fingerprints(shingle)(text.cast("string")).alias("fp"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    prints = freeze(with_fingerprints(docs, col(doc_id), col(text), shingle), "simhash")
    return (prints.join(fingerprint_components(prints, max_bits), "fp", "left")
            .select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_first(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One document of each component, with the columns of ``docs``: the one with the smallest id, then the
    smallest hash of its text; ids may repeat or be null (null ids come last). Of rows with this id and
    text one stays."""
    one, tie = fresh(docs, "kept_id"), fresh(docs, "kept_tie")
    hashed = F.xxhash64(F.col("text"))
    prints = freeze(docs.select(F.col("doc_id").alias("id"), hashed.alias("tie"), fingerprints(shingle)(F.col("text").cast("string")).alias("fp")), "simhash")
    roots = fingerprint_components(prints.select("id", "fp"), max_bits).select("fp", "root")
    best = prints.join(roots, "fp").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tie")).alias("best"))
    kept = best.select(F.col("best.id").alias(one), F.col("best.tie").alias(tie))
    rows = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(one)) & (hashed == F.col(tie)))
    return rows.dropDuplicates([one, tie]).select(*[col(c) for c in docs.columns])
