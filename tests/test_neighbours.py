"""Stored inverted lists and the similar-items table against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelake.operators import neighbours as nb


def brute(ids, m, k, queries=None):
    """(id, rank, neighbour, distance) by all distances."""
    with np.errstate(all="ignore"):
        length = np.sqrt((m * m).sum(1))
        ok = np.isfinite(length) & (length > 0)
        u, own = m[ok] / length[ok, None], np.array(ids)[ok]
        d = np.round(1 - u @ u.T, nb.DIGITS) + 0.0
    out = set()
    for a, i in enumerate(own):
        if queries is None or i in queries:
            near = [x for x in np.lexsort((own, d[a])) if x != a][:k]
            out |= {(int(i), r, int(own[x]), float(d[a, x])) for r, x in enumerate(near, 1)}
    return out


def vectors(spark, m, ids):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, m)] + [(-1, None), (-2, [float("nan")] * m.shape[1])], "id long, embedding array<double>")


def some(kind):
    rng = np.random.default_rng(len(kind))
    m = rng.normal(size=(900, 6)) if kind == "isotropic" else rng.normal(size=(30, 6))[rng.integers(0, 30, 900)] + 0.02 * rng.normal(size=(900, 6))
    m[100:400] = m[0]                       # a third of all rows is one vector
    m[500], m[501] = 0, m[0] * 3
    ids = rng.permutation(5000)[:900]
    return m, ids


@pytest.mark.parametrize("kind", ["isotropic", "clusters"])
@pytest.mark.parametrize("block", [2048, 50])
def test_similar_items(spark, monkeypatch, kind, block):
    monkeypatch.setattr(nb, "BLOCK", block)
    m, ids = some(kind)
    got = nb.similar_items(vectors(spark, m, ids), lists=None if block == 50 else 5)
    assert {tuple(r) for r in got.collect()} == brute(ids, m, 12)


def test_few_and_no_vectors(spark):
    d = vectors(spark, np.array([[1.0, 0], [0, 1], [1, 0]]), [7, 8, 9])
    assert {tuple(r) for r in nb.similar_items(d).collect()} == {(7, 1, 9, 0.0), (7, 2, 8, 1.0), (9, 1, 7, 0.0), (9, 2, 8, 1.0), (8, 1, 7, 1.0), (8, 2, 9, 1.0)}
    assert nb.similar_items(d.limit(0)).count() == 0
    assert nb.similar_items(d.where("id < 0")).count() == 0


@pytest.mark.parametrize("kind", ["isotropic", "clusters"])
def test_stored_lists(spark, tmp_dir, kind):
    m, ids = some(kind)
    path = f"{tmp_dir}/index"
    nb.write_index(vectors(spark, m, ids), path, lists=20)
    lists = spark.read.parquet(f"{path}/lists").collect()
    assert sum(r["n"] for r in lists) == spark.read.parquet(f"{path}/vectors").count() == 899
    for i in (0, 450, 777):
        want = {(n, d) for _, _, n, d in brute(ids, m, 12, {ids[i]})}
        exact = {tuple(r) for r in nb.nearest(spark, path, m[i].tolist(), exclude=int(ids[i])).collect()}
        assert exact == want
        assert {tuple(r) for r in nb.nearest(spark, path, m[i].tolist(), probes=20, exclude=int(ids[i])).collect()} == want
        recall = [len({r["id"] for r in nb.nearest(spark, path, m[i].tolist(), p, exclude=int(ids[i])).collect()} & {n for n, _ in want}) for p in (1, 6, 20)]
        assert recall == sorted(recall)
    assert nb.nearest(spark, path, [0.0] * 6).count() == 0


def test_only_the_probed_lists_are_opened(spark, tmp_dir):
    m, ids = some("clusters")
    path = f"{tmp_dir}/index"
    nb.write_index(vectors(spark, m, ids), path, lists=20)
    some_lists = nb.members(spark, path, [3, 4])
    plan = some_lists._jdf.queryExecution().executedPlan().toString()
    assert "list_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r[0] for r in some_lists.select(F.input_file_name()).distinct().collect()} <= {f for f in some_lists.inputFiles() if "list_id=3/" in f or "list_id=4/" in f}


def test_empty_index(spark, tmp_dir):
    nb.write_index(vectors(spark, np.zeros((0, 3)), []).where("id > 0"), f"{tmp_dir}/index")
    assert nb.nearest(spark, f"{tmp_dir}/index", [1.0, 0, 0]).count() == 0
