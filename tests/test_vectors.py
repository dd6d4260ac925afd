"""H7: the IVF probe is exact when every list is probed, and recall grows with nprobe."""

from pricelake.operators import similar as sm
from pricelake.sources.tables import read_table

from conftest import SF_SMALL


def test_ivf_recall(spark):
    e = read_table(spark, SF_SMALL, "embeddings")
    model, assigned = sm.ivf_index(e, "embedding", 8)
    exact = [(r["vec_id"], round(r["distance"], 9))
             for r in sm.nearest(e, "vec_id", "embedding", 0).collect()]
    recalls = []
    for nprobe in (1, 3, 8):
        approx = [(r["vec_id"], round(r["distance"], 9)) for r in
                  sm.ivf_nearest(model, assigned, "vec_id", "embedding", 0, nprobe).collect()]
        recalls.append(len({v for v, _ in exact} & {v for v, _ in approx}) / len(exact))
        if nprobe == 8:
            assert approx == exact
    assert recalls == sorted(recalls) and recalls[-1] == 1.0
