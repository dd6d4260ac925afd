"""Change-feed slice semantics (the reference's feed tests) and gap detection."""

import datetime as dt

from pricelake.operators import ops

T0 = dt.datetime(2026, 8, 1)


def log(spark, seqs, epoch=7):
    rows = [(epoch, s, T0 + dt.timedelta(seconds=s)) for s in seqs]
    return spark.createDataFrame(rows, "epoch long, seq long, ts timestamp_ntz")


def status(spark, seqs, since, limit, retained_from=1):
    return ops.change_feed_status(log(spark, seqs), since, limit, retained_from).first()


def test_slice_all(spark):
    lg = log(spark, range(1, 51))
    rows = ops.change_feed_slice(lg, 0, 1000).orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(1, 51))
    s = status(spark, range(1, 51), 0, 1000)
    assert (s["rows"], s["has_more"], s["gone"]) == (50, False, False)


def test_slice_since_and_limit(spark):
    rows = ops.change_feed_slice(log(spark, range(1, 51)), 45, 1000).collect()
    assert sorted(r["seq"] for r in rows) == [46, 47, 48, 49, 50]
    s = status(spark, range(1, 51), 0, 10)
    assert (s["rows"], s["has_more"]) == (10, True)


def test_gone(spark):
    assert status(spark, range(1, 51), 51, 10)["gone"]          # cursor ahead of the head
    assert status(spark, range(1, 51), 3, 10, retained_from=10)["gone"]   # aged out
    assert not status(spark, range(1, 51), 50, 10)["gone"]     # at the head


def test_gaps(spark):
    g = ops.gaps(log(spark, [1, 2, 3, 6, 7, 10])).orderBy("after_seq").collect()
    assert [(r["after_seq"], r["next_seq"]) for r in g] == [(3, 6), (7, 10)]


def test_cursor_positions_and_epoch_resets(spark):
    rows = [("valuecart", 1, "catalog", 100, 0, 5), ("valuecart", 2, "offers", 100, 1, 9),
            ("valuecart", 3, "offers", 200, 0, 0), ("shopmax", 1, "catalog", 7, 0, 3)]
    log = spark.createDataFrame(rows, "retailer string, arrival long, phase string, epoch long, "
                                      "page long, next_seq long")
    pos = {r["retailer"]: (r["phase"], r["epoch"], r["next_seq"])
           for r in ops.cursor_positions(log).collect()}
    assert pos == {"valuecart": ("offers", 200, 0), "shopmax": ("catalog", 7, 3)}
    resets = ops.epoch_resets(log).collect()
    assert [(r["retailer"], r["arrival"], r["prev_epoch"]) for r in resets] == [("valuecart", 3, 100)]


def test_exact_quantiles_against_plain_ranks(spark):
    """Ties, zeros, negatives, nulls, one value, values of one bin and of many."""
    import random

    rng = random.Random(4)
    groups = {"ties": [0.25] * 40 + [0.5] * 3, "one": [7.0], "two": [1.0, 2.0], "signs": [-2.0, 0.0, 0.0, -1.0, 3.0], "null": [None], "some": [None, 0.1, 0.2],
              "near": [1 + i * 1e-9 for i in range(50)], "wide": [10 ** rng.uniform(-9, 9) for _ in range(3000)]}
    rows = [(g, v) for g, own in groups.items() for v in own]
    rng.shuffle(rows)
    got = {r["g"]: r for r in ops.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", (0.0, 0.5, 0.95, 1.0)).collect()}
    assert set(got) == set(groups)
    for g, own in groups.items():
        own = sorted(v for v in own if v is not None)
        for i, q in enumerate((0.0, 0.5, 0.95, 1.0)):
            if not own:
                assert got[g][f"q{i}"] is None
                continue
            at = q * (len(own) - 1)
            lo, hi = own[int(at)], own[min(int(at) + 1, len(own) - 1)]
            assert abs(got[g][f"q{i}"] - (lo + (hi - lo) * (at - int(at)))) <= 1e-12 * max(1, abs(hi))
