"""Two-phase sync: the rule, its composition over partitions, and the stream against the batch."""

import datetime as dt
import json
import os
import random
from functools import reduce

from pyspark.sql import functions as F

from pricelake.operators import sync
from pricelake.operators.segments import Edge
from pricelake.sources import fixtures as fx
from pricelake.sources.feed import explode_pages
from pricelake.streaming import ingest
from pricelake.streaming.sync import start_synced_stream

from conftest import SF_SMALL

LOG = "retailer string, arrival long, phase string, epoch long, page long, as_of_seq long, next_seq long, last boolean, n_items int"


def verdicts(pages, state=sync.Sync()):
    out = []
    for p in pages:
        what, state = sync.turn(state, *p)
        out.append(what)
    return out, state


def cat(page, epoch=1, as_of=10, last=False):
    return ("catalog", epoch, page, as_of, None, last, 5)


def chg(to, epoch=1, n=5):
    return ("offers", epoch, None, None, to, False, n)


def test_updates_of_mid_sync_are_replayed():
    got, state = verdicts([cat(0, as_of=0), chg(7), cat(1, as_of=9), cat(2, last=True), chg(7), chg(12), chg(12), chg(15, n=0)])
    assert got == ["start", "early", "catalog", "catalog", "offers", "offers", "replayed", "idle"]
    assert state == sync.Sync("offers", 1, 12, 0, 0)


def test_restart_in_mid_sync_and_afterwards():
    got, state = verdicts([cat(0), cat(1, epoch=2), cat(1), cat(0, epoch=2, as_of=3), cat(1, epoch=2, last=True), chg(4, epoch=2), chg(50, epoch=3), chg(60, epoch=2), cat(0, epoch=3, last=True)])
    assert got == ["start", "gone", "out_of_order", "start", "catalog", "offers", "gone", "early", "start"]
    assert (state.epoch, state.resyncs) == (3, 2)


def test_pages_out_of_order():
    got, _ = verdicts([cat(1), chg(3), cat(0), cat(2), cat(1), cat(1), cat(2, last=True), cat(3), chg(None)])
    assert got == ["out_of_order", "early", "start", "out_of_order", "catalog", "out_of_order", "catalog", "out_of_order", "offers"]


def random_pages(rng, n):
    return [rng.choice([cat(0, rng.randint(1, 2), rng.randint(0, 9), rng.random() < .2), cat(rng.randint(1, 2), rng.randint(1, 2), 0, rng.random() < .4),
                        *[chg(rng.randint(0, 40), rng.randint(1, 2), rng.choice([0, 5, 5]))] * 3]) for _ in range(n)]


def test_composition_equals_the_walk():
    rng = random.Random(2)
    run = lambda s, pages: reduce(lambda s, p: sync.turn(s, *p)[1], pages, s)
    for n in (*range(1, 60), 4000):
        pages = random_pages(rng, n) if n < 4000 else [cat(0), cat(1, last=True)] + [chg(i) for i in range(n)]
        size = rng.randint(1, 8)
        parts = [pages[i:i + size] for i in range(0, len(pages), size)]
        rounds = []

        def evaluate(questions):
            rounds.append(1)
            for i, own in questions.items():
                for q in own:
                    s, reset = sync.Sync(q[0], q[1], None, q[2], 0), False
                    for p in parts[i]:
                        what, s = sync.turn(s, *p)
                        reset |= what in ("start", "gone")
                    yield i, q, (s, reset)

        got = sync.starts([Edge(i, ("a",), ("a",), run(sync.Sync(), p)) for i, p in enumerate(parts)], evaluate)
        state, want = run(sync.Sync(), parts[0]), {}
        for i, p in enumerate(parts[1:], 1):
            want[i], state = state, run(state, p)
        assert got == want and (n < 4000 or len(rounds) <= 3)


def test_log_in_partitions(spark):
    rng = random.Random(3)
    own = {f"r{k}": random_pages(rng, n) for k, n in enumerate((1, 5, 70, 3))}
    rows = [(r, i * 2, *p) for r, pages in own.items() for i, p in enumerate(pages)] + [(None, 1, *cat(0)), ("r0", None, *cat(0))]
    for partitions in (1, 7, 23):
        d = sync.decide(spark.createDataFrame(rows, LOG), partitions)
        got = {}
        for r in d.orderBy("retailer", "arrival").collect():
            got.setdefault(r["retailer"], []).append(r["verdict"])
        assert got == {r: verdicts(p)[0] for r, p in own.items()}
    at = {r["retailer"]: r for r in sync.positions(d).collect()}
    assert all(at[r]["cursor"] == verdicts(p)[1].cursor and at[r]["seq"] == verdicts(p)[1].seq for r, p in own.items())
    assert sync.decide(spark.createDataFrame([], LOG)).count() == 0


def item(k, cents, day):
    return {"sku": f"SKU-{k:05d}", "title": f"thing {k}", "price_cents": cents, "currency": "USD", "in_stock": True, "updated_at": f"2001-05-{day:02d}T00:00:00Z", "url": ""}


def land(folder, slug, pages, first, step):
    """Envelopes of a retailer, two to a file, interleaved with those of others by file time."""
    lines = []
    for i, (phase, epoch, page, as_of, to, last, _) in enumerate(pages):
        items = [item(100 * (page or 9) + j, 500 + 7 * i + j, 1 + i % 28) for j in range(3)]
        lines.append(json.dumps({"retailer": slug, "arrival": i, "phase": phase, "epoch": epoch, "page": page, "as_of_seq": as_of, "next": to,
                                 "next_cursor": None if last else 1, "items": items}))
    for n, at in enumerate(range(0, len(lines), 2)):
        path = os.path.join(folder, f"{slug}-{at:03d}.json")
        with open(path, "w") as f:
            f.write("\n".join(lines[at:at + 2]) + "\n")
        os.utime(path, (1_700_000_000 + first + n * step,) * 2)


def test_stream_with_a_restart_in_mid_sync_equals_batch(spark, tmp_dir):
    pages_dir, clock = os.path.join(tmp_dir, "pages"), dt.datetime(2002, 1, 1)
    os.makedirs(pages_dir)
    retailers = fx.retailers(spark, SF_SMALL)
    a, b = [r["slug"] for r in retailers.orderBy("id").limit(2).collect()]
    land(pages_dir, a, [cat(0), chg(11), cat(1), cat(2, epoch=2), cat(3), cat(0, epoch=2, as_of=1), cat(1, epoch=2), chg(3, epoch=2), cat(2, epoch=2, last=True), chg(3, epoch=2), chg(3, epoch=2), chg(8, epoch=2)], 0, 2)
    land(pages_dir, b, [cat(0, last=True), chg(20), chg(30, epoch=5), chg(40), cat(0, epoch=5, as_of=30, last=True), chg(31, epoch=5)], 1, 2)
    with open(os.path.join(pages_dir, "bad.json"), "w") as f:
        f.write("not an envelope\n")

    paths, shuffles = ingest.Paths(os.path.join(tmp_dir, "stream")), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for _ in range(2):                  # the second run starts from the checkpoint and finds nothing new
        start_synced_stream(spark, pages_dir, paths, retailers, os.path.join(tmp_dir, "ckpt"), clock=lambda: clock, files_per_trigger=3).awaitTermination(600)
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)

    envelopes = spark.read.text(pages_dir)
    log = sync.page_log(envelopes)
    decided = sync.decide(log)
    stream_log = spark.read.parquet(paths.page_log)
    key = ["retailer", "arrival", "verdict", "s_phase", "s_epoch", "s_seq", "s_cursor", "s_resyncs"]
    assert sorted(map(tuple, stream_log.where("verdict <> 'unreadable'").select(*key).collect())) == sorted(map(tuple, decided.select(*key).collect()))
    assert stream_log.where("verdict = 'unreadable'").count() == 1

    whole = ingest.Paths(os.path.join(tmp_dir, "batch"))
    taken = log.join(decided.where(F.col("verdict").isin(sync.PROCESSED)).select("retailer", "arrival"), ["retailer", "arrival"], "left_semi")
    ingest.process_batch(explode_pages(taken.select("value").unionByName(envelopes.where("value LIKE 'not%'"))), 0, whole, retailers, clock)
    cols = ["retailer_id", "sku_norm", "price_cents", "updated_at", "spike_streak"]
    offers = lambda p: sorted(map(tuple, ingest.current_offers(spark, p).join(ingest.current_products(spark, p, None).select(F.col("id").alias("product_id"), "sku_norm"), "product_id").select(*cols).collect()))
    assert offers(paths) == offers(whole) and len(offers(paths)) > 10
    bad = lambda p: spark.read.parquet(p.quarantine).where("reason = 'bad_envelope'").count()
    assert bad(paths) == bad(whole) == 1
