"""Two-phase sync of a retailer's feed over landed pages (L2, L3), and its positions.

A sync reads the whole catalog, page by page, and then the change feed. The first catalog page pins the feed's
epoch and its change position, so updates that are made while the catalog is read are replayed from the
pinned position afterwards. A page of another epoch means that the feed has restarted and its
positions mean nothing any more: the sync is given up until the catalog starts anew (a resync).

``turn`` is one step of that rule; the batch (``decide``) and the stream (``streaming.sync``) both take
it. Verdicts: ``start`` and ``catalog`` (catalog pages), ``offers`` (changes), all processed; ``idle`` (a change page
without items), ``replayed`` (changes up to a position already reached), ``early`` (changes while the
catalog is read, which come again), ``out_of_order`` (a catalog page that is not the next one), ``gone``
(another epoch), all skipped. Changes without a position are processed and leave it as it is.

The batch is a segmented fold (``operators.segments``) over range partitions of (retailer, arrival), so
a retailer with a third of all pages is shared by many tasks. The map of a partition keeps the
position symbolic: changes raise it to a maximum, a catalog start sets it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelake.operators.segments import Edge, compose
from pricelake.session import checkpoint_dir

PROCESSED = ["start", "catalog", "offers"]
#: Columns of a page log; ``last`` marks the last catalog page, ``arrival`` orders a retailer's pages.
PAGE = ["retailer", "arrival", "phase", "epoch", "page", "as_of_seq", "next_seq", "last", "n_items"]
_STATE = "s_phase string, s_epoch long, s_seq long, s_cursor long, s_resyncs long"


class Sync(NamedTuple):
    """Position of a retailer: phase, pinned epoch, change position, next catalog page, syncs begun after the first."""

    phase: str = "catalog"
    epoch: int | None = None
    seq: int | None = None
    cursor: int = 0
    resyncs: int = -1


def turn(state: Sync, phase: str, epoch: int, page: int | None, as_of_seq: int | None, next_seq: int | None, last: bool, n_items: int) -> tuple[str, Sync]:
    """The verdict on the next page and the position after it."""
    given_up = state._replace(phase="catalog", epoch=None, seq=None, cursor=0)
    if phase == "catalog":
        if page == 0:
            begun = Sync("offers" if last else "catalog", epoch, as_of_seq, 0 if last else 1, state.resyncs + 1)
            return "start", begun
        if state.phase == "catalog" and state.cursor > 0 and epoch != state.epoch:
            return "gone", given_up
        if state.phase != "catalog" or state.cursor == 0 or page != state.cursor:
            return "out_of_order", state
        return "catalog", state._replace(phase="offers", cursor=0) if last else state._replace(cursor=page + 1)
    if state.phase == "catalog":
        return "early", state
    if epoch != state.epoch:
        return "gone", given_up
    if n_items == 0:
        return "idle", state
    if state.seq is not None and next_seq is not None and next_seq <= state.seq:
        return "replayed", state
    return "offers", state if next_seq is None else state._replace(seq=next_seq)


def page_log(envelopes: DataFrame) -> DataFrame:
    """The ``PAGE`` columns of landed envelopes (``value``: one JSON text per page), and the text."""
    v = F.try_parse_json("value")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    return envelopes.select(
        get("$.retailer", "string").alias("retailer"), get("$.arrival", "bigint").alias("arrival"), get("$.phase", "string").alias("phase"),
        get("$.epoch", "bigint").alias("epoch"), get("$.page", "bigint").alias("page"), get("$.as_of_seq", "bigint").alias("as_of_seq"),
        get("$.next", "bigint").alias("next_seq"), get("$.next_cursor", "bigint").isNull().alias("last"),
        F.coalesce(F.size(get("$.items", "array<variant>")), F.lit(0)).alias("n_items"), "value")


def _pages(b: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(b.column(c).to_pylist() for c in PAGE), strict=True)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seg = first = last = None
    state = Sync()
    for b in batches:
        for retailer, _, *page in _pages(b):
            if seg is None:
                seg, first = b.column("seg")[0].as_py(), retailer
            if retailer != last:
                last, state = retailer, Sync()
            _, state = turn(state, *page)
    if seg is not None:
        yield pa.RecordBatch.from_pylist([{"seg": seg, "first": first, "last": last} | dict(zip(("s_phase", "s_epoch", "s_seq", "s_cursor", "s_resyncs"), state))],
                                         pa.schema([("seg", pa.int32()), ("first", pa.string()), ("last", pa.string()), *_STATE_FIELDS]))


_STATE_FIELDS = [("s_phase", pa.string()), ("s_epoch", pa.int64()), ("s_seq", pa.int64()), ("s_cursor", pa.int64()), ("s_resyncs", pa.int64())]


def _maps(questions: dict[int, list[tuple]]):
    """Task body: for each (phase, epoch, cursor) the position after the partition's pages, begun with no
    position, and whether that one was set by a catalog start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, states = None, {}
        for b in batches:
            if b.num_rows and seg is None:
                seg = b.column("seg")[0].as_py()
                states = {q: [Sync(q[0], q[1], None, q[2], 0), False] for q in questions.get(seg, ())}
            for _, _, *page in _pages(b):
                for s in states.values():
                    what, s[0] = turn(s[0], *page)
                    s[1] |= what in ("start", "gone")
        rows = [(seg, *q, *s, own) for q, (s, own) in states.items()]
        if rows:
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), *(t for _, t in _STATE_FIELDS), pa.bool_()]
            names = ["seg", "phase", "epoch", "cursor", *(c for c, _ in _STATE_FIELDS), "own"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names)
    return run


def _answer(known: dict, state: Sync) -> Sync | None:
    found = known.get((state.phase, state.epoch, state.cursor))
    if found is None:
        return None
    after, own = found
    seq = after.seq if own or state.seq is None else state.seq if after.seq is None else max(state.seq, after.seq)
    return after._replace(seq=seq, resyncs=state.resyncs + after.resyncs)


def starts(edges: list[Edge], evaluate) -> dict[int, Sync]:
    """``compose`` for this rule; ``evaluate`` answers (partition, (phase, epoch, cursor), (position, own))."""
    return compose(edges, lambda s: (s.phase, s.epoch, s.cursor), _answer, evaluate)


def _decide(begin: dict[int, Sync]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, Sync()
        for b in batches:
            rows = []
            for retailer, arrival, *page in _pages(b):
                if retailer != last:
                    state = begin.get(b.column("seg")[0].as_py(), Sync()) if last is None else Sync()
                    last = retailer
                verdict, state = turn(state, *page)
                rows.append((retailer, arrival, verdict, *state))
            if rows:
                kinds = [pa.string(), pa.int64(), pa.string(), *(t for _, t in _STATE_FIELDS)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)],
                                                 ["retailer", "arrival", "verdict", *(c for c, _ in _STATE_FIELDS)])
    return run


DECISION = "retailer string, arrival long, verdict string, " + _STATE


def decide(log: DataFrame, partitions: int | None = None) -> DataFrame:
    """The verdict on every page of a log and the position after it (``DECISION``); a page without a
    retailer or an arrival number has no place in the order and is left out."""
    checkpoint_dir(log.sparkSession)
    n = partitions or int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = log.where("retailer IS NOT NULL AND arrival IS NOT NULL").select(*PAGE)
    fixed = rows.repartitionByRange(n, "retailer", "arrival").sortWithinPartitions("retailer", "arrival").withColumn("seg", F.spark_partition_id()).checkpoint()

    def evaluate(questions: dict[int, list[tuple]]) -> list:
        schema = "seg int, phase string, epoch long, cursor long, " + _STATE + ", own boolean"
        some = fixed.where(F.col("seg").isin(list(questions))).mapInArrow(_maps(questions), schema)
        return [(r[0], tuple(r[1:4]), (Sync(*r[4:9]), r[9])) for r in some.collect()]

    edges = sorted(fixed.mapInArrow(_edges, "seg int, first string, last string, " + _STATE).collect())
    begin = starts([Edge(r[0], (r[1],), (r[2],), Sync(*r[3:])) for r in edges], evaluate)
    return fixed.mapInArrow(_decide(begin), DECISION)


VERDICTS = [*PROCESSED, "idle", "replayed", "early", "out_of_order", "gone"]


def positions(decided: DataFrame) -> DataFrame:
    """The position of every retailer after its last page, and its pages by verdict."""
    last = F.max_by(F.struct("s_phase", "s_epoch", "s_seq", "s_cursor", "s_resyncs"), "arrival").alias("p")
    return decided.groupBy("retailer").agg(last, *[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in VERDICTS]).select(
        "retailer", *[F.col(f"p.s_{c}").alias(c) for c in ("phase", "epoch", "seq", "cursor", "resyncs")], *[f"n_{v}" for v in VERDICTS])
