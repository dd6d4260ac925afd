"""The two-phase sync as a keyed stateful stream (L2, L3): landed envelopes in, processed pages out.

``transformWithStateInPandas`` keeps one ``sync.Sync`` per retailer in the state store, so a position survives
restarts and a feed that restarts in mid-sync is given up until its catalog begins anew, as in the batch.
A micro-batch is ordered by the arrival number within a retailer; numbers at or below the last one
seen are pages landed twice and are left out. A task holds the pages of one retailer of a micro-batch
(bounded by the files of a trigger).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pricelake.operators import sync
from pricelake.sources.feed import explode_pages
from pricelake.streaming import ingest

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = sync.DECISION + ", value string"
#: First character of the keys that lines without a place in any sync are spread over.
UNREADABLE = "\0"
_KEPT = StructType([StructField("phase", StringType()), StructField("epoch", LongType()), StructField("seq", LongType()),
                    StructField("cursor", LongType()), StructField("resyncs", LongType()), StructField("arrival", LongType())])


class SyncProcessor(StatefulProcessor):
    """One ``sync.turn`` per page in order of arrival."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("sync", _KEPT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0].startswith(UNREADABLE):
            for part in rows:
                blank = {c.split()[0]: None for c in OUT.split(", ")}
                yield part[["value"]].assign(**blank | {"verdict": "unreadable", "value": part["value"]})[list(blank)]
            return
        state, seen = sync.Sync(), None
        if self.kept.exists():
            *fields, seen = self.kept.get()
            state = sync.Sync(*fields)
        pages = [p for part in rows for p in zip(*(part[c] for c in [*sync.PAGE, "value"]), strict=True)]
        out = []
        for retailer, arrival, phase, *numbers, last, n_items, value in sorted(pages, key=lambda p: p[1]):
            if seen is not None and arrival <= seen:
                continue
            seen = int(arrival)
            verdict, state = sync.turn(state, phase, *(None if pd.isna(x) else int(x) for x in numbers), bool(last), int(n_items))
            out.append((retailer, seen, verdict, *state, value))
        if out:
            self.kept.update((*state, seen))
            names = [c.split()[0] for c in OUT.split(", ")]
            yield pd.DataFrame(out, columns=names).astype({c: "Int64" for c in ("s_epoch", "s_seq", "s_cursor", "s_resyncs")})

    def close(self) -> None:
        pass


def decided_pages(pages: DataFrame) -> DataFrame:
    """The verdict on every page of a stream (or table) of envelopes (``value``), and the text. Lines without
    a retailer or an arrival number take no part in a sync and come out as ``unreadable``."""
    log = sync.page_log(pages)
    salt = F.concat(F.lit(UNREADABLE), F.pmod(F.xxhash64("value"), F.lit(64)).cast("string"))
    log = log.withColumn("retailer", F.when(F.col("retailer").isNull() | F.col("arrival").isNull(), salt).otherwise(F.col("retailer")))
    return log.groupBy("retailer").transformWithStateInPandas(
        statefulProcessor=SyncProcessor(), outputStructType=OUT, outputMode="Append", timeMode="None")


def start_synced_stream(spark: SparkSession, pages_dir: str, paths: ingest.Paths, retailers: DataFrame, checkpoint_location: str,
                        clock: Callable[[], dt.datetime] | None = None, files_per_trigger: int = 1, seed_products: DataFrame | None = None):
    """L1 with L2 and L3: landed page files → sync → ``process_batch`` of the processed pages. The verdict on
    every page goes to ``<root>/page_log/batch_id=<n>``."""
    clock = clock or (lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    src = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(pages_dir)

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()         # the stateful step runs once for both sinks
        try:
            batch.drop("value").write.mode("overwrite").parquet(f"{paths.page_log}/batch_id={batch_id}")
            ingest.process_batch(explode_pages(batch.where(F.col("verdict").isin([*sync.PROCESSED, "unreadable"]))), batch_id, paths, retailers, clock(), seed_products)
        finally:
            batch.unpersist()

    return decided_pages(src).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_location).trigger(availableNow=True).start()
