"""Helpers shared by the operators: session settings, column names, and numpy views of Arrow text.

The numpy helpers work on one Arrow batch at a time inside a task, so memory is bounded by a batch
(``BATCH_ROWS`` rows) and, for the hashing helper, by ``CHUNK_BYTES`` of text or one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelake.session import apply_engine_conf, checkpoint_dir

#: Rows of an Arrow batch sent to a Python worker.
BATCH_ROWS = 512
#: Bytes of an Arrow batch (one row may be longer).
BATCH_BYTES = 32 << 20
#: Bytes of text that the hashing helper holds at once (one document may be longer).
CHUNK_BYTES = 1 << 19


def prepare(spark: SparkSession) -> SparkSession:
    """Engine settings, the shared checkpoint folder, and small Arrow batches."""
    apply_engine_conf(spark)
    checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offset of each row, plus the end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = column.cast(pa.large_binary()).fill_null(b"")
    offs = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1]
    if not len(offs):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = a.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most ``limit`` bytes together (one row at least)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


# Odd multiplier and its inverse modulo 2**64: substring hashes come from prefix sums.
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span of ``raw``; equal bytes give equal hashes."""
    n = len(raw)
    with np.errstate(over="ignore"):
        pw = np.full(n + 1, _P, np.uint64)
        pw[0] = 1
        np.cumprod(pw, out=pw)
        pre = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * pw[:n], out=pre[1:])
        pw.fill(_PINV)
        pw[0] = 1
        np.cumprod(pw, out=pw)
        h = (pre[ends] - pre[starts]) * pw[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def bit_filter(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """A bit array of ``bits`` bits (a power of two) in which two bits of each 64-bit key are set, by its low and by
    its high half. Spark packs it into words, so at most ``bits`` / 64 rows come to the driver, whatever the keys."""
    both = F.explode(F.array(F.col(key), F.shiftrightunsigned(F.col(key), 32)))
    at = F.col("k").bitwiseAND(bits - 1)
    rows = (keys.select(both.alias("k")).select(F.shiftright(at, 6).alias("at"), F.expr("shiftleft(1L, CAST(k & 63 AS INT))").alias("bit"))
            .groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(max(1, bits // 64), np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def has_bits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether both bits of each key (unsigned 64-bit) are set."""
    last = np.uint64(len(bits) * 64 - 1)

    def one(k: np.ndarray) -> np.ndarray:
        return (bits[(k & last) >> np.uint64(6)] >> (k & np.uint64(63))) & np.uint64(1) > 0

    return one(keys) & one(keys >> np.uint64(32))
