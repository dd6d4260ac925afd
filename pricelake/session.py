"""Spark session settings the engine relies on.

Everything here is plain Spark configuration. The engine needs UTC session time (days are cut in UTC,
SURVEY §8.16), AQE for runtime coalescing and skew splitting, and a shared checkpoint folder for
lineage cuts. On a cluster the folder comes from ``spark.checkpoint.dir``; only a local session
(tests, bench) gets a scratch folder of its own.
"""

from __future__ import annotations

import os
import tempfile
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "pricelake", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine defaults applied."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in ENGINE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    apply_engine_conf(spark)
    return spark


def apply_engine_conf(spark: SparkSession) -> None:
    """Runtime-settable engine settings, for sessions created elsewhere (the driver's)."""
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled",
              "spark.sql.adaptive.skewJoin.enabled"):
        spark.conf.set(k, ENGINE_CONF[k])
    ship_package(spark)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``pricelake`` importable on the executors (the Pandas-function stages unpickle their
    functions there): zip the package once per context and ``addPyFile`` it."""
    import zipfile

    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="pricelake-pkg-", dir=os.environ.get("PRICELAKE_SCRATCH", "/tmp"))
    path = os.path.join(out, "pricelake.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    _SHIPPED.add(id(sc))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from the session (``spark.checkpoint.dir`` or the context's checkpoint dir). Only when the
    session runs in local mode and nothing is set does it fall back to a fresh scratch folder.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if d:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(d)
        return sc.getCheckpointDir() or d
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    d = tempfile.mkdtemp(prefix="pricelake-ckpt-", dir=os.environ.get("PRICELAKE_SCRATCH", "/tmp"))
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for a written intermediate table."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


_OWN = threading.local()


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Removes at its end, failed or not, the tables that ``freeze`` wrote in it (in this thread). Nothing that
    reads them may be used after it."""
    outer = getattr(_OWN, "scopes", [])
    _OWN.scopes = [*outer, own := []]
    try:
        yield
    finally:
        _OWN.scopes = outer
        for path in own:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside it; those before it come back at its end."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Shuffle files go when the query that wrote them ends, not when the driver's memory is collected. Only for steps that
#: store each result and run no plan twice.
DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def freeze(df, name: str, outer: bool = False):
    """Cut lineage by writing ``df`` as a parquet table under the shared checkpoint folder and
    reading it back: one pass (an eager ``checkpoint()`` computes its input twice: a count, then
    the write). Use where the partition layout need not survive; otherwise ``checkpoint()``.
    With ``outer`` the table outlives the innermost ``scratch_tables`` and goes with the one around it."""
    import uuid

    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    scopes = getattr(_OWN, "scopes", [])[:-1 if outer else None]
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.parquet(path)
