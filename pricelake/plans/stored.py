"""Stored read structures of the registered queries (indexes, postings, rollups): built from the tables once
per session and table folder, written to the shared checkpoint folder, and read from there by every
query that follows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from pricelake.session import scratch_path

_PATHS: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], None]) -> str:
    """The path of the structure ``name``; ``build`` writes it there if this session has not yet."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _PATHS:
        path = scratch_path(spark, f"stored-{name}-{uuid.uuid4().hex}")
        build(path)
        _PATHS[key] = path
    return _PATHS[key]
