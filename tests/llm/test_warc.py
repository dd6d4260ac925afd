"""WARC bundles: records, seek table, random access, digest columns against plain code."""

import glob
import hashlib

import pytest
import zstandard
from pyspark.sql import functions as F

from pricelake.llm import queries, warc
from pricelake.llm.common import table

from .helpers import SF

LONG = "<p>" + "é page " * 30
PAGES = [(5, "u5", LONG), (3, "u3\r\nX: y %0A", LONG), (9, None, LONG), (3, "again", LONG), (None, "n", LONG), (1, "u", None), (2, "u", ""), (4, "u", "x" * 99),
         (6, "u", "x" * 99), (7, "u", "y" * 100), (8, "u", "y" * 100), (None, "n", "z" * 200), (None, "m", "z" * 200), (10, "long", "ab\r\n\r\n" * 400_000)]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_round_trip(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_RECORDS", 3)
    d = pages(spark, PAGES).withColumn("size", F.lit("clash")).withColumn("digest", F.lit(1))
    index = warc.write(d.coalesce(2), tmp_dir)
    got = warc.read(index).collect()
    assert len(got) == len(PAGES)
    first = {LONG: 3, "y" * 100: 7}
    left = [(None if i is None else str(i), u, None if t in first and i != first[t] else (t or "").encode(),
             len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest(), str(first[t]) if t in first and i != first[t] else None) for i, u, t in PAGES]
    have = [(r["id"], r["url"], None if r["payload"] is None else bytes(r["payload"]), r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in got]
    assert sorted(left, key=repr) == sorted(have, key=repr)
    assert all((r["record_type"] == "revisit") == (r["refers_to"] is not None) for r in got)
    assert index.agg(F.max("frame")).first()[0] >= 1


def test_frames_are_independent_and_the_stream_is_plain_zstandard(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 2000)
    rows = [(i, f"u{i}", f"page {i} " * (i % 50 + 1)) for i in range(200)]
    index = warc.write(pages(spark, rows).coalesce(1), tmp_dir).collect()
    (path,) = {r["bundle"] for r in index}
    (file,) = glob.glob(f"{tmp_dir}/*.zst")
    raw = open(file, "rb").read()
    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    bundle = warc.Bundle(path)
    assert whole == b"".join(map(bundle.read, range(len(bundle.frames)))) and len(bundle.frames) > 20
    for r in index[::17]:
        at, size, _, _ = bundle.frames[r["frame"]]
        part = zstandard.ZstdDecompressor().decompress(raw[at:at + size])[r["offset"]:r["offset"] + r["length"]]
        assert part.startswith(b"WARC/1.1\r\n") and f"<{r['record_id']}>".encode() in part and part.endswith(b"\r\n\r\n")
    wanted = spark.createDataFrame([(index[3]["record_id"],), (index[150]["record_id"],), ("urn:record:none:0",)], "record_id string")
    frozen = spark.createDataFrame(index)
    assert {r["record_id"] for r in warc.lookup(frozen, wanted).collect()} == {index[3]["record_id"], index[150]["record_id"]}
    damaged = bytearray(raw)
    damaged[bundle.frames[1][0] + 30] ^= 1
    open(file, "wb").write(bytes(damaged))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        warc.Bundle(path).read(1)


def test_bundles_are_closed_when_full(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 500)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 1000)
    index = warc.write(pages(spark, [(i, "u", str(i) * 300) for i in range(30)]).coalesce(1), tmp_dir)
    assert index.select("bundle").distinct().count() > 3 and warc.read(index).count() == 30


def test_empty_table(spark, tmp_dir):
    index = warc.write(pages(spark, []), tmp_dir)
    assert index.count() == 0 and warc.read(index).count() == 0


def test_query_reads_every_page(spark):
    got = queries.QUERIES["op12_warc_bundles"](spark, SF)
    assert got.select("page_id").distinct().count() == table(spark, SF, "pages").count()
