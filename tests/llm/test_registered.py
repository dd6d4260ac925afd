"""The registered queries: SQL where there is one, plain code on whole tables where there is not."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pricelake.llm import queries
from pricelake.llm.common import table
from pricelake.plans import check

from .helpers import SF, base_statistics
from .test_text_ops import plain_fingerprint, plain_line_dedup


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, len(numbers) + 1)) and set(queries.ORACLES) <= set(queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "line_dedup", "simhash_dedup", "packing"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    r = check.compare(spark, SF, name, queries.QUERIES[name], queries.ORACLES[name], check.duck(SF))
    assert r["cols_match"] and r["values_match"], r


def test_whole_tables(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    for r in queries.QUERIES["op4_quality_rules"](spark, SF).collect():
        assert tuple(r)[1:6] == base_statistics(texts[r["doc_id"]])
    for r in queries.QUERIES["op5_simhash_dedup"](spark, SF).collect():
        assert r["fingerprint"] == f"{plain_fingerprint(texts[r['doc_id']]):016x}"
    got = {r["doc_id"]: r["text"] for r in queries.QUERIES["op7_line_dedup"](spark, SF).collect()}
    assert got == plain_line_dedup(sorted(texts.items()))


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    kept = [set(r["doc_id"] for r in docs.select("doc_id").collect())]
    df = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == docs.columns
        df = out.cache()
        kept.append(set(r["doc_id"] for r in df.select("doc_id").collect()))
    assert all(b <= a for a, b in zip(kept, kept[1:])) and kept[2] == kept[3]
    good = [i for i in kept[0] if labels.get(i) == 1]
    assert len([i for i in good if i in kept[1]]) > 0.98 * len(good)        # clean documents stay
    texts = {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    assert len({plain_fingerprint(t) for t in texts.values()}) == len(texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, df, SF)
    assert packed.select("doc_id").distinct().count() == len(texts)
    over = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count()
    assert over == 0


