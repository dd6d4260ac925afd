"""Classifier, quality rules, line dedup, SimHash dedup."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pricelake.llm import line_dedup, quality_classifier, quality_rules, simhash_dedup
from pricelake.llm.common import table
from pricelake.llm.components import components

from .helpers import SCHEMA, SF, base_statistics, docs, groups, words

ODD = [None, "", " \n\t", "x", "a a a a a a", "one two three\none two three\n\none two three", "é " * 300, "w" * 5000, "*** $$$ <a> & | " * 9]


def test_classifier_on_held_out_labels(spark):
    out = quality_classifier.classify(table(spark, SF, "documents"), table(spark, SF, "labels"))
    rows = out.join(table(spark, SF, "labels"), "doc_id").toPandas()
    held = rows[rows["held_out"]]
    assert len(out.columns) == 4 and len(held) > 50
    assert (held["predicted"] == held["quality"]).mean() > 0.95
    assert rows["score"].between(0, 1).all()


def test_classifier_edges(spark):
    d = docs(spark, ODD + [(2, "")]).withColumn("score", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(4, 1, 0), (5, None, 0), (6, 7, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_classifier.classify(d, none).collect()
    assert len(rows) == len(ODD) + 1 and all(r["score"] == 0.5 and r["predicted"] == 1 for r in rows)
    assert all(0.5 <= r["score"] < 1 for r in quality_classifier.classify(d, one).collect())
    assert quality_classifier.classify(docs(spark, []), one).count() == 0
    assert quality_classifier.keep_good(d, none).columns == d.columns


def test_labels_of_held_out_rows_do_not_matter(spark):
    d, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    turned = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_classifier.classify(d, x).orderBy("doc_id").toPandas()["score"] for x in (labels, turned))
    assert np.allclose(a, b)


def test_rows_of_a_labelled_id_are_fitted_once(spark, monkeypatch):
    seen = []
    fitted = quality_classifier.fit_network
    monkeypatch.setattr(quality_classifier, "fit_network", lambda x, *a: seen.append(len(x)) or fitted(x, *a))
    ids = [r["i"] for r in spark.range(1, 40).select(F.col("id").alias("i"), quality_classifier.held_out(F.col("id")).alias("h")).collect() if not r["h"]][:4]
    d = docs(spark, [(i, f"text {i} of row {k}") for i in ids for k in range(5)])
    quality_classifier.fit(d, spark.createDataFrame([(i, i % 2, 0) for i in ids], "doc_id long, quality int, toxic int"))
    assert seen == [4]


def test_base_statistics(spark):
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choices("ab", k=rng.randint(1, 40))).replace("a b", "a\nb") for _ in range(60)]
    for r in quality_rules.judge(docs(spark, texts)).collect():
        want = base_statistics(texts[r["doc_id"] - 1])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_outliers_go_and_the_rest_stays(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choices("etaoin", k=rng.randint(2, 8))) for _ in range(n))
    good = [prose(rng.randint(60, 400)) for _ in range(80)]
    bad = [" ".join(w + "***" for w in prose(100).split()) for _ in range(12)]
    rows = {r["doc_id"]: r for r in quality_rules.judge(docs(spark, good + bad)).collect()}
    assert all(rows[i + 1]["kept"] for i in range(80))
    assert not any(rows[81 + i]["kept"] or rows[81 + i]["base_failed"] for i in range(12))


def test_each_repetition_rejects_alone_and_a_header_does_not(spark):
    rng = random.Random(4)
    prose = lambda n: ["".join(rng.choices("etaoin", k=rng.randint(2, 8))) for _ in range(n)]
    lined = lambda w, k: "\n".join(" ".join(w[i:i + k]) for i in range(0, len(w), k))
    good = [lined(prose(rng.randint(60, 400)), 10) for _ in range(120)]
    header = " ".join(prose(13))
    headed = [f"{header}\n{lined(prose(n), 10)}\n{header}" for n in (40, 60, 100, 200, 380)]
    words_ = [" ".join((w := prose(n // 4)) + w + prose(n - 2 * (n // 4))) for n in (100, 200, 400)]    # half of the words
    lines = ["\n".join(["et", "on"] * 6 + [" ".join(prose(10)) for _ in range(30)]) for _ in range(3)]    # ten of 42 lines
    rows = {r["doc_id"]: r for r in quality_rules.judge(docs(spark, good + headed + words_ + lines)).collect()}
    assert all(rows[i + 1]["kept"] for i in range(125))
    assert not any(rows[126 + i]["kept"] or rows[126 + i]["base_failed"] for i in range(6))


def test_two_fifths_of_a_source_can_be_outliers(spark):
    rng = random.Random(5)
    prose = lambda n: ["".join(rng.choices("etaoin", k=rng.randint(2, 8))) for _ in range(n)]
    good = [" ".join(prose(rng.randint(60, 400))) for _ in range(120)]
    signs = [" ".join(w + "*" * rng.randint(0, 1) for w in prose(rng.randint(60, 400))) for _ in range(50)]
    long = [" ".join(w + w for w in prose(rng.randint(60, 400))) for _ in range(40)]
    rows = {r["doc_id"]: r for r in quality_rules.judge(docs(spark, good + signs + long)).collect()}
    assert all(rows[i + 1]["kept"] for i in range(120))
    assert not any(rows[121 + i]["kept"] or rows[121 + i]["base_failed"] for i in range(90))


def test_rules_keep_rows_and_columns(spark):
    d = docs(spark, ODD + ["word " * 10]).withColumn("kept", F.lit("x")).withColumn("m0", F.lit(1)).withColumn("lang", F.lit(None).cast("string"))
    long = docs(spark, [" ".join(f"w{i}" for i in range(80))]).withColumn("kept", F.lit("x")).withColumn("m0", F.lit(1))
    out = quality_rules.keep_good(d.unionByName(long).unionByName(long))
    assert out.columns == d.columns and out.count() == 2        # repeated rows are judged one by one
    assert quality_rules.judge(docs(spark, [])).count() == 0


def plain_lines(text):
    """(physical line, words) after wrapping, by the rule as the docstring states it."""
    out = []
    for k, line in enumerate(text.split("\n")):
        w = line.encode().split()
        if len(w) <= 24:
            out += [(k, w)] if w else []
            continue
        h = [xxhash.xxh3_64_intdigest(x) for x in w]
        h = [h[0]] + [((b ^ a >> 7) * 0x9E3779B97F4A7C15) % 2**64 for a, b in zip(h[:-1], h[1:])]
        cuts = [i for i in range(1, len(h)) if all(h[i] < y for y in h[max(0, i - 5):i]) and all(h[i] <= y for y in h[i + 1:i + 6])]
        for a, b in zip([0, *cuts], [*cuts, len(w)]):
            out += [(k, w[i:min(i + 24, b)]) for i in range(a, b, 24)]
    return out


def plain_line_dedup(rows):
    """(id, text) in order of id, without the three-line windows found earlier, by comparing words."""
    first, out = set(), {}
    for i, t in rows:
        lines = plain_lines(t or "")
        gone = set()
        for k in range(len(lines) - 2):
            key = tuple(tuple(w) for _, w in lines[k:k + 3])
            if key in first:
                gone |= {k, k + 1, k + 2}
            first.add(key)
        if not gone:
            out[i] = t
            continue
        cut = {lines[g][0] for g in gone}
        left = {}
        for g, (k, w) in enumerate(lines):
            if g not in gone:
                left.setdefault(k, []).extend(w)
        out[i] = "\n".join(b" ".join(left[k]).decode() if k in cut else x for k, x in enumerate(t.split("\n")) if k not in cut or k in left)
    return out


def test_line_dedup_against_plain_code(spark):
    rng = random.Random(3)
    texts = [None, "", "a\nb", "a\nb\nc"] + ["\n".join(rng.choice(["a", "b", "c", "", "d  e", "f " * 70]) for _ in range(rng.randint(1, 12))) for _ in range(80)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs(spark, texts).withColumn("n_later_windows", F.lit(1))).collect()}
    assert got == plain_line_dedup(list(enumerate(texts, 1)))


def test_long_passage_on_one_line(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    texts = ["intro one\n" + passage + "\nend", "other intro\n" + passage + "\nother end", "clean text\nof three\nlines"]
    got = [r["text"] for r in line_dedup.deduped_documents(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == [texts[0], "other intro\nother end", texts[2]]


def test_pieces_against_plain_code():
    rng = random.Random(6)
    texts = [None, "", " \n\t\n"]
    for _ in range(200):
        texts.append("".join(f"{rng.randint(0, rng.choice([1, 9, 999]))}{rng.choice([' ', '  ', chr(9)] * 20 + [chr(10), chr(10) * 2])}" for _ in range(rng.randint(1, 120))))
    p = line_dedup.Pieces(pa.array(texts))
    for d, t in enumerate(texts):
        own = range(p.doc_first[d], p.doc_first[d + 1])
        got = [[p.raw[p.start[w]:p.end[w]].tobytes() for w in np.flatnonzero(p.piece == k)] for k in own]
        assert got == [w for _, w in plain_lines(t or "")] and max(map(len, got), default=0) <= line_dedup.WRAP
    n, h1, h2 = p.windows()
    keys = [tuple(tuple(w) for _, w in plain_lines(t or "")[k:k + 3]) for t in texts for k in range(len(plain_lines(t or "")) - 2)]
    assert len(keys) == n.sum() and len(set(zip(keys, h1.tolist(), h2.tolist()))) == len(set(keys)) == len(set(h1.tolist()))


def test_full_filter(spark, monkeypatch):
    """With every bit set all places are written; the result is the same."""
    monkeypatch.setattr(line_dedup, "FILTER_BITS", 64)
    rng = random.Random(5)
    texts = ["\n".join(rng.choice(["a", "b", "c d"]) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs(spark, texts)).collect()}
    assert got == plain_line_dedup(list(enumerate(texts, 1)))


def test_long_passage_at_any_offset_of_a_line(spark):
    passage = " ".join(f"p{i}" for i in range(90))
    texts = ["start " + passage + " end"] + [" ".join(f"a{n}b{i}" for i in range(n)) + " " + passage + f" tail{n} of it" for n in range(1, 24)]
    got = [r["text"] for r in line_dedup.deduped_documents(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got[0] == texts[0]
    for text, cut in zip(texts[1:], got[1:], strict=True):
        left, own = cut.split(), [w for w in text.split() if w[0] != "p"]
        assert [w for w in left if w[0] != "p"] == own and sum(w[0] == "p" for w in left) < 45


def test_line_dedup_edges(spark):
    same = docs(spark, [(1, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (None, "x\ny\nz"), (2, "x\ny\nz")])
    out = line_dedup.deduped_documents(same)
    assert out.columns == same.columns
    assert sorted((r["doc_id"] or 0, r["text"], r["n_chars"]) for r in out.collect()) == [(0, "x\ny\nz", 5), (1, "a\nb\nc\nd", 7), (1, "a\nb\nc\nd", 7), (2, "", 0)]
    assert line_dedup.dedup(docs(spark, [])).count() == 0


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    texts = ODD + ["A b C", "a B c", "ab", "ÀB c d e f"]
    for r in simhash_dedup.near_duplicates(docs(spark, texts)).collect():
        assert r["fingerprint"] == f"{plain_fingerprint(texts[r['doc_id'] - 1]):016x}"


@pytest.mark.parametrize("crowded", [1, 4, 64])
def test_components_of_planted_fingerprints(spark, monkeypatch, crowded):
    """Chains and dense groups, with every share of crowded buckets, against all pairs."""
    monkeypatch.setattr(simhash_dedup, "CROWDED", crowded)
    monkeypatch.setattr(simhash_dedup, "BLOCK", 16)
    rng = random.Random(crowded)
    fps = [rng.getrandbits(64) for _ in range(150)] + [0]
    for _ in range(250):
        f = rng.choice(fps[100:])
        for b in rng.sample(range(64), rng.randint(0, 4)):
            f ^= 1 << b
        fps.append(f)
    rows = [(i + 1, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    got = {r["fp"]: r["component_id"] for r in simhash_dedup.fingerprint_components(spark.createDataFrame(rows, "id long, fp long"), 3).collect()}
    want = groups(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert [got[f] for _, f in rows] == [w + 1 for w in want]


def test_thresholds_follow_the_general_pigeonhole():
    rng = np.random.default_rng(0)
    sample = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    for m in (2, 3, 4):
        g = simhash_dedup.bit_groups(np.abs(rng.normal(size=(64, 64))), m)
        assert sorted(np.concatenate(g).tolist()) == list(range(64))
        for n in (100, 10**6, 10**10):
            assert sum(t + 1 for t in simhash_dedup.allocate(g, sample, n, 3)[1]) == 4


def test_keep_first(spark):
    text = " ".join(f"w{i}" for i in range(60))
    d = docs(spark, [(5, text), (3, text), (3, text), (7, "something else entirely here"), (8, None), (9, ""), (None, "n u l l")]).withColumn("kept_id", F.lit(1)).withColumn("kept_tie", F.lit(1))
    out = simhash_dedup.keep_first(d)
    assert out.columns == d.columns
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 3, 7, 8]
    assert simhash_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_keep_first_with_shared_and_null_ids(spark):
    """Unrelated texts of one id stay both; copies without an id shrink to one, also beside one with an id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    d = docs(spark, [(1, a), (1, b), (1, b), (None, c), (None, c), (None, a), (2, a + " end"), (None, None), (None, "")])
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in simhash_dedup.keep_first(d).collect()))
    assert got in ([(0, ""), (0, c), (1, a), (1, b)], [(0, ""), (0, c), (1, a), (1, b), (2, a + " end")])
    assert len(got) == 4 or len({plain_fingerprint(a), plain_fingerprint(a + " end")}) == 2


def test_components(spark):
    links = [(1, 2), (2, 1), (2, 3), (5, 5), (8, 7), (9, 8), (10, 9), (11, 10), (12, 11), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 10: 7, 11: 7, 12: 7}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
