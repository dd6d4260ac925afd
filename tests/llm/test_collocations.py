"""Phrase collocations against plain counting, with small budgets so that prefixes are extended."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import functions as F

from pricelake.llm import collocations as co

from .helpers import SCHEMA


def pieces(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def plain(rows, least, top):
    out, langs = [], {}
    for lang, text in rows:
        langs.setdefault(lang or "und", []).extend(pieces(text))
    for lang, own in langs.items():
        n = sum(map(len, own))
        f = Counter(tuple(w[i:i + k]) for w in own for k in range(1, 6) for i in range(len(w) - k + 1))
        found = []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and b >= a and b >= least and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in f.items()):
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(8)
    vocabulary = ["the", "of", "A", "b", "É", "new", "york", "city", "x\x00y", "z"]
    rows = [(rng.choice(["en", "de", None]), " ".join(rng.choices(vocabulary, k=rng.randint(1, 40))).replace(" z ", rng.choice([". ", "\n", "\t", ", ", " z "]))) for _ in range(80)]
    rows += [("en", "one two three four five six seven, one two")] * 7 + [("en", None), ("en", ""), (None, "?!"), ("fr", "seul"), ("de", "b b b b b b b b. " * 40)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 0) for i, (g, t) in enumerate(rows)], SCHEMA)


def test_against_plain_counting(spark):
    rows = corpus()
    d = table(spark, rows).withColumn("n", F.lit(1)).withColumn("word", F.lit("x")).withColumn("g", F.lit(0))
    for least, top in ((2, 1000), (5, 12)):
        assert sorted(map(tuple, co.mine(d.repartition(4), least, top).collect())) == plain(rows, least, top)


def test_small_budgets(spark, monkeypatch):
    """Prefixes of more leaves than a group holds are extended; slabs are a few bytes; the filters are full."""
    rows = corpus()
    want = plain(rows, 3, 500)
    monkeypatch.setattr(co, "LEAVES", 2)
    monkeypatch.setattr(co, "SLAB", 64)
    texts = table(spark, rows).selectExpr("coalesce(lang, 'und') AS lang", "text")
    words, seed = co.words_of(texts)
    leaves, groups = co.grouped(co.leaves_of(texts, co.pairs_of(texts, words, seed, 3), seed))
    assert groups > 10 and leaves.agg(F.max("own")).first()[0] >= 4
    assert sorted(map(tuple, co.mine(table(spark, rows), 3, 500).collect())) == want
    monkeypatch.setattr(co, "FILTER_BITS", 64)
    assert sorted(map(tuple, co.mine(table(spark, rows), 3, 500).collect())) == want


def test_equal_keys_take_another_seed(spark, monkeypatch):
    count = co._count_words

    def one_key(batches):
        for b in count(0)(batches):
            yield b.set_column(2, "key", pa.array([7] * b.num_rows, pa.int64()))

    monkeypatch.setattr(co, "_count_words", lambda seed: count(seed) if seed else one_key)
    rows = [("en", " ".join(f"w{i}" for i in range(12)) + ".")] * 3
    words, seed = co.words_of(table(spark, rows).select("lang", "text"))
    assert seed == 1 and words.select("key").distinct().count() == words.count() == 12
    assert sorted(map(tuple, co.mine(table(spark, rows), 2, 50).collect())) == plain(rows, 2, 50)


def test_long_text_is_cut_between_pieces():
    text = ("ab cd ef. " * 500 + "gh " * 2000).encode()
    raw = np.frombuffer(text, np.uint8)
    parts = list(co._cuts(raw))
    assert parts[0][0] == 0 and parts[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array([text.decode(), "x y"])], ["lang", "text"])
    assert sum(len(s.code) for s in co.slabs(iter([batch]), 0)) == 3502


def test_exact_beyond_64_bits(spark):
    out = spark.range(1).selectExpr("(CAST(1000 AS DECIMAL(38,0)) * 3000000000000L * 9000000000000L) div (CAST(7000000000000L AS DECIMAL(38,0)) * 3000000000001L) AS s")
    assert out.first()["s"] == 1000 * 3 * 10**12 * 9 * 10**12 // (7 * 10**12 * (3 * 10**12 + 1))


def test_empty_table(spark):
    out = co.mine(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.count() == 0


def test_suffixes_of_infrequent_prefixes_are_not_sent(spark):
    """Many suffixes of frequent pairs only: none is a leaf unless its first three words are frequent."""
    rng = random.Random(4)
    rows = [("en", " ".join(rng.choices([f"w{i}" for i in range(14)], k=60))) for _ in range(120)] + [("en", "w1 w2 w3 w4 w5 w6.")] * 30
    texts = table(spark, rows).select("lang", "text").repartition(3)
    f = Counter(tuple(w[i:i + k]) for _, t in rows for w in pieces(t) for k in (2, 3) for i in range(len(w) - k + 1))
    assert min(n for p, n in f.items() if len(p) == 2) >= 16 and sum(n < 16 for p, n in f.items() if len(p) == 3) > 2000
    words, seed = co.words_of(texts)
    pairs = co.pairs_of(texts, words, seed, 16)
    frequent = sum(n >= 16 for p, n in f.items() if len(p) == 3)
    leaves = co.leaves_of(texts, pairs, seed, 16)
    assert leaves.selectExpr("substring(g, 1, 24) AS p").distinct().count() == frequent < 100
    assert sorted(map(tuple, co.mine(texts, 16, 500).collect())) == plain(rows, 16, 500)


def test_shared_buckets_and_small_holds(monkeypatch):
    """Task bodies alone: rows sent a few at a time, and buckets that many prefixes share, lose no frequent phrase."""
    rng = random.Random(3)
    rows = [("en", " ".join(rng.choices("abcd", k=20))) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows]), pa.array([t for _, t in rows])], ["lang", "text"])
    pairs = np.full(16, -1, np.int64).view(np.uint64)
    want = Counter(tuple(w[i:i + k]) for _, t in rows for w in pieces(t) for k in (3, 4, 5) for i in range(len(w) - k + 1))
    frequent, sent = {p for p, n in want.items() if n >= 12}, []
    monkeypatch.setattr(co, "SLAB", 100)
    for buckets, held in ((1 << 24, 1 << 19), (1 << 24, 10), (64, 10)):
        monkeypatch.setattr(co, "BUCKETS", buckets)
        monkeypatch.setattr(co, "BLOCK", min(1 << 14, buckets // 4))
        monkeypatch.setattr(co, "HELD_ROWS", held)
        found = pa.Table.from_batches(list(co._count_prefixes(pairs, 0, 12)(iter([batch]))))
        bits = np.zeros((buckets // co.BLOCK, co.BLOCK // 8), np.uint8)
        for k in set(found.column("block").to_pylist()):
            own = co._frequent_buckets(12)(found.filter(pa.compute.equal(found.column("block"), k)))
            bits[k] = np.frombuffer(own.column("bits")[0].as_py(), np.uint8)
        spell = {int(k): w for s in co.slabs(iter([batch]), 0) for k, w in zip(s.keys(), s.dictionary.take(pa.array(s.code)).to_pylist())}
        total = Counter()
        for b in co._write_suffixes(pairs, bits.reshape(-1), 0)(iter([batch])):
            for g, n in zip(b.column("g").to_pylist(), b.column("n").to_pylist()):
                w = tuple(spell[int(x)].decode() for x in np.frombuffer(g, ">u8"))
                for k in range(3, len(w) + 1):
                    total[w[:k]] += n
        assert frequent and {p: total[p] for p in frequent} == {p: want[p] for p in frequent}
        sent.append(len(total))
    assert sent[0] == sent[1] == len(frequent) < sent[2]
