"""Ranked search: the grid against plain points, the query's ranking against plain scoring."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricelake.llm import ranked_search as rs

from .helpers import SCHEMA, docs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, items, k=10):
    """(item, rank, doc_id, score) by scoring every row."""
    each = [(i, Counter(terms(t))) for i, t in rows]
    each = [(i, c) for i, c in each if c]
    n_docs, n_terms = len(each), sum(sum(c.values()) for _, c in each)
    df = Counter(t for _, c in each for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c in each:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def test_split_terms():
    texts = [None, "", "Ab9-É x", "a", "b c", "\x00z\x7fZ[`{", "naïve_x", "中文 ok", "a.", ".a"]
    raw, offs = rs.utf8(pa.array(texts))
    found, row = rs.split_terms(raw, offs)
    own = [[] for _ in texts]
    for r, t in zip(row, found.to_pylist()):
        own[r].append(t.decode())
    assert own == [terms(t) for t in texts]
    assert rs._n_terms(pa.array(texts)).to_pylist() == [len(terms(t)) for t in texts]


@pytest.mark.parametrize("rows,columns", [(1, 1), (1, 9), (9, 1), (40, 5), (5, 40), (64, 64)])
def test_grid_holds_its_points(rows, columns):
    rng = np.random.default_rng(rows * 100 + columns)
    points = {(int(r), int(c)): int(v) for r, c, v in zip(rng.integers(0, rows, 60), rng.integers(0, columns, 60), rng.integers(1, 10**6, 60))}
    r, c, v = (np.array(x) for x in zip(*[(a, b, x) for (a, b), x in points.items()]))
    treap = rs.Treap(rs.build_grid(r, c, v, rows, columns), columns)
    assert treap.best[0][1] == v.max()
    for row in range(rows):
        own = sorted((-x, False, b) for (a, b), x in points.items() if a == row)
        best: list = []
        if own:
            at = np.array([row])
            treap.top(at, np.array([1]), treap.bands(at), 4, best, list(range(columns)))
        assert best == own[:4]


def test_against_plain_scoring(spark, monkeypatch):
    monkeypatch.setattr(rs, "BLOCK_DOCS", 13)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["É", "中", "A-b", "the", "the", "the"]
    rows = [(1, None), (2, ""), (None, "the w1 w2"), (3, ". - ."), (7, "w1 w1 w2"), (7, "w1 w1 w2"), (7, "w3")]
    rows += [(rng.randint(0, 60), " ".join(rng.choices(words, k=rng.randint(1, 40)))) for _ in range(150)] + [(99, "w5 " * 5000)]
    items = [(1, "w1 w2 THE w3"), (1, "w1 w2 THE w3"), (1, "w7"), (2, None), (3, "unknown"), (4, " ".join(words)), (5, "É 中 a b"), (6, "the")]
    d = docs(spark, rows).withColumn("score", F.lit(0)).withColumn("id", F.lit("x"))
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("terms", F.lit(1)).withColumn("rank", F.lit(1))
    got = [tuple(r) for r in rs.search(rs.index(d.repartition(3)), q).collect()]
    assert sorted(got, key=repr) == plain(rows, items)
    monkeypatch.setattr(rs, "ITEMS", 2)                     # batches of items
    assert sorted((tuple(r) for r in rs.search(rs.index(d), q).collect()), key=repr) == plain(rows, items)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rs.search(rs.index(none), items).count() == 0
    assert rs.search(rs.index(docs(spark, ["a", "b"])), items.limit(0)).count() == 0
    out = rs.search(rs.index(docs(spark, ["a", "b"])), items)
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 1
