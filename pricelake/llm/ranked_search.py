"""Ranked lexical search over compressed quadtrees (K2-treaps) of a term-document grid.

*Grid.* Documents are dealt into blocks of at most ``BLOCK_DOCS`` documents and about ``BLOCK_BYTES``
bytes of text, as they are read. A block is a grid with a row for each of its terms (most frequent
first) and a column for each document (longest first); the value at a crossing is the impact of the
term there, ``(10^9 tf) div (1000 tf + 8 m)``. The grid is halved in both directions again and
again; a bitmap per level says which quadrants hold a value, and every cell knows the largest impact
inside it. Bitmaps and the values of the last level are stored, one row per block; the maxima of the
other levels follow from them and are rebuilt when a block is loaded.

*Search.* The terms of an item are rows of the grid. Their paths descend together over ranges of
documents: a range has, for every term, the cell where the term's row meets the range, and the sum of
weight times maximum over these cells bounds the score of each document in it. The ranges of the best
bounds, up to ``RANGES`` of a level, are halved ``FAN`` times together; single documents have exact
scores. The descent ends when no bound reaches the item's k-th best score, which a task carries from
block to block. Each task returns k documents an item, and a ranking window joins them.

*Plan.* One pass over the texts counts terms (two sums), a second one builds the blocks; no posting is
shuffled. Document frequencies are an aggregate of the blocks' own ones, pre-reduced per block. The
items come in batches of at most ``ITEMS`` items and ``ITEM_TERMS`` terms in all (an item with more is
alone); a batch goes to all tasks with the function, so it is bounded at any size of either table.

Defined results: null and empty texts hold no terms and are never found; repeated rows are documents
of their own, also if they share their id; equal scores are ordered by id, null ids last; items
without a known term have no rows; repeated items are ranked once, items that share an id but not
the text are ranked apart; a text of any length is read whole; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from pricelake.llm.common import chunks, col, utf8
from pricelake.session import freeze

#: Documents and bytes of text of a block (one document may be longer).
BLOCK_DOCS, BLOCK_BYTES = 4096, 8 << 20
#: Levels that a range of documents is halved at once.
FAN = 4
#: Ranges that are taken from the best ones at once.
RANGES = 32
#: Items and terms of a batch.
ITEMS, ITEM_TERMS = 1000, 1 << 18

_SIDES = np.arange(2, dtype=np.int32)[None, :, None]
_BYTES = np.arange(256)
#: Bytes of terms: digits, letters and all bytes of characters outside ASCII.
IN_TERM = (_BYTES >= 128) | np.isin(_BYTES, np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def split_terms(raw: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, and the row of each."""
    inside = IN_TERM[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offs[:-1][offs[:-1] < len(raw)]
    begin[edges] = inside[edges]
    letters = LOWER[raw[inside]]
    ends = np.append(np.flatnonzero(begin[inside]), len(letters)).astype(np.int64)
    row = np.searchsorted(offs, np.flatnonzero(begin), "right") - 1
    terms = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    return terms, row


def _n_terms(texts: pa.Array) -> pa.Array:
    raw, offs = utf8(texts)
    out = np.zeros(len(texts), np.int64)
    for i, j in chunks(offs):
        begin = IN_TERM[raw[offs[i]:offs[j]]]
        begin[1:] &= ~begin[:-1]
        edges = offs[i:j] - offs[i]
        edges = edges[edges < len(begin)]
        begin[edges] = IN_TERM[raw[offs[i]:offs[j]][edges]]
        total = np.concatenate([[0], np.cumsum(begin)])
        out[i:j] = np.diff(total[offs[i:j + 1] - offs[i]])
    return pa.array(out)


def _item_terms(texts: pa.Array) -> pa.Array:
    raw, offs = utf8(texts)
    terms, row = split_terms(raw, offs)
    each: list[set] = [set() for _ in range(len(texts))]
    for r, t in zip(row.tolist(), terms.to_pylist(), strict=True):
        each[r].add(t)
    return pa.array([sorted(x) for x in each], pa.list_(pa.binary()))


def _spread(x: np.ndarray) -> np.ndarray:
    """The 32 low bits of each number, with a zero after each."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Grid(NamedTuple):
    """A quadtree: cells per level, bitmaps of all levels but the last, values of the last."""

    sizes: list[int]
    bits: bytes
    leaves: bytes


def build_grid(row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int, columns: int) -> Grid:
    """The quadtree of distinct points (row, column) with their values."""
    height = max(1, int(rows - 1).bit_length(), int(columns - 1).bit_length())
    code = (_spread(row) << np.uint64(1)) | _spread(column)
    order = np.argsort(code)
    code, leaves = code[order], value[order].astype("<u4")
    sizes, bitmaps = [len(code)], []
    for _ in range(height):
        parent = code >> np.uint64(2)
        new = np.ones(len(parent), bool)
        new[1:] = parent[1:] != parent[:-1]
        bits = np.zeros(4 * int(new.sum()), np.uint8)
        bits[4 * (np.cumsum(new) - 1) + (code & np.uint64(3)).astype(np.int64)] = 1
        bitmaps.append(np.packbits(bits).tobytes())
        code = parent[new]
        sizes.append(len(code))
    return Grid(sizes[::-1], b"".join(bitmaps[::-1]), leaves.tobytes())


class Treap:
    """A loaded quadtree. Cells of a level count from 1; 0 is the empty cell."""

    def __init__(self, grid: Grid, columns: int):
        self.height = len(grid.sizes) - 1
        self.column_bits = max(1, int(columns - 1).bit_length())
        packed, at = np.frombuffer(grid.bits, np.uint8), 0
        self.child: list[np.ndarray] = []
        firsts = []
        for size in grid.sizes[:-1]:
            bits = np.unpackbits(packed[at:at + (4 * size + 7) // 8])[:4 * size]
            at += (4 * size + 7) // 8
            rank = np.cumsum(bits, dtype=np.int32)
            self.child.append(np.concatenate([np.zeros(4, np.int32), rank * bits]))
            held = np.concatenate([[0], rank[3::4]])
            firsts.append(held[:-1])
        best = np.frombuffer(grid.leaves, "<u4").astype(np.int64)
        self.best = [best]
        for first in firsts[::-1]:
            best = np.maximum.reduceat(best, first)
            self.best.append(best)
        self.best = [np.concatenate([[0], b]) for b in self.best[::-1]]

    def bands(self, rows: np.ndarray) -> np.ndarray:
        """The cell of each row's path from which on the documents are halved too."""
        cell = np.ones(len(rows), np.int64)
        for level in range(self.height - self.column_bits):
            cell = self.child[level][4 * cell + 2 * ((rows >> (self.height - 1 - level)) & 1)]
        return cell

    def top(self, rows: np.ndarray, weights: np.ndarray, cells: np.ndarray, k: int, best: list[tuple], ids: list) -> None:
        """Merge the k best documents of this block into ``best``, triples (-score, null id, id) in order."""
        start = self.height - self.column_bits
        turns = [2 * ((rows >> (self.height - 1 - deep)) & 1) for deep in range(start, self.height)]
        cells = cells.astype(np.int32)[None, :]
        waiting = {start: (self.best[start].take(cells) @ weights, np.zeros(1, np.int64), cells)}
        while waiting:
            level = max(waiting, key=lambda x: (waiting[x][0].max(), x))
            bound, at, now = waiting.pop(level)
            least = max(1, -best[-1][0]) if len(best) == k else 1
            order = np.argsort(-bound, kind="stable")
            order = order[:np.searchsorted(-bound[order], -least, "right")]
            if not len(order):
                return
            if len(order) > RANGES:
                rest = order[RANGES:]
                waiting[level] = bound[rest], at[rest], now[rest]
            at, now, to = at[order[:RANGES]], now[order[:RANGES]], min(level + FAN, self.height)
            for deep in range(level, to):
                down = 4 * now + turns[deep - start].astype(np.int32)
                now = self.child[deep].take(down[:, None, :] + _SIDES).reshape(-1, len(rows))
                at = (2 * at[:, None] + np.arange(2)).reshape(-1)
            score = self.best[to].take(now) @ weights
            worth = np.flatnonzero(score >= least)
            if to < self.height:
                if len(worth):
                    found = score[worth], at[worth], now[worth]
                    waiting[to] = tuple(np.concatenate(x) for x in zip(waiting[to], found, strict=True)) if to in waiting else found
                continue
            for i in worth[np.argsort(-score[worth], kind="stable")]:
                id_ = ids[at[i]]
                found = (-int(score[i]), id_ is None, 0 if id_ is None else id_)
                if len(best) < k or found < best[-1]:
                    best.append(found)
                    best.sort()
                    del best[k:]
                elif found[0] > best[-1][0]:
                    break


def _builder(n_docs: int, n_terms: int, kinds: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task body: (id, text) rows into blocks."""
    def block(ids: pa.Array, raw: np.ndarray, offs: np.ndarray) -> pa.RecordBatch | None:
        terms, doc = split_terms(raw, offs)
        length = np.bincount(doc, minlength=len(ids))
        longest = np.argsort(-length, kind="stable")
        longest = longest[length[longest] > 0]
        if not len(longest):
            return None
        column = np.zeros(len(ids), np.int64)
        column[longest] = np.arange(len(longest))
        encoded = terms.dictionary_encode()
        point = encoded.indices.to_numpy().astype(np.int64) * len(longest) + column[doc]
        point, tf = np.unique(point, return_counts=True)
        code, at = point // len(longest), point % len(longest)
        df = np.bincount(code, minlength=len(encoded.dictionary))
        common = np.argsort(-df, kind="stable")
        row = np.empty(len(common), np.int64)
        row[common] = np.arange(len(common))
        m = np.array([10 + 90 * int(n) * n_docs // n_terms for n in length[longest]], np.int64)
        grid = build_grid(row[code], at, 1_000_000_000 * tf // (1000 * tf + 8 * m[at]), len(common), len(longest))
        values = [ids.take(pa.array(longest)), encoded.dictionary.cast(pa.binary()).take(pa.array(common)), pa.array(df[common], pa.int32()), pa.array(grid.sizes, pa.int32())]
        columns = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values]
        return pa.RecordBatch.from_arrays([*columns, pa.array([grid.bits]), pa.array([grid.leaves])], schema=kinds)

    def cut(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        ids = rows.column(0).combine_chunks()
        raw, offs = utf8(rows.column(1))
        for i, j in chunks(offs, BLOCK_BYTES):
            for a in range(i, j, BLOCK_DOCS):
                b = min(a + BLOCK_DOCS, j)
                made = block(ids.slice(a, b - a), raw[offs[a]:offs[b]], offs[a:b + 1] - offs[a])
                if made is not None:
                    yield made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            n += batch.num_rows
            if size >= BLOCK_BYTES or n >= BLOCK_DOCS:
                yield from cut(held)
                held, size, n = [], 0, 0
        if held:
            yield from cut(held)
    return run


class Index(NamedTuple):
    """The stored blocks (ids, terms, dfs, sizes, bits, leaves) and the two corpus counts."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The grids of all documents, written as a table in the shared folder."""
    rows = docs.select(col(doc_id).alias("id"), col(text).cast("string").alias("text"))
    n = F.arrow_udf(_n_terms, "long")(F.col("text"))
    n_docs, n_terms = rows.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    schema = StructType([StructField("ids", ArrayType(rows.schema["id"].dataType)), StructField("terms", ArrayType(BinaryType())),
                         StructField("dfs", ArrayType(IntegerType())), StructField("sizes", ArrayType(IntegerType())),
                         StructField("bits", BinaryType()), StructField("leaves", BinaryType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    return Index(freeze(rows.mapInArrow(_builder(n_docs, n_terms, to_arrow_schema(schema)), schema), "grid-blocks"), n_docs, n_terms)


def weights(idx: Index, terms: DataFrame) -> DataFrame:
    """(term, w) of the distinct ``term`` values that occur in a document and have a weight."""
    own = idx.blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.dfs").alias("df"))
    df = own.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    ratio = F.lit(2 * idx.n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    return df.select("term", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("w")).where("w > 0")


def _searcher(batch: list[tuple[int, list[tuple[bytes, int]]]], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task body: blocks into (item, id, score), the k best documents of the task for each item."""
    known = sorted({t for _, own in batch for t, _ in own})
    at = {t: i for i, t in enumerate(known)}
    items = [(n, np.array([at[t] for t, _ in own], np.int64), np.array([w for _, w in own], np.int64)) for n, own in batch]
    wanted = pa.array(known, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {n: [] for n, _, _ in items}
        kind = None
        for blocks in batches:
            kind = blocks.schema.field("ids").type.value_type
            for i in range(blocks.num_rows):
                ids, terms, sizes = (blocks.column(c)[i].values for c in ("ids", "terms", "sizes"))
                ids = ids.to_pylist()
                treap = Treap(Grid(sizes.to_pylist(), blocks.column("bits")[i].as_py(), blocks.column("leaves")[i].as_py()), len(ids))
                row = pc.fill_null(pc.index_in(wanted, value_set=terms), -1).to_numpy().astype(np.int64)
                cell = np.where(row >= 0, treap.bands(np.maximum(row, 0)), 0)
                for n, own, weight in items:
                    here = row[own] >= 0
                    if here.any():
                        treap.top(row[own][here], weight[here], cell[own][here], k, best[n], ids)
        if kind is not None:
            found = [(n, None if null else id_, -score) for n, own in best.items() for score, null, id_ in own]
            cols = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], kind), pa.array(cols[2], pa.int64())], ["item", "id", "score"])
    return run


def _batches(rows: Iterator) -> Iterator[list]:
    held, n = [], 0
    for r in rows:
        if held and (len(held) >= ITEMS or n + len(r["terms"]) > ITEM_TERMS):
            yield held
            held, n = [], 0
        held.append((r["item"], [(bytes(t["term"]), t["w"]) for t in r["terms"]]))
        n += len(r["terms"])
    if held:
        yield held


def search(idx: Index, items: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    own = F.arrow_udf(_item_terms, "array<binary>")(col(text))
    each = freeze(items.groupBy(col(item_id).alias("item_id"), col(text).alias("text")).count()
                  .select("item_id", F.monotonically_increasing_id().alias("item"), own.alias("terms")), "items")
    exploded = each.select("item", F.explode("terms").alias("term"))
    weighted = freeze(exploded.join(weights(idx, exploded), "term").groupBy("item")
                      .agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("terms")), "item-weights")
    kind = idx.blocks.schema["ids"].dataType.elementType
    schema = StructType([StructField("item", LongType()), StructField("id", kind), StructField("score", LongType())])
    found = [freeze(idx.blocks.select("ids", "terms", "sizes", "bits", "leaves").mapInArrow(_searcher(batch, k), schema), "found")
             for batch in _batches(weighted.toLocalIterator())]
    hits = each.sparkSession.createDataFrame([], schema)
    for f in found:
        hits = hits.unionByName(f)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return (hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .join(each.select("item", "item_id"), "item")
            .select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score"))


#: DuckDB SQL of the query's rows.
ORACLE = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms
    FROM documents WHERE text IS NOT NULL
), grid AS (
    SELECT r, t AS term, count(*) AS tf FROM (SELECT r, unnest(terms) AS t FROM docs) GROUP BY ALL
), sizes AS (
    SELECT r, doc_id, len(terms) AS n FROM docs WHERE len(terms) > 0
), totals AS (
    SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes
), w AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM grid GROUP BY term), totals
), m AS (
    SELECT r, doc_id, 10 + (90 * n * n_docs) // n_terms AS m FROM sizes, totals
), items AS (
    SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'))) AS term
    FROM benchmark
), scores AS (
    SELECT item_id, r, doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * m.m))) AS BIGINT) AS score
    FROM items JOIN w USING (term) JOIN grid USING (term) JOIN m USING (r)
    GROUP BY ALL
), ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scores WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""
