"""Phrase collocation mining by vertically partitioned suffix trees (after ERA).

*Words.* ``A-Z`` are lower-cased, texts are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into
words ``[^\\x20\\x09]+``. A word of a language is a 64-bit key; the vocabulary, counted exactly by the
words themselves, is searched for two words with one key, and another seed is taken if there are any.
So a phrase, the keys of its words in a row, is exact.

*Vertical partitioning.* Prefixes grow by a word as long as they are frequent: one pass counts words, a
second one pairs of frequent words, a third one the prefixes of three words and more in which every pair is
frequent, and a fourth one writes the suffixes that begin with such a prefix of three words, cut at ``DEPTH``
words, at the end of the piece and before the first word that makes the prefix infrequent. Which words and pairs are
frequent goes to the tasks as a bit array of ``FILTER_BITS`` bits by hash, which longer prefixes as one of ``BUCKETS``
bits; their sizes are the same for any corpus, and a false bit only sends a suffix that no count needs. The
longer prefixes are counted by bucket alone: a bucket's count is the sum of its prefixes', so a bucket below the
threshold holds no frequent one. Equal suffixes are one leaf with a count (merged in each task, up to
``HELD_ROWS`` at a time, so a passage in a third of all documents is a few rows). Prefixes of two words are dealt into groups of about ``LEAVES`` leaves;
a prefix with more leaves is extended by a word until it fits.

*Subtrees.* Every group, one Arrow table of bounded size, is sorted into its suffix tree; the count of
a node is the sum of the leaves under it. Nodes above an extended prefix are summed over groups.

*Scores.* Cuts are equi-joins of the frequent phrases with themselves; products are decimals of 38 digits
and the quotient is exact. A phrase inside a longer one of the same count is inside one that is a word
longer, of the same count too, so only neighbours in length are compared.

Defined results: null and empty texts have no words; a null language is ``und``; repeated rows count as
often as they occur; ties follow the stated order (score, count, phrase), which is total within a
language; a text of any length is read whole, in slabs cut between pieces; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelake.llm.common import bit_filter, chunks, col, has_bits, span_hashes, utf8
from pricelake.session import freeze

DEPTH = 5
_ODD = np.array([3, 5, 7, 11, 13], np.uint64)
#: Bytes of text taken at once (a longer piece is taken whole).
SLAB = 2 << 20
#: Bits of the arrays of frequent words and pairs: 8 MB each.
FILTER_BITS = 1 << 26
#: Buckets of prefixes of three words and more, and buckets of a row that a task sends.
BUCKETS = 1 << 24
BLOCK = 1 << 14
#: Pairs, prefixes or leaves that a task holds to merge equal ones before it passes them on.
HELD_ROWS = 1 << 19
#: Leaves of a prefix that is not extended, and twice the mean of a group.
LEAVES = 1 << 17

# Classes of bytes (0 in a word, 1 blank, 2 end of a piece) and lower case.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[np.frombuffer(b".,;:!?\x0a\x0b\x0c\x0d", np.uint8)] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class Words:
    """The words of a slab: dictionary, codes, keys, row of each, and whether the next one is in the same piece."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, langs: list[str], seed: int):
        raw = LOWER[raw]
        kind = KIND[raw]
        inside = kind == 0
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        edges = offs[:-1][offs[:-1] < len(raw)]
        begin[edges] = inside[edges]
        letters = raw[inside]
        ends = np.append(np.flatnonzero(begin[inside]), len(letters)).astype(np.int64)
        at = np.flatnonzero(begin)
        self.row = np.searchsorted(offs, at, "right") - 1
        piece = np.cumsum(kind == 2, dtype=np.int32)[at]
        self.joined = (piece[1:] == piece[:-1]) & (self.row[1:] == self.row[:-1])
        found = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
        self.code, self.dictionary = found.indices.to_numpy(), found.dictionary
        own, spans = utf8(self.dictionary)
        self.names, self.lang = np.unique(np.array(langs, object), return_inverse=True)
        self.lang_keys = np.array([xxhash.xxh64_intdigest(x, seed) for x in self.names], np.uint64)
        with np.errstate(over="ignore"):
            self.word_keys = _mix(span_hashes(own, spans[:-1], spans[1:]) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))

    def key(self, code: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """The keys of words of languages; 0 is left free."""
        return np.maximum(_mix(self.word_keys[code] ^ self.lang_keys[lang]), np.uint64(1))

    def keys(self) -> np.ndarray:
        """The key of every word in order."""
        return self.key(self.code, self.lang[self.row])


def _cuts(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """A long text in parts of about ``SLAB`` bytes that end between pieces."""
    ends = np.flatnonzero(KIND[raw] == 2)
    a = 0
    while a < len(raw):
        i = np.searchsorted(ends, a + SLAB)
        b = int(ends[i]) + 1 if i < len(ends) else len(raw)
        yield a, b
        a = b


def slabs(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[Words]:
    """The words of (lang, text) rows, slab by slab."""
    def cut(held: list[pa.RecordBatch]) -> Iterator[Words]:
        rows = pa.Table.from_batches(held).combine_chunks()
        langs = rows.column(0).to_pylist()
        raw, offs = utf8(rows.column(1))
        for i, j in chunks(offs, SLAB):
            own = raw[offs[i]:offs[j]]
            if j == i + 1 and len(own) > SLAB:
                for a, b in _cuts(own):
                    yield Words(own[a:b], np.array([0, b - a]), langs[i:j], seed)
            elif len(own):
                yield Words(own, offs[i:j + 1] - offs[i], langs[i:j], seed)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SLAB:
            yield from cut(held)
            held, size = [], 0
    if held:
        yield from cut(held)


def _count_words(seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task body: (lang, word, key, n)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slabs(batches, seed):
            size = max(1, len(s.dictionary))
            both, n = np.unique(s.lang[s.row] * size + s.code, return_counts=True)
            lang, code = both // size, both % size
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.names.tolist(), pa.string()).take(pa.array(lang)), s.dictionary.take(pa.array(code)).cast(pa.binary()),
                 pa.array(s.key(code, lang).view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "word", "key", "n"])
    return run


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of keys, for the bit array alone."""
    with np.errstate(over="ignore"):
        return _mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def _merged(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows as one with their sum. Rows are brought together by a hash, and compared whole."""
    with np.errstate(over="ignore"):
        order = np.argsort(_mix((rows * _ODD[:rows.shape[1]]).sum(1)), kind="stable")
    rows, n = rows[order], n[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1)
    first = np.flatnonzero(new)
    return rows[first], np.add.reduceat(n, first) if len(first) else n


def _held(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The merged rows of slabs, merged with each other up to ``HELD_ROWS`` at a time."""
    held, size = [], 0
    for rows, n in found:
        held.append((rows, n))
        size += len(n)
        if size >= HELD_ROWS:
            yield _merged(*(np.concatenate(x) for x in zip(*held)))
            held, size = [], 0
    if held:
        yield _merged(*(np.concatenate(x) for x in zip(*held)))


def _count_pairs(words: np.ndarray, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task body: (a, b, n) of adjacent frequent words, by their keys."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for s in slabs(batches, seed):
            key = s.keys()
            known = has_bits(words, key)
            at = np.flatnonzero(s.joined & known[1:] & known[:-1])
            yield _merged(np.stack([key[at], key[at + 1]], 1), np.ones(len(at), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, n in _held(found(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].view(np.int64)), pa.array(rows[:, 1].view(np.int64)), pa.array(n)], ["a", "b", "n"])
    return run


def _pair_of(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(_pair(a.to_numpy().view(np.uint64), b.to_numpy().view(np.uint64)).view(np.int64))


def _phrases(rows: np.ndarray, depth: np.ndarray) -> pa.Array:
    """The first ``depth`` keys of each row as bytes."""
    data = rows.astype(">u8")[np.arange(rows.shape[1]) < depth[:, None]]
    offs = np.concatenate([[0], np.cumsum(8 * depth)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offs), pa.py_buffer(data.tobytes())])


def _suffixes(batches: Iterator[pa.RecordBatch], pairs: np.ndarray, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slab by slab: the suffixes that begin with two frequent pairs, ``DEPTH`` keys each, 0 from the first pair on that
    is not frequent; the buckets of their prefixes of three words and more (a column for each length)."""
    for s in slabs(batches, seed):
        key = s.keys()
        link = np.zeros(len(key) + DEPTH, bool)
        if len(key) > 1:
            link[:len(key) - 1] = s.joined & has_bits(pairs, _pair(key[:-1], key[1:]))
        at = np.flatnonzero(link[:-1] & link[1:])
        rows = np.zeros((len(at), DEPTH), np.uint64)
        key = np.concatenate([key, np.zeros(DEPTH, np.uint64)])
        on = np.ones(len(at), bool)
        rows[:, 0] = key[at]
        for k in range(1, DEPTH):
            on &= link[at + k - 1]
            rows[on, k] = key[at[on] + k]
        bucket = np.zeros((len(at), DEPTH - 2), np.int64)
        h = _pair(rows[:, 0], rows[:, 1])
        for k in range(2, DEPTH):
            h = _pair(h, rows[:, k])
            bucket[:, k - 2] = h & np.uint64(BUCKETS - 1)
        yield rows, bucket


def _count_prefixes(pairs: np.ndarray, seed: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task body: (block, at, n) of the prefixes of three words and more: the buckets found in a block of ``BLOCK``, each
    by two bytes, and their counts, ``least`` at most."""
    kind = np.min_scalar_type(least)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for rows, bucket in _suffixes(batches, pairs, seed):
            at, n = np.unique(bucket[rows[:, 2:] != 0], return_counts=True)
            yield at.view(np.uint64)[:, None], n.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, n in _held(found(batches)):
            order = np.argsort(rows[:, 0])
            at, n = rows[order, 0].astype(np.int64), np.minimum(n[order], least).astype(kind)
            edges = np.flatnonzero(np.diff(at // BLOCK, prepend=-1, append=BUCKETS // BLOCK + 1))
            spans = list(zip(edges[:-1], edges[1:]))
            low = (at % BLOCK).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(at[i]) // BLOCK for i, _ in spans], pa.int64()), pa.array([low[i:j].tobytes() for i, j in spans], pa.binary()),
                 pa.array([n[i:j].tobytes() for i, j in spans], pa.binary())], ["block", "at", "n"])
    return run


def _frequent_buckets(least: int) -> Callable[[pa.Table], pa.Table]:
    """Group body: the rows of a block into (block, bits): which of its buckets have ``least`` prefixes, as bytes of bits."""
    kind = np.min_scalar_type(least)

    def run(block: pa.Table) -> pa.Table:
        at, n = (np.frombuffer(utf8(block.column(c))[0].tobytes(), t) for c, t in (("at", np.uint16), ("n", kind)))
        bits = np.packbits(np.bincount(at, n, BLOCK) >= least, bitorder="little")
        return pa.table({"block": block.column("block").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})
    return run


def _write_suffixes(pairs: np.ndarray, prefixes: np.ndarray, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task body: (phrase, n) of the truncated suffixes that begin with a frequent prefix of three words."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for rows, bucket in _suffixes(batches, pairs, seed):
            on = np.logical_and.accumulate((rows[:, 2:] != 0) & (prefixes[bucket >> 3] >> (bucket & 7) & 1 > 0), 1)
            rows[:, 2:][~on] = 0
            rows = rows[on[:, 0]]
            yield _merged(rows, np.ones(len(rows), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, n in _held(found(batches)):
            yield pa.RecordBatch.from_arrays([_phrases(rows, (rows != 0).sum(1)), pa.array(n)], ["g", "n"])
    return run


def _subtree(least: int) -> Callable[[pa.Table], pa.Table]:
    """Group body: the leaves (g, n, depth of the prefix) of a group into the nodes (g, f) of their tree."""
    def run(leaves: pa.Table) -> pa.Table:
        raw, offs = utf8(leaves.column("g"))
        size = np.diff(offs) // 8
        rows = np.zeros((len(size), DEPTH), np.uint64)
        rows[np.arange(DEPTH) < size[:, None]] = np.frombuffer(raw.tobytes(), ">u8")
        n, own = leaves.column("n").to_numpy(), leaves.column("own").to_numpy()
        order = np.lexsort(rows.T[::-1])
        rows, n, own = rows[order], n[order], own[order]
        phrases, counts = [], []
        new = np.zeros(len(rows), bool)
        new[:1] = True
        for depth in range(1, DEPTH + 1):
            new[1:] |= rows[1:, depth - 1] != rows[:-1, depth - 1]
            first = np.flatnonzero(new)
            total = np.add.reduceat(n, first)
            node = (rows[first, depth - 1] != 0) & ((total >= least) | (depth < own[first])) & (depth > 2)
            phrases.append(_phrases(rows[first[node]], np.full(int(node.sum()), depth)))
            counts.append(total[node])
        return pa.table({"g": pa.concat_arrays(phrases), "f": pa.array(np.concatenate(counts))})
    return run


def words_of(texts: DataFrame) -> tuple[DataFrame, int]:
    """The stored vocabulary (lang, word, key, n) of (lang, text) rows, and the seed of its keys."""
    for seed in range(16):
        words = freeze(texts.mapInArrow(_count_words(seed), "lang string, word binary, key long, n long")
                       .groupBy("lang", "word", "key").agg(F.sum("n").alias("n")), "words")
        if words.groupBy("key").count().where("count > 1").isEmpty():
            return words, seed
    raise RuntimeError("words of equal keys under every seed")


def pairs_of(texts: DataFrame, words: DataFrame, seed: int, least: int) -> DataFrame:
    """The stored frequent pairs (a, b, n), by the keys of their words."""
    frequent = bit_filter(words.where(F.col("n") >= least), "key", FILTER_BITS)
    pairs = texts.mapInArrow(_count_pairs(frequent, seed), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return freeze(pairs.where(F.col("n") >= least), "pairs")


def prefixes_of(texts: DataFrame, pairs: np.ndarray, seed: int, least: int) -> np.ndarray:
    """The bytes of ``BUCKETS`` bits: which buckets hold ``least`` prefixes of three words and more."""
    rows = (texts.mapInArrow(_count_prefixes(pairs, seed, least), "block long, at binary, n binary")
            .groupBy("block").applyInArrow(_frequent_buckets(least), "block long, bits binary").toArrow())
    out = np.zeros((max(1, BUCKETS // BLOCK), BLOCK // 8), np.uint8)
    for block, bits in zip(rows.column("block").to_pylist(), rows.column("bits").to_pylist()):
        out[block] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def leaves_of(texts: DataFrame, pairs: DataFrame, seed: int, least: int = 1) -> DataFrame:
    """The stored leaves (g, n): distinct truncated suffixes that begin with a frequent prefix of three words."""
    frequent = bit_filter(pairs.select(F.arrow_udf(_pair_of, "long")("a", "b").alias("pair")), "pair", FILTER_BITS)
    prefixes = prefixes_of(texts, frequent, seed, least)
    return freeze(texts.mapInArrow(_write_suffixes(frequent, prefixes, seed), "g binary, n long").groupBy("g").agg(F.sum("n").alias("n")), "leaves")


def _part(g: Column | str, first: int, n: int = DEPTH) -> Column:
    """Words ``first`` (from 1) and on of a phrase, ``n`` at most."""
    return F.substring(g, 8 * first - 7, 8 * n)


def grouped(leaves: DataFrame) -> tuple[DataFrame, int]:
    """The leaves with the group ``grp`` of their prefix and its number of words ``own``; the number of groups."""
    out = leaves.withColumn("own", F.lit(2))
    for depth in range(2, DEPTH):
        prefix = _part("g", 1, depth)
        heavy = freeze(out.where(F.col("own") == depth).groupBy(prefix.alias("prefix")).count().where(F.col("count") > LEAVES).drop("count"), "heavy")
        if heavy.isEmpty():
            break
        out = (out.withColumn("prefix", prefix).join(heavy.withColumn("heavy", F.lit(True)), "prefix", "left")
               .withColumn("own", F.when(F.col("heavy"), depth + 1).otherwise(F.col("own"))).drop("prefix", "heavy"))
    groups = max(1, 2 * leaves.count() // LEAVES)
    prefix = F.substring(F.col("g"), F.lit(1), 8 * F.col("own"))
    return out.withColumn("grp", F.pmod(F.xxhash64(prefix), F.lit(groups))), groups


def phrases(texts: DataFrame, words: DataFrame, seed: int, least: int) -> DataFrame:
    """The stored frequent phrases (g, f) of one to ``DEPTH`` words."""
    pairs = pairs_of(texts, words, seed, least)
    leaves, _ = grouped(leaves_of(texts, pairs, seed, least))
    nodes = (leaves.groupBy("grp").applyInArrow(_subtree(least), "g binary, f long")
             .groupBy("g").agg(F.sum("f").alias("f")).where(F.col("f") >= least))
    single = words.where(F.col("n") >= least).select(_bytes("key").alias("g"), F.col("n").alias("f"))
    double = pairs.select(F.concat(_bytes("a"), _bytes("b")).alias("g"), F.col("n").alias("f"))
    return freeze(nodes.unionByName(single).unionByName(double), "phrases")


def _bytes(key: str) -> Column:
    return F.unhex(F.lpad(F.hex(key), 16, "0"))


def mine(docs: DataFrame, least: int = 100, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language."""
    texts = docs.select(F.coalesce(col(lang).cast("string"), F.lit("und")).alias("lang"), col(text).cast("string").alias("text"))
    words, seed = words_of(texts)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    spelled = words.where(F.col("n") >= least).select(_bytes("key").alias("w"), "lang", F.col("word").cast("string").alias("word"))
    grams = phrases(texts, words, seed, least)
    size = (F.octet_length("g") / 8).cast("int")
    candidates = grams.where(F.octet_length("g") > 8)

    longer = candidates.where(F.octet_length("g") > 16).select(
        F.explode(F.array(F.substring(F.col("g"), F.lit(1), F.octet_length("g") - 8), _part("g", 2))).alias("g"), "f")
    inside = longer.groupBy("g").agg(F.max("f").alias("longest"))
    kept = candidates.join(inside, "g", "left").where("longest IS NULL OR longest < f").select("g", F.col("f").alias("a"))

    cuts = kept.select("g", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    left, right = grams.select(F.col("g").alias("left"), F.col("f").alias("l")), grams.select(F.col("g").alias("right"), F.col("f").alias("r"))
    named = spelled.select(F.col("w").alias("head"), "lang").join(sizes, "lang")
    scored = (cuts.withColumn("left", F.substring(F.col("g"), F.lit(1), 8 * F.col("k")))
              .withColumn("right", F.substring(F.col("g"), 8 * F.col("k") + 1, F.lit(8 * DEPTH))).withColumn("head", _part("g", 1, 1))
              .join(left, "left").join(right, "right").join(named, "head")
              .withColumn("score", F.expr("(CAST(1000 AS DECIMAL(38,0)) * a * n) div (CAST(l AS DECIMAL(38,0)) * r)"))
              .groupBy("g", "lang", "n", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))

    at = scored.select("g", F.posexplode(F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(F.col("g"), 8 * i - 7, F.lit(8)))).alias("i", "w"))
    spelt = (at.join(spelled.select("w", "word"), "w").groupBy("g")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    return (scored.join(spelt, "g").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
            .withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


#: DuckDB SQL of the query's rows.
ORACLE = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^ \t]+') AS w
    FROM documents WHERE text IS NOT NULL
), n AS (
    SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang
), grams AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 6) t(k))
    GROUP BY ALL HAVING count(*) >= 100
), candidates AS (
    SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k >= 2
), cuts AS (
    SELECT c.lang, c.k, c.phrase, c.a, c.w, i, array_to_string(c.w[1:i], ' ') AS head, array_to_string(c.w[i + 1:], ' ') AS tail
    FROM (SELECT *, unnest(range(1, k)) AS i FROM candidates) c
), scored AS (
    SELECT cuts.lang, cuts.k, cuts.phrase, a, i, x.f AS l, y.f AS r, n,
           (CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS score
    FROM cuts JOIN grams x ON x.lang = cuts.lang AND x.phrase = head JOIN grams y ON y.lang = cuts.lang AND y.phrase = tail JOIN n ON n.lang = cuts.lang
), best AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1
), inside AS (
    SELECT lang, array_to_string(w[j:j + m - 1], ' ') AS phrase, max(a) AS longest
    FROM (SELECT lang, w, a, k, m, unnest(range(1, k - m + 2)) AS j FROM candidates, range(2, 5) t(m) WHERE m < k)
    GROUP BY ALL
), kept AS (
    SELECT b.* FROM best b LEFT JOIN inside s ON s.lang = b.lang AND s.phrase = b.phrase
    WHERE s.longest IS NULL OR 100 * s.longest < 100 * b.a
), ranked AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
           phrase, a, l, r, n, CAST(score AS BIGINT) AS score
    FROM kept
)
SELECT * FROM ranked WHERE rank <= 2000
"""
