"""Best-fit packing of documents into token sequences by a grouping genetic algorithm.

*Pieces.* A document is its token ids (the library's own ids, whole text) and one closing id. Only
documents longer than a sequence are cut, into full pieces and a rest. Text is encoded chunk by
chunk between spaces and line ends: the tokenizer drops white space and none of its steps looks
across it, so the ids are those of the whole text. numpy cuts a slab of texts into chunks, and plain
chunks into the runs of letters, single digits and runs of symbols that the tokenizer would cut them
into; the distinct ones are encoded by the library, runs by its model alone (a cache of ``CACHE`` entries per worker, whose oldest
half goes when it is full), and the ids of a text are gathered by index.

*Packing.* Full pieces are sequences of their own. The others are dealt by a hash of their row
(equal rows spread too) into blocks of about ``BLOCK`` pieces; every block is evolved by ``ISLANDS`` islands, a Spark row each. An island
keeps a small population of packings made by best-fit over perturbed decreasing lengths. Crossover
injects the well-filled bins of one parent into another, dissolves the bins that hold an injected
piece a second time and a few of the emptiest, and best-fits the displaced pieces. After an epoch
the elite of each island migrates to the next one (a join by block); after the last one the best
island gives the block its bins. Bins that are filled to ``KEEP`` are final after the first round;
the pieces of all others are dealt anew into blocks and packed in a second round, whose bins are all
final. Blocks are bounded, so no task grows with the corpus.

Defined results: null and empty texts are one piece with the closing id alone; repeated rows are
packed like different documents; null ids are kept; ties are ordered by id and piece; an empty table
gives an empty result.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelake.llm.common import chunks, col, utf8
from pricelake.session import freeze

CAPACITY = 4096
CLOSING_ID = 1
CACHE = 500_000
BLOCK = 4096
ISLANDS = 3
EPOCHS = 2
POPULATION = 4
GENERATIONS = 10
KEEP = 0.995

_ENCODERS: dict[str, tuple] = {}
#: Bytes of text that are encoded at once (a longer text in parts that end at white space); the arrays of a slab
#: take about 30 times as much.
SLAB = 2 << 20

# Classes of bytes. The white space that separates chunks; letters, digits and symbols of
# printable ASCII; the bytes that only the tokenizer can judge (contractions, special tokens, other characters).
SPACE, LETTER, DIGIT, SYMBOL, HARD = range(5)
_CLASS = np.full(256, HARD, np.uint8)
_CLASS[33:127] = SYMBOL
_CLASS[48:58] = DIGIT
_CLASS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = LETTER
_CLASS[np.frombuffer(b"'<", np.uint8)] = HARD
_CLASS[np.frombuffer(b" \n", np.uint8)] = SPACE
#: A byte of a unit that only the tokenizer can judge.
_CALLS = re.compile(rb"['<\x00-\x20\x7f]|[\x80-\xff](?<!\xc3)(?<!\xc3.)|\xc3[\x97\xb7]", re.S)
#: How the tokenizer's model spells bytes: those without a visible character of their own, in order, from 256 on.
_UNSEEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_SHOWN = {b: chr(256 + i) for i, b in enumerate(_UNSEEN)}
#: First byte of the composed letters of Latin-1, and the second bytes that are signs.
_LATIN, _SIGNS = 0xC3, (0x97, 0xB7)


def _encoder(path: str):
    """The tokenizer of ``path`` and the cache of units."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _ENCODERS[path] = (Tokenizer.from_file(path), {})
    return _ENCODERS[path]


def split_units(raw: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The units of the texts in order and the text of each. A chunk between white space is cut into the
    lower-case runs that the tokenizer cuts it into, or stays whole if it holds a hard byte."""
    kind = _CLASS[raw]
    lead = np.flatnonzero(raw[:-1] == _LATIN)
    lead = lead[(raw[lead + 1] >= 0x80) & (raw[lead + 1] < 0xC0) & ~np.isin(raw[lead + 1], _SIGNS)]
    kind[lead] = kind[lead + 1] = LETTER
    inside = kind != SPACE
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offs[:-1][offs[:-1] < len(raw)]
    begin[edges] = inside[edges]

    kept = np.flatnonzero(inside)
    if not len(kept):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    kind, first = kind[kept], np.flatnonzero(begin[kept])
    chunk = np.cumsum(begin[kept], dtype=np.int32) - 1
    easy = ~np.logical_or.reduceat(kind == HARD, first)[chunk]
    low = raw[kept]
    upper = easy & (low >= 65) & (low <= 90)
    second = np.zeros(len(low), bool)
    second[np.searchsorted(kept, lead + 1)] = True
    upper |= easy & second & (low <= 0x9E)
    low = low + np.uint8(32) * upper
    cut = np.ones(len(kind), bool)
    cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    cut &= easy
    cut[first] = True
    ends = np.append(np.flatnonzero(cut), len(low)).astype(np.int64)
    row = np.searchsorted(offs, kept[ends[:-1]], "right") - 1
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(low)]), row


def _slab_ids(raw: np.ndarray, offs: np.ndarray, path: str) -> list[bytes]:
    """Token ids of each text, as little-endian unsigned 32-bit numbers. Distinct units are encoded once."""
    tokenizer, cache = _encoder(path)
    units, row = split_units(raw, offs)
    found = units.dictionary_encode()
    words = found.dictionary.to_pylist()
    new = [w for w in words if w not in cache]
    if len(cache) + len(new) > CACHE:                    # the oldest entries go; those of this slab must stay
        for w in list(itertools.islice(cache, len(cache) // 2)):
            del cache[w]
        new = [w for w in words if w not in cache]
    hard, model = [], tokenizer.model
    for w in new:                                        # a plain run is one word of the tokenizer: its model suffices
        if _CALLS.search(w):
            hard.append(w)
        else:
            own = model.tokenize(w.decode() if w.isascii() else w.decode("latin-1").translate(_SHOWN))
            cache[w] = struct.pack(f"<{len(own)}I", *[t.id for t in own])
    for w, e in zip(hard, tokenizer.encode_batch([w.decode() for w in hard], add_special_tokens=False), strict=True):
        cache[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)
    ids, ends = utf8(pa.array([cache[w] for w in words], pa.large_binary()).take(found.indices))
    at = ends[np.searchsorted(row, np.arange(len(offs)))].tolist()
    return [ids[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]


def _parts(raw: np.ndarray):
    """A long text in parts of about ``SLAB`` bytes that end at white space."""
    spaces = np.flatnonzero(_CLASS[raw] == SPACE)
    a = 0
    while a < len(raw):
        i = np.searchsorted(spaces, a + SLAB)
        b = int(spaces[i]) + 1 if i < len(spaces) else len(raw)
        yield raw[a:b]
        a = b


def encoded(texts: pa.Array, path: str) -> Iterator[bytes]:
    """The token ids of each text, as little-endian unsigned 32-bit numbers."""
    raw, offs = utf8(texts)
    for i, j in chunks(offs, SLAB):
        own = raw[offs[i]:offs[j]]
        if j == i + 1 and len(own) > SLAB:
            yield b"".join(_slab_ids(p, np.array([0, len(p)]), path)[0] for p in _parts(own))
        else:
            yield from _slab_ids(own, offs[i:j + 1] - offs[i], path)


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    def cut(batches):
        step, end = 4 * capacity, np.array([CLOSING_ID], "<u4").tobytes()

        def made(held):
            rows = pa.Table.from_batches(held).combine_chunks()
            found = [(i, k, at // 4, len(ids[at:at + step]) // 4, zlib.crc32(ids[at:at + step]))
                     for i, ids in enumerate(x + end for x in encoded(rows.column(1), path))
                     for k, at in enumerate(range(0, len(ids), step))]
            cols = list(zip(*found, strict=True)) if found else [[]] * 5
            return pa.RecordBatch.from_arrays(
                [rows.column(0).combine_chunks().take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()),
                 *(pa.array(c, pa.int64()) for c in cols[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= SLAB:
                yield made(held)
                held, size = [], 0
        if held:
            yield made(held)

    rows = docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"))
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return rows.mapInArrow(cut, schema)


def best_fit(order, lengths, bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Puts each item of ``order`` into the open bin with the least room that fits, or a new one."""
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(room):
        if r:
            by_room.setdefault(r, []).append(b)
            mask |= 1 << r
    for i in order:
        n = lengths[i]
        fits = mask >> n
        if fits:
            r = (fits & -fits).bit_length() - 1 + n
            b = by_room[r].pop()
            if not by_room[r]:
                mask &= ~(1 << r)
            bins[b].append(i)
            r -= n
        else:
            b, r = len(bins), capacity - n
            bins.append([i])
            room.append(r)
        room[b] = r
        if r:
            by_room.setdefault(r, []).append(b)
            mask |= 1 << r


def _fitness(room: list[int], capacity: int) -> float:
    """Falkenauer's: the mean squared fill, higher for fewer and for fuller bins."""
    return float(np.mean((1 - np.array(room) / capacity) ** 2)) if room else 1.0


def _cross(receiver, donor, lengths, capacity: int, rng):
    """Child of two packings: well-filled bins of the donor, then what is left of the receiver."""
    (bins_r, room_r), (bins_d, room_d) = receiver, donor
    full = [b for b, r in enumerate(room_d) if r <= 0.005 * capacity]
    if not full:
        full = np.argsort(room_d)[:max(1, len(room_d) // 4)].tolist()
    chosen = [full[k] for k in rng.permutation(len(full))[:max(1, int(len(full) * rng.uniform(0.3, 0.7)))]]
    bins = [bins_d[b][:] for b in chosen]
    room = [room_d[b] for b in chosen]
    injected = {i for b in bins for i in b}
    worst = set(np.argsort(room_r)[-max(2, len(room_r) // 50):].tolist())
    displaced = []
    for b, items in enumerate(bins_r):
        if b in worst or not injected.isdisjoint(items):
            displaced.extend(i for i in items if i not in injected)
        else:
            bins.append(items[:])
            room.append(room_r[b])
    displaced.sort(key=lambda i: -lengths[i] * (1 + 0.05 * rng.random()))
    best_fit(displaced, lengths, bins, room, capacity)
    return bins, room


def _unpack(assign, lengths, capacity: int):
    bins: list[list[int]] = [[] for _ in range(max(assign) + 1)]
    for i, b in enumerate(assign):
        bins[b].append(i)
    return bins, [capacity - sum(lengths[i] for i in b) for b in bins]


def evolve(lengths: list[int], guests: list[list[int]], seed, capacity: int = CAPACITY) -> tuple[list[int], int, float]:
    """The elite of an island after its generations: bin of each item, number of bins, fitness."""
    rng = np.random.default_rng(seed)
    people = [_unpack(g, lengths, capacity) for g in guests]
    value = np.array(lengths, float)
    while len(people) < POPULATION:
        order = np.argsort(-value * (1 + 0.02 * len(people) * rng.random(len(value))), kind="stable").tolist()
        bins, room = [], []
        best_fit(order, lengths, bins, room, capacity)
        people.append((bins, room))
    score = lambda p: (-len(p[0]), _fitness(p[1], capacity))
    people.sort(key=score, reverse=True)
    least = -(-sum(lengths) // capacity)
    for _ in range(GENERATIONS):
        if len(people[0][0]) <= least:
            break
        a, b = rng.choice(len(people), 2, replace=False)
        people[-1] = _cross(people[min(a, b)], people[max(a, b)], lengths, capacity, rng)
        people.sort(key=score, reverse=True)
    bins, room = people[0]
    assign = [0] * len(lengths)
    for b, items in enumerate(bins):
        for i in items:
            assign[i] = b
    return assign, len(bins), _fitness(room, capacity)


_ISLAND = "block bigint, island int, lengths array<bigint>, elite array<int>, n_bins int, fitness double"


def _epoch(epoch: int, capacity: int):
    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                guests = [g for g in (r["elite"], r["migrant"]) if g]
                r["elite"], r["n_bins"], r["fitness"] = evolve(r["lengths"], guests, [r["block"], r["island"], epoch], capacity)
            yield pa.RecordBatch.from_pylist(
                [{k: r[k] for k in ("block", "island", "lengths", "elite", "n_bins", "fitness")} for r in rows],
                pa.schema([("block", pa.int64()), ("island", pa.int32()), ("lengths", pa.list_(pa.int64())),
                           ("elite", pa.list_(pa.int32())), ("n_bins", pa.int32()), ("fitness", pa.float64())]))
    return run


def _sequences(part: int, schema: pa.Schema):
    """One row per piece: its bin's number (unique over tasks and rounds), offset and free room."""
    def run(batches):
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            items = batch.column("items")
            ends = np.cumsum([0, *(len(x) for x in items)])
            flat = items.flatten()
            for k, assign in enumerate(batch.column("elite").to_pylist()):
                assign = np.array(assign)
                own = flat.slice(ends[k], ends[k + 1] - ends[k])
                order = np.argsort(assign, kind="stable")
                length = own.field("length").to_numpy()[order]
                bins = assign[order]
                first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
                before = np.cumsum(length) - length
                offset = before - np.repeat(before[first], np.diff(np.append(first, len(bins))))
                fill = np.repeat(np.add.reduceat(length, first), np.diff(np.append(first, len(bins))))
                taken = own.take(pa.array(order))
                yield pa.RecordBatch.from_arrays(
                    [*(taken.field(f.name) for f in schema[:-3]),
                     pa.array((at + bins) * 4 + part), pa.array(offset), pa.array(fill)], schema=pa.schema(schema))
                at += int(assign.max()) + 1
    return run


def _pack_round(left: DataFrame, n: int, part: int, capacity: int) -> DataFrame:
    """Packs the pieces ``left`` (n rows) in blocks; adds sequence_id, offset and fill."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = left.sparkSession
    blocks = max(1, -(-n // BLOCK))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks * ISLANDS // 8))
    item = F.struct("length", *[c for c in left.columns if c != "length"])
    dealt = freeze(left.withColumn("block", F.pmod(F.xxhash64(F.lit(part), F.monotonically_increasing_id()), F.lit(blocks)))
                   .groupBy("block").agg(F.sort_array(F.collect_list(item), asc=False).alias("items")), "blocks")
    rows = (dealt.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
                         F.transform("items", lambda x: x["length"]).alias("lengths"))
            .withColumns({"elite": F.lit(None).cast("array<int>"), "migrant": F.lit(None).cast("array<int>")}))
    for epoch in range(EPOCHS):
        if epoch:
            moved = rows.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elite").alias("migrant"))
            rows = rows.drop("n_bins", "fitness").join(moved, ["block", "island"])
        rows = rows.select("block", "island", "lengths", "elite", "migrant").repartition(tasks, "block", "island")
        rows = freeze(rows.mapInArrow(_epoch(epoch, capacity), _ISLAND), "islands")
    best = rows.groupBy("block").agg(F.min_by("elite", F.struct("n_bins", -F.col("fitness"), "island")).alias("elite"))
    names = ["length", *[c for c in left.columns if c != "length"]]
    out = left.select(names).withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint"),
                                          "fill": F.lit(0).cast("bigint")})
    schema = to_arrow_schema(out.schema)
    return dealt.join(best, "block").select("items", "elite").mapInArrow(_sequences(part, [schema.field(i) for i in range(len(schema))]), out.schema)


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    all_ = freeze(pieces(docs, path, doc_id, text, capacity), "pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = (all_.where(F.col("length") == capacity)
            .withColumns({"sequence_id": F.monotonically_increasing_id() * 4 + 3, "offset": F.lit(0).cast("bigint")}))
    rest = all_.where(F.col("length") < capacity)
    first = freeze(_pack_round(rest, rest.count(), 0, capacity), "round")
    kept = F.col("fill") >= int(KEEP * capacity)
    left = first.where(~kept).select(all_.columns)
    second = _pack_round(left, left.count(), 1, capacity)
    return full.select(names).unionByName(first.where(kept).select(names)).unionByName(second.select(names))
