"""Line dedup: overlapping windows of three lines, repeated anywhere in the corpus.

*Lines.* A text is split at ``\\n``; blank lines are left alone and skipped. A line of more than
``WRAP`` words counts as several lines (as if wrapped): it is broken before every word whose hash,
taken with the word before, is the least among ``REACH`` words on either side, and after ``WRAP``
words without such a place. The breaks follow the words and not their distance from the start of
the line, so a passage inside a longer line is cut into the same pieces at any offset, but for the
pieces at its ends. A piece has about 11 words; a passage of three whole pieces is a window of its
own, as is a line of over 2 x ``WRAP`` words. Lines are compared by their words, so white space does
not matter.

*Windows.* Every three consecutive lines are hashed to 128 bits. A window that occurs more than
once keeps its first occurrence, by (doc_id, text hash, position); the positions covered by all
other occurrences are merged per document and removed. Because the order is total and each removed
line has an equal line in an earlier place, one copy of every line stays somewhere. Lines that are
removed in part keep their other words.

*Plan.* The window hashes of each document are stored once. They are counted by 8 of their 16 bytes (pre-reduced
map-side: a window found in a third of all documents is fine); which ones repeat goes to the tasks as a bit array of
``FILTER_BITS`` bits, of the same size for any corpus, in which a false bit only costs a row. The places of
the windows with a set bit are written to the shared folder. One aggregate by the whole hash keeps the repeated ones
with their first place; an equi-join, split by AQE where a window is hot, gives the later places;
one aggregate merges them per document; one left join by document brings them to the texts. Words,
breaks and hashes of a batch are found by numpy at once.

Defined results: null text stays null, empty stays empty; texts of fewer than three lines are never
changed; rows that share doc_id and text are one document and are all cut alike; null ids come
first in the order; extra columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.llm.common import bit_filter, chunks, col, fresh, has_bits, utf8
from pricelake.session import freeze

WINDOW = 3
#: Words above which a line is wrapped, and of the longest piece.
WRAP = 24
#: Words on either side among which a break has the least hash.
REACH = 5
#: Bytes of text that are cut into words at once (one text may be longer).
SLAB = 8 << 20
#: Bits of the array of repeated windows: 16 MB.
FILTER_BITS = 1 << 27
#: White space between words.
_BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
#: Odd multipliers of the two halves of a hash, with their inverses modulo 2**64.
_FACTORS = [(np.uint64(p), np.uint64(pow(p, -1, 1 << 64))) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


class Pieces:
    """The words of a batch of texts and the pieces (lines after wrapping) that they form."""

    def __init__(self, texts: pa.Array):
        self.raw, self.offs = raw, offs = utf8(texts)
        inside = ~_BLANK[raw]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        edges = offs[:-1][offs[:-1] < len(raw)]
        begin[edges] = inside[edges]
        self.start = np.flatnonzero(begin)
        n = len(self.start)
        letters = raw[inside]
        ends = np.append(np.flatnonzero(begin[inside]), len(letters)).astype(np.int64)
        self.end = self.start + np.diff(ends)
        self.doc = np.searchsorted(offs, self.start, "right") - 1
        row = np.cumsum(raw == 10, dtype=np.int64)[self.start] + self.doc       # physical lines, numbered through all texts
        words = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
        known = np.frombuffer(b"".join([xxhash.xxh3_64_digest(w) for w in words.dictionary.to_pylist()]), ">u8").astype(np.uint64)
        self.word = known[words.indices.to_numpy()]

        new = np.ones(n, bool)
        new[1:] = row[1:] != row[:-1]
        self.row = np.cumsum(new) - 1                       # lines that hold a word
        self.row_first = np.append(np.flatnonzero(new), n)
        long = np.diff(self.row_first)[self.row] > WRAP if n else new
        cut = new | (long & self._least(new))
        held = np.maximum.accumulate(np.where(cut, np.arange(n), 0))
        cut |= long & ((np.arange(n) - held) % WRAP == 0)
        self.first = np.flatnonzero(cut)                    # first word of each piece
        self.piece = np.cumsum(cut) - 1
        self.piece_doc = self.doc[self.first]
        self.doc_first = np.searchsorted(self.piece_doc, np.arange(len(offs)))

    def _least(self, new: np.ndarray) -> np.ndarray:
        """Words whose hash, taken with the word before in the line, is the least within reach (the first of equal ones)."""
        with np.errstate(over="ignore"):
            h = np.where(new, self.word, (self.word ^ (np.roll(self.word, 1) >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15))
        least = np.ones(len(h), bool)
        for d in range(1, min(REACH, len(h) - 1) + 1):
            same = self.row[d:] == self.row[:-d]
            least[d:] &= ~same | (h[d:] < h[:-d])
            least[:-d] &= ~same | (h[:-d] <= h[d:])
        return least

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of windows of each text, and the two halves of each window's hash."""
        n = np.maximum(np.diff(self.doc_first) - WINDOW + 1, 0)
        at = np.repeat(self.doc_first[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        halves = []
        for p, q in _FACTORS:
            with np.errstate(over="ignore"):
                power, back = np.full(len(self.word), p, np.uint64), np.full(len(self.word), q, np.uint64)
                power[:1] = back[:1] = 1
                np.cumprod(power, out=power)
                np.cumprod(back, out=back)
                total = np.concatenate([[np.uint64(0)], np.cumsum(_mix(self.word + p) * power)])
                ends = np.append(self.first[1:], len(self.word))
                line = _mix((total[ends] - total[self.first]) * back[self.first] + (ends - self.first).astype(np.uint64))
                h = np.zeros(len(at), np.uint64)
                for k in range(WINDOW):
                    h = _mix(h * p + line[at + k])
            halves.append(h)
        return n, *halves


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


def _chunked(texts: pa.Array):
    """Texts in parts of about ``SLAB`` bytes."""
    _, offs = utf8(texts)
    for i, j in chunks(offs, SLAB):
        yield i, j, Pieces(texts.slice(i, j - i))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body: (id, tie, text) into (id, tie, h1, h2), the window hashes of each text in order as two lists."""
    def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        texts = rows.column("text").combine_chunks()
        for i, j, p in _chunked(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts):
            n, h1, h2 = p.windows()
            ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            own = [rows.column(c).slice(i, j - i).combine_chunks() for c in ("id", "tie")]
            yield pa.RecordBatch.from_arrays([*(c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in own),
                                              *(pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64))) for h in (h1, h2))], ["id", "tie", "h1", "h2"])

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= SLAB:
            yield from made(held)
            held, size = [], 0
    if held:
        yield from made(held)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body: (h1, n) of the windows of a batch."""
    for b in batches:
        h, n = np.unique(b.column("h1").flatten().to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], ["h1", "n"])


def _placed(bits: np.ndarray):
    """Task body: (id, tie, pos, h1, h2) of the windows whose bit is set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2 = (b.column(c).flatten().to_numpy() for c in ("h1", "h2"))
            n = np.diff(b.column("h1").offsets.to_numpy())
            set_ = np.flatnonzero(has_bits(bits, h1.view(np.uint64)))
            doc = np.repeat(np.arange(len(n)), n)[set_]
            pos = (np.arange(len(h1)) - np.repeat(np.cumsum(n) - n, n))[set_]
            own = b.select(["id", "tie"]).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(pos.astype(np.int32)), pa.array(h1[set_]), pa.array(h2[set_])], ["id", "tie", "pos", "h1", "h2"])
    return run


def _cut(pieces: Pieces, doc: int, starts: list[int]) -> bytes:
    """A text without the words of the pieces that its windows at ``starts`` cover."""
    text = pieces.raw[pieces.offs[doc]:pieces.offs[doc + 1]].tobytes()
    base, top = pieces.doc_first[doc], pieces.doc_first[doc + 1]
    gone = np.zeros(top - base, bool)
    for k in range(WINDOW):
        gone[np.array(starts) + k] = True
    if gone.all():
        return b"\n".join(x for x in text.split(b"\n") if not x.strip())
    first = np.append(pieces.first, len(pieces.start))
    lost = np.repeat(gone, np.diff(first[base:top + 1]))
    a, begin, out, at = int(first[base]), int(pieces.offs[doc]), [], 0
    for r in np.unique(pieces.row[a:a + len(lost)][lost]).tolist():                 # lines that lose words
        i, j = pieces.row_first[r:r + 2].tolist()
        x, y = (pieces.start[i:j] - begin).tolist(), (pieces.end[i:j] - begin).tolist()
        left = text.rfind(b"\n", 0, x[0]) + 1
        right = text.find(b"\n", y[-1])
        if left > at:
            out.extend(text[at:left - 1].split(b"\n"))
        kept = [text[u:v] for u, v, no in zip(x, y, lost[i - a:j - a].tolist(), strict=True) if not no]
        if kept:
            out.append(b" ".join(kept))
        at = len(text) + 1 if right < 0 else right + 1
    if at <= len(text):
        out.extend(text[at:].split(b"\n"))
    return b"\n".join(out)


def _remove(texts: pa.Array, starts: pa.Array) -> pa.Array:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    out = texts.cast(pa.binary()).to_pylist()
    own = starts.to_pylist()
    hit = [i for i, s in enumerate(own) if s and out[i] is not None]
    some = texts.take(pa.array(hit, pa.int64()))
    for i, j, pieces in _chunked(some):
        for k in range(i, j):
            out[hit[k]] = _cut(pieces, k - i, own[hit[k]])
    return pa.array(out, pa.binary()).cast(pa.string())


def later_windows(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """(id, tie, starts): per document the starts of windows that occur earlier in the corpus."""
    rows = docs.select(doc_id.alias("id"), F.xxhash64(text).alias("tie"), text.cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    each = freeze(rows.mapInArrow(_windows, f"id {kind}, tie long, h1 array<long>, h2 array<long>"), "windows")
    counts = each.select("h1").mapInArrow(_counted, "h1 long, n long").groupBy("h1").agg(F.sum("n").alias("n"))
    bits = bit_filter(counts.where("n > 1"), "h1", FILTER_BITS)
    places = freeze(each.mapInArrow(_placed(bits), f"id {kind}, tie long, pos int, h1 long, h2 long"), "places")
    place = F.struct("id", "tie", "pos")
    first = (places.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
             .where("first != last").drop("last"))
    return (places.join(first, ["h1", "h2"]).where(place != F.col("first"))
            .groupBy("id", "tie").agg(F.collect_set("pos").alias("starts")))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the cut text in place of ``text``, plus the number of windows found earlier in
    the column that ``windows_column`` names."""
    later = later_windows(docs, col(doc_id), col(text))
    n = windows_column(docs)
    starts = fresh(docs, "window_starts")
    later = later.select(F.col("id").alias(starts + "_id"), F.col("tie").alias(starts + "_tie"),
                         F.col("starts").alias(starts))
    rows = docs.join(later.hint("shuffle_hash"), col(doc_id).eqNullSafe(F.col(starts + "_id"))
                     & (F.xxhash64(col(text)) == F.col(starts + "_tie")), "left")
    cut = F.when(col(starts).isNull(), col(text)).otherwise(F.arrow_udf(_remove, "string")(col(text), col(starts)))
    return rows.select(*[cut.alias(c) if c == text else col(c) for c in docs.columns],
                       F.coalesce(F.size(col(starts)), F.lit(0)).alias(n))


def windows_column(docs: DataFrame) -> str:
    return fresh(docs, "n_later_windows")


def deduped_documents(docs: DataFrame) -> DataFrame:
    """Pipeline form: the columns of ``docs``, with ``n_chars`` following the cut text."""
    out = dedup(docs).drop(windows_column(docs))
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                             .otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[col(c) for c in docs.columns])
