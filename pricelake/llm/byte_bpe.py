"""Byte-level BPE encoding and decoding with Spark higher-order functions.

*Tables.* The rank file becomes four literals: ``starts`` maps a prefix of a token to the ranks of the
tokens that may start with it (an array of small maps by the hash of the prefix, since a lookup in
one large map is a linear search), ``merges`` has the pair that each token is merged from, ``names``
the decimal id of each character of a fold, ``pieces`` the hex bytes of each id. They are bound once
per expression, so a task carries one copy of each.

*Encoding.* A text is split by the pattern. The state of a fold is a string with one character a
token, at first one a byte. The tokens that may occur in the word are looked up by the prefixes at
its bytes; the fold takes them in the order of their ranks, and each step replaces every occurrence
of the pair that a token is merged from, from left to right. That is the merge of the lowest rank
first, because in an ordered rank file every token comes from one pair of tokens of lower ranks, so
no step makes a pair whose turn is over (``_splits`` proves this token by token when the file is
read). A file that is not ordered is folded by ``fold_steps``: a step merges the leftmost pair of
the lowest rank and looks up the two pairs that the new token forms; its state is two strings of ids
of four hex digits, between end marks: the tokens, and what each would merge to with its
predecessor. Words are folded where they are distinct: the ``COMMON`` most frequent words of a
sample once up front into two more literals (a cache of bounded size: which words it holds changes
the time, not the ids), all others once per slice of ``SLICE`` words of a document, so the work on a
very long text stays in proportion to its length. Nothing is shuffled but the counts of the sampled
words.

*Decoding.* Every id gives its piece; the pieces are concatenated to the bytes of the text.

Defined results: null and empty texts have no tokens and empty bytes; repeated rows are encoded one
by one; extra columns are ignored; an empty table gives an empty result. One unbroken word of n
bytes costs n squared at most, as in the library.
"""

from __future__ import annotations

import base64
import json
from functools import cached_property

import public_tokenizers
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.llm.common import col

BUCKETS = 1 << 16
#: End marks of the fold's strings, and "does not merge"; greater than any id.
NONE = "ZZZZ"
COMMON = 250_000
COMMON_SLOTS = 1 << 18
#: Share of the documents whose words are counted for the cache.
SAMPLE = 0.08
SLICE = 4096
#: Lengths of the prefixes by which tokens are looked up, longest first.
PREFIXES = (6, 4, 3, 2)

#: Java's \\s is ASCII without (?U).
PATTERN = "(?U)" + public_tokenizers.PATTERN


def _hash(*keys: bytes) -> int:
    """Spark's ``xxhash64`` of strings, unsigned."""
    seed = 42
    for k in keys:
        seed = xxhash.xxh64_intdigest(k, seed)
    return seed


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _char(piece: bytes, rank: int) -> str:
    """The character of a token in the string of a fold: a byte, or after those, without the surrogates."""
    return chr(piece[0] if len(piece) == 1 else rank + 256 if rank + 256 < 0xD800 else rank + 256 + 0x800)


def _splits(ranks: dict[bytes, int]) -> dict[bytes, tuple[bytes, bytes]] | None:
    """The pair that each token is merged from, if merging the bytes of any token by lower ranks ends in one pair of
    tokens of lower ranks, and no two ranks are equal; else None."""
    out = {}
    for piece, rank in ranks.items():
        parts = [piece[k:k + 1] for k in range(len(piece))]
        while len(parts) > 2:
            low, k = min((ranks.get(a + b, rank), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if low >= rank:
                return None
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        if len(piece) > 1:
            if any(len(p) > 1 and ranks[p] >= rank for p in parts):
                return None
            out[piece] = (parts[0], parts[1])
    return out if len(set(ranks.values())) == len(ranks) else None


class Tables:
    """The literals of one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ids beyond 16 bits")
        pieces = [""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece.hex()
        self.ranks = ranks
        self.pieces = F.split(F.lit(" ".join(pieces)), " ", -1)
        splits = _splits(ranks)
        self.ordered = splits is not None
        if self.ordered:
            self._by_rank(splits)
        self.with_common([])

    def _by_rank(self, splits: dict[bytes, tuple[bytes, bytes]]) -> None:
        """Sets the tables of ``fold``."""
        ranks = self.ranks
        char = {piece: _char(piece, ranks[piece]) for piece in [*splits, *(bytes([b]) for b in range(256))]}
        names = [""] * (max(map(ord, char.values())) + 1)
        for piece, c in char.items():
            names[ord(c)] = str(ranks[piece])
        starts: dict[bytes, set[int]] = {piece[:k]: set() for piece in splits for k in PREFIXES if k <= len(piece)}
        for prefix, found in starts.items():
            found.update(ranks[prefix[:k]] for k in range(2, len(prefix) + 1) if prefix[:k] in splits)
        for piece, rank in ranks.items():
            longest = next((k for k in PREFIXES if k <= len(piece)), None)
            if longest:                              # a word without a longer prefix in the table has no longer token here
                starts[piece[:longest]].add(rank)
        buckets: list[dict[str, list[int]]] = [{} for _ in range(BUCKETS)]
        for prefix, found in starts.items():
            key = prefix.decode("latin-1")
            buckets[_hash(key.encode()) % BUCKETS][key] = sorted(found)
        merges: list[dict | None] = [None] * (max(ranks.values()) + 1)
        for piece, (a, b) in splits.items():
            merges[ranks[piece]] = {"pair": char[a] + char[b], "c": char[piece]}
        self.starts = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,array<int>>>")
        self.merges = F.from_json(F.lit(json.dumps(merges)), "array<struct<pair:string,c:string>>")
        self.names = F.split(F.lit(" ".join(names)), " ", -1)

    @cached_property
    def bytes(self) -> Column:
        return F.split(F.lit(" ".join(f"{self.ranks[bytes([b])]:04X}" for b in range(256))), " ", -1)

    @cached_property
    def pairs(self) -> Column:
        """What every pair of ids merges to, for ``fold_steps``."""
        name = {piece: f"{rank:04X}" for piece, rank in self.ranks.items()}
        pairs: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
        for piece in self.ranks:
            for k in range(1, len(piece)):           # every pair of tokens that joins to this one
                a, b = name.get(piece[:k]), name.get(piece[k:])
                if a and b:
                    pairs[_hash(a.encode(), b.encode()) % BUCKETS][a + b] = name[piece]
        return F.from_json(F.lit(json.dumps(pairs)), "array<map<string,string>>")

    def fold(self, word: Column, e: Column) -> Column:
        """Ids of a word in decimal, joined by one space; ``e`` has the tables ``FOLDS[self.ordered]``."""
        return fold(word, e) if self.ordered else fold_steps(word, e)

    def with_common(self, words: list[tuple[str, str]]) -> Tables:
        """Sets the cache: two arrays of slots with ``word\\2ids``, ids in decimal. A word takes its
        slot in the first, else its slot in the second, else it is not cached."""
        slots = [[""] * COMMON_SLOTS, [""] * COMMON_SLOTS]
        for word, ids in words:
            if not set(word) & {"\1", "\2"}:
                h = _hash(word.encode())
                for k, at in enumerate((h % COMMON_SLOTS, (h >> 32) % COMMON_SLOTS)):
                    if not slots[k][at]:
                        slots[k][at] = f"{word}\2{ids}"
                        break
        self.common, self.common2 = (F.split(F.lit("\1".join(s)), "\1", -1) for s in slots)
        return self

    def bind(self, body, *names: str) -> Column:
        """``body`` of a struct of the named tables, by default those of ``fold_steps``."""
        return _let(F.struct(*[getattr(self, n).alias(n) for n in names or FOLDS[False]]), body)


#: Tables that a fold takes, by whether the file is ordered.
FOLDS = {True: ("starts", "merges", "names"), False: ("pairs", "bytes")}


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(PATTERN), F.lit(0))


def _merged(e: Column, a: Column, b: Column) -> Column:
    """The id that a pair of ids merges to, or ``NONE``."""
    bucket = F.get(e["pairs"], F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)).cast("int"))
    return F.coalesce(F.try_element_at(bucket, F.concat(a, b)), F.lit(NONE))


def _least(r: Column) -> Column:
    """The lowest rank of the string of what tokens merge to."""
    return F.array_min(F.split(r, " "))


def _step(e: Column, acc: Column) -> Column:
    """Merges the leftmost pair of the lowest rank ``m``, if any; a word that is done is passed on as it is. An id is at
    position 5 i + 1 of its string; a match is never across ids, because they are separated by spaces."""
    t, r, m = acc["t"], acc["r"], acc["m"]
    part = lambda c, at: F.substring(c, at, F.lit(4))

    def at(q: Column) -> Column:
        ranks = F.concat(F.substring(r, F.lit(1), q - 6), _merged(e, part(t, q - 10), m), F.lit(" "),
                         _merged(e, m, part(t, q + 5)), F.substring(r, q + 9, F.length(r)))
        return _let(ranks, lambda x: F.struct(
            F.concat(F.substring(t, F.lit(1), q - 6), m, F.substring(t, q + 4, F.length(t))).alias("t"), x.alias("r"), _least(x).alias("m")))

    return F.when(m == NONE, acc).otherwise(_let(F.instr(r, m), at))


def fold(word: Column, e: Column) -> Column:
    """Ids of a word in decimal, joined by one space, by an ordered file: its tokens by rank, all places of a pair at once."""
    none = F.array().cast("array<int>")

    def starting(raw: Column, at: Column) -> Column:
        def look(key: Column) -> Column:
            return F.try_element_at(F.get(e["starts"], F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")), key)
        return F.coalesce(*[look(F.substring(raw, at, F.lit(k))) for k in PREFIXES], none)

    def merged(raw: Column, found: Column) -> Column:
        order = F.sort_array(F.when(F.size(found) > 256, F.array_distinct(found)).otherwise(found))
        done = F.aggregate(F.transform(order, lambda rank: F.get(e["merges"], rank)), raw, lambda acc, m: F.replace(acc, m["pair"], m["c"]))
        return F.array_join(F.transform(F.split(done, "", -1), lambda c: F.get(e["names"], F.ascii(c))), " ")

    one_a_byte = F.when(F.octet_length(word) == F.char_length(word), word).otherwise(F.decode(word.cast("binary"), "ISO-8859-1"))
    return _let(one_a_byte, lambda raw: _let(F.flatten(F.transform(
        F.sequence(F.lit(1), F.char_length(raw)), lambda at: starting(raw, at))), lambda found: merged(raw, found)))


def fold_steps(word: Column, e: Column) -> Column:
    """Ids of a word in decimal, joined by one space, by any file: one merge a step. The lowest rank is carried along, so
    the steps after the last merge search nothing; cutting strings is several times cheaper than slicing arrays."""
    n = F.octet_length(word)
    plain = F.transform(F.sequence(F.lit(1), n), lambda i: F.get(e["bytes"], F.ascii(F.substring(word, i, F.lit(1)))))
    other = _let(F.hex(word.cast("binary")), lambda h: F.transform(F.sequence(F.lit(1), n), lambda i: F.get(
        e["bytes"], F.conv(F.substring(h, 2 * i - 1, F.lit(2)), 16, 10).cast("int"))))
    ranks = lambda ids: F.concat(F.lit(f"{NONE} {NONE} "), F.array_join(F.transform(
        F.slice(ids, F.lit(2), n), lambda b, i: F.concat(_merged(e, F.get(ids, i), b), F.lit(" "))), ""), F.lit(NONE))
    start = _let(F.when(n == F.char_length(word), plain).otherwise(other), lambda ids: _let(ranks(ids), lambda r: F.struct(
        F.concat(F.lit(f"{NONE} "), F.array_join(ids, " "), F.lit(f" {NONE}")).alias("t"), r.alias("r"), _least(r).alias("m"))))
    done = F.aggregate(F.sequence(F.lit(1), n), start, lambda acc, _: _step(e, acc))
    ids = F.filter(F.split(done["t"], " "), lambda x: x != NONE)
    return F.array_join(F.transform(ids, lambda x: F.conv(x, 16, 10)), " ")


def _slice_ids(some: Column, e: Column, tables: Tables) -> Column:
    """Ids of a slice of words: from the cache, else folded once per distinct word."""
    def cached(slots: Column, at: Column, w: Column) -> Column:
        return _let(F.get(slots, F.pmod(at, F.lit(COMMON_SLOTS)).cast("int")), lambda x: F.when(
            F.startswith(x, F.concat(w, F.lit("\2"))), F.substring_index(x, "\2", -1)))

    def known(w: Column) -> Column:
        h = F.xxhash64(w)
        return F.coalesce(cached(e["common"], h, w), cached(e["common2"], F.shiftrightunsigned(h, 32), w))

    def joined(hit: Column) -> Column:
        rare = F.array_distinct(F.filter(some, lambda w, i: F.get(hit, i).isNull()))
        return _let(rare, lambda rw: _let(F.transform(rw, lambda w: tables.fold(w, e)), lambda ids: F.array_join(
            F.transform(some, lambda w, i: F.coalesce(F.get(hit, i), F.get(ids, F.array_position(rw, w).cast("int") - 1))), " ")))

    return _let(F.transform(some, known), joined)


def ids_text(text: Column, tables: Tables) -> Column:
    """Ids of a whole text in decimal, joined by one space."""
    return tables.bind(lambda e: _let(words(text), lambda w: F.array_join(F.transform(
        F.sequence(F.lit(0), F.floor((F.size(w) + SLICE - 1) / SLICE).cast("int")),
        lambda k: F.when(k * SLICE < F.size(w), _slice_ids(F.slice(w, k * SLICE + 1, F.lit(SLICE)), e, tables))), " ")),
        *FOLDS[tables.ordered], "common", "common2")


def decode(ids: Column, tables: Tables) -> Column:
    """The bytes of an array of ids."""
    return _let(tables.pieces, lambda pieces: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")))


def common_words(docs: DataFrame, tables: Tables, text: str = "text") -> list[tuple[str, str]]:
    """The most frequent words of a sample of documents with their ids; at most ``COMMON`` rows."""
    top = (docs.sample(SAMPLE, 2).select(F.explode(words(col(text))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
           .where("n > 1").orderBy(F.desc("n"), "w").limit(COMMON))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = tables.bind(lambda e: tables.fold(F.col("w"), e), *FOLDS[tables.ordered])
    out = top.repartition(n, "w").select("w", ids.alias("ids"), "n").toArrow().sort_by([("n", "descending"), ("w", "ascending")])
    return list(zip(out["w"].to_pylist(), out["ids"].to_pylist()))


def encode(docs: DataFrame, tables: Tables, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array) and ids_text (decimal, joined by one space) of every row."""
    tables.with_common(common_words(docs, tables, text))
    out = docs.select(col(doc_id).alias("doc_id"), ids_text(col(text), tables).alias("ids_text"))
    return out.select("doc_id", "ids_text", F.when(F.col("ids_text") == "", F.array().cast("array<int>")).otherwise(
        F.split("ids_text", " ").cast("array<int>")).alias("ids"))


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    tables = Tables(path)
    return encode(docs, tables, doc_id, text).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("ids_text", 256).alias("ids_sha256"),
        F.sha2(decode(F.col("ids"), tables), 256).alias("decoded_sha256"))
