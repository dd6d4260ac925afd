"""Token counts by finite-state transducers.

Two deterministic transducers replace the tokenizer of a byte-level BPE file (JSON).

*Words.* The split pattern is compiled to a transducer over character classes (``STATES`` x
``CLASSES``): every transition says whether a word starts at this character and whether one started
at the character before (the pattern looks one character ahead). All texts of an Arrow batch form
one stream with an end mark after each. It is cut into chunks; for every chunk the map from entry
state to exit state is computed in lockstep, the maps are composed by a parallel prefix scan, and
with each chunk's entry state known the word starts are read off in lockstep again. A very long text
is just more chunks.

*Tokens.* Inside a word the transducer reads bytes. Its state holds the open suffixes of the word
(those that some vocabulary entry starts with), the last token before each, and how many tokens ended
there relative to now; that decides how the best segmentation goes on. A transition is annotated with
the change of the number of tokens, so the sum along a word is its count. Of all entries that end at
a byte exactly one follows its predecessor validly: the ranked merges of their joined bytes leave the
two. States are compiled when first reached and shared by all words of a worker; at
``MAX_STATES`` the tables start afresh, so memory is bounded.

Special tokens of the file that occur in a text count as one token and split it, as in the library.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted one by
one; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.llm.common import col

LIMIT = 512
CHUNK = 256
MAX_STATES = 250_000
#: Entries of the memo of token pairs.
MAX_PAIRS = 1_000_000

# Fixed values of the split pattern: character classes, contraction letters and white space.
CLASSES = ["letter", "stmd", "r", "v", "l", "e", "number", "space", "white", "apostrophe", "other", "end"]
_WHITE = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Letters and numbers that Unicode 16 assigned, where Python's tables are older.
_NEW_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
                (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
                (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
                (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
                (0x1E5F0, 0x1E5F0)]
_NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
                (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
STATES = ["start", "letters", "numbers", "others", "apostrophe", "'r", "'v", "'l", "contraction",
          "space", "white", "spaces", "whites"]
_AFTER = {"letter": "letters", "stmd": "letters", "r": "letters", "v": "letters", "l": "letters", "e": "letters",
          "number": "numbers", "space": "space", "white": "white", "apostrophe": "apostrophe", "other": "others", "end": "start"}


def _word_step(state: str, kind: str) -> tuple[str, bool, bool]:
    """Next state, whether a word starts here, whether one started at the character before."""
    letter, blank = _AFTER[kind] == "letters", kind in ("space", "white")
    if kind == "end":
        return "start", True, state in ("'r", "'v", "'l")
    if state in ("space", "white", "spaces", "whites"):
        if blank:
            return ("spaces" if kind == "space" else "whites"), False, False
        late = state in ("spaces", "whites")          # the last blank of several is cut off
        if state in ("space", "spaces"):              # and a plain space goes with what follows
            return ("others" if kind == "apostrophe" else _AFTER[kind]), False, late
        return _AFTER[kind], True, late
    if state == "letters" and letter or state == "numbers" and kind == "number":
        return state, False, False
    if state in ("others", "apostrophe") and kind in ("apostrophe", "other"):
        return "others", False, False
    if state == "apostrophe" and letter:
        if kind == "stmd":
            return "contraction", False, False
        if kind in ("r", "v", "l"):
            return f"'{kind}", False, False
        return "letters", True, False
    if state in ("'r", "'v", "'l"):
        if kind == ("l" if state == "'l" else "e"):
            return "contraction", False, False
        return ("letters", False, True) if letter else (_AFTER[kind], True, True)
    return _AFTER[kind], True, False


def _word_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = {s: i for i, s in enumerate(STATES)}
    nxt, here, before = (np.zeros((len(STATES), len(CLASSES)), t) for t in (np.uint8, bool, bool))
    for i, s in enumerate(STATES):
        for j, c in enumerate(CLASSES):
            to, here[i, j], before[i, j] = _word_step(s, c)
            nxt[i, j] = at[to]
    return nxt, here, before


_NEXT, _HERE, _BEFORE = _word_tables()
_KINDS: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """Class of every code point, by its Unicode category."""
    if not _KINDS:
        out = np.full(0x110000, CLASSES.index("other"), np.uint8)
        for c in range(0x110000):
            g = unicodedata.category(chr(c))[0]
            if g in "LN":
                out[c] = CLASSES.index("letter" if g == "L" else "number")
        for name, spans in (("letter", _NEW_LETTERS), ("number", _NEW_NUMBERS)):
            for a, b in spans:
                out[a:b + 1] = CLASSES.index(name)
        out[_WHITE] = CLASSES.index("white")
        for name, chars in (("space", " "), ("apostrophe", "'"), ("stmd", "stmd"), *((x, x) for x in "rvle")):
            out[[ord(x) for x in chars]] = CLASSES.index(name)
        _KINDS.append(out)
    return _KINDS[0]


def word_starts(kinds: np.ndarray) -> np.ndarray:
    """Whether a word starts at each character of a stream of classes (ends included)."""
    n = len(kinds)
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, CLASSES.index("end"), np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    maps = np.tile(np.arange(len(STATES), dtype=np.uint8), (rows, 1))
    for k in range(CHUNK):                            # every chunk from every entry state
        maps = _NEXT[maps, grid[k][:, None]]
    step = 1
    while step < rows:                                # parallel prefix scan of the maps
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), 1)
        step *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = maps[:-1, 0]
    here = np.zeros((CHUNK, rows), bool)
    late = np.zeros((CHUNK, rows), bool)
    for k in range(CHUNK):
        here[k], late[k] = _HERE[state, grid[k]], _BEFORE[state, grid[k]]
        state = _NEXT[state, grid[k]]
    out = here.T.reshape(-1)
    out[:-1] |= late.T.reshape(-1)[1:]
    return out[:n]


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level files write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    """Token counter of one byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.vocab = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.merges = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = map(raw, m.split(" ") if isinstance(m, str) else m)
            self.merges[a, b] = rank
        self.made = {a + b: ((a, b), rank) for (a, b), rank in self.merges.items()}
        self.edges: dict[tuple[bytes, int], list[tuple[bytes, float]]] = {}
        self.open = {t[:k] for t in self.vocab for k in range(1, len(t))}
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.valid_memo: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        # one state: (longest open suffix, ((its length, last token before it, tokens up to it - now), ...))
        first = (b"", ((0, None, 0),))
        self.keys, self.ids = [first], {first: 0}
        self.table: list[dict[int, tuple[int, int]]] = [{}]

    def merged(self, word: bytes) -> list[bytes]:
        """The ranked merges themselves, lowest rank and leftmost first."""
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min((r, i) for i in range(len(parts) - 1)
                       for r in (self.merges.get((parts[i], parts[i + 1]), len(self.merges)),))
            if best[0] == len(self.merges):
                break
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """What stands at an edge of a token while its bytes are merged (side 0: left, 1: right): the
        growing tokens, each with the rank of the merge that ends it."""
        if (token, side) not in self.edges:
            out, rank, t = [], float("inf"), token
            while True:
                out.append((t, rank))
                if len(t) == 1:
                    break
                pair, rank = self.made[t]
                t = pair[side]
            self.edges[token, side] = out[::-1]
        return self.edges[token, side]

    def follows(self, last: bytes | None, token: bytes) -> bool:
        """Whether ``token`` may stand after ``last`` (None: at the start of a word): whether the merges
        of their joined bytes leave the two. Merges run in the order of rank, since a merged token
        ranks after its parts; so it is enough to follow the pair at the border through the merges on
        both sides. It joins if its rank comes before the next merge of either side; of equal ranks
        the pair further left is first."""
        key = (last, token)
        if key in self.valid_memo:
            return self.valid_memo[key]
        if len(self.valid_memo) >= MAX_PAIRS:
            self.valid_memo.clear()
        if last is None:
            ok = self.merged(token) == [token]
        else:
            left, right, i, j = self.edge(last, 1), self.edge(token, 0), 0, 0
            ok = self.follows(None, token)
            while ok:
                (x, r), (y, s) = left[i], right[j]
                rank = self.merges.get((x, y), float("inf"))
                if rank < r and rank <= s:
                    ok = False
                elif i + 1 == len(left) and j + 1 == len(right):
                    break
                elif r <= s:
                    i += 1
                else:
                    j += 1
        self.valid_memo[key] = ok
        return ok

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        suffix, opened = self.keys[state]
        text = suffix + bytes([byte])
        for length, last, past in opened:
            token = text[len(suffix) - length:]
            if token in self.vocab and self.follows(last, token):
                break
        else:
            raise ValueError("the merges of the file do not reach every byte")
        change = past + 1
        kept = [(n + 1, t, p - change) for n, t, p in opened if text[len(suffix) - n:] in self.open]
        kept.append((0, token, 0))
        key = (text[len(text) - kept[0][0]:], tuple(kept))
        if key not in self.ids:
            self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.table.append({})
        out = self.table[state][byte] = (self.ids[key], change)
        return out

    def count(self, word: bytes) -> int:
        if len(self.keys) > MAX_STATES:
            self.reset()
        state = total = 0
        table = self.table
        for byte in word:
            step = table[state].get(byte) or self.compile(state, byte)
            state = step[0]
            total += step[1]
        return total

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, t in enumerate(texts):
            own = self.special.split(t) if self.special else [t]
            out[i] = len(own) - 1
            parts += own
            owner += [i] * len(own)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        chars = "\0".join(parts) + "\0"
        code = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = _kinds()[code]
        kinds[ends] = CLASSES.index("end")
        starts = np.flatnonzero(word_starts(kinds))
        size = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        at = (np.cumsum(size) - size)[starts].tolist()
        raw = chars.encode("utf-8", "surrogatepass")
        words = [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
        known = {w: self.count(w) for w in set(words)}
        known[b"\0"] = known.get(b"\0", 0)
        each = np.array([known[w] for w in words] + [0], np.int64)
        each[np.searchsorted(starts, ends)] = 0       # the end marks are words of the stream only
        part = np.add.reduceat(each, np.searchsorted(starts, np.concatenate(([0], ends[:-1] + 1))))
        np.add.at(out, owner, part)
        return out


_LOADED: dict[str, Transducer] = {}


def load(path: str) -> Transducer:
    if path not in _LOADED:
        _LOADED[path] = Transducer(path)
    return _LOADED[path]


def n_tokens(text: Column, path: str) -> Column:
    def tokens(texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        out, i = [], 0
        while i < len(rows):                          # about a million characters at a time
            j, size = i, 0
            while j < len(rows) and (j == i or size + len(rows[j] or "") < 1 << 20):
                size += len(rows[j] or "")
                j += 1
            out.append(load(path).counts([t or "" for t in rows[i:j]]))
            i = j
        return pa.array(np.concatenate([np.zeros(0, np.int64), *out]))
    return F.arrow_udf(tokens, "bigint")(text.cast("string"))


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    return (docs.select(col(doc_id).alias("doc_id"),
                        F.coalesce(F.octet_length(col(text).cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
                        n_tokens(col(text), path).alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))
