"""Tokenizers and packing against the libraries, chat formatting, pages and vectors."""

import base64
import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers as P
from pricelake.llm import byte_bpe, chat_format, embedding_dedup, html_extract, html_pages, packing, token_counts

from pricelake.llm.common import table

from .helpers import SF, docs, groups, path

PIECES = ["'s", "'re", "r", "'ll", "'", "''ve", " ", "  ", "\n", "\t", " \n", " ", "　", "A", "The", "x", "1", "42", "É", "ß", "ÿ",
          "İ", "Σ", "ς", "中文", "😀", "!", "...", "<|endoftext|>", "<|startoftext|>", "<", "\x00", "\x1c", "\x85", "s", "e", "́", "²", "_", "\1", "\2"]
RNG = random.Random(5)
TEXTS = [None, "", " ", "a" * 3000, "=-" * 200, "\n" * 50] + ["".join(RNG.choices(PIECES, k=RNG.randint(1, 14))) for _ in range(300)]


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_round_trip(spark, encoding):
    d = docs(spark, TEXTS + ["the of and " * 3000]).withColumn("ids", F.lit(1))
    for r in byte_bpe.round_trip(d, path("byte_bpe_50k.tiktoken")).collect():
        text = (TEXTS + ["the of and " * 3000])[r["doc_id"] - 1] or ""
        ids = encoding.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.round_trip(docs(spark, []), path("byte_bpe_50k.tiktoken")).count() == 0


def test_byte_bpe_word_that_is_done_is_passed_on(spark):
    """The fold reads the carried lowest rank alone once nothing merges."""
    state = F.struct(F.lit("ZZZZ 0001 ZZZZ").alias("t"), F.lit("not read").alias("r"), F.lit(byte_bpe.NONE).alias("m"))
    tables = byte_bpe.Tables(path("byte_bpe_50k.tiktoken"))
    out = spark.range(1).select(tables.bind(lambda e: byte_bpe._step(e, state)).alias("s")).first()["s"]
    assert tuple(out) == ("ZZZZ 0001 ZZZZ", "not read", byte_bpe.NONE)


def own_ranks(tmp_path, merged):
    """A rank file of the single bytes and the given tokens, in this order."""
    pieces = [bytes([b]) for b in range(256)] + merged
    file = tmp_path / "own.tiktoken"
    file.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % i for i, p in enumerate(pieces)))
    return str(file), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={p: i for i, p in enumerate(pieces)}, special_tokens={})


@pytest.mark.parametrize("merged, ordered", [
    ([b"ab", b"bc", b"aa", b"aab", b"abab", b"bcc", b"aabbcc", b"aaab", b"\xc3\xa9", b"a\xc3\xa9", b"aaaa", b"ababab", b"aaababab"], True),
    ([b"ab", b"bc", b"aa", b"aab", b"abab", b"bcc", b"\xc3\xa9", b"a\xc3\xa9", b"aaaa", b"ababab", b"aaababab"], True),
    ([b"aab", b"ab", b"aa", b"abab"], False)])
def test_byte_bpe_folds_by_rank_where_the_file_is_ordered(spark, tmp_path, merged, ordered):
    """All places of a pair are merged at once, in the order of the ranks; other files are folded one merge a step."""
    file, own = own_ranks(tmp_path, merged)
    tables = byte_bpe.Tables(file)
    assert tables.ordered == ordered
    rng = random.Random(3)
    texts = ["".join(rng.choices("aabbcé", k=rng.randint(1, 14))) for _ in range(400)] + ["a" * 301, "ab" * 150 + "é"]
    for r in byte_bpe.encode(docs(spark, texts), tables).collect():
        # the library gives a whole word that is a token its id; an unordered file may not reach it by merges
        if ordered or texts[r["doc_id"] - 1].encode() not in merged:
            assert r["ids"] == own.encode_ordinary(texts[r["doc_id"] - 1]), texts[r["doc_id"] - 1]


def test_byte_bpe_takes_a_step_a_token_of_the_word(spark, monkeypatch):
    """The registered file is ordered, so no word is folded by searching for the lowest rank after every merge."""
    monkeypatch.setattr(byte_bpe, "_step", None)
    tables = byte_bpe.Tables(path("byte_bpe_50k.tiktoken"))
    out = byte_bpe.encode(docs(spark, ["zgrablwyn"]), tables).first()
    assert tables.ordered and bytes.fromhex("".join(p.hex() for i in out["ids"] for p, r in tables.ranks.items() if r == i)) == b"zgrablwyn"


def test_token_counts(spark):
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    d = docs(spark, TEXTS + ["x y " * 400]).withColumn("n_tokens", F.lit("clash"))
    for r in token_counts.token_counts(d, path("byte_bpe_50k.json")).collect():
        text = (TEXTS + ["x y " * 400])[r["doc_id"] - 1] or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)
    assert token_counts.token_counts(docs(spark, []), path("byte_bpe_50k.json")).count() == 0


def test_chunks_do_not_matter(monkeypatch):
    counter = token_counts.load(path("byte_bpe_50k.json"))
    texts = [t or "" for t in TEXTS]
    want = counter.counts(texts)
    for size in (1, 3, 64):
        monkeypatch.setattr(token_counts, "CHUNK", size)
        assert (counter.counts(texts) == want).all()
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    assert (counter.counts(texts) == want).all()


def check_packing(rows, texts, capacity):
    t = Tokenizer.from_file(path("word_bpe_49k.json"))
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    for i, text in enumerate(texts, 1):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want = [(k, s, len(ids[s:s + capacity]), zlib.crc32(np.array(ids[s:s + capacity], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got[i]) == want
    return len(bins)


def test_packing(spark, monkeypatch):
    rng = random.Random(6)
    texts = TEXTS + ["word " * rng.randint(1, 90) for _ in range(200)] + ["long text " * 100]
    d = docs(spark, texts).withColumn("piece", F.lit(0))
    rows = packing.pack(d, path("word_bpe_49k.json"), capacity=64).collect()
    n = check_packing(rows, texts, 64)
    assert n <= 1.1 * -(-sum(r["length"] for r in rows) // 64) + 2
    monkeypatch.setattr(packing, "BLOCK", 40)               # many blocks and a second round
    check_packing(packing.pack(d, path("word_bpe_49k.json"), capacity=64).collect(), texts, 64)
    assert packing.pack(docs(spark, []), path("word_bpe_49k.json")).count() == 0


def test_units_and_long_texts(monkeypatch):
    """Against the library, with slabs of a few bytes and a cache that overflows."""
    t = Tokenizer.from_file(path("word_bpe_49k.json"))
    rng = random.Random(9)
    odd = PIECES + ["×", "÷", "Ã", "ÃŸ", "À", "ñ", "Þ", "a.b", "é", "e\u0301"]
    texts = ["".join(rng.choices(odd, k=rng.randint(0, 14))) for _ in range(3000)] + [None, "", "long " * 90 + "x" * 300]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    for slab, cache in ((8 << 20, 500_000), (50, 30)):
        monkeypatch.setattr(packing, "SLAB", slab)
        monkeypatch.setattr(packing, "CACHE", cache)
        assert [np.frombuffer(x, "<u4").tolist() for x in packing.encoded(pa.array(texts), path("word_bpe_49k.json"))] == want


def test_crossover_keeps_every_item_once():
    rng = np.random.default_rng(1)
    lengths = sorted(rng.integers(1, 60, 300).tolist(), reverse=True)
    for seed in range(5):
        assign, n, _ = packing.evolve(lengths, [], [seed], 100)
        fill = np.bincount(assign, lengths)
        assert len(assign) == 300 and len(fill) == n and fill.max() <= 100 and fill.min() > 0


CHAT = [(1, 0, "system", "be & <kind>"), (1, 1, "user", "a</s><n>"), (1, 2, "user", None), (1, 3, "assistant", "x &lt; y"), (1, 4, "assistant", ""),
        (1, 5, "assistant", "zé😀"), (2, 0, "a\nb<", "t\n"), (2, None, None, "first"), (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (None, 0, "user", "n")]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string").withColumn("blocks", F.lit(1))
    out = chat_format.formatted(turns)
    rows = out.select("conv_id", "formatted", chat_format.parsed(F.col("formatted")).alias("t"), chat_format.masked(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    for r in rows:
        own = sorted(((-1 if t is None else t), ro or "", te or "") for c, t, ro, te in CHAT if c == r["conv_id"])
        assert [(t["role"], t["text"]) for t in r["t"]] == [(ro, te) for _, ro, te in own]
        assert r["loss"] == "".join(te for _, ro, te in own if ro == "assistant")
        assert r["formatted"].count("<s>") == 1 + sum(a[1] != b[1] for a, b in zip(own, own[1:]))
    assert len(rows) == 4 and chat_format.digests(chat_format.formatted(turns.limit(0))).count() == 0


def test_pages_held_out():
    model, wrong, total = html_extract.model(), 0, 0
    for page, own in html_pages.labelled(80, seed=77):
        tree = html_extract.Tree(page)
        content = model.messages(tree, tree.features())[0]
        for v, tag in enumerate(tree.tag):
            if tag is None:
                total += 1
                wrong += (content[v] > 0.5) != (tree.text[v].strip() in own)
    assert wrong < 0.03 * total


def test_messages_are_exact_marginals():
    """Against the sum over all labellings of a small tree."""
    import itertools
    import math

    model = html_extract.model()
    tree = html_extract.Tree("<div class=x><p>one two <b>three</b></p><ul><li>a</ul></div>")
    features = tree.features()
    n, total, on = len(features), 0.0, [0.0] * len(features)
    for y in itertools.product((0, 1), repeat=n):
        s = sum(y[v] * sum(model.weight.get(f, 0) for f in fs) for v, fs in enumerate(features))
        s += sum(model.pair[tree.edge(v)][y[tree.parent[v]]][y[v]] for v in range(1, n))
        total += math.exp(s)
        for v in range(n):
            on[v] += y[v] * math.exp(s)
    assert np.allclose(model.messages(tree, features)[0], [x / total for x in on])


def test_pages(spark):
    menu = "<nav><ul><li><a href=x>home</a><li><a href=y>more</a></ul></nav>"
    body = "<article><h1>A  title</h1><p>One &amp; two\n three, a whole sentence.<p>Second <b>bold</b>ed paragraph of text.</article>"
    pages = [(1, "u", f"<html><head><title>t</title></head><body>{menu}<script>var x='<p>no</p>'</script><!-- no -->{body}<footer>&copy; me</footer></body></html>"),
             (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", "<div>" * 3000 + "deep words in here, really." + "</div>" * 10), (1, "u", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1))
    rows = html_extract.extract(df).orderBy("page_id", F.desc("n_chars")).collect()
    assert rows[0]["text"] == "A title One & two three, a whole sentence. Second bolded paragraph of text." and rows[0]["n_chars"] == len(rows[0]["text"])
    assert [r["text"] for r in rows[1:4]] == ["", "", ""] and len(rows) == 6
    assert html_extract.extract(df.limit(0)).count() == 0


def test_pages_of_the_table(spark):
    """The text of the article element (read here only) of every page, whatever its paragraphs are like."""
    model = html_extract.model()
    wrong = 0
    rows = table(spark, SF, "pages").select("html").collect()
    for (page,) in rows:
        tree = html_extract.Tree(page or "")
        inside = [0.0] * len(tree.tag)
        for v in range(1, len(inside)):
            inside[v] = float(inside[tree.parent[v]] or tree.tag[tree.parent[v]] == "article")
        got, want = model.extract(page), tree.article(inside)
        assert got or not want
        wrong += got != want
    assert wrong <= 0.005 * len(rows)


def test_hostile_pages_are_read_in_linear_time():
    model = html_extract.model()
    for part in ('<a "', "<textarea>", "<", "<a", "</", "<!--", "<script>", '<div class="', "<p <b \"'>", "<svg>", "&"):
        begin = time.process_time()
        model.extract(part * (1_000_000 // len(part)))
        assert time.process_time() - begin < 8, part


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 24))
    vectors = [*base, *(base[rng.integers(0, 20, 150)] + rng.normal(scale=0.12, size=(150, 24))), *base[:5], *base[:2] * 3]
    rows = [(i + 10, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(1, None), (2, []), (3, [0.0] * 24), (4, [float("nan")] * 24), (5, [1.0, None]), (6, [float("inf")] * 24), (7, [1.0, 2.0]), (8, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("node", F.lit(1))
    got = {r["vec_id"]: r for r in embedding_dedup.dedup(df).collect()}
    unit = np.array([v / np.linalg.norm(v) for v in vectors])
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    want = groups(len(vectors), list(zip(*np.nonzero(near))))
    assert [got[i + 10]["n_links"] for i in range(len(vectors))] == near.sum(1).tolist()
    assert [got[i + 10]["component_id"] for i in range(len(vectors))] == [w + 10 for w in want]
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] and got[i]["component_id"] == i for i in range(1, 7))
    assert got[8]["component_id"] == 7 and got[7]["n_links"] == 1 and not got[8]["kept"]
    assert embedding_dedup.dedup(df.limit(0)).count() == 0
    assert embedding_dedup.dedup(df.where("vec_id < 7")).count() == 6


def near_vectors(kind, n, dims, seed):
    """Vectors of which half are near copies of another, at cosines about the threshold."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 2, dims)) if kind == "isotropic" else rng.normal(size=(12, dims))[rng.integers(0, 12, n // 2)] + 0.4 * rng.normal(size=(n // 2, dims))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.94, 0.99, (len(base), 1))
    return np.concatenate([base, c * base + np.sqrt(1 - c * c) * side]) * rng.uniform(0.5, 2, (2 * len(base), 1))


@pytest.mark.parametrize("kind", ["isotropic", "clusters"])
def test_no_link_is_lost(spark, monkeypatch, kind):
    """Against all pairs, with more lists than a query probes in clusters, in many blocks."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 300)
    x = near_vectors(kind, 3000, 32, 5).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    assert near.sum() > 2000
    want = groups(len(u), zip(*map(np.ndarray.tolist, np.nonzero(near))))
    got = {r["vec_id"]: r for r in embedding_dedup.dedup(df).collect()}
    assert [got[i]["n_links"] for i in range(len(u))] == near.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(len(u))] == want


def test_probed_lists_are_few_in_clusters_and_enough():
    for kind in ("isotropic", "clusters"):
        x = embedding_dedup._units(near_vectors(kind, 4000, 32, 6))
        coarse, _ = embedding_dedup.fit(x, len(x))
        own, reach = embedding_dedup._nearest(x, coarse), float(np.sqrt(0.1))
        may = embedding_dedup.probed(x, own, coarse, reach)
        i, j = np.nonzero((x @ x.T >= 0.95))
        assert may[i, own[j]].all()
        assert kind == "isotropic" or may.mean() < 0.5
