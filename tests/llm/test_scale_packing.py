"""Memory of the packing's encoder."""

import tracemalloc

import pyarrow as pa

from pricelake.llm import packing

from .helpers import path


def test_a_slab_stays_small():
    texts = pa.array(["the quick brown fox jumps over a lazy dog, again 12 times " * 2000] * 80)     # 9 MB of short words
    packing.encoded(texts.slice(0, 1), path("word_bpe_49k.json")).__next__()
    tracemalloc.start()
    try:
        n = sum(len(x) for x in packing.encoded(texts, path("word_bpe_49k.json")))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 80 * len(next(packing.encoded(texts.slice(0, 1), path("word_bpe_49k.json"))))
    assert peak < 160 << 20
