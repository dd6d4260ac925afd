"""Small fixtures and plain-code versions that the operators are held against."""

import re
from collections import Counter, defaultdict

import public_tokenizers as P

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **extra):
    """Documents of the texts: ids 1, 2, ... unless a text is a pair (id, text)."""
    rows = [t if isinstance(t, tuple) else (i + 1, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def path(name):
    return P.path(name)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_statistics(text):
    w = words(text)
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def groups(n, links):
    """Smallest index reachable from each of n items."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = [-1] * n
    for i in range(n):
        todo = [i] if out[i] < 0 else []
        while todo:
            j = todo.pop()
            if out[j] < 0:
                out[j] = i
                todo.extend(near[j])
    return out
