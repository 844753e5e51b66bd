"""Small tables with every awkward case, and plain Python versions of what the operators compute."""

import hashlib
import re
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, rid int, unit string, size string, span string"


def docs(spark, rows):
    """rows: (doc_id, text[, lang[, source]]); the further columns have names that operators use inside."""
    filled = [(*row, *[None] * (4 - len(row))) for row in rows]
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), "x", 1, "y", "z", None) for i, t, lang, source in filled], SCHEMA)


def shingles(text, width=5):
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


class Groups:
    def __init__(self, nodes):
        self.parent = {n: n for n in nodes}

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def near_copies(rows, percent):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    groups = Groups(sets)
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                groups.link(a, b)
    return {i: (len(sets[i]), groups.find(i)) for i in ids}


def repeated(rows, length):
    """For each (doc_id, text): (bytes, removed, spans, digest of the rest), by counting every string."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)
