"""Renamed copies: passages of code that are alike but for the names, numbers, strings, comments and spacing in them.

A file becomes tokens. Literals count as one token each, and a name as the distance to where it stood before within the same GRAM
tokens, so passages are alike if one becomes the other by renaming names consistently. Every GRAM tokens that follow each other have a
hash; of WINDOW hashes that follow each other the least (of equals the last) is a fingerprint of the file, so any two
alike passages of GRAM + WINDOW - 1 tokens share one, and only about two in WINDOW + 1 hashes leave the file's row. Fingerprints of fewer
than VARIED different tokens, as tables of numbers give, are left out.

Files are worked on one at a time within Arrow batches, a file a PIECE of tokens at a time, and rows leave in batches of ROWS, so a Python worker
holds no more than a batch of texts. What is shared is found by counts of hashes. Adjacent shared fingerprints of
a file are one region. Null and short texts have no fingerprints. Paths are taken to be unique.
"""

from __future__ import annotations

import hashlib
import keyword
import re
from collections import deque
from collections.abc import Iterator
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkquill.operators.outline import SKIPPED

GRAM, WINDOW, VARIED = 40, 21, 8
#: Tokens that are held at a time, and fingerprints that leave a worker together.
PIECE, ROWS = 1 << 14, 1 << 13
#: at: the number of a fingerprint in its file; line, last: where its first and last token stand.
PRINTS = "path string, lang string, at int, line int, last int, hash binary"
_PRINTS = pa.schema({"path": pa.string(), "lang": pa.string(), "at": pa.int32(), "line": pa.int32(), "last": pa.int32(), "hash": pa.binary()})
# Words of the languages with braces that are no names.
BRACES = frozenset(
    """abstract as async await bool boolean break byte case catch char class const continue crate decimal default defer delete do double dyn else enum
    explicit export extends extern false final finally float fn for foreach from func function go goto if impl implements import in inline instanceof int
    interface internal is let lock long loop match mod move mut namespace new nil null operator override package private protected pub public range readonly
    ref return sealed select self short signed sizeof static string struct super switch synchronized template this throw throws trait true try type typedef
    typename typeof undefined union unsafe unsigned use using var virtual void volatile where while yield""".split()
)
WORDS = {"python": frozenset(keyword.kwlist)}
_CODE = {lang: re.compile(rf"(?P<skip>{skip})|(?P<name>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<sign>\S)") for lang, skip in SKIPPED.items()}
_PROSE, _DIGITS = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[0-9]+")


def _read(lang: str, text: str) -> Iterator[tuple[str, int, bool]]:
    """The tokens of a text, their lines, and which of them are names. Texts of no language have words, in which only numbers are alike."""
    line, at = 1, 0
    words = WORDS.get(lang, BRACES)
    for found in (_CODE.get(lang) or _PROSE).finditer(text):
        line += text.count("\n", at, found.start())
        at, token, kind = found.start(), found[0], found.lastgroup
        if kind == "skip" and token[0] not in "\"'`":
            continue
        if kind is None:
            token = token if token.isalpha() else _DIGITS.sub("0", token)
        elif kind != "sign" and token not in words:
            token = {"skip": '""', "number": "0"}.get(kind, token)
        yield token, line, kind == "name" and token not in words


def tokens(lang: str, text: str) -> tuple[list[str], list[int], list[bool]]:
    """What _read finds, as columns."""
    rows = list(_read(lang, text))
    return [x[0] for x in rows], [x[1] for x in rows], [x[2] for x in rows]


def _passages(out: list[str], named: list[bool]) -> Iterator[bytes]:
    """The GRAM tokens from each one on, with names as distances."""
    count = len(out) - GRAM + 1
    if not any(named):  # nothing changes from one passage to the next: each is cut from the same bytes
        parts = [x.encode("utf-8", "surrogatepass") for x in out]
        whole, starts = b" ".join(parts), [0, *accumulate(len(x) + 1 for x in parts)]
        yield from (whole[starts[i] : starts[i + GRAM] - 1] for i in range(count))
        return
    after: dict[int, int] = {}
    before: dict[str, int] = {}
    coded = list(out)
    for i, token in enumerate(out):
        if named[i]:
            seen = before.get(token)
            coded[i] = "v0" if seen is None else f"v{i - seen}"
            if seen is not None:
                after[seen] = i
            before[token] = i
    for i in range(count):
        if i - 1 in after:  # what a name referred to has left the passage
            coded[after[i - 1]] = "v0"
        yield " ".join(coded[i : i + GRAM]).encode("utf-8", "surrogatepass")


def _fingerprints(lang: str, text: str) -> Iterator[tuple[int, int, int, bytes]]:
    """(at, line, last, hash) of a text, in order."""
    rows = _read(lang, text)
    out: list[str] = []
    lines: list[int] = []
    named: list[bool] = []
    held: deque[tuple[bytes, int]] = deque()  # hashes that may still be the least of a window, rising
    at = last = -1
    base = i = 0  # the numbers of the first token held and of the next passage
    while True:
        piece = list(islice(rows, PIECE))
        for kept, column in zip((out, lines, named), zip(*piece, strict=True), strict=False):
            kept.extend(column)
        least = []
        for passage in _passages(out[i - base :], named[i - base :]) if piece else ():
            digest = hashlib.md5(passage, usedforsecurity=False).digest()
            while held and held[-1][0] >= digest:
                held.pop()
            held.append((digest, i))
            if held[0][1] <= i - WINDOW:
                held.popleft()
            i += 1
            if i >= WINDOW and held[0][1] != last:
                least.append(held[0])
                last = held[0][1]
        if not piece and 0 < i < WINDOW:  # all passages are one window
            least.append(held[0])
        for digest, k in least:
            k -= base
            if len(set(out[k : k + GRAM])) >= VARIED:
                at += 1
                yield at, lines[k], lines[k + GRAM - 1], digest
        if not piece:
            return
        past = max(0, i - WINDOW - base)  # earlier tokens are in no window to come
        del out[:past], lines[:past], named[:past]
        base += past


def fingerprints(lang: str, text: str) -> list[tuple[int, int, int, bytes]]:
    """(at, line, last, hash) of a text, in order."""
    return list(_fingerprints(lang, text))


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PRINTS of batches (path, lang, content), ROWS at a time. Texts become Python strings one by one."""
    for batch in batches:
        rows = ((path.as_py(), lang.as_py(), *x) for path, lang, content in zip(*batch.columns, strict=True) for x in _fingerprints(lang.as_py(), content.as_py()))
        while part := list(islice(rows, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(x, field.type) for x, field in zip(zip(*part, strict=True), _PRINTS, strict=True)], schema=_PRINTS)
        del batch, rows
        pa.default_memory_pool().release_unused()


def prints(files: DataFrame, prose: bool = False) -> DataFrame:
    """PRINTS of files (path, lang, content); those of no language only with prose."""
    known = files.where("content IS NOT NULL") if prose else files.where("lang != 'other' AND content IS NOT NULL")
    return known.select("path", "lang", "content").mapInArrow(_batched, PRINTS)


def regions(found: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(path, line, last_line, n_places, hash) of each run of adjacent fingerprints (PRINTS) that stand more than once, or of those in the paths of
    only. n_places: how often the rarest of them stands; hash: the first one's."""
    own = found if only is None else found.join(only, "path", "left_semi")
    counted = found if only is None else found.join(own.select("hash").distinct(), "hash", "left_semi")
    shared = counted.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    runs = own.join(shared, "hash").withColumn("island", F.col("at") - F.row_number().over(Window.partitionBy("path").orderBy("at")))
    rows = runs.groupBy("path", "island").agg(F.min(F.struct("at", "line", "hash")).alias("first"), F.max("last").alias("last_line"), F.min("n").alias("n_places"))
    return rows.select("path", F.col("first.line").alias("line"), "last_line", "n_places", F.lower(F.hex("first.hash")).alias("hash"))
