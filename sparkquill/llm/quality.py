"""Quality classification: histogram gradient-boosted trees over statistics of whole documents.

Statistics (FEATURES) are counts of bytes, words and lines of a text; nothing else of a document is looked at. Trees are fitted to a
bounded sample of labelled documents: values are binned by quantiles, each level of a tree sums gradients by node and bin, and the
split of greatest gain wins, the first of equal ones. A tree is complete: its nodes lie in arrays by level, a node that isn't split
sends all to the left, so scoring is a few look-ups for all rows and trees of a batch at once.

Learning moves no text: labels are sampled by a hash of their ids, at most ``rows`` of them are broadcast to the documents, and
only statistics of labelled ones meet in the one task that fits the trees. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquill.llm.common import each

#: Bytes of words that are held as a list at a time; a longer text is passed over in pieces that end between words.
PIECE = 1 << 20
FEATURES = (
    "log_bytes", "log_words", "log_lines", "letters", "capitals", "digits", "spaces", "breaks", "marks", "other_bytes", "kinds_of_marks", "top_mark", "second_mark", "stops", "entropy",
    "word_length", "log_longest", "distinct_words", "top_word", "same_next", "distinct_triples", "short_words", "long_words", "capital_words", "upper_words", "wordless", "ended_words",
    "line_length", "distinct_lines", "ended_lines", "one_word_lines",
)
ADDED = ("score", "predicted")
_MARKS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
_STOPS = (b".", b"!", b"?", b":", b";", b",")
_letter = re.compile(rb"[A-Za-z\x80-\xff]").search


def _pieces(data: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(data):
        end = min(len(data), start + PIECE)
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        yield data[start:end]
        start = end


def statistics(text: str) -> list[float]:
    """FEATURES of a text; shares are of its bytes, words or lines, and 0 where it has none."""
    data = text.encode()
    n = max(1, len(data))
    byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    marks = np.sort(byte[_MARKS])[::-1]
    present = byte[byte > 0] / n
    words: Counter[bytes] = Counter()
    triples: set[int] = set()
    total = length = same = short = long = capital = upper = wordless = ended = longest = 0
    tail: list[bytes] = []
    for piece in _pieces(data):
        own = piece.split()
        words.update(own)
        total += len(own)
        held = tail + own
        same += sum(map(eq, held[max(0, len(tail) - 1) :], held[max(1, len(tail)) :]))
        triples.update(map(hash, zip(held, held[1:], held[2:])))
        tail = held[-2:]
    for word, k in words.items():
        size = len(word)
        length += k * size
        if size > longest:
            longest = size
        if size <= 2:
            short += k
        elif size >= 12:
            long += k
        if word[:1].isupper():
            capital += k
            if size > 1 and word.isupper():
                upper += k
        if word.endswith(_STOPS):
            ended += k
        if not word.isalpha() and _letter(word) is None:
            wordless += k
    lines = data.split(b"\n")
    filled = [line for line in map(bytes.strip, lines) if line]
    w, rows = max(1, total), max(1, len(filled))
    share = lambda low, high: byte[low : high + 1].sum() / n
    return [
        math.log1p(len(data)), math.log1p(total), math.log1p(len(lines)), share(65, 90) + share(97, 122), share(65, 90), share(48, 57), byte[32] / n, byte[10] / n, marks.sum() / n, share(128, 255), float((marks > 0).sum()), marks[0] / n, marks[1] / n, byte[[33, 46, 63]].sum() / n, float(-(present * np.log2(present)).sum()),
        length / w, math.log1p(longest), len(words) / w, max(words.values(), default=0) / w, same / w, len(triples) / max(1, total - 2), short / w, long / w, capital / w, upper / w, wordless / w, ended / w,
        len(data) / rows, len(set(filled)) / rows, sum(line.endswith(_STOPS) for line in filled) / rows, sum(b" " not in line for line in filled) / rows,
    ]


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: feature and threshold of each inner node by level, value of each leaf; base is the log-odds without trees."""

    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row of statistics."""
        trees = len(self.feature)
        if not trees or not len(rows):
            return np.full(len(rows), 1 / (1 + math.exp(-self.base)))
        node, tree, at = np.zeros((len(rows), trees), np.int64), np.arange(trees), np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            node = 2 * node + 1 + (rows[at, self.feature[tree, node]] > self.threshold[tree, node])
        total = self.base + self.value[tree, node - ((1 << self.depth) - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(rows: np.ndarray, labels: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, least: int = 20, ridge: float = 1.0) -> Trees:
    """Boosted trees for logistic loss. least: rows in a leaf at least; ridge: added to the sum of second derivatives.

    Without rows the score is 0.5; with one label only it is that of (n + 1) / (n + 2) rows.
    """
    n, width = len(labels), rows.shape[1]
    share = (labels.sum() + 1) / (n + 2)
    base = math.log(share / (1 - share))
    empty = Trees(base, depth, np.zeros((0, (1 << depth) - 1), np.int64), np.zeros((0, (1 << depth) - 1)), np.zeros((0, 1 << depth)))
    if not n or labels.min() == labels.max():
        return empty
    edges = [np.unique(np.quantile(rows[:, f], np.arange(1, bins) / bins, method="lower")) for f in range(width)]
    codes = np.stack([np.searchsorted(edges[f], rows[:, f], side="left") for f in range(width)])  # code <= k means value <= edge k
    total = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - labels, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf), np.full((1 << depth) - 1, bins)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            best = np.zeros(count)
            for f in range(width):
                if not len(edges[f]):
                    continue
                key = (node - first) * bins + codes[f]
                sums = [np.bincount(key, x, count * bins).reshape(count, bins).cumsum(axis=1) for x in (g, h, None)]
                left_g, left_h, left_n = (x[:, : len(edges[f])] for x in sums)
                all_g, all_h, all_n = (x[:, -1:] for x in sums)
                gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
                gain[(left_n < least) | (all_n - left_n < least)] = 0
                where = gain.argmax(axis=1)
                top = gain[np.arange(count), where]
                better = np.flatnonzero(top > best + 1e-9)
                best[better] = top[better]
                feature[first + better], cut[first + better], threshold[first + better] = f, where[better], edges[f][where[better]]
            node = 2 * node + 1 + (codes[feature[node], np.arange(n)] > cut[node])
        leaf = node - ((1 << depth) - 1)
        value = -rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + ridge)
        total += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(base, depth, np.array(features), np.array(thresholds), np.array(values))


def _measured(docs: DataFrame, *keep: str) -> DataFrame:
    """Columns keep of docs, and stats: the statistics of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each(batches):
            stats = [statistics(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(stats, pa.list_(pa.float64()))], [*keep, "stats"])

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), *keep)
    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:]), "stats array<double>"]))


def learn(docs: DataFrame, labels: DataFrame, rows: int = 20_000, trees: int = 120, depth: int = 4) -> Trees:
    """Trees from labels (doc_id, quality) of docs (doc_id, text).

    At most ``rows`` labelled ids, those of least hash, and as many documents are learned from. Labels other than 0 and 1 and null ids are left
    out, so are ids with both labels; rows that repeat id and text count once.
    """
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30))
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    known = known.select(F.col("doc_id").alias("__id"), "quality", draw.alias("draw"))
    n = known.count()
    sample = known.where(F.col("draw") < int((1 << 30) * min(1, 2 * rows / max(1, n))) + 1).orderBy("draw", "__id").limit(rows)
    own = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))
    found = _measured(own.select("text", "__id", "quality", "draw", F.xxhash64("text").alias("key")), "__id", "quality", "draw", "key")
    found = found.groupBy("__id", "key").agg(F.first("quality").alias("quality"), F.first("draw").alias("draw"), F.first("stats").alias("stats")).orderBy("draw", "__id", "key").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("quality", pa.int32()), ("stats", pa.list_(pa.float64()))]))
        stats = table["stats"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
        x = fit(stats, table["quality"].to_numpy().astype(np.float64), trees, depth)
        yield pa.RecordBatch.from_arrays([pa.array([x.base]), *(pa.array([a.ravel()]) for a in (x.feature, x.threshold, x.value))], ["base", "feature", "threshold", "value"])

    fitted = found.select(F.col("quality").cast("int").alias("quality"), "stats").coalesce(1).mapInArrow(run, "base double, feature array<long>, threshold array<double>, value array<double>").first()
    if fitted is None:  # no partition, so no row
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0), depth=depth)
    inner, leaves = (1 << depth) - 1, 1 << depth
    return Trees(fitted["base"], depth, np.array(fitted["feature"], np.int64).reshape(-1, inner), np.array(fitted["threshold"], np.float64).reshape(-1, inner), np.array(fitted["value"], np.float64).reshape(-1, leaves))


def classify(docs: DataFrame, model: Trees, threshold: float = 0.3) -> DataFrame:
    """docs (doc_id, text, ...) with score (the probability of label 1) and predicted (1 from threshold on, else 0).

    Null text counts as empty, and empty text is scored as any other; equal texts have equal scores. Columns of docs of the added
    names are replaced; an empty table gives an empty result.
    """
    docs = docs.drop(*ADDED)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each(batches):
            stats = [statistics(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(np.array(stats).reshape(-1, len(FEATURES))))], ["__row", "score"])

    kept = [c for c in docs.columns]
    rows = docs.select(F.struct(*[docs[c] for c in kept]).alias("__row"), F.coalesce(docs["text"], F.lit("")).alias("__text"))
    found = rows.mapInArrow(run, f"__row {rows.schema['__row'].dataType.simpleString()}, score double")
    return found.select(*[F.col("__row").getField(c).alias(c) for c in kept], "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, model: Trees, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of each row of docs: as classify, but no text comes back from the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each(batches):
            stats = [statistics(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(np.array(stats).reshape(-1, len(FEATURES))))], ["doc_id", "score"])

    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
