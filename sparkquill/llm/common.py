"""Helpers shared by the corpus operators: lineage cuts, byte hashing in numpy, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.session import cut, shared_folder  # noqa: F401

#: Bytes that part words: 0x20 and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy pass works on, so that its arrays stay near the cache; longer documents are passed over in pieces or alone.
CHUNK = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after each one, Arrow's pool gives what it doesn't need back to the system."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def zipped(docs: DataFrame) -> DataFrame:
    """docs with text as zstandard frames in a binary column of that name: texts cross shuffles compressed."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1).compress
        for batch in each(batches):
            columns = list(batch.columns)
            columns[at] = pa.array([zip_(x.as_py().encode()) if x.is_valid else None for x in columns[at]], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema))


def unzipped(column: pa.Array, row: int) -> np.ndarray:
    frame = column[row].as_py()
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), np.uint8) if frame else np.zeros(0, np.uint8)


# ---------------------------------------------------------------- hashing


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class RollingHash:
    """Hash of any substring of a byte array from prefix sums of byte weights times powers of an odd base, modulo 2**64.

    Equal substrings hash equally wherever they stand; a finalizer spreads the bits. lower: A-Z count as a-z."""

    base = 0x9E3779B97F4A7C15 | 1

    def __init__(self, lower: bool = False) -> None:
        weights = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        if lower:
            weights[65:91] = weights[97:123]
        self.weights = weights
        self._powers(CHUNK + 4096)

    def _powers(self, n: int) -> None:
        inverse = pow(self.base, -1, 1 << 64)
        self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (self.base, inverse))

    def load(self, data: np.ndarray) -> None:
        if len(data) >= len(self.up):
            self._powers(2 * len(data))
        terms = self.weights[data]
        terms *= self.up[: len(data)]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = self.sums[end] - self.sums[start]
        x *= self.down[start]
        return mix64(x)

    def windows(self, k: int) -> np.ndarray:
        """Of every k bytes, before the finalizer."""
        x = self.sums[k:] - self.sums[:-k]
        x *= self.down[: len(x)]
        return x


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column, one after the other, and the offsets of its rows; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and len(column.buffers()[2]) else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of up to size bytes; a longer row is alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def segments(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, from batches in which equal keys follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in each(batches):
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        ends = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held and held[-1].column(held[-1].schema.get_field_index(key))[held[-1].num_rows - 1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        start = 0
        for end in ends[:-1]:
            yield pa.Table.from_batches([*held, batch.slice(start, end - start)])
            held, start = [], end
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


# ---------------------------------------------------------------- graphs


def local_labels(linked: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links between rows: the least row that each one reaches."""
    n = len(linked)
    labels = np.arange(n)
    nodes = np.flatnonzero(linked.any(axis=1))
    if not len(nodes):
        return labels
    part = linked[np.ix_(nodes, nodes)]
    own = np.arange(len(nodes))
    while True:
        new = np.minimum(own, np.where(part, own[None, :], len(nodes)).min(axis=1))
        new = np.minimum(new, new[new])
        if (new == own).all():
            labels[nodes] = nodes[own]
            return labels
        own = new


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the least node it reaches.

    Rounds of large-star and small-star joins, each cut by a checkpoint, until no edge changes; the number of
    rounds grows with the logarithm of the longest path. Minima are pre-aggregated, and cut off, so that both sides of the
    joins are plain shuffles: adaptive execution splits the edges of a hub, and no task gathers the neighbours of a node. Loops and repeated
    edges are allowed; edges with a null end are dropped.
    """
    a, b = F.col("a"), F.col("b")
    edges = cut(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if state == seen or not state[0]:
            return edges.select(a.alias("node"), b.alias("component")).unionByName(edges.select(b.alias("node"), b.alias("component"))).distinct()
        seen = state
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = cut(both.groupBy("a").agg(F.least(a, F.min("b")).alias("m")))
        large = cut(both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")).distinct())
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = cut(small.where(a != b).distinct())
