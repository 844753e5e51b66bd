"""Near-duplicates of word shingles: circulant MinHash, banding, then exact Jaccard similarity.

A document's set holds its distinct shingles of five words as 64-bit hashes. Its signature needs two permutations of
the integers modulo 2**32 only: sigma shuffles the set once, and coordinate k is the least value of pi shifted
circularly by k, min pi(sigma(x) - k). Documents that agree on all rows of a band are candidates; they are compared
on their full sets, so the signature never decides a link.

At scale: equal sets are one class before banding. Candidates are joined into groups by identifiers alone. A group of
up to ``block`` classes and ``together`` shingles is compared in one task, each set being shipped once. In larger groups
each class is first compared with the hub (the least class) that it shares most buckets with, in chunks of bounded size; so
a tight group, however large, is linked by shipping each set once. Then only buckets that still hold classes not known to be
linked are compared, in pairs of chunks, without those within one linked part. What stays quadratic, in block products, is a
large bucket of classes that are candidates of each other and yet not linked.
Every comparison is a product of 0/1 matrices; what leaves a task is at most one link for each row, never a pair list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquill.llm.common import RollingHash, chunks, connected_components, cut, each, local_labels, mix64, segments, texts, unzipped, zipped

_M = [np.uint64(x | 1) for x in (0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]


def banding(threshold: float, miss: float = 3e-7) -> tuple[int, int]:
    """(bands, rows): rows by the threshold, and as many bands as let a pair at the threshold slip with probability miss."""
    rows = 6 if threshold >= 0.84 else 5 if threshold >= 0.75 else 3
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows))), rows


def shingle_sets(hasher: RollingHash, data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; offsets count from the first byte of data."""
    n = len(offsets) - 1
    if not len(data):
        return [np.zeros(0, np.uint64)] * n
    letter = np.ones(256, bool)
    letter[[0x20, *range(0x09, 0x0E)]] = False
    inside = letter[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    starts[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    hasher.load(data)
    words = hasher.of(starts, ends)
    bounds = np.searchsorted(starts, offsets)
    if len(words) >= width:
        rolled = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            rolled += words[k : len(words) - width + 1 + k] * _M[k % len(_M)] if k < len(_M) else mix64(words[k : len(words) - width + 1 + k] + np.uint64(k))
        rolled = mix64(rolled)
    out = []
    for i in range(n):
        first, last = bounds[i], bounds[i + 1]
        if last - first >= width:
            out.append(np.unique(rolled[first : last - width + 1]))
        elif last > first:
            whole = np.array([last - first], np.uint64)
            for k in range(first, last):
                whole = mix64(whole * _M[0] + words[k : k + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


#: Shifts and odd factors of the two permutations.
SIGMA, PI = ((15, 0xD35A2D97), (17, 0xC2B2AE3D)), ((16, 0x7FEB352D), (15, 0x846CA68B))


def _permute(x: np.ndarray, scratch: np.ndarray, steps: tuple[tuple[int, int], ...]) -> None:
    """A permutation of the integers modulo 2**32, in place."""
    for shift, factor in steps:
        np.right_shift(x, np.uint32(shift), out=scratch)
        np.bitwise_xor(x, scratch, out=x)
        np.multiply(x, np.uint32(factor), out=x)


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of size circulant MinHash coordinates for each set; sets must not be empty."""
    out = np.empty((len(sets), size), np.uint32)
    first = 0
    while first < len(sets):
        last, total = first + 1, len(sets[first])
        while last < len(sets) and total + len(sets[last]) <= 65_536:
            total += len(sets[last])
            last += 1
        shuffled = (np.concatenate(sets[first:last]) >> np.uint64(32)).astype(np.uint32)
        scratch, work = np.empty_like(shuffled), np.empty_like(shuffled)
        np.bitwise_xor(shuffled, np.uint32(0x5BD1E995), out=shuffled)
        _permute(shuffled, scratch, SIGMA)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[first : last - 1]])]).astype(np.intp)
        for k in range(size):
            np.subtract(shuffled, np.uint32(k), out=work)
            _permute(work, scratch, PI)
            out[first:last, k] = np.minimum.reduceat(work, starts)
        first = last
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sketch(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = RollingHash(lower=True)
        for batch in each(batches):
            data, offsets = texts(batch.column(1))
            for first, last in chunks(offsets):
                own = offsets[first : last + 1]
                sets = shingle_sets(hasher, data[own[0] : own[-1]], own - own[0], width)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                keys = np.zeros((len(sets), bands), np.uint64)
                cls = np.zeros(len(sets), np.uint64)
                if len(full):
                    kept = [sets[i] for i in full]
                    signed = signatures(kept, bands * rows).reshape(len(kept), bands, rows)
                    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _M[1], (len(kept), bands)).copy()
                    for r in range(rows):
                        key = mix64(key * _M[2] + signed[:, :, r].astype(np.uint64))
                    keys[full] = key
                    sums = [np.array([f(s).sum() for s in kept], np.uint64) for f in (lambda s: s, lambda s: mix64(s * _M[3]))]
                    cls[full] = mix64(sums[0] * _M[0] + mix64(sums[1]))
                empty = n == 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(sets) + 1, bands), pa.int32()), pa.array(_signed(keys.reshape(-1))))
                own = (batch.column(k).slice(first, last - first) for k in (0, 2))
                yield pa.RecordBatch.from_arrays([*own, pa.array(n), pa.array(_signed(cls), mask=empty), lists], ["doc_id", "text_key", "n_shingles", "cls", "bands"])

    return run


def _unit_sets(hasher: RollingHash, frames: pa.ChunkedArray, order: np.ndarray, width: int) -> list[np.ndarray]:
    """The shingle sets of compressed texts, in this order."""
    out: list[np.ndarray] = []
    for chunk in np.array_split(order, max(1, len(order) // 64)):
        raw = [unzipped(frames, int(i)) for i in chunk]
        out += shingle_sets(hasher, np.concatenate(raw), np.cumsum([0, *map(len, raw)]), width)
    return out


def jaccard_links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs have 100 * intersection >= percent * union, as a symmetric matrix without its diagonal."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), sizes)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    counts = np.diff(np.concatenate([starts, [len(values)]]))
    common = np.zeros((m, m), np.int64)
    for d in np.unique(counts[(counts >= 2) & (counts <= 12)]):  # shingles of few sets: count their pairs
        rows = owner[starts[counts == d][:, None] + np.arange(d)[None, :]]
        for i in range(d):
            for j in range(i + 1, d):
                common += np.bincount(rows[:, i] * m + rows[:, j], minlength=m * m).reshape(m, m)
    common += common.T
    frequent = np.flatnonzero(counts > 12)
    for block in range(0, len(frequent), 4096):  # shingles of many sets: products of 0/1 matrices
        part = frequent[block : block + 4096]
        dense = np.zeros((m, len(part)), np.float32)
        for column, k in enumerate(part):
            dense[owner[starts[k] : starts[k] + counts[k]], column] = 1
        common += (dense @ dense.T).astype(np.int64)
    linked = (100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)) & (common > 0)
    np.fill_diagonal(linked, False)
    return linked


def _verify(percent: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = RollingHash(lower=True)
        for unit in segments(batches, "unit"):
            if unit.num_rows < 2:
                continue
            ids = unit.column("cls").to_numpy()
            order = np.argsort(ids, kind="stable")
            labels = local_labels(jaccard_links(_unit_sets(hasher, unit.column("text"), order, width), percent))
            joined = np.flatnonzero(labels != np.arange(len(ids)))
            if len(joined):
                ids = ids[order]
                yield pa.RecordBatch.from_arrays([pa.array(ids[joined]), pa.array(ids[labels[joined]])], ["a", "b"])

    return run


def _hub_units(pairs: DataFrame, block: int, together: int) -> DataFrame:
    """(cls, unit) for pairs (cls, key, hub, n_shingles): each class with the hub that it shares most buckets with, in chunks of up to
    about block classes and together shingles; the hub itself is in each of its chunks."""
    best = pairs.groupBy("cls", "hub", "n_shingles").agg((-F.count("*")).alias("less")).groupBy("cls", "n_shingles").agg(F.min(F.struct("less", "hub"))["hub"].alias("hub"))
    sizes = best.groupBy("hub").agg(F.ceil(F.greatest(F.count("*") / (block - 1), F.sum("n_shingles") / together)).cast("int").alias("parts"))
    own = best.join(sizes, "hub").select("cls", F.xxhash64("hub", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")).alias("unit"))
    hubs = sizes.select(F.col("hub").alias("cls"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k")).select("cls", F.xxhash64("cls", "k").alias("unit"))
    return own.unionByName(hubs).distinct()


def _bucket_units(rows: DataFrame, block: int, together: int) -> DataFrame:
    """(cls, unit) for rows (cls, key, label, n_shingles): in each bucket that holds several labels, chunks of up to half a block, in
    pairs; chunks of one label that has its own are not paired with each other."""
    mixed = rows.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("key")
    rows = rows.join(mixed, "key")
    half, short = block // 2, together // 2
    counts = rows.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    counts = counts.withColumn("grp", F.when((F.col("n") > half) | (F.col("weight") > short), F.col("label")))
    parts = counts.groupBy("key", "grp").agg(F.ceil(F.greatest(F.sum("n") / half, F.sum("weight") / short)).cast("int").alias("parts"))
    parts = parts.select(F.col("key").alias("k"), F.col("grp").alias("g"), "parts")
    placed = counts.join(parts, (F.col("key") == F.col("k")) & F.col("grp").eqNullSafe(F.col("g"))).select("key", "label", "grp", "parts")
    placed = rows.join(placed, ["key", "label"]).withColumn("side", F.xxhash64("grp", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")))
    others = parts.select(F.col("k").alias("key"), "g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k")).select("key", "g", F.xxhash64("g", "k").alias("other"))
    met = placed.join(others, "key").where(~F.coalesce(F.col("grp") == F.col("g"), F.lit(False)))
    return met.select("cls", F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other")).alias("unit"))


def minhash_dedup(docs: DataFrame, threshold: float = 0.8, width: int = 5, block: int = 512, together: int = 2_000_000) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept, text_key, group_key.

    Links join rows whose sets of width-word shingles have a Jaccard similarity of threshold or more (in whole percents);
    component_id is the least doc_id that a row reaches. Null, empty and wordless texts have no shingles and link with nothing;
    fewer than width words make one shingle. A row without doc_id links with nothing and is kept. Rows that repeat a doc_id are
    rows of their own, linked by their texts only; text_key (a hash of the text) tells them apart, and group_key (null without
    links to be had) is the same for all rows of a component. Sets are equal if 64-bit hashes of them are. Further columns of
    docs are ignored; an empty table gives an empty result.
    """
    bands, rows = banding(threshold)
    percent = round(threshold * 100)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    sketch = cut(docs.mapInArrow(_sketch(width, bands, rows), "doc_id long, text_key long, n_shingles long, cls long, bands array<long>"))
    full = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(full.groupBy("cls").agg(F.min(F.struct("doc_id", "text_key", "n_shingles", "bands")).alias("x")).select("cls", "x.*"))

    keyed = classes.select("cls", "n_shingles", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("cls").alias("hub")).where("n > 1").select("key", "hub")
    pairs = cut(keyed.join(buckets, "key"))
    groups = connected_components(pairs.select(F.col("cls").alias("a"), F.col("hub").alias("b")))
    groups = groups.select(F.col("node").alias("cls"), F.col("component").alias("grp")).join(classes.select("cls", "n_shingles"), "cls")
    sizes = groups.groupBy("grp").agg(((F.count("*") <= block) & (F.sum("n_shingles") <= together)).alias("small"))
    groups = cut(groups.join(sizes, "grp"))
    # The texts of all classes that have candidates, compressed; their sets are made where they are compared.
    todo = groups.select("cls").join(classes.select("cls", "doc_id", "text_key"), "cls")
    held = cut(zipped(docs).join(todo, ["doc_id", "text_key"]).select("cls", "text").dropDuplicates(["cls"]))

    def linked(units: DataFrame) -> DataFrame:
        """(a, b): links found by comparing the classes of each unit of (cls, unit)."""
        shipped = held.join(units, "cls").select("unit", "cls", "text")
        return cut(shipped.repartition("unit").sortWithinPartitions("unit").mapInArrow(_verify(percent, width), "a long, b long"))

    units = groups.where("small").select("cls", F.xxhash64(F.lit(-1), "grp").alias("unit"))
    large = groups.where("NOT small").select("cls")
    if large.isEmpty():
        links = linked(units)
    else:
        pairs = cut(pairs.join(large, "cls"))
        links = linked(units.unionByName(_hub_units(pairs, block, together)))
        one = links.groupBy("a").agg(F.min("b").alias("b"))
        two = one.join(one.select(F.col("a").alias("b"), F.col("b").alias("c")), "b", "left").select(F.col("a").alias("cls"), F.coalesce("c", "b").alias("label"))
        pairs = cut(pairs.join(two, "cls", "left").select("cls", "key", "n_shingles", F.coalesce("label", "cls").alias("label")))
        rest = cut(_bucket_units(pairs, block, together).distinct())
        if not rest.isEmpty():
            links = links.unionByName(linked(rest))
    found = connected_components(links)
    labels = classes.select("cls", "doc_id").join(found, F.col("cls") == F.col("node"), "left").select("cls", "doc_id", F.coalesce("component", "cls").alias("group_key"))
    least = labels.groupBy("group_key").agg(F.min("doc_id").alias("component_id"))
    labels = labels.join(least, "group_key").select(F.col("cls").alias("c"), "group_key", "component_id")
    members = sketch.join(labels, F.col("doc_id").isNotNull() & (F.col("cls") == F.col("c")), "left")
    component = F.coalesce("component_id", "doc_id")
    return members.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"), "text_key", "group_key")
