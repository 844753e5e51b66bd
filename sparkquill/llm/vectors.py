"""Near-duplicates of embedding vectors: spherical-cap filters from a structured random product code.

A filter direction is a pair of code words, one for each half of a randomly rotated space, so size * size directions need
2 * size words only. List decoding goes down the halves and drops what can no longer exceed the cap. A vector holds all
directions above the cap; where the code is thin it is lowered until ``filters`` are, which keeps recall even. Vectors meet where
they hold the same direction, and only there are they compared, by cosine in double precision.

At scale: the code grows with the square root of the number of vectors, so a direction holds about ``bucket`` of them and
each vector meets as many at any size. Equal vectors are one row. Vectors within half the link angle of a leader (the
least identifier of many of their directions) form a ball; all of a ball is linked by the triangle inequality, so a tight
group is counted, not compared. Directions held by more than ``block`` vectors are dealt out as pairs of chunks, without
those within one ball. A pair counts at the first direction it shares; tasks return counts and one edge a row, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquill.llm.common import connected_components, cut, each, local_labels, segments


def product_code(dim: int, size: int, seed: int = 20_477) -> tuple[np.ndarray, list[np.ndarray]]:
    """A random rotation, and unit code words for each part of the rotated space."""
    rng = np.random.default_rng([seed, dim, size])
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    words = [rng.standard_normal((size, len(part))) for part in np.array_split(np.arange(dim), min(2, dim))]
    return rotation, [w / np.linalg.norm(w, axis=1, keepdims=True) for w in words]


def list_decode(vectors: np.ndarray, rotation: np.ndarray, words: list[np.ndarray], wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """All filter directions that exceed each unit vector's cap: how many each has, and their codes in order, vector after vector.

    The cap is the same for all, one that a random vector exceeds wanted times on average; for a vector that exceeds it less often it
    is lowered just so far that wanted directions do (all there are, if there are fewer)."""
    dim, size = vectors.shape[1], len(words[0])
    total = size ** len(words)
    wanted = min(wanted, total)
    rotated = vectors @ rotation
    at = np.cumsum([0, *(w.shape[1] for w in words)])
    scores = [rotated[:, at[k] : at[k + 1]] @ w.T for k, w in enumerate(words)]
    usual = NormalDist().inv_cdf(max(1e-12, 1 - min(0.9, wanted / total))) * math.sqrt(len(words) / dim)
    counts, out = np.empty(len(vectors), np.int64), []
    for i in range(len(vectors)):
        own = [s[i] for s in scores]
        cap = usual
        while True:
            sums, codes = np.zeros(1), np.zeros(1, np.int64)
            for k, s in enumerate(own):
                grown = sums[:, None] + s[None, :]
                a, b = np.nonzero(grown >= cap - sum(x.max() for x in own[k + 1 :]))
                sums, codes = grown[a, b], codes[a] * size + b
            if len(sums) >= wanted:
                break
            cap -= 0.25 / math.sqrt(dim)
        if cap < usual:
            codes = codes[sums >= np.partition(sums, len(sums) - wanted)[len(sums) - wanted]]
        counts[i] = len(codes)
        out.append(np.sort(codes).astype(np.int32))
    return counts, np.concatenate([np.empty(0, np.int32), *out])


def unit_vectors(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _decode(size: int, wanted: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, tuple] = {}
        for batch in each(batches):
            vectors = batch.column(1)
            dims = np.diff(vectors.offsets.to_numpy())
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                codes[dim] = codes.get(dim) or product_code(dim, size)
                for part in np.array_split(rows, max(1, len(rows) // 2048)):
                    counts, held = list_decode(unit_vectors(_matrix(vectors.take(pa.array(part)))), *codes[dim], wanted)
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(held))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(part)), lists], ["rep", "filters"])

    return run


def _near(cosine: float):
    """Of (rep, lead, x, y): the least lead of which the vector of rep is that near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each(batches):
            x, y = batch.column(2), batch.column(3)
            dims = np.diff(x.offsets.to_numpy())
            near = np.zeros(batch.num_rows, bool)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                part = pa.array(rows)
                near[rows] = (unit_vectors(_matrix(x.take(part))) * unit_vectors(_matrix(y.take(part)))).sum(axis=1) >= cosine
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near)) for k in range(2)], ["rep", "lead"])

    return run


def _verify(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in segments(batches, "unit"):
            if unit.num_rows < 2:
                continue
            ids, mult, ball, side = (unit.column(c).to_numpy() for c in ("rep", "mult", "ball", "side"))
            vectors = unit_vectors(_matrix(unit.column("embedding")))
            linked = vectors @ vectors.T >= cosine
            linked &= ball[:, None] != ball[None, :]
            if unit.column("cross")[0].as_py():
                linked &= side[:, None] != side[None, :]
            rows = np.flatnonzero(linked.any(axis=1))
            if not len(rows):
                continue
            linked, ids, mult = linked[np.ix_(rows, rows)], ids[rows], mult[rows]
            filters, own = unit.column("filters").take(pa.array(rows)), unit.column("filter")[0].as_py()
            filters = filters.combine_chunks() if isinstance(filters, pa.ChunkedArray) else filters
            held, owner = filters.flatten().to_numpy(), np.repeat(np.arange(len(rows)), np.diff(filters.offsets.to_numpy()))
            lower = held < own
            values, inverse, counts = np.unique(held[lower], return_inverse=True, return_counts=True)
            first = np.ones(linked.shape, bool)
            if (counts > 1).any():
                shared = np.zeros((len(rows), len(values)), np.float32)
                shared[owner[lower], inverse] = 1
                shared = shared[:, counts > 1]
                first = shared @ shared.T == 0
            linked &= first
            order = np.argsort(ids)
            labels = np.empty(len(ids), np.int64)
            labels[order] = order[local_labels(linked[np.ix_(order, order)])]
            n = linked @ mult
            some = np.flatnonzero(n)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[labels[some]]), pa.array(n[some])], ["a", "b", "n"])

    return run


def vector_dedup(vectors: DataFrame, cosine: float = 0.95, filters: int = 32, bucket: int = 48, block: int = 1024) -> DataFrame:
    """One row for each row of vectors (vec_id, embedding): vec_id, n_links (rows linked directly, itself left out), component_id, kept.

    Vectors that are null, empty, zero or hold a null or non-finite component, and those without vec_id, link with
    nothing. Vectors of different lengths never link. Repeated rows are linked copies. Further columns are ignored; an
    empty table gives an empty result.
    """
    vectors = vectors.select("vec_id", "embedding")
    good = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    vectors = vectors.withColumn("good", F.coalesce(good, F.lit(False)))
    reps = cut(vectors.where("good").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")))
    size = max(16, math.ceil(math.sqrt(max(1, reps.count()) * filters / bucket)))
    held = cut(reps.select("rep", "embedding").mapInArrow(_decode(size, filters), "rep long, filters array<int>"))
    # A filter's key also has the length of the vectors.
    keyed = held.join(reps, "rep").select("rep", F.explode("filters").alias("filter"), F.size("embedding").alias("dim"))
    keyed = cut(keyed)
    leads = keyed.groupBy("dim", "filter").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).where("n > 1")
    close = keyed.join(leads, ["dim", "filter"]).where("lead < rep").groupBy("rep", "lead").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, filters // 5))
    x, y = reps.select("rep", F.col("embedding").alias("x")), reps.select(F.col("rep").alias("lead"), F.col("embedding").alias("y"))
    near = close.join(x, "rep").join(y, "lead").select("rep", "lead", "x", "y").mapInArrow(_near(math.sqrt((1 + cosine) / 2) + 1e-9), "rep long, lead long")
    balls = near.groupBy("rep").agg(F.min("lead").alias("lead"))
    rows = cut(held.join(reps, "rep").join(balls, "rep", "left").select("rep", "mult", "embedding", "filters", F.coalesce("lead", "rep").alias("ball"), F.col("lead").isNotNull().alias("led")))
    # Units of comparison.
    whole = keyed.join(rows.select("rep", "ball"), "rep")
    counts = whole.groupBy("dim", "filter", "ball").agg(F.count("*").alias("in_ball"))
    half = block // 2
    sizes = counts.groupBy("dim", "filter").agg(F.sum("in_ball").alias("n"), F.count("*").alias("n_balls")).where("n_balls > 1")
    placed = cut(whole.join(sizes, ["dim", "filter"]))
    small = placed.where(F.col("n") <= block).select("rep", "filter", F.xxhash64("dim", "filter").alias("unit"), F.lit(0).cast("long").alias("side"), F.lit(False).alias("cross"))
    group = F.when(F.col("in_ball") > half, F.col("ball"))
    large = placed.where(F.col("n") > block).join(counts, ["dim", "filter", "ball"]).withColumn("grp", group)
    parts = counts.join(sizes.where(F.col("n") > block), ["dim", "filter"]).withColumn("grp", group).groupBy("dim", "filter", "grp").agg(F.ceil(F.sum("in_ball") / half).alias("parts"))
    large = large.join(parts.withColumnsRenamed({"dim": "d", "filter": "f", "grp": "g"}), (F.col("dim") == F.col("d")) & (F.col("filter") == F.col("f")) & F.col("grp").eqNullSafe(F.col("g"))).withColumn("side", F.xxhash64(F.lit("chunk"), "grp", F.pmod(F.xxhash64("rep"), "parts")))
    others = parts.select(F.col("dim").alias("d2"), F.col("filter").alias("f2"), F.col("grp").alias("g2"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("k")).withColumn("other", F.xxhash64(F.lit("chunk"), "g2", F.col("k")))
    large = large.join(others, (F.col("dim") == F.col("d2")) & (F.col("filter") == F.col("f2"))).where(~F.coalesce(F.col("grp") == F.col("g2"), F.lit(False)))
    large = large.select("rep", "filter", F.xxhash64("dim", "filter", F.least("side", "other"), F.greatest("side", "other")).alias("unit"), "side", (F.col("side") != F.col("other")).alias("cross"))
    shipped = small.unionByName(large).join(rows, "rep").select("unit", "side", "cross", "filter", "rep", "mult", "ball", "embedding", "filters")
    found = cut(shipped.repartition("unit").sortWithinPartitions("unit").mapInArrow(_verify(cosine), "a long, b long, n long"))
    components = connected_components(found.select("a", "b").unionByName(rows.where("led").select(F.col("rep").alias("a"), F.col("ball").alias("b"))))
    linked = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    totals = rows.groupBy("ball").agg(F.sum("mult").alias("total"))
    result = rows.join(totals, "ball").join(linked, rows["rep"] == linked["node"], "left").select(F.col("rep"), (F.col("total") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    result = result.join(components, result["rep"] == components["node"], "left").select("rep", "n_links", F.coalesce("component", "rep").alias("component_id"))
    result = result.join(reps.select("rep", F.col("embedding").alias("e")), "rep")
    joined = vectors.join(result, F.col("good") & (vectors["embedding"] == result["e"]), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
