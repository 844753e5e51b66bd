"""Exact centroid clustering: Lloyd's rounds over integer vectors, screened in single precision and decided in integers.

Components become floor(scale * x). One matrix product in float32 gives all scores |c|^2 - 2 v.c of a batch at once. Each score
has an interval that surely holds the exact one (BOUND below); centroids whose interval begins above the least end are out,
and where more than one is left, those alone are computed again in 64-bit integers, ties going to the lowest number. So results are exact
whatever the order of sums, the batches or the machine.

A round is one scan of the vectors with the centroids broadcast (k times the dimension, both parameters): each task sums its own
vectors by centroid, and only sums are shuffled, so a centroid that holds a third of all vectors costs no more than another one.
The driver gets k centroids a round.

BOUND. With u = 2**-24 and n components, both factors rounded to float32, n products and n - 1 sums in any order, the error of a product of
vectors is at most g / (1 - g) * sum |v_i| |c_i| with g = (n + 2) u, and the sum is at most |v| |c|. Components are integers up to
2**LIMIT, so nothing under- or overflows; the float64 steps after it have their own, far smaller, share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquill.llm.common import cut, each

#: Integers are held within +-2**LIMIT, so that a squared distance of up to MOST_DIM components fits a long.
LIMIT, MOST_DIM = 25, 1_024
#: Rows of one matrix product.
ROWS = 4_096


def valid(embedding: Column, dim: int) -> Column:
    """Whether an array has dim components, none of them null, infinite or not a number."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(embedding) == dim) & ~odd, F.lit(False))


def integers(flat: np.ndarray, dim: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * x), x in double precision, held within +-2**LIMIT."""
    x = np.floor(flat.astype(np.float64) * scale)
    return np.clip(x, -(2.0**LIMIT), 2.0**LIMIT).astype(np.int64).reshape(-1, dim)


def _distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows."""
    x = vectors - centroids
    return np.einsum("ij,ij->i", x, x)


class Screen:
    """Nearest of some centroids (rows of integers)."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.exact = centroids
        self.single = np.ascontiguousarray(centroids.astype(np.float32).T)
        squares = (centroids * centroids).sum(axis=1)
        self.squares = squares.astype(np.float64)
        g = (centroids.shape[1] + 2) * 2.0**-24
        up = 1 + 2.0**-40  # above what float64's own rounding of norms takes away
        self.reach = np.sqrt(self.squares) * up
        self.relative = 2 * g / (1 - g) * up

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of each vector's nearest centroid, and how many vectors were decided in integers."""
        dots = (vectors.astype(np.float32) @ self.single).astype(np.float64)
        scores = self.squares - 2 * dots
        norms = np.sqrt((vectors * vectors).sum(axis=1).astype(np.float64)) * (1 + 2.0**-40)
        error = self.relative * norms[:, None] * self.reach + 2.0**-50 * (self.squares + 2 * np.abs(dots))
        low, high = scores - error, scores + error
        left = low <= high.min(axis=1, keepdims=True)
        best = left.argmax(axis=1)
        open_ = np.flatnonzero(left.sum(axis=1) > 1)
        if len(open_):
            row, number = np.nonzero(left[open_])
            distance = _distances(vectors[open_[row]], self.exact[number])
            order = np.lexsort((number, distance, row))
            first = order[np.searchsorted(row[order], np.arange(len(open_)))]
            best[open_] = number[first]
        return best, _distances(vectors, self.exact[best]), len(open_)


def _passes(batch: pa.RecordBatch, column: int, dim: int, scale: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, integers) of ROWS rows at a time."""
    for start in range(0, batch.num_rows, ROWS):
        yield start, integers(batch.column(column).slice(start, ROWS).flatten().to_numpy(zero_copy_only=False), dim, scale)


def initial(vectors: DataFrame, k: int, dim: int, scale: int) -> np.ndarray:
    """The k vectors of smallest SHA-256 of ``2:`` and id, in that order; of equal ones by the vector itself."""
    text = F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(text, 256).alias("h"), "embedding").orderBy("h", "embedding").limit(k).collect()
    return integers(np.array([r["embedding"] for r in rows], np.float64), dim, scale)


def moved(vectors: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """Each centroid as the componentwise floor of its vectors' exact mean; one without vectors stays."""
    dim = centroids.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(shared.value)
        counts, sums = np.zeros(len(screen.exact), np.int64), np.zeros(screen.exact.shape, np.int64)
        for batch in each(batches):
            for _, rows in _passes(batch, 0, dim, scale):
                number, _, _ = screen.nearest(rows)
                counts += np.bincount(number, minlength=len(counts))
                order = np.argsort(number, kind="stable")
                held, first = np.unique(number[order], return_index=True)
                sums[held] += np.add.reduceat(rows[order], first, axis=0)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held]), pa.array(list(sums[held]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = vectors.select("embedding").mapInArrow(run, "cluster int, n long, sums array<long>")
    exact = "decimal(38,0)"
    found = parts.select("cluster", "n", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum(F.col("n").cast(exact)).alias("n"), F.sum(F.col("x").cast(exact)).alias("x"))
    out = centroids.copy()
    for r in found.collect():
        out[r["cluster"], r["at"]] = int(r["x"]) // int(r["n"])
    shared.unpersist()
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray, scale: int) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""
    dim = centroids.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(shared.value)
        for batch in each(batches):
            for start, rows in _passes(batch, 1, dim, scale):
                number, distance, _ = screen.nearest(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, ROWS), pa.array(number, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256) -> DataFrame:
    """One row for each kept row of vectors (vec_id, embedding): vec_id, cluster, distance (squared), cluster_inertia and inertia (distance summed
    over the cluster and over all), centroid_sha256 (of the components as decimal integers joined by commas).

    Kept are vectors of dim components, none null, infinite or not a number. Repeated rows stand apart; a null id is an empty one in the
    draw of the first centroids. With fewer than k vectors there are fewer centroids; without any the result is empty.
    Further columns are ignored. Integers beyond +-2**25 count as that; a sum of distances beyond a long is null.
    """
    if not 0 < dim <= MOST_DIM:
        raise ValueError(f"dim must be from 1 to {MOST_DIM}")
    kept = vectors.where(valid(F.col("embedding"), dim)).select("vec_id", "embedding")
    centroids = initial(kept, k, dim, scale).reshape(-1, dim)
    if not len(centroids):
        return kept.where("false").selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    for _ in range(rounds):
        centroids = moved(kept, centroids, scale)
    rows = cut(assigned(kept, centroids, scale))
    sums = {r["cluster"]: int(r["own"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()}
    whole = [(i, *(x if x < 1 << 63 else None for x in (sums[i], sum(sums.values()))), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist()) if i in sums]
    facts = kept.sparkSession.createDataFrame(whole, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256) -> str:
    """The same by all distances of all pairs, round after round."""
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v AS c FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"d{i} AS MATERIALIZED (SELECT rid, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance FROM kept, c{i}),\n"
            f"a{i} AS MATERIALIZED (SELECT rid, cluster, distance FROM d{i} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) = 1)"
        )
        if i < rounds:
            parts.append(
                f"m{i} AS MATERIALIZED (SELECT cluster, place, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT cluster, generate_subscripts(v, 1) AS place, unnest(v) AS x FROM a{i} JOIN kept USING (rid)) GROUP BY cluster, place),\n"
                f"c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN (SELECT cluster, list(x ORDER BY place) AS c FROM m{i} GROUP BY cluster) n USING (cluster))"
            )
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (rid) JOIN c{rounds} USING (cluster)
"""


ORACLE_SQL = oracle_sql()
