"""Centroid clustering against rounds in Python's integers; screening against every exact distance."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkquill.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", "d", "n") for i, v in rows], SCHEMA)


def expected(rows, k, rounds, dim, scale):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) by Python integers alone."""
    bound = 1 << centroids.LIMIT
    kept = [(i, [max(-bound, min(bound, math.floor(float(np.float32(x)) * scale))) for x in v], v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))[:k]
    heads = [v for _, v, _ in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(heads))[::-1]

    for _ in range(rounds):
        held = {}
        for _, v, _ in kept:
            held.setdefault(nearest(v)[0], []).append(v)
        heads = [[sum(x) // len(held[j]) for x in zip(*held[j], strict=True)] if j in held else c for j, c in enumerate(heads)]
    last = [(i, *nearest(v)) for i, v, _ in kept]
    own = {}
    for _, j, d in last:
        own[j] = own.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in heads]
    return sorted(((i, j, d, own[j], sum(own.values()), sha[j]) for i, j, d in last), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@settings(max_examples=60)
@given(st.integers(0, 10**6), st.sampled_from([1, 3, 64, 700]), st.sampled_from([1, 3, 1_000, 1 << 20, 1 << 25]), st.booleans())
def test_screening_finds_the_exact_nearest(seed, dim, most, close):
    rng = np.random.default_rng(seed)
    heads = rng.integers(-most, most + 1, (9, dim))
    heads[4] = heads[2]  # a tie for every vector
    vectors = rng.integers(-most, most + 1, (60, dim))
    if close:  # halfway between two centroids, a little off, where float32 can't tell
        pairs = rng.integers(0, 9, (60, 2))
        vectors = (heads[pairs[:, 0]] + heads[pairs[:, 1]]) // 2
    number, distance, _ = centroids.Screen(heads).nearest(vectors)
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)) for c in heads] for v in vectors]
    assert distance.tolist() == [min(x) for x in exact]
    assert number.tolist() == [x.index(min(x)) for x in exact]


def test_few_vectors_are_decided_in_integers():
    rng = np.random.default_rng(1)
    heads, vectors = rng.integers(-300, 300, (40, 64)), rng.integers(-300, 300, (2_000, 64))
    assert centroids.Screen(heads).nearest(vectors)[2] < 20


@pytest.mark.parametrize("k,rounds", [(5, 3), (40, 5), (1, 1), (7, 0)])
def test_rounds_are_those_of_integers(spark, k, rounds):
    rng = np.random.default_rng(k)
    rows = [(int(i), [float(x) for x in np.float32(rng.standard_normal(6))]) for i in rng.permutation(120)]
    rows += [(1_000 + i, rows[0][1]) for i in range(150)]  # one vector is more than half of all
    assert found(centroids.cluster_vectors(frame(spark, rows).repartition(7), k, rounds, 6, 16)) == expected(rows, k, rounds, 6, 16)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, -2.5]), (1, [1.0, -2.5]), (1, [0.5, 3.0]), (None, [0.001, -0.001]), (2, [0.0, 0.0]), (3, [-0.0, 1e30]), (4, [-3e38, 3e38])]
    rows = [*good, (5, None), (6, []), (7, [1.0]), (8, [1.0, None]), (9, [nan, 1.0]), (10, [inf, 1.0]), (11, [1.0, -inf]), (12, [1.0, 2.0, 3.0])]
    for k in (2, 40):
        assert found(centroids.cluster_vectors(frame(spark, rows), k, 2, 2, 256)) == expected(rows, k, 2, 2, 256)
    for none in (frame(spark, []), frame(spark, rows).where("vec_id > 4")):
        df = centroids.cluster_vectors(none, 3, 1, 2)
        assert df.count() == 0 and df.dtypes == centroids.cluster_vectors(frame(spark, rows), 3, 1, 2).dtypes
    with pytest.raises(ValueError):
        centroids.cluster_vectors(frame(spark, rows), dim=4_000)


def test_double_components(spark):
    rows = [(i, [0.1 * i, 1 / (i + 1)]) for i in range(20)]
    double = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    table = {r.vec_id: r for r in centroids.cluster_vectors(double, 20, 0, 2, 1 << 16).collect()}
    assert all(r.distance == 0 for r in table.values())
    assert table[3].centroid_sha256 == hashlib.sha256(f"{math.floor(0.1 * 3 * (1 << 16))},{math.floor(0.25 * (1 << 16))}".encode()).hexdigest()
