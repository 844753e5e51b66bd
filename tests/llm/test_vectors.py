import math
from statistics import NormalDist

import numpy as np
import pytest

from sparkquill.llm.vectors import list_decode, product_code, unit_vectors, vector_dedup
from tests.llm.helpers import Groups

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, ball string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", "b") for i, v in rows], SCHEMA)


def expected(rows, cosine=0.95):
    good = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[k] = unit_vectors(np.array([v], np.float32))[0]
    links = {k: [j for j in good if j != k and len(good[j]) == len(good[k]) and good[j] @ good[k] >= cosine] for k in good}
    groups = Groups({rows[k][0] for k in good})
    for k, others in links.items():
        for j in others:
            groups.link(rows[k][0], rows[j][0])
    return sorted(((i, len(links.get(k, ())), groups.find(i) if k in good else i) for k, (i, _) in enumerate(rows)), key=repr)


def clustered(seed, groups, size, dim=24, noise=0.06):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        centre = rng.standard_normal(dim)
        for _ in range(size):
            rows.append((len(rows), [float(x) for x in np.float32(centre / np.linalg.norm(centre) + noise * rng.standard_normal(dim))]))
    return rows


@pytest.mark.parametrize("options", [{}, {"block": 8}])
@pytest.mark.parametrize("noise", [0.02, 0.045])
def test_links_and_components_are_those_of_all_pairs(spark, options, noise):
    rows = clustered(3, 12, 15, noise=noise) + [(900 + k, v) for k, (_, v) in enumerate(clustered(3, 1, 5))]
    found = vector_dedup(frame(spark, rows), **options).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=repr) == expected(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_awkward_rows(spark):
    a = [1.0, 0.0, 0.0]
    rows = [(5, a), (5, a), (6, [2.0, 0.0, 0.0]), (7, None), (8, []), (9, [0.0] * 3), (10, [1.0, None, 0.0]), (11, [float("nan")] * 3), (12, [float("inf"), 0.0, 0.0]), (None, a), (13, [1.0]), (14, [3.0]), (15, [1.0, 0.0]), (1, [-1.0, 0.0, 0.0])]
    found = sorted(((r.vec_id, r.n_links, r.component_id) for r in vector_dedup(frame(spark, rows)).collect()), key=repr)
    assert found == expected(rows)


def test_empty_table(spark):
    assert vector_dedup(frame(spark, [])).count() == 0


def test_caps_hold_all_that_exceeds_them():
    rotation, words = product_code(16, 20)
    vectors = unit_vectors(np.random.default_rng(1).standard_normal((300, 16)))
    counts, held = list_decode(vectors, rotation, words, 12)
    scores = np.stack([((vectors @ rotation)[:, :8] @ words[0].T)[:, :, None] + ((vectors @ rotation)[:, 8:] @ words[1].T)[:, None, :]]).reshape(300, -1)
    cap = NormalDist().inv_cdf(1 - 12 / 400) * math.sqrt(2 / 16)
    assert (counts > 12).any() and (counts == 12).any() and counts.sum() == len(held)
    for own, s in zip(np.split(held, np.cumsum(counts)[:-1]), scores, strict=True):
        assert list(own) == sorted(np.flatnonzero(s >= min(cap, np.sort(s)[-12])))
