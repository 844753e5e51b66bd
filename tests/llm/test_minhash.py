import random

import numpy as np
import pytest

from sparkquill.llm.minhash import banding, minhash_dedup, shingle_sets, signatures
from sparkquill.llm.common import RollingHash
from tests.llm.helpers import docs, near_copies, shingles

WORDS = [f"w{k}" for k in range(400)]


def corpus(seed, groups=15, copies=8, size=60):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(size // 2, size))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = rng.choice(WORDS)
            rows.append((len(rows), "  ".join(text).title() if rng.random() < 0.5 else "\n".join(text)))
    return rows


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("threshold", [0.8, 0.85])
@pytest.mark.parametrize("options", [{}, {"block": 4}, {"together": 300}])
def test_components_are_those_of_all_pairs(spark, threshold, options):
    rows = corpus(int(threshold * 100))
    assert found(minhash_dedup(docs(spark, rows), threshold, **options)) == near_copies(rows, round(100 * threshold))


def test_documents(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    assert found(minhash_dedup(table, 0.85)) == near_copies(rows, 85)


def test_awkward_rows(spark):
    long = " ".join(f"x{k}" for k in range(250_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\ttwo"), (6, "two one"), (7, long), (8, long + " more"), (9, "É é"), (10, "é É"), (-3, "a b c d e"), (11, "A b C d e")]
    assert found(minhash_dedup(docs(spark, rows), 0.85)) == near_copies(rows, 85)


def test_a_large_group_of_near_copies_and_what_is_close_to_it(spark):
    rng = random.Random(8)
    base = [f"b{k}" for k in range(80)]
    rows = []
    for k in range(10_000):
        text = list(base)
        if k % 3:
            text[rng.randrange(80)] = f"o{k}"
        rows.append((k, " ".join(text)))
    far = list(base)
    for k in range(0, 80, 16):
        far[k] = "far"
    rows += [(20_000 + k, " ".join([*far, f"e{k}"])) for k in range(600)]  # near each other, candidates of the others
    result = found(minhash_dedup(docs(spark, rows), 0.85, block=256))
    sample = [rows[k] for k in (*range(0, 10_000, 250), *range(10_000, 10_600, 40))]
    assert {result[i][0] == len(shingles(t)) for i, t in sample} == {True}
    groups = {}
    for i, (_, c) in result.items():
        groups.setdefault(c, []).append(i)
    assert {c for _, c in near_copies([(0, " ".join(base)), *rows[:10_000:100]], 85).values()} == {0}  # all are linked with the base
    assert sorted(groups[0]) == [*range(10_000)] and sorted(groups[20_000]) == [*range(20_000, 20_600)]


@pytest.mark.parametrize("seed", range(3))
def test_large_groups_of_several_components(spark, seed):
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(120):  # a family: all candidates of each other, about half of them linked
        text = list(base)
        for _ in range(rng.randrange(6)):
            text[rng.randrange(60)] = rng.choice(WORDS[:9])
        rows.append((k, " ".join(text)))
    for options in ({"block": 8}, {"block": 16, "together": 500}):
        assert found(minhash_dedup(docs(spark, rows), 0.85, **options)) == near_copies(rows, 85)


def test_rows_of_one_id_with_different_texts(spark):
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen"
    rows = [(4, a), (4, b), (5, a), (3, b + " "), (4, b), (None, a)]
    result = sorted(((r.doc_id, r.component_id, r.kept, r.n_shingles) for r in minhash_dedup(docs(spark, rows), 0.85).collect()), key=repr)
    assert result == sorted([(4, 4, True, 4), (4, 3, False, 2), (4, 3, False, 2), (5, 4, False, 4), (3, 3, True, 2), (None, None, True, 4)], key=repr)


def test_rows_without_id_and_repeated_rows(spark):
    rows = minhash_dedup(docs(spark, [(None, "a b c"), (None, "a b c"), (2, "a b c"), (2, "a b c"), (3, "a b c")]), 0.85).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in rows if r.doc_id is not None), key=repr) == [(2, 2, True), (2, 2, True), (3, 2, False)]
    assert [r.kept for r in rows if r.doc_id is None] == [True, True]


def test_empty_table(spark):
    assert minhash_dedup(docs(spark, []), 0.85).count() == 0


def test_sets_have_every_shingle():
    texts = [t.encode() for _, t in corpus(5)] + [b"", b"x", "ß ẞ".encode()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    sets = shingle_sets(RollingHash(lower=True), data, np.cumsum([0, *map(len, texts)]), 5)
    assert [len(s) for s in sets] == [len(shingles(t.decode())) for t in texts]


def test_coordinates_estimate_the_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 300, dtype=np.uint64)
    a, b = np.sort(pool[:240]), np.sort(pool[60:])
    x, y = signatures([a, b], 2000)
    assert abs((x == y).mean() - 0.6) < 0.05


def test_bands_let_few_pairs_slip():
    for threshold in (0.5, 0.8, 0.85, 0.9):
        bands, rows = banding(threshold)
        assert (1 - threshold**rows) ** bands <= 3e-7
