"""Boosted trees against a plain version, and held-out accuracy."""

import math

import numpy as np
import pytest

from sparkquill.llm import quality, queries
from tests.llm.helpers import docs


def walked(trees, row):
    """The score of one row, tree by tree."""
    total = trees.base
    for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
        total += value[node - len(feature)]
    return 1 / (1 + math.exp(-total))


def sampled(seed, n=400):
    rng = np.random.default_rng(seed)
    rows = np.stack([rng.standard_normal(n), rng.integers(0, 3, n), np.zeros(n), rng.exponential(size=n)], axis=1)
    return rows, ((rows[:, 0] > 0.3) ^ (rows[:, 1] == 1)).astype(float)


def test_traversal_is_that_of_each_tree():
    rows, labels = sampled(1)
    trees = quality.fit(rows, labels, trees=25, depth=3)
    assert np.allclose(trees.score(rows), [walked(trees, r) for r in rows], atol=1e-12)
    assert ((trees.score(rows) > 0.5) == (labels == 1)).mean() > 0.97


def test_a_split_is_the_best_of_all():
    rows, labels = sampled(2, 60)
    (tree,) = quality.fit(rows, labels, trees=1, depth=1, least=5, bins=400).feature
    share = (labels.sum() + 1) / 62
    g, h = share - labels, np.full(60, share * (1 - share))

    def gain(f, t):
        left = rows[:, f] <= t
        if min(left.sum(), (~left).sum()) < 5:
            return 0
        return sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left))

    best = max((gain(f, t), -f) for f in range(4) for t in set(rows[:, f]))
    assert tree[0] == -best[1]
    whole = quality.fit(rows, labels, trees=1, depth=1, least=5, bins=400)
    assert gain(tree[0], whole.threshold[0, 0]) == pytest.approx(best[0])


def test_labels_of_one_kind_and_none():
    rows, _ = sampled(3, 50)
    assert quality.fit(rows, np.ones(50)).score(rows).tolist() == pytest.approx([51 / 52] * 50)
    assert quality.fit(rows[:0], np.zeros(0)).score(rows).tolist() == pytest.approx([0.5] * 50)
    assert len(quality.fit(rows, np.ones(50)).score(rows[:0])) == 0


def test_statistics_of_known_texts():
    x = dict(zip(quality.FEATURES, quality.statistics("Ab ab ab. 12!\nAb ab ab. 12!\n\n"), strict=True))
    assert x["distinct_words"] == 4 / 8 and x["top_word"] == 2 / 8 and x["ended_words"] == 4 / 8 and x["wordless"] == 2 / 8
    assert x["distinct_lines"] == x["ended_lines"] * 0.5 == 0.5 and x["same_next"] == 0 and x["distinct_triples"] == 4 / 6
    assert dict(zip(quality.FEATURES, quality.statistics("a a a"), strict=True))["same_next"] == 2 / 3
    assert all(math.isfinite(v) for t in ("", " ", "\n", "é", "x" * 10) for v in quality.statistics(t))


def test_pieces_count_as_a_whole(monkeypatch):
    text = "Some words. of which\nsome some ARE 12 longer-than-others. " * 40
    whole = quality.statistics(text)
    monkeypatch.setattr(quality, "PIECE", 37)
    assert quality.statistics(text) == whole


@pytest.mark.parametrize("size", ["sf0.01"])
def test_held_out_documents_are_told_apart(spark, sf_dir, size):
    folder = f"{sf_dir.rsplit('/', 1)[0]}/{size}"
    rows = queries.op13_quality_classifier(spark, folder).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    judged = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(judged) > 50 and sum(r.predicted == labels[r.doc_id] for r in judged) >= 0.97 * len(judged)


def test_awkward_rows(spark):
    bad, good = "junk | junk | junk | ", "A plain sentence of some words, and then another one. "
    rows = [(k, bad * (5 + k % 7) if k % 3 else good * (1 + k % 5)) for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0), 0) for k in range(300)] + [(0, 1, 0), (1, 1, 0), (5, None, 0), (6, 7, 0), (None, 1, 0), (900, 1, 0)], "doc_id long, quality int, toxic int")
    table = docs(spark, [*rows, (0, rows[0][1]), (0, rows[0][1]), (None, good), (None, None), (400, None), (401, ""), (402, bad * 20_000), (403, "x" * 50_000)])
    model = quality.learn(table, labels)
    found = quality.classify(table, model)
    assert found.columns == [*table.columns, "score", "predicted"]
    got = {(r.doc_id, r.text): (r.score, r.predicted) for r in found.collect()}
    assert found.count() == table.count() and all(got[row][1] == (row[0] % 3 == 0) for row in rows)
    assert got[(None, good)][1] == 1 and got[(402, bad * 20_000)][1] == 0
    assert got[(400, None)][0] == got[(401, "")][0] == got[(None, None)][0]
    assert {(r.doc_id, r.score) for r in quality.quality_scores(table, model).collect()} == {(i, s) for (i, _), (s, _) in got.items()}
    again = quality.learn(table.repartition(5), labels)
    assert np.array_equal(again.threshold, model.threshold) and np.array_equal(again.value, model.value)
    bounded = quality.learn(table, labels, rows=40)
    assert bounded.base != model.base


def test_empty_tables(spark):
    table, labels = docs(spark, [(1, "text")]), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    nothing = quality.learn(table.limit(0), labels.limit(0))
    assert [r.score for r in quality.classify(table, nothing).collect()] == [0.5]
    assert quality.classify(table.limit(0), quality.learn(table, labels)).count() == 0
    replaced = quality.classify(table.withColumnRenamed("size", "score"), nothing)
    assert replaced.columns.count("score") == 1
