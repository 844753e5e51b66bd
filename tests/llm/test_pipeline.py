
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkquill.llm.langid import held_out, identify, learn
from tests.llm.helpers import docs, near_copies, repeated



@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    out, df = {}, spark.read.parquet(f"{sf_dir}/documents.parquet")
    out["documents"] = df
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, df, sf_dir).write.parquet(path)
        out[name] = df = spark.read.parquet(path)
    return out


def test_stages_keep_the_columns_of_documents(stages):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "repeats", "mixing", "tokens"]
    for name in names[:-1]:
        assert stages[name].dtypes == stages["documents"].dtypes


def test_language_drops_what_it_rejects(spark, stages):
    table = stages["documents"]
    rejected = {r.doc_id for r in identify(table, learn(table.where(~held_out(table["doc_id"])))).where("rejected").collect()}
    assert {r.doc_id for r in stages["language"].collect()} == {r.doc_id for r in table.collect()} - rejected
    assert len(rejected) <= 0.03 * table.count()


def test_near_duplicates_leave_one_of_each_group(stages):
    groups = near_copies([(r.doc_id, r.text) for r in stages["language"].collect()], 80)
    assert {r.doc_id for r in stages["near_duplicates"].collect()} == {i for i, (_, c) in groups.items() if i == c}


def test_rows_of_one_id_with_other_texts_stay(spark, sf_dir):
    a, b, c = ("".join(f"{x}{k} " for k in range(60)) for x in "abc")
    rows = [(1, a, "en", "s"), (1, b, "en", "s"), (1, a + "z", "en", "s"), (2, a, "en", "t"), (3, c, "en", "s"), (3, c, "en", "s"), (3, c, "de", "s"), (4, None, None, None), (4, None, None, "x"), (None, a, None, None), (5, "", None, None)]
    table = docs(spark, rows)
    kept = corpus_pipeline.near_duplicates(spark, table, sf_dir).collect()
    texts = sorted((repr(r.doc_id), r.text or "", r.lang or "") for r in kept)
    assert [t[0] for t in texts] == ["1", "1", "3", "4", "5", "None"]
    assert {t[1] for t in texts if t[0] == "1"} in ({a, b}, {a + "z", b})
    assert [t[2] for t in texts if t[0] == "3"] == ["de"]  # the first by its further columns


def test_repeats_are_cut(stages):
    before = {r.doc_id: r.text for r in stages["near_duplicates"].collect()}
    counted = {r[0]: r for r in repeated(list(before.items()), 200)}
    after = {r.doc_id: r for r in stages["repeats"].collect()}
    for i, r in after.items():
        gone = len(before[i].encode()) - len(r.text.encode())
        assert counted[i][2] - 8 * counted[i][3] <= gone <= counted[i][2]
        assert r.n_chars == len(r.text)
    assert all(len(before[i].encode()) - counted[i][2] <= 20 for i in set(before) - set(after))


def test_mixing_comes_near_the_targets(stages):
    before, after = stages["repeats"].collect(), stages["mixing"].collect()
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    counts = {}
    for r in after:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(counts.values()) <= 3
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(words(after) - words(before)) <= sum(max(len(r.text.split()) for r in before if r.source == s) for s in {r.source for r in before})


def test_tokens_of_every_row(stages):
    assert stages["tokens"].count() == stages["mixing"].count()
    texts = {r.doc_id: r.h for r in stages["mixing"].select("doc_id", F.sha2("text", 256).alias("h")).collect()}
    assert all(r.decoded_sha256 == texts[r.doc_id] for r in stages["tokens"].collect())


def test_awkward_rows_pass_every_stage(spark, sf_dir):
    table = docs(spark, [(1, None, None, None), (2, "", "en", "a"), (None, "words of a text", "en", None), (3, "the same words " * 80, "en", "a"), (3, "the same words " * 80, "en", "a"), (4, "der die das und " * 4, "de", "b")])
    for rows in (table, table.limit(0)):
        df = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, sf_dir)
            assert df.columns == table.columns, name
            assert {r.size for r in df.select("size").collect()} <= {"z"}, name
        assert corpus_pipeline.STAGES[-1][1](spark, df, sf_dir).count() == df.count()


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    columns = stages["tokens"].columns
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()), key=repr)
    assert rows(corpus_pipeline.run(spark, sf_dir)) == rows(stages["tokens"])
