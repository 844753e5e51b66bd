import random

import pytest

from sparkquill.llm import repeats as module
from sparkquill.llm.repeats import remove_repeats, repeat_digest
from tests.llm.helpers import docs, repeated


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdefgh \nñ"
    shared = ["".join(rng.choice(letters) for _ in range(rng.randrange(150, 700))) for _ in range(8)]
    rows = []
    for k in range(60):
        text = ""
        for _ in range(rng.randrange(1, 4)):
            piece = rng.choice(shared)
            cut = rng.randrange(len(piece))
            text += "".join(rng.choice(letters) for _ in range(rng.randrange(200))) + rng.choice([piece, piece[:cut], piece[cut:]])
        rows.append((k, text))
    return rows


def digest(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("group", [4096, 3, 0])
def test_digests_are_those_of_counting_every_string(spark, group):
    rows = corpus(group)
    assert digest(repeat_digest(docs(spark, rows), 200, group=group)) == repeated(rows, 200)


@pytest.mark.parametrize("group", [4096, 20])
def test_a_passage_in_many_surroundings(spark, group):
    rng = random.Random(11)
    say = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passages = [say(n) for n in (90, 150, 230)]
    rows = [(k, say(rng.randrange(120)) + rng.choice(passages) + say(rng.randrange(300))) for k in range(150)]
    rows += [(200 + k, rows[k][1][:300]) for k in range(20)]
    table = docs(spark, rows).repartition(4)
    assert digest(repeat_digest(table, 200, group=group)) == repeated(rows, 200)


@pytest.mark.parametrize("group", [4096, 0])
def test_awkward_rows(spark, group):
    x = "".join(chr(97 + k * k % 26) + str(k) for k in range(120))
    rows = [(1, None), (2, ""), (3, "a" * 199), (4, "a" * 200), (5, "a" * 450), (6, "ab" * 300), (7, "b" + "ab" * 99), (8, x), (8, x), (None, x), (9, x + "é" * 300), (10, "\0" * 300), (11, "\0" * 201 + "x"), (12, x[:150] + x[100:])]
    assert digest(repeat_digest(docs(spark, rows), 200, group=group)) == repeated(rows, 200)


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    rng = random.Random(4)
    a = "".join(rng.choice("acgt") for _ in range(1_300_000))
    rows = [(1, a), (2, a[500_000:500_400] + "x" * 50 + a[1_048_000:1_049_500])]
    found = {r.doc_id: (r.n_removed, r.n_spans) for r in repeat_digest(docs(spark, rows)).collect()}
    assert found == {1: (1900, 2), 2: (1900, 2)}


def test_cleaned_texts(spark):
    shared = "".join(f"é{k}" for k in range(80))
    rows = [(1, "first " + shared + " end", "en", "s"), (2, "ü" + shared, None, None), (3, None, None, None), (4, "short", "de", "t")]
    table = docs(spark, rows)
    found = remove_repeats(table)
    assert found.columns == table.columns and found.schema == table.schema
    texts = {r.doc_id: r.text for r in found.collect()}
    assert texts == {1: "first  end", 2: "ü", 3: None, 4: "short"}


def test_characters_that_a_span_covers_in_part_stay(spark):
    tail = "".join(f"{k}z" for k in range(100))
    texts = {r.doc_id: r.text for r in remove_repeats(docs(spark, [(1, "é" + tail), (2, "ũ" + tail)])).collect()}
    assert texts == {1: "é", 2: "ũ"}


def test_empty_table(spark):
    assert repeat_digest(docs(spark, [])).count() == 0 and remove_repeats(docs(spark, [])).count() == 0


def test_every_string_holds_its_trigger():
    assert module.K + (1 << module.LOG_SPAN) - 1 <= 200
