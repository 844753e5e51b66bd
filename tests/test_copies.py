"""Renamed copies against brute force and known answers."""

import hashlib
import random
import re
import tracemalloc

import pyarrow as pa
import pytest

from sparkquill import sample
from sparkquill.operators import copies
from sparkquill.plans import gate
from tests.test_engine import files


def program(n, seed=1, names="abcdefg"):
    """n lines of calls and conditions, of one seed the same but for names."""
    draw = random.Random(seed)
    pick = lambda: draw.choice(range(len(names)))
    shapes = ("{0} = {1} + {2}(3)", "if {0} > {1}: {2} = 4", "print({0}, [{1}, {2}])", "while {0}: {1} -= {2}", "{0} = 'x' if {1} else {2}", "for {0} in {1}: {2}.append({0})")
    return "".join(draw.choice(shapes).format(*(names[pick()] for _ in range(3))) + "\n" for _ in range(n))


def renamed(text, names):
    return re.sub(r"\b[a-g]\b", lambda x: names["abcdefg".index(x[0])], text)


def slow(lang, text):
    """fingerprints by their definition."""
    out, lines, named = copies.tokens(lang, text)
    grams = []
    for i in range(len(out) - copies.GRAM + 1):
        gram = out[i : i + copies.GRAM]
        code = [f"v{next((d for d in range(1, j + 1) if gram[j - d] == t and named[i + j - d]), 0)}" if named[i + j] else t for j, t in enumerate(gram)]
        grams.append(hashlib.md5(" ".join(code).encode()).hexdigest())
    width = min(copies.WINDOW, len(grams))
    picked = sorted({min(range(i, i + width), key=lambda k: (grams[k], -k)) for i in range(len(grams) - width + 1)}) if grams else []
    kept = [i for i in picked if len(set(out[i : i + copies.GRAM])) >= copies.VARIED]
    return [(at, lines[i], lines[i + copies.GRAM - 1], bytes.fromhex(grams[i])) for at, i in enumerate(kept)]


@pytest.mark.parametrize("seed", range(6))
def test_fingerprints_are_those_of_their_definition(seed):
    text = program(3 + 12 * seed, seed)
    for shape in (text, text + text, text * 2 + renamed(text, "pqrstuv"), "x = [" + "0, " * 200 + "]\n" + text):
        assert copies.fingerprints("python", shape) == slow("python", shape)
    assert copies.fingerprints("other", text) == slow("other", text)


@pytest.mark.parametrize("piece", (1, 7, 40, 64, 1000))
def test_pieces_of_tokens_change_nothing(monkeypatch, piece):
    monkeypatch.setattr(copies, "PIECE", piece)
    for n in (0, 3, 9, 25):
        text = program(n) + "x = [" + "0, " * 60 + "]\n" + renamed(program(n), "pqrstuv")
        assert copies.fingerprints("python", text) == slow("python", text) and copies.fingerprints("other", text) == slow("other", text)


def test_a_worker_holds_few_rows_at_a_time(monkeypatch):
    monkeypatch.setattr(copies, "ROWS", 256)
    words = [chr(97 + x % 26) + chr(97 + x // 26) for x in range(600)]
    texts = [" ".join(random.Random(k).choices(words, k=1500)) for k in range(60)]
    batch = pa.RecordBatch.from_pydict({"path": [str(k) for k in range(60)], "lang": ["other"] * 60, "content": texts})
    tracemalloc.start()
    sizes = [out.num_rows for out in copies._batched(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) > 20 * copies.ROWS and max(sizes) <= copies.ROWS and peak < 1e6
    few = batch.slice(0, 5)
    rows = [tuple(x.values()) for out in copies._batched(iter([few, few.slice(0, 0)])) for x in out.to_pylist()]
    assert rows == [(str(k), "other", *x) for k in range(5) for x in copies.fingerprints("other", texts[k])]


def test_empty_short_and_odd_texts():
    assert not any(copies.fingerprints(lang, text) for lang in ("python", "rust", "other") for text in ("", "\n\n", "a b c", "\ud800", "'", '"""'))
    assert not copies.fingerprints("python", "x = [" + "0, " * 5000 + "]")  # a table of numbers
    assert not copies.fingerprints("java", "/*" + " words" * 500 + "*/ // " + "more " * 500)


@pytest.mark.parametrize("seed", range(20))
def test_copies_of_enough_tokens_share_a_fingerprint(seed):
    body = program(18, seed)
    enough = len(copies.tokens("python", body)[0]) >= copies.GRAM + copies.WINDOW - 1
    found = [{x[3] for x in copies.fingerprints("python", program(30, 100 + k) + text + program(30, 200 + k))} for k, text in enumerate((body, renamed(body, ["one", "two", "three", "four", "five", "six", "seven"])))]
    assert enough and found[0] & found[1]


def test_what_tokens_are():
    text = 'fn f(a: &str) {\n  // gone\n  let b = "x\ny"; g(b, 0x1F, \'c\')\n}'
    out, lines, named = copies.tokens("rust", text)
    assert out == ["fn", "f", "(", "a", ":", "&", "str", ")", "{", "let", "b", "=", '"', "x", "y", '"', ";", "g", "(", "b", ",", "0", ",", '""', ")", "}"]
    assert lines[9:13] == [3, 3, 3, 3] and lines[14] == 4 and lines[-1] == 5 and [t for t, n in zip(out, named, strict=True) if n] == ["f", "a", "str", "b", "x", "y", "g", "b"]
    assert copies.tokens("other", "It's 12 o'clock,\n3x")[:2] == (["It's", "0", "o'clock,", "0x"], [1, 1, 1, 2])


def issues(spark, *rows, **how):
    return sorted((r.path, r.line, r.rule_id, r.message) for r in gate.collect_issues(files(spark, *rows), **how).where("category = 'duplicate_code'").collect())


def test_a_renamed_copy_is_one_issue_at_each_place_and_an_exact_one_is_said_once(spark):
    body, other = program(100), renamed(program(100), ["un", "deux", "trois", "quatre", "cinq", "six", "sept"])
    found = issues(spark, ("x/a.py", body), ("x/b.py", "import os\n\n" + other.replace("3", "77") + "# end\n"), ("x/c.py", program(40, 9)))
    assert [x[:3] for x in found] == [("x/a.py", found[0][1], "renamed_copy"), ("x/b.py", found[0][1] + 2, "renamed_copy")]
    assert found[0][1] <= 12 and all(" stands 2 times" in x[3] for x in found) and int(found[0][3].split()[2]) >= 88
    exact = issues(spark, ("x/a.py", body), ("x/b.py", body))
    assert [x[:3] for x in exact] == [("x/a.py", 1, "duplicate_block"), ("x/b.py", 1, "duplicate_block")]


def test_names_must_be_renamed_one_to_one(spark):
    body = program(30)
    mixed = "".join(renamed(line, random.Random(k).sample("pqrstuv", 7)) for k, line in enumerate(body.splitlines(True)))
    assert not issues(spark, ("x/a.py", body), ("x/b.py", mixed))


def test_changes_and_classes(spark):
    a, b = ("x/a.py", program(30)), ("x/b.py", renamed(program(30), "pqrstuv"))
    changed = spark.createDataFrame([("x/b.py",)], "path string")
    assert {x[0] for x in issues(spark, a, b, mode="diff", changed=changed)} == {"x/b.py"}
    assert not issues(spark, a, ("generated/b.py", b[1]))
    assert not copies.regions(copies.prints(files(spark).where("false"))).collect()


def test_nulls_and_texts_without_language(spark):
    prose = " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}x {k}" for k in range(80))
    rows = files(spark, ("a.txt", prose), ("b.txt", prose.replace("7", "8")), ("c.py", None), ("d.txt", ""))
    assert copies.prints(rows).count() == 0
    assert {(r.path, r.n_places) for r in copies.regions(copies.prints(rows, prose=True)).collect()} == {("a.txt", 2), ("b.txt", 2)}


def test_the_sample_holds_one_renamed_copy(spark):
    found = copies.regions(copies.prints(files(spark, *sample.FILES)))
    assert sorted((r.path, r.line) for r in found.collect()) == [("native/census.c", 3), ("native/tally.c", 1)]
