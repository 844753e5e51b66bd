"""Fill-in-the-middle against a plain version, and exact round trips."""

import hashlib
import re

import pytest
import regex
from hypothesis import given
from hypothesis import strategies as st

from sparkquill.llm import middle, queries
from sparkquill.llm.middle import Format
from tests.llm.helpers import docs


def plainly(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by the definition, with re."""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    i, j = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(u) for u in (units[:i], units[i:j], units[j:]))
    form = "spm" if h[3] % 100 < 20 else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@given(st.integers(-50, 10**12), st.text(st.sampled_from("ab Z<>PSM\n1é𝒳́\x00"), max_size=60))
def test_texts_are_cut_and_rebuilt(doc_id, text):
    style = Format()
    x = middle.cut(text, str(doc_id), style, regex.compile(style.units))
    assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == plainly(doc_id, text)
    assert middle.rebuild(x.output, x.form, style) == text


def test_sentinels_that_could_be_mistaken_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("", "b", "c"), ("aba", "x", "y"), ("<P", "P>", "q"), ("ab", "abc", "x")):
        with pytest.raises(ValueError):
            Format(*marks)
    assert Format("[pre]", "[suf]", "[mid]").suffix == "[suf]"


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "some words here"), (4, "x<M>y " * 9), (5, "\n\x00é𝒳" * 50), (6, "long words " * 60_000), (7, "<P"), (8, "S><P"), (9, "z" * 100_000)] + [(100 + k, f"line {k}\nof text {k}") for k in range(80)]
    found = middle.fill_in_middle(docs(spark, rows))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "node", "rid", "unit", "size", "span", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = middle.restore(found).collect()
    key = lambda r: repr(r)
    assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted(((i, t, *plainly(i, t or "")) for i, t in rows), key=key)
    assert all(r.restored == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    digests = {(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in middle.middle_digest(docs(spark, rows)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert digests == {(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, sha(r.output), sha(r.restored)) for r in got}


def test_added_columns_replace_those_of_the_same_name_and_empty_tables_stay_empty(spark):
    table = docs(spark, [(1, "some words")]).withColumnsRenamed({"size": "n", "span": "output"})
    assert middle.fill_in_middle(table).columns.count("n") == 1
    for f in (middle.fill_in_middle, middle.middle_digest):
        assert f(table.limit(0)).count() == 0
    odd = middle.restore(spark.createDataFrame([(None, "psm", "r"), ("x", None, "r")], "output string, form string, restored string")).collect()
    assert [r.restored for r in odd] == [None, None]


def test_the_query_takes_every_row(spark, sf_dir):
    rows = queries.op11_fill_in_middle(spark, sf_dir).collect()
    table = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(table)
    for r in rows:
        n, form, prefix, middle_, output = plainly(r.doc_id, table[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, prefix, middle_, *(hashlib.sha256(t.encode()).hexdigest() for t in (output, table[r.doc_id])))
