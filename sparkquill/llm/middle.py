"""Fill-in-the-middle: texts cut into prefix, middle and suffix between units, and put in another order behind sentinels.

A unit is what the pattern matches; an Arrow-batched pandas UDF collects the ends of a text's units in a compact array of 32-bit
numbers, so that a cut between units is one look-up and a slice, however long the text is. Where to cut and which form to
take are drawn from a hash of the row's id, so reruns and other partitionings agree and nothing is shuffled.

Sentinels must neither overlap each other nor themselves (checked), so the first one of its kind in an output is the one that was put
there, and a text that holds one already stays plain: every output gives its text back.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a word together, anything else alone.
UNITS = r"[A-Za-z]+|[^A-Za-z]"
PLAIN, PSM, SPM = "plain", "psm", "spm"
PARTS = "n long, form string, prefix_chars long, middle_chars long"
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


@dataclass(frozen=True)
class Format:
    """Sentinels, how many texts of a hundred are cut, and how many of those put the suffix first."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    cut_percent: int = 90
    suffix_first_percent: int = 20
    units: str = UNITS

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        ends_in = any(a[k:] and b.startswith(a[k:]) for a in marks for b in marks for k in range(len(a)) if k or a is not b)
        if not all(marks) or len(set(marks)) < 3 or ends_in:
            raise ValueError("sentinels must be different and none may begin with an end of another or of itself")


@dataclass(frozen=True)
class Cut:
    """n units; prefix_chars and middle_chars are None where the form is plain."""

    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def seeds(key: str) -> list[int]:
    """The first four 8-digit groups of the hex SHA-256 of ``1:`` and key."""
    digest = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def unit_ends(text: str, units: regex.Pattern) -> array:
    """Where each unit ends, in code points."""
    return array("I", (m.end() for m in units.finditer(text)))


def cut(text: str, key: str, style: Format, units: regex.Pattern) -> Cut:
    ends = unit_ends(text, units)
    n = len(ends)
    one, two, whether, which = seeds(key)
    if not text or whether % 100 >= style.cut_percent or any(mark in text for mark in (style.prefix, style.suffix, style.middle)):
        return Cut(n, PLAIN, None, None, text)
    first, second = sorted((one % (n + 1), two % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if which % 100 < style.suffix_first_percent:
        return Cut(n, SPM, a, b - a, f"{style.suffix}{suffix}{style.prefix}{prefix}{style.middle}{middle}")
    return Cut(n, PSM, a, b - a, f"{style.prefix}{prefix}{style.suffix}{suffix}{style.middle}{middle}")


def rebuild(output: str, form: str, style: Format) -> str:
    """The text that an output of a form was made of."""
    if form == PLAIN:
        return output
    outer, _, middle = output.partition(style.middle)
    first, then = (style.prefix, style.suffix) if form == PSM else (style.suffix, style.prefix)
    a, _, b = outer.removeprefix(first).partition(then)
    return a + middle + b if form == PSM else b + middle + a


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def _udf(schema: str, row: Callable[[str, str], tuple]) -> Callable[..., Column]:
    """An Arrow-batched UDF of (text, key) to a struct."""
    names = [field.split()[0] for field in schema.split(", ")]
    wide = {name: "Int64" for name in names if f"{name} long" in schema.split(", ")}

    @F.pandas_udf(f"struct<{', '.join(field.replace(' ', ':') for field in schema.split(', '))}>")
    def run(text: pd.Series, key: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([row(t, k) for t, k in zip(text, key, strict=True)], columns=names).astype(wide)

    return run


def fill_in_middle(docs: DataFrame, style: Format = Format()) -> DataFrame:
    """docs (doc_id, text, ...) with n, form, prefix_chars, middle_chars and output.

    Null text counts as empty, and empty text stays plain; a null id is drawn for as an empty one; rows of one id and text agree.
    Columns of docs of the added names are replaced; an empty table gives an empty result.
    """
    docs = docs.drop(*ADDED)
    units = regex.compile(style.units)

    def row(text: str, key: str) -> tuple:
        x = cut(text, key, style, units)
        return x.n, x.form, x.prefix_chars, x.middle_chars, x.output

    found = _udf(f"{PARTS}, output string", row)(F.coalesce(docs["text"], F.lit("")), _key(docs["doc_id"]))
    return docs.withColumn("__fim", found).select(*[docs[c] for c in docs.columns], "__fim.*")


def restore(rows: DataFrame, style: Format = Format()) -> DataFrame:
    """rows (output, form, ...) with restored: the text that each output was made of; null where one of the two is null."""
    names = [c for c in rows.columns if c != "restored"]

    @F.pandas_udf("string")
    def run(output: pd.Series, form: pd.Series) -> pd.Series:
        return pd.Series([None if o is None or f is None else rebuild(o, f, style) for o, f in zip(output, form, strict=True)], dtype=object)

    return rows.select(*[rows[c] for c in names], run(rows["output"], rows["form"]).alias("restored"))


def middle_digest(docs: DataFrame, style: Format = Format()) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256.

    The same as fill_in_middle and restore, but a text crosses to Python once and only digests come back.
    """
    units = regex.compile(style.units)

    def row(text: str, key: str) -> tuple:
        x = cut(text, key, style, units)
        return x.n, x.form, x.prefix_chars, x.middle_chars, *(hashlib.sha256(t.encode()).hexdigest() for t in (x.output, rebuild(x.output, x.form, style)))

    found = _udf(f"{PARTS}, output_sha256 string, restored_sha256 string", row)(F.coalesce("text", F.lit("")), _key(F.col("doc_id")))
    return docs.select("doc_id", found.alias("x")).select("doc_id", "x.*")


#: By counting matches and slicing lists of them.
ORACLE_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
numbers AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM drawn),
places AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (
  SELECT *, array_to_string(u[1:i], '') AS p, array_to_string(u[i + 1:j], '') AS m, array_to_string(u[j + 1:], '') AS s FROM places)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
