"""Licence scans: sparse TF-IDF cosine of notices to templates, and inheritance from the nearest directory that has a licence.

Texts and templates are bags of words (lower case, letters a-z and digits, without STOPWORDS), weighed by term frequency times
inverse document frequency, of every word, over all documents. Templates are titles, standard headers, opening sentences and
SPDX lines; they stand for whole licence texts too, as one of them is in each. A template is held against windows: runs of words
from one of the template's words to another one, of up to SPAN times the template's words and over any line ends. So a notice
counts by itself, whatever stands beside it or in its line. A window must also hold what the template has of the licence's
name: "released under license" is no "mit", and version 2 of a licence isn't version 3. A document takes the licence of the
greatest cosine that reaches the threshold; a licence that another one adds a clause to (OUTRANKS) gives way to it. Bags of words
don't read sentences: "not released under the MIT License" holds a notice.

A licence file is a document named as one, or of which the notice is a large part. It holds for its directory and those below,
up to the next one: each directory's ancestors are joined to the directories that have a licence file, and the deepest one
wins. A notice of its own goes before.

At scale: texts are read twice, once for the document frequencies, a sum that combines before it is shuffled, and once to find
windows within their row. A cosine needs so much of a template that one of its rarest words must be there (``_anchors``); only
texts with such a word are looked into, and only windows that hold enough of a template go on. Their words meet the document
frequencies by a join; each window, of bounded length, is scored by itself. The templates are a constant of fixed size.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquill.llm.common import cut

#: Licence and wording of its notices (public texts, fixed values).
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsl-1.0", "Boost Software License Version 1.0"),
    ("cc0-1.0", "CC0 1.0 Universal"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("gpl-2.0", "This program is free software; you can redistribute it under the terms of the GNU General Public License, version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("lgpl-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("agpl-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("agpl-3.0", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("apache-2.0", "Apache License Version 2.0, January 2004"),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International"),
    ("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("gpl-2.0", "GNU General Public License Version 2, June 1991"),
    ("gpl-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("gpl-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("lgpl-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("lgpl-2.1", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("lgpl-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("lgpl-3.0", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("mpl-2.0", "Mozilla Public License Version 2.0"),
)
TEMPLATES += tuple((name, f"SPDX-License-Identifier: {name}") for name in sorted({name for name, _ in TEMPLATES}))
#: The first has a clause that the second lacks, and all else of it: where both are found, the first holds.
OUTRANKS = (("bsd-3-clause", "bsd-2-clause"),)
#: The longest window, in a template's words.
SPAN = 3
STOPWORDS = ("a", "an", "and", "any", "are", "as", "at", "be", "by", "can", "for", "from", "in", "into", "is", "it", "may", "not", "of", "on", "or", "the", "this", "to", "under", "was", "with", "you")
NAMED = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(*STOPWORDS))


def _words(text: str) -> list[str]:
    return [t for t in re.findall("[a-z0-9]+", text.lower()) if t not in STOPWORDS]


def _vocabulary() -> list[str]:
    return sorted({t for _, text in TEMPLATES for t in _words(text)})


def _named(name: str, text: str) -> list[str]:
    return sorted(set(re.split("[^a-z0-9]", name)) & set(_words(text)))


def _weights(idf: dict[str, float]) -> list[dict[str, float]]:
    """Of each template: the weights of its words, of length 1."""
    out = []
    for _, text in TEMPLATES:
        tf = Counter(_words(text))
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in tf.items()))
        out.append({t: n * idf[t] / norm for t, n in tf.items()})
    return out


def _anchors(weights: list[dict[str, float]], least: float) -> list[str]:
    """Words of which a text needs one: of a template's other words, the mass is under the least that a notice must hold."""
    out = set()
    for words in weights:
        left = 1.0
        for term in sorted(words, key=lambda t: (-words[t], t)):
            if left < least:
                break
            out.add(term)
            left -= words[term] ** 2
    return sorted(out)


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is computed once."""
    return F.transform(F.array(value), f)[0]


def _mass(weights: Column, words: Column) -> Column:
    """The part of a template's squared length that words hold."""
    return F.aggregate(F.map_keys(weights), F.lit(0.0), lambda acc, t: acc + F.when(F.array_contains(words, t), F.try_element_at(weights, t) * F.try_element_at(weights, t)).otherwise(0.0))


def _templates(weights: list[dict[str, float]]) -> Column:
    """array<struct<license, weights, named, span>>: named holds words of the licence's name, span is the longest window."""
    return F.array(*[F.struct(F.lit(name).alias("license"), _map(w).alias("weights"), _strings(_named(name, text)).alias("named"), F.lit(SPAN * len(_words(text))).alias("span")) for (name, text), w in zip(TEMPLATES, weights, strict=True)])


def _windows(text: Column, templates: Column, least: float) -> Column:
    """array<struct<k, words>>: the windows that hold enough of template k (from 1), each as long as may be."""

    def of(ts: Column, template: Column, k: Column) -> Column:
        weights, named = template["weights"], template["named"]
        starts = F.filter(F.transform(ts, lambda t, i: F.when(F.map_contains_key(weights, t), i + 1)), lambda i: i.isNotNull())
        fit = F.filter(F.transform(starts, lambda i: F.slice(ts, i, template["span"])), lambda w: (_mass(weights, w) >= least) & (F.size(F.array_except(named, w)) == 0))
        return F.transform(F.array_distinct(fit), lambda w: F.struct(k.alias("k"), w.alias("words")))

    def near(ts: Column) -> Column:
        return F.flatten(F.transform(templates, lambda template, i: F.when(_mass(template["weights"], ts) >= least, of(ts, template, i + 1)).otherwise(F.expr("slice(array(named_struct('k', 0, 'words', array(''))), 1, 0)"))))

    return _let(terms(text), near)


def _score(window: Column, template: Column) -> Column:
    """struct<less, license, size> of the best run from the first word of a window (array<struct<at, term, idf>>) to a word of the template:
    less is its cosine, negative, and so is size, its number of words."""
    weights, named = template["weights"], template["named"]
    steps = F.transform(window, lambda x, i: F.struct(x["idf"].alias("v"), F.try_element_at(weights, x["term"]).alias("w"), F.array_contains(named, x["term"]).alias("named"), F.size(F.filter(F.slice(window, F.lit(1), i), lambda y: y["term"] == x["term"])).alias("seen")))

    def step(state: Column, x: Column) -> Column:
        dot = state["dot"] + x["v"] * F.coalesce(x["w"], F.lit(0.0))
        square = state["square"] + (2 * x["seen"] + 1) * x["v"] * x["v"]
        held = state["held"] + F.when(x["named"] & (x["seen"] == 0), 1).otherwise(0)
        score = F.when(x["w"].isNotNull() & (held == F.size(named)), F.round(dot / F.sqrt(square), 6)).otherwise(0.0)
        best = F.when(score > state["score"], state["at"] + 1).otherwise(state["size"])
        return F.struct(dot.alias("dot"), square.alias("square"), held.alias("held"), (state["at"] + 1).alias("at"), F.greatest(state["score"], score).alias("score"), best.alias("size"))

    start = F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("square"), F.lit(0).alias("held"), F.lit(0).alias("at"), F.lit(0.0).alias("score"), F.lit(0).alias("size"))
    return F.aggregate(steps, start, step, lambda x: F.struct((-x["score"]).alias("less"), template["license"].alias("license"), (-x["size"]).alias("size")))


def scan_licenses(files: DataFrame, threshold: float = 0.7, licence_share: float = 0.4) -> DataFrame:
    """One row for each row of files (doc_id, path, text): doc_id, path, license, origin, score, licence_file.

    license: null if there is none; origin: ``own``, ``inherited`` or ``none``; score: the cosine of the own notice, to six
    places, or null; ties go to the licence first in order, then to the longer notice. Rows stand for themselves, whether doc_id
    is null or repeats; rows of one path are files of one directory; a null path has no directory, so it inherits nothing; null
    and empty texts have no notice. Further columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    # the empty word stands for each row, so that one aggregate counts rows too
    counted = files.select(F.explode(F.concat(F.array(F.lit("")), F.array_distinct(terms(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    counted = cut(counted)
    df = {r.term: r.df for r in counted.where(F.col("term").isin("", *_vocabulary())).collect()}
    n = df.get("", 0)
    idf_of = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in _vocabulary()}
    weights = _weights(idf_of)
    templates = _templates(weights)
    least = (threshold - 1e-6) ** 2 - 1e-9  # of a template's squared length, by Cauchy-Schwarz; scores are rounded
    held = F.arrays_overlap(terms(text), _strings(_anchors(weights, least)))
    windows = F.when(held, F.struct(_windows(text, templates, least).alias("windows"), F.regexp_count(F.lower(text), F.lit("[a-z0-9]+")).alias("n_words")))
    directory = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", ""))
    rows = cut(files.select("doc_id", "path", directory.alias("dir"), windows.alias("x"), F.monotonically_increasing_id().alias("row")))
    words = rows.where("size(x.windows) > 0").select("row", F.posexplode("x.windows").alias("window", "w")).select("row", "window", "w.k", F.posexplode("w.words").alias("at", "term"))
    # Words of templates are in every window; theirs are at hand, so no key of the join gathers them.
    known = F.try_element_at(_map(idf_of), F.col("term"))
    idf = counted.select("term", (F.log((F.lit(float(n)) + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    others = words.where(known.isNull()).join(idf, "term")
    whole = words.where(known.isNotNull()).withColumn("idf", known).unionByName(others).groupBy("row", "window", "k").agg(F.sort_array(F.collect_list(F.struct("at", "term", "idf"))).alias("words"))
    best = whole.select("row", _score(F.col("words"), F.element_at(templates, F.col("k"))).alias("x")).where(F.col("x.less") <= -threshold).groupBy("row").agg(F.min("x").alias("best"), *[F.min(F.when(F.col("x.license") == more, F.col("x"))).alias(f"more_{k}") for k, (more, _) in enumerate(OUTRANKS)])
    for k, (_, less) in enumerate(OUTRANKS):
        best = best.withColumn("best", F.when((F.col("best.license") == less) & F.col(f"more_{k}").isNotNull(), F.col(f"more_{k}")).otherwise(F.col("best"))).drop(f"more_{k}")
    found = cut(rows.join(best, "row", "left").select("doc_id", "path", "dir", F.col("best.license").alias("own"), (-F.col("best.less")).alias("score"), (-F.col("best.size")).alias("size"), "x.n_words"))
    is_file = F.col("own").isNotNull() & (F.coalesce(F.col("path").rlike(NAMED), F.lit(False)) | (F.col("size") >= licence_share * F.col("n_words")))
    found = found.withColumn("licence_file", is_file).drop("size", "n_words")
    licensed = found.where("licence_file AND dir IS NOT NULL").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("less"), "own")).alias("x")).select(F.col("dir").alias("at"), F.col("x.own").alias("inherited"))
    parts = F.split("dir", "/")
    ancestors = found.where("dir IS NOT NULL").select("dir").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("at"), i.alias("depth")))).alias("a"))
    nearest = ancestors.select("dir", "a.at", "a.depth").join(licensed, "at").groupBy("dir").agg(F.max_by("inherited", "depth").alias("inherited"))
    result = found.join(nearest.withColumnRenamed("dir", "d"), F.col("dir") == F.col("d"), "left")
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    return result.select("doc_id", "path", F.coalesce("own", "inherited").alias("license"), origin.alias("origin"), "score", "licence_file")


def _sql() -> str:
    def quoted(values):
        return ", ".join(f"'{v}'" for v in values)

    def bag(text):
        return f"list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda t: t <> '' AND t NOT IN ({quoted(STOPWORDS)}))"

    values = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))
    names = ", ".join(f"({k}, '{word}')" for k, (name, text) in enumerate(TEMPLATES) for word in _named(name, text))
    outranked = " OR ".join(f"(license = '{less}' AND doc_id IN (SELECT doc_id FROM named_runs WHERE license = '{more}'))" for more, less in OUTRANKS)
    return rf"""
WITH templates AS (
  SELECT k, license, term, count(*) AS tf FROM (
    SELECT k, license, unnest({bag("notice")}) AS term FROM (VALUES {values}) AS x(k, license, notice))
  GROUP BY ALL),
names AS (SELECT * FROM (VALUES {names}) AS x(k, term)),
n_names AS (SELECT t.k, count(DISTINCT n.term) AS n_names FROM templates t LEFT JOIN names n USING (k) GROUP BY t.k),
spans AS (SELECT k, CAST({SPAN} * sum(tf) AS BIGINT) AS span FROM templates GROUP BY k),
files AS (
  SELECT doc_id, '/' || source || '/' || CAST(doc_id // 1000 AS VARCHAR) || '/' || CAST(doc_id // 20 AS VARCHAR) AS dir, coalesce(text, '') AS text FROM documents),
paths AS (SELECT doc_id, dir, dir || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, text FROM files),
tokens AS (
  SELECT doc_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM (SELECT doc_id, {bag("text")} AS ts FROM files)),
counted AS (SELECT term, count(DISTINCT doc_id) AS df FROM tokens GROUP BY term),
idf AS (
  SELECT term, ln(((SELECT count(*) FROM files) + 1) / (coalesce(df, 0) + 1)) + 1 AS idf
  FROM (SELECT term FROM templates UNION SELECT term FROM counted) LEFT JOIN counted USING (term)),
weighed AS (
  SELECT k, license, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY k)) AS w FROM templates JOIN idf USING (term)),
likely AS (
  SELECT doc_id, k FROM (SELECT DISTINCT doc_id, term FROM tokens) JOIN weighed USING (term) GROUP BY doc_id, k HAVING sum(w * w) > 0.48),
starts AS (
  SELECT t.doc_id, t.pos AS start, l.k FROM tokens t JOIN likely l ON l.doc_id = t.doc_id JOIN weighed w ON w.k = l.k AND w.term = t.term),
cells AS (
  SELECT s.doc_id, s.k, start, t.pos, t.term, idf AS v, w,
         row_number() OVER (PARTITION BY s.doc_id, s.k, start, t.term ORDER BY t.pos) - 1 AS seen,
         t.term IN (SELECT term FROM names n WHERE n.k = s.k) AS named
  FROM starts s JOIN spans p ON p.k = s.k JOIN tokens t ON t.doc_id = s.doc_id AND t.pos BETWEEN start AND start + span - 1
  JOIN idf ON idf.term = t.term LEFT JOIN weighed w ON w.k = s.k AND w.term = t.term),
running AS (
  SELECT doc_id, k, start, pos, w, sum(v * coalesce(w, 0)) OVER run AS dot, sum((2 * seen + 1) * v * v) OVER run AS square,
         sum(CASE WHEN named AND seen = 0 THEN 1 ELSE 0 END) OVER run AS held
  FROM cells WINDOW run AS (PARTITION BY doc_id, k, start ORDER BY pos)),
scored AS (
  SELECT doc_id, k, start, pos - start + 1 AS size, round(dot / sqrt(square), 6) AS score FROM running JOIN n_names USING (k) WHERE w IS NOT NULL AND held = n_names),
runs AS (
  SELECT * FROM scored WHERE score >= 0.7 QUALIFY row_number() OVER (PARTITION BY doc_id, k, start ORDER BY score DESC, size) = 1),
named_runs AS (SELECT doc_id, license, size, score FROM runs JOIN (SELECT DISTINCT k, license FROM templates) USING (k)),
best AS (
  SELECT doc_id, license, size, score FROM named_runs r
  WHERE NOT ({outranked})
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license, size DESC) = 1),
found AS (
  SELECT p.doc_id, path, dir, license AS own, score,
         license IS NOT NULL AND coalesce(size >= 0.4 * len(regexp_extract_all(lower(text), '[a-z0-9]+')), false) AS licence_file
  FROM paths p LEFT JOIN best b ON p.doc_id = b.doc_id),
licensed AS (
  SELECT dir AS pos, own AS inherited FROM found WHERE licence_file AND dir IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, own) = 1),
nearest AS (
  SELECT d.dir, arg_max(inherited, len(pos)) AS inherited
  FROM (SELECT DISTINCT dir FROM found) d JOIN licensed l ON d.dir = l.pos OR starts_with(d.dir, l.pos || '/') GROUP BY d.dir)
SELECT doc_id, path, coalesce(own, inherited) AS license,
       CASE WHEN own IS NOT NULL THEN 'own' WHEN inherited IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, score, licence_file
FROM found LEFT JOIN nearest USING (dir)
"""


ORACLE_SQL = _sql()
