"""Mixing sources to target weights: hash-random order in each source, distributed prefix sums, a cut at the exact budget.

Rows of a source are ordered by a hash of their id. Ranges of the hash are buckets of even size, so a running total is the
total of the buckets before plus a window within one bucket; no source is ever one task. A source's budget is its target
rounded to whole words: it gives that many full passes over its rows and then, in the same order, rows up to the exact
word, so the row at the cut gives a part of its words. Only the table of sources, and of sources by buckets, is sorted whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquill.llm.common import WORD, cut

WEIGHTS = (5, 2, 1)
#: No source, and so no row, is taken more often.
MOST = 3
#: Columns of a mix.
ADDED = ("size", "source_size", "target", "epochs", "part", "taken")


def words(text: str = "text") -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sizes (source, source_size) with target: the total shared by weight; what exceeds MOST times a source's size goes to the others.

    Sources take the weights in turn by code point, null last. In the order of size over weight the sources at their bound
    come first, so the common level follows from running sums over the table of sources.
    """
    by_name, by_bound = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("bound", "rank")
    everything = Window.partitionBy()
    rows = sizes.withColumn("rank", F.row_number().over(by_name))
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("most", MOST * F.col("source_size")).withColumn("bound", F.col("most").cast("double") / F.col("weight"))
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"k": F.row_number().over(by_bound), "spent": F.coalesce(F.sum("most").over(before), F.lit(0)), "left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)), "total": F.sum("source_size").over(everything)})
    rows = rows.withColumn("level", (F.col("total") - F.col("spent")).cast("double") / F.col("left"))
    rows = rows.withColumn("level", F.min(F.when(F.col("level") <= F.col("bound"), F.struct("k", "level"))).over(everything)["level"])
    return rows.select("source", "source_size", F.least(F.col("level") * F.col("weight"), F.col("most").cast("double")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, bucket_rows: int = 2_000) -> DataFrame:
    """docs (doc_id, source, text, ...) with size, source_size, target, epochs, part and taken; columns of these names are replaced.

    epochs: how often the row is taken whole; part: words of it taken once more, where the budget ends within it; taken:
    epochs * size + part. Null texts have no words; null is a source of its own. Rows that repeat an id stay apart. The order
    depends on doc_id only, or on the text where that is null, so reruns agree. An empty table gives an empty result.
    """
    docs = docs.drop(*ADDED)
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit(""))))))
    thin = cut(docs.select("source", key.alias("__key"), words().alias("size")))
    n_buckets = max(1, math.ceil(thin.count() / bucket_rows))
    bucket = F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("double") / 2**32 * n_buckets).alias("__bucket")
    sums = thin.groupBy("source", bucket).agg(F.sum("size").alias("words"))
    sources = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights)
    earlier = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    sums = sums.withColumnRenamed("source", "s").join(sources, F.col("s").eqNullSafe(F.col("source"))).select("s", F.col("__bucket").alias("b"), "offset", "source_size", "target")
    within = Window.partitionBy("source", "__bucket").orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = docs.withColumn("__key", key).withColumn("size", words()).withColumn("__bucket", bucket)
    rows = rows.withColumn("__before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("__bucket") == F.col("b")))
    budget = F.floor(F.col("target") + 0.5)
    some = F.col("source_size") > 0
    rows = rows.withColumn("epochs", F.when(some, F.expr("floor(target + 0.5) div source_size")).otherwise(0))
    rest = budget - F.col("epochs") * F.col("source_size")
    rows = rows.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("__before") - F.col("offset"))))
    return rows.withColumn("taken", F.col("epochs") * F.col("size") + F.col("part")).select(*docs.columns, *ADDED)


def repeat_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of a mix, each as often as it is taken; the row at a source's cut once more if at least half of it is."""
    copies = (F.col("epochs") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)).cast("int")
    rows = mixed.withColumn("__copies", copies).where("__copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*columns)


ORACLE_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sources),
weighed AS (
  SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] AS weight, 3 * source_size AS most FROM ranked),
bounds AS (
  SELECT *, CAST(most AS DOUBLE) / weight AS bound FROM weighed),
levels AS (
  SELECT *, row_number() OVER (ORDER BY bound, rank) AS k,
         CAST((sum(source_size) OVER ()) - coalesce(sum(most) OVER (ORDER BY bound, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER (ORDER BY bound, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM bounds),
chosen AS (
  SELECT arg_min(level, k) AS level FROM levels WHERE level <= bound),
targets AS (
  SELECT source, source_size, least(chosen.level * weight, CAST(most AS DOUBLE)) AS target FROM levels, chosen),
ordered AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM ordered
"""
