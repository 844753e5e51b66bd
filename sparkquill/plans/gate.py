"""The quality gate: which detectors a mode runs, what a file's class switches off, and the verdict."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill import sample
from sparkquill.functions.text import class_of
from sparkquill.operators import copies, detectors, flow, imports
from sparkquill.plans import facts
from sparkquill.session import cut
from sparkquill.sources.rules import Rule

#: Categories that a class of files switches off. Red lines (security) hold everywhere.
SWITCHED_OFF: tuple[tuple[str, str], ...] = (
    ("test", "complexity"), ("test", "params"), ("test", "methods"), ("test", "lines"), ("test", "naming"),
    ("generated", "complexity"), ("generated", "nesting"), ("generated", "params"), ("generated", "methods"), ("generated", "lines"), ("generated", "naming"), ("generated", "duplicate_code"), ("generated", "exception_handling"),
    ("migration", "complexity"), ("migration", "duplicate_code"), ("migration", "naming"),
    ("config", "complexity"), ("config", "lines"), ("config", "naming"),
    ("doc", "complexity"), ("doc", "lines"), ("doc", "naming"),
)
RANKS = {"info": 0, "warn": 1, "block": 2}
MODES = ("diff", "personal", "team")


def allowed_layers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(sample.ALLOWED_LAYERS), "src_layer string, dst_layer string")


def policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SWITCHED_OFF), "file_class string, category string")


def collect_issues(files: DataFrame, rules: Sequence[Rule] = (), mode: str = "personal", trees: bool = True, changed: DataFrame | None = None) -> DataFrame:
    """All issues of files in a mode; naming belongs to ``team`` only. trees: Python files are measured by their syntax trees, else
    by patterns as other languages are.

    In ``diff`` mode the issues are those of changed (path). Files are all the same: imports, repeated blocks and usual names
    are of the whole project, so that what a changed file breaks together with unchanged ones is found.
    """
    changed = _changed(mode, changed)
    measured = None if changed is None else files.join(changed, "path", "left_semi")
    return issues_of(facts.gather(files, rules, trees, mode == "team", measured), mode, changed)


def _changed(mode: str, changed: DataFrame | None) -> DataFrame | None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if mode != "diff":
        return None
    if changed is None:
        raise ValueError("diff mode needs the changed paths")
    return cut(changed.select("path").distinct())


def issues_of(known: facts.Facts, mode: str = "personal", changed: DataFrame | None = None) -> DataFrame:
    """All issues that follow from facts, in ``diff`` mode those of changed (path)."""
    changed = _changed(mode, changed)
    only = (lambda rows: rows) if changed is None else (lambda rows: rows.join(changed, "path", "left_semi"))
    spark = known.files.sparkSession
    edges = cut(imports.edges(known.files.where("lang != 'other' OR roots IS NOT NULL").select("path", "lang", "imports", "package", "roots")))
    exact = detectors.duplicate_regions(switched_on(known.files, "duplicate_code").select("path", F.inline("blocks")), changed)
    found = detectors.unhandled(only(known.files).select("path", "lang", F.inline("matches")), known.parts)
    parts = [
        _by_trees(found, known) if known.trees else found.select(*detectors.ISSUE),
        detectors.structure_issues(only(known.parts)),
        detectors.duplicate_issues(exact),
        only(detectors.cycle_issues(edges)),
        only(detectors.layer_issues(edges, allowed_layers(spark))),
    ]
    if known.prints is not None:
        parts.append(detectors.renamed_issues(copies.regions(switched_on(known.prints, "duplicate_code"), changed), exact))
    if mode == "team":
        if known.names is None:
            raise ValueError("team mode needs the facts' names")
        parts.append(detectors.naming_issues(known.names))
    return adapt(reduce(DataFrame.unionByName, parts))


def _by_trees(found: DataFrame, known: facts.Facts) -> DataFrame:
    """Matches where trees have their say of handlers and of dangerous calls."""
    return flow.judged(detectors.unparsed(found, known.parts), known.flows, detectors.SYNTAX).select(*detectors.ISSUE)


def switched_on(files: DataFrame, category: str) -> DataFrame:
    """files without those whose class switches a category off."""
    off = [file_class for file_class, c in SWITCHED_OFF if c == category]
    return files.where(~F.coalesce(class_of(F.col("path")).isin(*off), F.lit(False)))


def adapt(issues: DataFrame) -> DataFrame:
    """issues without those of categories that their file's class switches off. Red lines never go through the policy."""
    bound = issues.where(F.col("category") != "security").withColumn("file_class", class_of(F.col("path")))
    kept = bound.join(F.broadcast(policy(issues.sparkSession)), ["file_class", "category"], "left_anti")
    return kept.select(*detectors.ISSUE).unionByName(issues.where(F.col("category") == "security").select(*detectors.ISSUE))


def by_severity(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count("*").alias("n_issues"), F.count_distinct("path").alias("n_files"), F.min("confidence").alias("least_confidence"))


def rank() -> Column:
    """RANKS of severity; rules of other severities aren't loaded."""
    return reduce(lambda out, pair: F.when(F.col("severity") == pair[0], pair[1]).otherwise(out), RANKS.items(), F.lit(0))


def verdict(issues: DataFrame) -> DataFrame:
    """One row: 0 to pass, 1 to warn, 2 to block, by the worst severity; no issue passes."""
    return issues.agg(F.coalesce(F.max(rank()), F.lit(0)).alias("exit_code"))


def as_json(issues: DataFrame) -> DataFrame:
    """Each issue as one JSON string, for clients."""
    return issues.select(F.to_json(F.struct(*detectors.ISSUE), {"ignoreNullFields": "false"}).alias("issue"))


def constraints(files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(path, id, line): for each file (path, lang, layer) the rules in whose scope it is, as sentences to put before its code is written."""
    lines = F.array_compact(F.array(*[F.when(r.fits(), F.struct(F.lit(r.id).alias("id"), F.lit(f"[{r.severity.upper()}] {r.target}: {r.description} - {r.suggestion}").alias("line"))) for r in rules]))
    return files.select("path", F.inline(lines)) if rules else files.sparkSession.createDataFrame([], "path string, id string, line string")
