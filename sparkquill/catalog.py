"""The registered queries of the code-quality engine; their SQL is in oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill import sample
from sparkquill.operators import detectors as d
from sparkquill.operators import copies, flow
from sparkquill.operators.structure import identifiers, structure
from sparkquill.oracle import ORACLE_SQL
from sparkquill.plans import gate
from sparkquill.sources.files import all_files, sample_files
from sparkquill.sources.rules import Rule, parse_rules, scoped, valid_rules

Query = Callable[[SparkSession, str], DataFrame]


def _rules(spark: SparkSession) -> list[Rule]:
    return valid_rules(spark, sample.RULES_JSON)[0]


def _on_files(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(all_files(spark, sf_dir))


def scan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of the changed files, against imports, blocks and names of all."""
    changed = spark.createDataFrame([(p,) for p in sample.CHANGED], "path string")
    return gate.collect_issues(all_files(spark, sf_dir), _rules(spark), "diff", changed=changed)


def class_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each class of files that there is: how many files, and the categories switched off."""
    classes = all_files(spark, sf_dir).groupBy("file_class").agg(F.count("*").alias("n_files"))
    return classes.join(gate.policy(spark), "file_class", "left").groupBy("file_class", "n_files").agg(F.count("category").alias("n_off"))


def _issues(mode: str, trees: bool = False) -> Query:
    return lambda spark, sf_dir: gate.collect_issues(all_files(spark, sf_dir), _rules(spark), mode, trees)


def nesting_braces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("string").alias("path"), F.coalesce("html", F.lit("")).alias("content"))
    return d.brace_nesting(d.with_code(sample_files(spark)).select("path", F.col("code").alias("content")).unionByName(pages))


def event_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles in the graph of event types: an edge where a type often follows another one for the same user."""
    from pyspark.sql import Window

    following = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("src"), following.alias("dst")).where("dst IS NOT NULL AND src != dst")
    counts = steps.groupBy("src", "dst").agg(F.count("*").alias("n"))
    often = counts.join(F.broadcast(counts.agg(F.avg("n").alias("mean"))), F.col("n") > F.col("mean")).select("src", "dst")
    return d.cycle_members(often).withColumnRenamed("path", "event_type")


def _parts(kind: str, *columns: str, trees: bool = True) -> Query:
    def run(files: DataFrame) -> DataFrame:
        rows = structure(files, trees).where(F.col("kind") == kind)
        return (rows.where("by = 'tree'") if trees else rows).select("path", *columns)

    return _on_files(run)


QUERIES: dict[str, Query] = {
    "scan_files": _on_files(lambda f: f.select("path", "lang", "file_class", "layer", F.length("content").alias("n_chars"))),
    "scan_diff": scan_diff,
    "scan_team": _issues("team"),
    "load_rules": lambda spark, sf_dir: scoped(all_files(spark, sf_dir), parse_rules(spark, sample.RULES_JSON)),
    "detect_language": _on_files(lambda f: f.groupBy("lang").agg(F.count("*").alias("n_files"))),
    "classify_file": _on_files(lambda f: f.groupBy("file_class").agg(F.count("*").alias("n_files"))),
    "classify_layer": _on_files(lambda f: f.groupBy("layer").agg(F.count("*").alias("n_files"))),
    "class_policy": class_policy,
    "rule_scope": lambda spark, sf_dir: d.rule_scope(all_files(spark, sf_dir), [r for r in _rules(spark) if r.kind != "glob"]),
    "rule_scope_glob": lambda spark, sf_dir: d.rule_scope(all_files(spark, sf_dir), [r for r in _rules(spark) if r.kind == "glob"]),
    "custom_rules": lambda spark, sf_dir: d.custom_issues(all_files(spark, sf_dir), _rules(spark)),
    "constraint_view": lambda spark, sf_dir: gate.constraints(all_files(spark, sf_dir), _rules(spark)),
    "strip_comments": _on_files(lambda f: d.with_code(f).select("path", F.md5(F.col("code").cast("binary")).alias("stripped_md5"), F.length("code").alias("n_chars"))),
    "three_scan_security": _on_files(d.three_scans),
    "red_lines": _on_files(lambda f: d.three_scans(f).groupBy("rule_id", "confidence").agg(F.count("*").alias("n_issues"), F.count_distinct("path").alias("n_files"))),
    "secrets": _on_files(lambda f: d.rule_hits(f, "hardcoded_secret")),
    "sql_concat": _on_files(lambda f: d.rule_hits(f, "sql_concatenation")),
    "dangerous_calls": _on_files(lambda f: d.rule_hits(f, "dangerous_call")),
    "log_leak": _on_files(lambda f: d.rule_hits(f, "sensitive_log")),
    "empty_handlers": _on_files(lambda f: d.rule_hits(f, "empty_handler")),
    "external_input": _on_files(lambda f: flow.reaching(d.cut(flow.flows(f)))),
    "exception_handling": _on_files(d.exception_issues),
    "file_size": _on_files(d.file_sizes),
    "complexity_regex": _parts("function", "lang", "name", "line", "complexity", trees=False),
    "param_count_regex": _parts("function", "lang", "name", "line", "n_params", trees=False),
    "class_methods_regex": _parts("class", "lang", "name", "line", "n_methods", trees=False),
    "nesting_braces": nesting_braces,
    "dup_blocks": _on_files(d.duplicate_blocks),
    "dup_files": _on_files(d.duplicate_files),
    "renamed_copies": _on_files(lambda f: copies.regions(d.cut(copies.prints(f, prose=True)))),
    "naming_consistency": _on_files(lambda f: d.naming_issues(d.cut(identifiers(f)))),
    "dep_edges": _on_files(d.dependency_edges),
    "dep_cycles": _on_files(lambda f: d.cycle_members(d.dependency_edges(f))),
    "event_cycles": event_cycles,
    "layer_violations": lambda spark, sf_dir: d.layer_violations(d.dependency_edges(all_files(spark, sf_dir)), gate.allowed_layers(spark)),
    "all_issues": _issues("personal"),
    "issues_by_severity": lambda spark, sf_dir: gate.by_severity(_issues("personal")(spark, sf_dir)),
    "gate_exit_code": lambda spark, sf_dir: gate.verdict(_issues("personal")(spark, sf_dir)),
    "issue_json": lambda spark, sf_dir: gate.as_json(_issues("personal")(spark, sf_dir)),
    "all_issues_ast": _issues("team", trees=True),
    "complexity_ast": _parts("function", "name", "line", "complexity"),
    "nesting_ast": _parts("function", "name", "line", "nesting"),
    "param_count_ast": _parts("function", "name", "line", "n_params"),
    "class_methods_ast": _parts("class", "name", "line", "n_methods"),
    "empty_handlers_ast": _parts("empty_handler", "line"),
}
