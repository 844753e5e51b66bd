"""Facts of files: what a scan draws from each file alone, and a stored, versioned table of them for scans of changes.

files has a row for each file: its matches, imports, package, roots of modules and blocks of lines; parts its functions, classes and handlers; names
what it declares; flows what goes from where to where within its functions; prints the fingerprints of its code. All issues follow from facts (see gate), so a file is opened once, and an unchanged file not at all: a store keeps the
facts of a project by version, each version those of the files that changed since the one before. A file's facts are current
unless a later version names its path. What has changed is told by a listing of sizes and times, which opens nothing.

A version is valid once its last table (meta) is written; one that was cut short is overwritten by the next run. After VERSIONS of them the
current facts are written whole, and versions before the merged ones are deleted.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.operators import copies, detectors, flow, imports
from sparkquill.operators.structure import identifiers, structure
from sparkquill.session import cut
from sparkquill.sources.files import list_project, open_files, with_traits
from sparkquill.sources.rules import Rule

#: Versions that are read together at most, and what tells that facts were drawn by other code.
VERSIONS, FORM = 8, 6
TABLES = ("files", "parts", "names", "flows", "prints")


@dataclass(frozen=True)
class Facts:
    """files (path, lang, matches, imports, package, roots, blocks), parts (structure.SCHEMA), names (of identifiers; None if not drawn), flows (flow.FLOWS,
    None without trees), prints (copies.PRINTS; None if not drawn); trees: whether Python was parsed for parts."""

    files: DataFrame
    parts: DataFrame
    names: DataFrame | None
    flows: DataFrame | None = None
    prints: DataFrame | None = None
    trees: bool = True


def drawn(files: DataFrame, rules: Sequence[Rule], *keep: str) -> DataFrame:
    """files (path, lang, layer, content, ...) as rows of Facts.files and columns keep. One pass: comments are stripped once."""
    lookups = [*detectors.security_lookups(), *detectors.exception_lookups(), *detectors.custom_lookups(rules)]
    known = F.col("lang") != "other"
    found = [detectors.matches(lookups, detectors.size_matches()).alias("matches"), detectors.blocks_of().alias("blocks")]
    return detectors.with_code(files).select("path", *keep, "lang", *found, F.when(known, imports.candidates()).alias("imports"), F.when(known, imports.package()).alias("package"), imports.roots().alias("roots"))


def gather(files: DataFrame, rules: Sequence[Rule] = (), trees: bool = True, names: bool = False, measured: DataFrame | None = None) -> Facts:
    """Facts of files. measured: the files whose parts are wanted, by default all."""
    return Facts(cut(drawn(files, rules)), cut(structure(files if measured is None else measured, trees)), cut(identifiers(files)) if names else None, flow.flows(files) if trees else None, cut(copies.prints(files)), trees)


# ---------------------------------------------------------------- store


def key_of(rules: Sequence[Rule], pattern: str) -> str:
    """What facts depend on beside the files."""
    return hashlib.sha256(json.dumps([FORM, pattern, [vars(r) for r in rules]], sort_keys=True).encode()).hexdigest()


def _system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, folder: str) -> bool:
    system, path = _system(spark, folder)
    return system.exists(path)


def versions(spark: SparkSession, store: str) -> list[int]:
    """The valid versions, in order."""
    system, path = _system(spark, store)
    names = [x.getPath().getName() for x in system.listStatus(path)] if system.exists(path) else []
    found = sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))
    return [v for v in found if _exists(spark, f"{store}/version={v}/meta/_SUCCESS")]


@dataclass(frozen=True)
class Version:
    number: int
    key: str
    whole: bool


def _metas(spark: SparkSession, store: str) -> list[Version]:
    """Versions from the last whole one on."""
    found = []
    for v in reversed(versions(spark, store)):
        row = spark.read.parquet(f"{store}/version={v}/meta").first()
        found.append(Version(v, row["key"], row["whole"]))
        if row["whole"]:
            return found[::-1]
    return []


def _current(spark: SparkSession, store: str, name: str, metas: list[Version]) -> DataFrame:
    """A table's rows of paths that no later version names. Files that are gone stand as rows without language."""
    read = lambda v, table: spark.read.parquet(f"{store}/version={v.number}/{table}")
    parts = []
    for k, v in enumerate(metas):
        later = [read(x, "files").select("path") for x in metas[k + 1 :]]
        rows = read(v, name)
        parts.append(rows.join(reduce(DataFrame.unionByName, later), "path", "left_anti") if later else rows)
    rows = reduce(DataFrame.unionByName, parts)
    return rows.where("lang IS NOT NULL")


def _write(spark: SparkSession, store: str, number: int, tables: dict[str, DataFrame], key: str, whole: bool) -> Version:
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{store}/version={number}/{name}")
    spark.createDataFrame([(key, whole)], "key string, whole boolean").coalesce(1).write.mode("overwrite").parquet(f"{store}/version={number}/meta")
    return Version(number, key, whole)


def load(spark: SparkSession, store: str, metas: list[Version] | None = None) -> Facts:
    """The current facts of a store."""
    metas = _metas(spark, store) if metas is None else metas
    return Facts(*(_current(spark, store, name, metas) for name in TABLES))


@dataclass(frozen=True)
class Refreshed:
    """Current facts, the version that holds them, and how many files were opened for it."""

    facts: Facts
    version: int
    opened: int


def _delete(spark: SparkSession, folder: str) -> None:
    system, path = _system(spark, folder)
    system.delete(path, True)


def refresh(spark: SparkSession, root: str, store: str, rules: Sequence[Rule] = (), pattern: str = "*") -> Refreshed:
    """The current facts of the project at root, kept in the folder store, which must not lie in the project.

    The first run, and one with other rules, opens every file. Later ones list the project and open what is new or has another
    size or time of change; a change that leaves both as they were isn't seen. Runs on one store must not overlap.
    """
    whole_path = lambda folder: _system(spark, folder)[0].makeQualified(_system(spark, folder)[1]).toUri().getPath().rstrip("/")
    if f"{whole_path(store)}/".startswith(f"{whole_path(root)}/"):
        raise ValueError("keep the facts of a project outside of it")
    key, metas = key_of(rules, pattern), _metas(spark, store)
    number = max(versions(spark, store), default=0) + 1
    listed = cut(list_project(spark, root, pattern))
    anew = not metas or metas[-1].key != key
    if anew:
        metas, changed, gone = [], listed, None
    else:
        seen = _current(spark, store, "files", metas).select("path", "size", "modified")
        changed = cut(listed.join(seen, ["path", "size", "modified"], "left_anti"))
        gone = cut(seen.join(listed, "path", "left_anti").select("path"))
        if changed.isEmpty() and gone.isEmpty():
            return Refreshed(load(spark, store, metas), metas[-1].number, 0)
    files = with_traits(open_files(spark, root, changed)).persist()  # opened once for all tables
    tables = {"files": drawn(files, rules, "size", "modified"), "parts": structure(files), "names": identifiers(files), "flows": flow.flows(files), "prints": copies.prints(files)}
    if gone is not None:
        tables["files"] = tables["files"].unionByName(gone, allowMissingColumns=True)
    metas.append(_write(spark, store, number, tables, key, anew))
    opened = files.count()
    files.unpersist()
    if len(metas) >= VERSIONS:
        metas = [_write(spark, store, number + 1, {name: _current(spark, store, name, metas) for name in TABLES}, key, True)]
        for v in versions(spark, store)[: -VERSIONS]:  # the ones just merged stay for those who still read them
            _delete(spark, f"{store}/version={v}")
    return Refreshed(load(spark, store, metas), metas[-1].number, opened)
