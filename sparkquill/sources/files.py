"""Sources: a project's files (see project), git's change list, and a table's texts as files."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill import sample
from sparkquill.functions.text import class_of, language_of, layer_of
from sparkquill.sources import project


def with_traits(files: DataFrame) -> DataFrame:
    """files (path, content, ...) with lang, file_class and layer."""
    traits = {"lang": language_of(F.col("path")), "file_class": class_of(F.col("path")), "layer": layer_of(F.col("path"))}
    return files.select("path", "content", *[x.alias(name) for name, x in traits.items()], *[c for c in files.columns if c not in ("path", "content", *traits)])


def _qualified(spark: SparkSession, root: str) -> tuple[str, str]:
    """The scheme and the whole path of root, however it is written: '.', '../x', with or without a scheme."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return uri.getScheme(), uri.getPath().rstrip("/")


def _below(base: str) -> Column:
    """The path of _metadata.file_path relative to base."""
    uri = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    whole = F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    return F.when(F.startswith(whole, F.lit(f"{base}/")), F.substring(whole, len(base) + 2, 1 << 30)).otherwise(F.regexp_extract(whole, "([^/]*)$", 1))


def _source(spark: SparkSession, uri: str, pattern: str, content: bool) -> DataFrame:
    spark.dataSource.register(project.ProjectSource)
    return spark.read.format("project").option("path", uri).option("pattern", pattern).option("content", str(content).lower()).load()


def place(spark: SparkSession, root: str) -> str | None:
    """What pyarrow opens root by, however it is written: a local path or a URI; None where it has no file system for the scheme."""
    scheme, base = _qualified(spark, root)
    uri = (base or "/") if scheme == "file" else root
    try:
        project.opened(uri)
    except ValueError:
        return None
    return uri


def read_project(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Every file below root as (path, content, ...), path relative to root; root may be any file system that Spark reads.

    Hidden files (names that begin with _ or a dot) are read too, but for those in excluded folders, by the source of
    project. On schemes that only Spark's JVM knows, Spark's reader is used, which leaves hidden files out.
    """
    uri = place(spark, root)
    if uri is not None:
        return with_traits(_source(spark, uri, pattern, content=True))
    base = _qualified(spark, root)[1]
    return with_traits(spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(_below(base).alias("path"), F.col("value").alias("content")))


def list_project(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified) of the files that read_project reads, without opening any."""
    uri = place(spark, root)
    if uri is None:
        raise ValueError(f"{root} can't be listed without Spark's reader")
    return _source(spark, uri, pattern, content=False).select("path", "size", "modified")


def open_files(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """paths (path, ...) below root with content, read by tasks; files that are gone are left out."""
    uri = place(spark, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = project.opened(uri)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                found = pa.array([project.text_of(system, f"{base.rstrip('/')}/{p}") for p in part.column(0).to_pylist()], pa.string())
                kept = pa.RecordBatch.from_arrays([*part.columns, found], [*part.schema.names, "content"])
                yield kept.filter(found.is_valid())

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in paths.schema)
    return paths.mapInArrow(run, f"{kinds}, content string")


def git_changes(root: str, base: str = "HEAD") -> list[str]:
    """Changed and untracked files below root, by git on the driver, as paths from root; before the first commit all files."""

    def run(*arguments: str) -> list[str]:
        return subprocess.run(["git", "-C", root, *arguments], capture_output=True, text=True, check=True).stdout.split("\0")

    known = subprocess.run(["git", "-C", root, "rev-parse", "-q", "--verify", base], capture_output=True).returncode == 0
    changed = run("diff", "--name-only", "--relative", "-z", "--diff-filter=d", base) if known else run("ls-files", "-z")
    return sorted({p for p in (*changed, *run("ls-files", "--others", "--exclude-standard", "-z")) if p})


def texts_as_files(docs: DataFrame) -> DataFrame:
    """A table (doc_id, source, text) as files /corpus/<source>/<doc_id>.txt."""
    return with_traits(docs.select(F.concat(F.lit("corpus/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("content")))


def sample_files(spark: SparkSession) -> DataFrame:
    return with_traits(spark.createDataFrame(list(sample.FILES), "path string, content string"))


def all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample project and every document."""
    return sample_files(spark).unionByName(texts_as_files(spark.read.parquet(f"{sf_dir}/documents.parquet")))
