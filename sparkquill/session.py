"""What jobs need from a Spark session: the package on the executors, and a shared folder to cut lineage in."""

from __future__ import annotations

import atexit
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's modules to the session's Python files, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="modules-")) / "sparkquill_modules.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """query, with the package shipped first."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where that is unset and all runs on this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df.checkpoint() into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


_tables: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame) -> DataFrame:
    """df written as a table into the shared folder and read back. Unlike cut() it also forgets what the optimizer inferred of its
    columns, which grows from round to round of a loop of joins on equal labels. Tables are deleted when the program ends, or by forget()."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid4().hex}"
    _tables.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def forget() -> None:
    """Deletes what stored() wrote; nothing that reads from it may be run afterwards."""
    while _tables:
        spark, path = _tables.pop()
        if spark.sparkContext._jsc is None:  # stopped: nothing is left to delete by
            continue
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
