"""Continuous scans: files that arrive in a folder are scanned in micro-batches and their issues appended as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkquill.operators import detectors
from sparkquill.sources.files import with_traits


def watch(spark: SparkSession, root: str, out: str, checkpoint: str, pattern: str = "*", once: bool = True) -> StreamingQuery:
    """Scans what is new below root for red lines. once: what is there now, then end. A batch that is run again after a
    failure replaces what it had written, so issues are neither lost nor doubled."""
    stream = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    files = stream.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))

    def scan(batch: DataFrame, number: int) -> None:
        detectors.three_scans(with_traits(batch)).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    writer = files.writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
