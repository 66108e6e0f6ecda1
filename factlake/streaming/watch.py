"""Watching a source tree: a micro-batch query over new files, and rounds over what changed since the last snapshot.

The stream sees each path once. ``changes`` compares two snapshots of a tree, so it also sees edits of known
files and files that went; ``scan_changes`` is one round of it with its state in a folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.patterns import lines_of, match_code


def stream_files(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of whole files: file, text."""
    r = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.load(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def stream_table(spark: SparkSession, folder: str, schema, per_trigger: int | None = None) -> DataFrame:
    """A stream over Parquet files that arrive in a folder."""
    r = spark.readStream.schema(schema)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.parquet(folder)


def watch(files: DataFrame, scan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs scan on each micro-batch of new files and appends its findings.

    Each batch is written to a folder of its own, so that a repeated batch replaces itself.
    every: a processing-time interval; without one, all that is there is scanned and the query ends.
    """

    def batch(df: DataFrame, number: int) -> None:
        scan(df).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    w = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def line_scan(pattern_id: str, code: dict) -> Callable[[DataFrame], DataFrame]:
    """A scan by one code pattern."""

    def scan(df: DataFrame) -> DataFrame:
        ranges = df.sparkSession.createDataFrame([], "file string, name string, start_line int, end_line int, ord int")
        return match_code(pattern_id, code, lines_of(df), ranges, df)

    return scan


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """file, size, modified of every file of a tree; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return listed.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """file, change (added, changed, removed) between two snapshots."""
    a, b = (df.select("file", F.struct("size", "modified").alias(n)) for df, n in ((before, "was"), (after, "now")))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return a.join(b, "file", "full_outer").select("file", kind.alias("change")).filter("change IS NOT NULL")


def scan_changes(spark: SparkSession, folder: str, state: str, number: int, scan: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Round ``number`` (from 1): (changes since the last round, findings in added and changed files).

    The snapshot of a round is written below ``state`` before anything is scanned; a round that is run again replaces its own.
    """
    snapshot(spark, folder).write.mode("overwrite").parquet(f"{state}/snapshot={number}")
    after = spark.read.parquet(f"{state}/snapshot={number}")
    before = spark.read.parquet(f"{state}/snapshot={number - 1}") if number > 1 else after.limit(0)
    found = changes(before, after)
    texts = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    live = found.filter("change <> 'removed'").select("file")
    return found, scan(texts.join(live, "file", "left_semi"))
