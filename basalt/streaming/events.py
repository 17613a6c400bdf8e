"""Event-time streams over the same transformations as batch: tumbling counts, sessions, duplicates."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path


def event_stream(spark: SparkSession, folder: str, sample: DataFrame, pattern: str = "events.parquet") -> DataFrame:
    """The table of a folder as a stream; times without a zone count as UTC, so that they can carry a watermark.

    A stream reads folders only: a table that is a folder is read as such, one that is a file by its name.
    """
    files = [f.rsplit("/", 2)[-2:] for f in sample.inputFiles()]
    reader = spark.readStream.schema(sample.schema)
    if len(files) == 1 and files[0][1] == pattern and files[0][0] != pattern:
        stream = reader.option("pathGlobFilter", pattern).parquet(folder)
    else:
        stream = reader.parquet(f"{folder}/{pattern}")
    if dict(sample.dtypes)["ts"] != "timestamp_ntz":
        return stream
    return stream.withColumn("ts", F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts))"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums by window and type."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return out.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of a user: events no further apart than the gap."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once; state is kept as long as events may be late."""
    return events.withWatermark("ts", late).dropDuplicates([*keys, "ts"])


def drain(stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what is there and returns the rows as a table in the shared folder.

    Every batch has a folder of its own there, so a batch that is done again replaces itself; in complete mode the last
    batch has all rows.  Nothing passes through the driver.  The state lies in the shared folder too.
    """
    spark = stream.sparkSession
    path, last = new_path(spark, name), []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        last[:] = [batch]

    writer = stream.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True)
    writer.option("checkpointLocation", checkpoint or new_path(spark, f"{name}-state")).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    found = spark.read.schema(stream.schema)
    return found.parquet(f"{path}/batch={last[0]}") if mode == "complete" else found.parquet(path).select(*stream.columns)


def batches(df: DataFrame) -> Iterator:
    """Rows one by one, a partition at a time on the driver."""
    return df.toLocalIterator(prefetchPartitions=True)


def pipe(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Every task writes its own part."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
