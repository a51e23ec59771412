"""The gate as a Structured Streaming job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gate import gate_counts, gated
from ..sources import IMAGE, decoded, listed, small_files

#: Most files of a batch of a stream, which bounds what the driver plans at once.
BATCH_FILES = 25_000


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """filename (what write_files() wrote as name=..., else the name of the file), length, height, width, channels, pixels and error of image files as they arrive below a folder."""
    with listed(spark):
        files = spark.readStream.format("image").schema(IMAGE).options(recursiveFileLookup=True, maxFilesPerTrigger=BATCH_FILES).load(folder)
    rows = decoded(files.withColumn("_n", F.col("_metadata.file_size")), "_n")
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    name = F.regexp_extract("image_path", "/name=([^/]*)(?:/[^/]*)?$", 1)  # escaped by the writer, and then by the reader
    filename = F.when(name != "", plain(plain(name))).otherwise(plain(F.regexp_extract("image_path", "([^/]*)$", 1)))
    return rows.select(filename.alias("filename"), F.col("_n").alias("length"), "height", "width", "channels", "pixels", "error")


def gate_stream(files: DataFrame, threshold: Column) -> DataFrame:
    """gated() of a stream of (filename, length, score); stateless, so rows are only appended."""
    return gated(files, threshold)


def gate_stream_counts(files: DataFrame, threshold: Column) -> DataFrame:
    """Running counts of the gate: one row, in complete mode; its state is three numbers, so it needs no watermark."""
    return gate_counts(gated(files, threshold))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Work through all that is there, to a Parquet table (append) or, for counts, to the table's latest state (complete)."""
    if mode == "append":
        with listed(stream.sparkSession), small_files(stream.sparkSession):
            stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return

    def latest(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    stream.writeStream.foreachBatch(latest).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
