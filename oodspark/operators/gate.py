"""The accept/reject gate over many files, as a batch or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decisions import REJECT, decided

#: What is accepted as an upload.
SUFFIXES, MOST_BYTES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff"), 25 * 1024 * 1024


def input_error() -> Column:
    """Why a file (filename, length) can't be scored; NULL if it can."""
    suffix = F.lower(F.regexp_extract("filename", r"\.([^./]+)$", 1))
    return F.when((suffix != "") & ~suffix.isin(*SUFFIXES), "unsupported file type").when(F.coalesce("length", F.lit(0)) == 0, "empty file").when(F.col("length") > MOST_BYTES, "file too large")


def gated(files: DataFrame, threshold: Column) -> DataFrame:
    """filename, verdict, score, threshold, prediction, decision, warning and status of files (filename, length, score).

    Files that can't be scored stay as rows of status "error".  The same function serves tables and streams.
    """
    df = decided(files.withColumn("_error", F.coalesce(input_error(), F.when(F.col("score").isNull(), "could not be decoded"))), threshold)
    bad = F.col("_error").isNotNull()
    blank = lambda c: F.when(~bad, F.col(c)).alias(c)
    return df.select("filename", F.when(bad, "ERROR").otherwise(F.col("verdict")).alias("verdict"), blank("score"), blank("threshold"), blank("prediction"), blank("decision"), F.when(bad, F.col("_error")).otherwise(F.col("warning")).alias("warning"), F.when(bad, "error").otherwise("ok").alias("status"))


def gate_counts(gate: DataFrame) -> DataFrame:
    """total, accepted, and rejected_or_error."""
    refused = (F.col("status") == "error") | (F.col("decision") == REJECT)
    accepted = (F.col("status") == "ok") & (F.col("prediction") == 0)
    return gate.agg(F.count("*").alias("total"), F.count_if(F.coalesce(accepted, F.lit(False))).alias("accepted"), F.count_if(F.coalesce(refused, F.lit(False))).alias("rejected_or_error"))
