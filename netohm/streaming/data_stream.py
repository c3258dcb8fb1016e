"""Comparison rows that arrive as files: the data file readers over Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netohm.functions import text as T


def stream_caps(spark: SparkSession, folder: str) -> DataFrame:
    """net, c1, c2 of new files `net c1 c2` in a folder; lines that hold no such row are skipped."""
    t = spark.readStream.text(folder).select(F.split(T.trim_blanks(F.col("value")), "[ \t]+").alias("t")).where(F.size("t") >= 3)
    rows = t.select(F.get("t", F.lit(0)).alias("net"), T.parse_data_number(F.get("t", F.lit(1))).alias("c1"), T.parse_data_number(F.get("t", F.lit(2))).alias("c2"))
    return rows.dropna(subset=["c1", "c2"])
