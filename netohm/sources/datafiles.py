"""Text files of comparison rows and of targets, in and out."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netohm.functions import text as T
from netohm.operators.compare import Comparison

CAP, RES, CCAP = ("net", "c1", "c2"), ("net", "driver", "sink", "r1", "r2"), ("net1", "net2", "c1", "c2")
NUMBERS = {"c1", "c2", "r1", "r2", "value"}


def _text(spark: SparkSession, path: str) -> DataFrame:
    """value, at: lines in file order by at. A missing local file is empty, with a warning."""
    if "://" not in path and not os.path.exists(path):
        import warnings

        warnings.warn(f"{path} does not exist: no rows", stacklevel=3)
        return spark.createDataFrame([], "value string, at struct<a: bigint, b: bigint>")
    raw = spark.read.text(path)
    return raw.select("value", F.struct(F.col("_metadata.file_block_start").alias("a"), F.monotonically_increasing_id().alias("b")).alias("at"))


def _rows(lines: DataFrame, columns: tuple[str, ...], commas: bool = True) -> DataFrame:
    x = T.trim_blanks(F.col("value"))
    split = F.split(x, "[ \t]+")
    if commas:
        split = F.when(F.instr(x, ",") > 0, F.transform(F.split(x, ","), T.trim_blanks)).otherwise(split)
    t = lines.where(x != "").withColumn("t", split).where(F.size("t") >= len(columns))
    cells = [T.parse_data_number(F.get("t", F.lit(i))).alias(c) if c in NUMBERS else F.get("t", F.lit(i)).alias(c) for i, c in enumerate(columns)]
    return t.select("at", *cells).dropna(subset=[c for c in columns if c in NUMBERS])


def _without_head(lines: DataFrame) -> DataFrame:
    """The first line goes if it holds a comma."""
    first = lines.agg(F.min("at").alias("first"))
    return lines.join(F.broadcast(first)).where((F.col("at") != F.col("first")) | (F.instr("value", ",") == 0)).drop("first")  # first is one row


def read_cap_data(spark: SparkSession, path: str) -> DataFrame:
    return _rows(_without_head(_text(spark, path)), CAP).drop("at")


def read_res_data(spark: SparkSession, path: str) -> DataFrame:
    return _rows(_without_head(_text(spark, path)), RES).drop("at")


def _no_comments(lines: DataFrame) -> DataFrame:
    return lines.where(~F.ltrim(F.col("value")).startswith("#"))


def read_ccap_data(spark: SparkSession, path: str) -> DataFrame:
    return _rows(_no_comments(_text(spark, path)), CCAP).drop("at")


def read_cap_targets(spark: SparkSession, path: str) -> DataFrame:
    """(net, value): the third column of each net's last row."""
    rows = _rows(_no_comments(_text(spark, path)), ("net", "old", "value"), commas=False)
    return rows.groupBy("net").agg(F.max_by("value", "at").alias("value"))


def read_res_targets(spark: SparkSession, path: str) -> DataFrame:
    """(net, sink, value): the fifth column of the last row of each net and sink."""
    rows = _rows(_no_comments(_text(spark, path)), ("net", "driver", "sink", "old", "value"), commas=False)
    return rows.groupBy("net", "sink").agg(F.max_by("value", "at").alias("value"))


def read_ccap_targets(spark: SparkSession, path: str) -> DataFrame:
    """(net1, net2, value): the last column of each unordered pair's last row."""
    rows = _rows(_no_comments(_text(spark, path)), ("a", "b", "c1", "value"))
    return rows.groupBy(F.least("a", "b").alias("net1"), F.greatest("a", "b").alias("net2")).agg(F.max_by("value", "at").alias("value"))


def load_comparison(spark: SparkSession, cap: str | None = None, res: str | None = None, ccap: str | None = None) -> Comparison:
    return Comparison(read_cap_data(spark, cap) if cap else None, read_res_data(spark, res) if res else None, read_ccap_data(spark, ccap) if ccap else None)


def write_data(df: DataFrame, path: str, columns: tuple[str, ...], single: bool = False) -> None:
    """Rows of space-separated columns; numbers keep all digits."""
    out = df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("value"))
    (out.coalesce(1) if single else out).write.mode("overwrite").text(path)


def csv_rows(df: DataFrame, x: str, y: str, kind: str) -> DataFrame:
    """net, <kind>_tool1, <kind>_tool2, ratio (inf where the first is 0), delta."""
    a, b = F.col(x), F.col(y)
    return df.select("net", a.alias(f"{kind}_tool1"), b.alias(f"{kind}_tool2"), T.ratio(a, b).alias("ratio"), (b - a).alias("delta"))


def write_csvs(c: Comparison, prefix: str, r_agg: str = "max") -> None:
    """<prefix>_caps.csv and <prefix>_res_<r_agg>.csv, one row for each net, and for each net and sink."""
    for df, x, y, kind, name in ((c.cap, "c1", "c2", "C", "caps"), (c.res, "r1", "r2", f"R_{r_agg}", f"res_{r_agg}")):
        if df is not None:
            csv_rows(df, x, y, kind).write.mode("overwrite").csv(f"{prefix}_{name}.csv", header=True)
