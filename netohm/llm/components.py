"""Connected components of links by alternating large and small stars; nothing of the graph reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netohm.llm.work import written


# least ids are written first: with a table on both sides of a join Spark can split a class's centre


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(written(least, "least"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame):
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]


def components(links: DataFrame) -> DataFrame:
    """(doc_id, class_id) of every end of a link (a, b); class_id is the least id of its component."""
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before, now = None, _mark(edges)
    while before != now:
        edges = written(_small(_large(edges)), "edges")
        before, now = now, _mark(edges)
    ends = edges.select(F.col("a").alias("doc_id"), F.col("b").alias("class_id"))
    return ends.unionByName(edges.select(F.col("b").alias("doc_id"), F.col("b").alias("class_id"))).distinct()
