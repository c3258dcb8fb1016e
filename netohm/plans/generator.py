"""Seeded SPEF text of any size, for tests and timing: nets in a ring of coupling, each a tree of resistors from its driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netohm.plans.derived import HEADER, write_lines_of


def _uniform(seed: int, *of: Column | int, low: float, high: float) -> Column:
    """A number that depends on seed and `of` only, whatever the partitions."""
    h = F.xxhash64(F.lit(seed), *[x if isinstance(x, Column) else F.lit(x) for x in of])
    return F.round(low + (high - low) * F.pmod(h, F.lit(1_000_003)) / 1_000_003, 6)


def generated_lines(spark: SparkSession, nets: int, seed: int = 42, connected: bool = True) -> DataFrame:
    """k1, k2, value: text of a file in order, a row of several lines for each net. connected = False leaves the driver outside the resistors."""
    i = F.col("id")
    n_sinks = F.pmod(F.xxhash64(F.lit(seed), F.lit("sinks"), i), F.lit(4)) + 1
    total = _uniform(seed, F.lit("total"), i, low=0.01, high=1.0)
    at = F.sequence(F.lit(0).cast("long"), n_sinks - 1)
    text = lambda x: x.cast("string")
    pin = lambda s: F.concat(F.lit("*"), text(i), F.lit(":s"), text(s))
    mid = lambda s: F.concat(F.lit("*"), text(i), F.lit(":m"), text(s))
    ohm = lambda s, leg: text(_uniform(seed, F.lit("r"), i, s, leg, low=0.1, high=5.0))
    driver = F.concat(F.lit("drv_"), text(i))
    start = lambda s: F.when(s == 0, driver if connected else mid(s)).otherwise(mid(s - 1))
    wires = F.flatten(F.transform(at, lambda s: F.array(
        F.concat_ws(" ", text(2 * s + 1), start(s), mid(s) if connected else pin(s), ohm(s, 0)), F.concat_ws(" ", text(2 * s + 2), mid(s), pin(s), ohm(s, 1)))))
    other = F.when(i < nets, F.array(F.concat_ws(" ", F.lit("2"), pin(F.lit(0)), F.concat(F.lit("*"), text(i + 1), F.lit(":s0")), text(_uniform(seed, F.lit("cc"), i, low=0.001, high=0.01)))))
    body = F.concat(
        F.array(F.concat_ws(" ", F.lit("*D_NET"), F.concat(F.lit("*"), text(i)), text(total)), F.lit("*CONN"), F.concat_ws(" ", F.lit("*P"), driver, F.lit("I"))),
        F.transform(at, lambda s: F.concat_ws(" ", F.lit("*I"), pin(s), F.lit("I"))), F.array(F.lit("*CAP"), F.concat_ws(" ", F.lit("1"), pin(F.lit(0)), text(F.round(total * 0.3, 6)))),
        F.coalesce(other, F.array().cast("array<string>")), F.array(F.lit("*RES")), wires, F.array(F.lit("*END")),
    )
    rows = spark.range(1, nets + 1)
    head = spark.range(1).select(F.lit(-2).cast("long").alias("k1"), F.posexplode(F.split(F.lit(HEADER), "\n")).alias("k2", "value"))
    names = rows.select(F.lit(-1).cast("long").alias("k1"), i.cast("int").alias("k2"), F.concat(F.lit("*"), text(i), F.lit(" net_"), text(i)).alias("value"))
    return head.unionByName(names).unionByName(rows.select(i.alias("k1"), F.lit(0).alias("k2"), F.array_join(body, "\n").alias("value")))


def write_generated(spark: SparkSession, path: str, nets: int, seed: int = 42, connected: bool = True) -> None:
    write_lines_of(generated_lines(spark, nets, seed, connected), path)
