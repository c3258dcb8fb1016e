"""A net library made of orders and lineitem: a net is an order, its sinks are its line numbers, its resistors are its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from netohm.sources.shared import kept, passing, write_text
from netohm.sources.spef import SpefLibrary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def net_name(key: str | Column) -> Column:
    return F.concat(F.lit("net_"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _totals(spark: SparkSession, sf_dir: str, second: bool = False) -> DataFrame:
    if not second:
        return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_totalprice") / 1e6).alias("total_cap_pf"))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("s"))
    return items.select(F.col("l_orderkey").alias("key"), (F.col("s") / 1e6).alias("total_cap_pf"))


def caps1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir).select(net_name("key").alias("net"), "total_cap_pf")


def caps2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir, True).select(net_name("key").alias("net"), "total_cap_pf")


def nets(spark: SparkSession, sf_dir: str, second: bool = False, star: bool = False) -> DataFrame:
    """Nets with sinks and edges. star wires the driver to each sink by its least resistor; else sinks form a chain of parallel resistors."""
    r = F.col("l_quantity") * (1 + F.col("l_discount")) if second else F.col("l_quantity")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("ln"), r.cast("double").alias("r"))
    items = items.repartition("l_orderkey")  # for both groupings, and joins by key
    per = items.groupBy("l_orderkey", "ln").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    rows = per.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("ln", "rs"))).alias("x")).withColumn("net", net_name("l_orderkey"))
    pin = lambda i: F.concat("net", F.lit(":s"), i.cast("string"))
    driver = F.concat("net", F.lit(":d"))
    if star:
        edges = F.transform("x", lambda e: F.struct(driver.alias("n1"), pin(e["ln"]).alias("n2"), F.array_min(e["rs"]).alias("r")))
    else:
        before = lambda i: F.when(i == 0, driver).otherwise(pin(F.get("x", i - 1)["ln"]))
        edges = F.flatten(F.transform("x", lambda e, i: F.transform(e["rs"], lambda r: F.struct(before(i).alias("n1"), pin(e["ln"]).alias("n2"), r.alias("r")))))
    return rows.select(
        F.lit("lib2" if second else "lib1").alias("lib_id"), "net", driver.alias("driver"), F.transform("x", lambda e: pin(e["ln"])).alias("sinks"), edges.alias("edges"), F.col("l_orderkey").alias("key")
    )


def coupling_entries(spark: SparkSession, sf_dir: str, second: bool = False) -> DataFrame:
    """key, other, c: consecutive orders of a customer couple, listed by both with the owner's value."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    pairs = orders.select(F.col("o_orderkey").alias("a"), "o_totalprice", F.lead("o_orderkey").over(w).alias("b"), F.lead("o_totalprice").over(w).alias("price2")).where("b is not null")
    if second:
        have = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
        pairs = pairs.join(have.withColumnRenamed("l_orderkey", "a"), "a", "left_semi").join(have.withColumnRenamed("l_orderkey", "b"), "b", "left_semi")
    f = 1.1 if second else 1.0
    entry = lambda key, other, price: F.struct(F.col(key).alias("key"), F.col(other).alias("other"), (F.col(price) / 1e7 * f).alias("c"))
    return pairs.select(F.explode(F.array(entry("a", "b", "o_totalprice"), entry("b", "a", "price2"))).alias("x")).select("x.*")


def library(spark: SparkSession, sf_dir: str, second: bool = False, star: bool = False) -> SpefLibrary:
    """All parts; every order is a net, those without lines have no sinks. Parts meet by their numeric key, names are made behind that."""
    from netohm.operators.coupling import resolve_coupling

    lib = "lib2" if second else "lib1"
    caps = _totals(spark, sf_dir, second).withColumn("net", net_name("key"))
    raw = coupling_entries(spark, sf_dir, second).groupBy("key").agg(F.collect_list(F.struct("other", "c")).alias("raw"))
    ends = F.transform("raw", lambda x: F.struct(F.concat("net", F.lit(":s1")).alias("n1"), net_name(x["other"]).alias("n2"), x["c"].alias("c")))
    n = nets(spark, sf_dir, second, star).select("key", "driver", "sinks", "edges")
    full = caps.join(n, "key", "left").join(raw, "key", "left").select(
        F.lit(lib).alias("lib_id"), F.col("key").cast("long").alias("pos"), "net", F.col("total_cap_pf").alias("total_cap"), "total_cap_pf", F.coalesce("driver", F.lit("")).alias("driver"),
        F.coalesce("sinks", F.array().cast("array<string>")).alias("sinks"), F.coalesce("edges", F.array().cast("array<struct<n1:string,n2:string,r:double>>")).alias("edges"),
        F.coalesce(ends, F.array().cast("array<struct<n1:string,n2:string,c:double>>")).alias("raw_ccaps"),
    )
    one = spark.range(1).select(F.lit(lib).alias("lib_id"), F.lit("NS").alias("t_unit"), F.lit("PF").alias("c_unit"), F.lit("OHM").alias("r_unit"), F.lit("HENRY").alias("l_unit"), F.lit(1.0).alias("c_scale"), F.lit(1.0).alias("r_scale"))
    names = full.select("lib_id", F.concat(F.lit("*"), F.col("pos").cast("string")).alias("id"), F.col("net").alias("name"))
    return SpefLibrary(one, names, full, resolve_coupling(full, one, plain=True))  # nets are named net_<key>


#: Name map lines that stay together.
CHUNK = 100_000
HEADER = "\n".join(['*SPEF "IEEE 1481-1999"', '*DESIGN "derived"', "*T_UNIT 1.00 NS", "*C_UNIT 1.00 PF", "*R_UNIT 1.00 OHM", "*L_UNIT 1.00 HENRY", "*DIVIDER /", "*DELIMITER :", "*BUS_DELIMITER [ ]", "*NAME_MAP"])


def spef_lines(lib: SpefLibrary) -> DataFrame:
    """The library as SPEF text (k1, k2, value), in order of k1 and k2: header lines, names, and a row of several lines for each net."""
    short = lambda x: F.regexp_replace(x, "^net_", "*")
    text = lambda v: v.cast("string")
    head = lib.libraries.sparkSession.range(1).select(F.lit(-2).cast("long").alias("k1"), F.posexplode(F.split(F.lit(HEADER), "\n")).alias("k2", "value"))
    names = lib.name_map.select(F.lit(-1).cast("long").alias("k1"), F.substring("id", 2, 30).cast("int").alias("k2"), F.concat_ws(" ", "id", "name").alias("value"))
    body = F.concat(
        F.array(F.concat(F.lit("*D_NET "), short(F.col("net")), F.lit(" "), text(F.col("total_cap"))), F.lit("*CONN")),
        F.when(F.col("driver") != "", F.array(F.concat(F.lit("*I "), short(F.col("driver")), F.lit(" O")))).otherwise(F.array().cast("array<string>")),
        F.transform("sinks", lambda s: F.concat(F.lit("*I "), short(s), F.lit(" I"))),
        F.array(F.lit("*CAP"), F.concat(F.lit("1 "), short(F.col("net")), F.lit(" "), text(F.col("total_cap") / 2))),
        F.transform("raw_ccaps", lambda c, i: F.concat_ws(" ", (i + 2).cast("string"), short(c["n1"]), short(c["n2"]), text(c["c"]))),
        F.array(F.lit("*RES")),
        F.transform("edges", lambda e, i: F.concat_ws(" ", (i + 1).cast("string"), short(e["n1"]), short(e["n2"]), text(e["r"]))),
        F.array(F.lit("*END")),
    )
    nets_ = lib.nets.select(F.col("pos").alias("k1"), F.lit(0).alias("k2"), F.array_join(body, "\n").alias("value"))
    return head.unionByName(names).unionByName(nets_)


def write_lines_of(lines: DataFrame, path: str, packed: bool = False) -> None:
    """Text (k1, k2, value) in order; each net lies in one part file. Names (k1 = -1) are spread by CHUNK. packed: part files are gzipped."""
    spark = lines.sparkSession
    chunk = F.when(F.col("k1") == -1, F.floor(F.col("k2") / CHUNK)).otherwise(F.lit(0)).cast("int")
    with passing(spark):
        lines = kept(lines.withColumn("chunk", chunk), "text")  # else it would be worked out once more for the ranges
        write_text(lines.repartitionByRange("k1", "chunk").sortWithinPartitions("k1", "chunk", "k2").select("value"), path, packed)


def write_spef(lib: SpefLibrary, path: str, packed: bool = False) -> None:
    write_lines_of(spef_lines(lib), path, packed)
