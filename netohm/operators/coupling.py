"""Coupling capacitors from nodes to net pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netohm.functions import text as T
from netohm.functions import units as U


def nodes_to_nets(df: DataFrame, nets: DataFrame, name_map: DataFrame | None, column: str, out: str) -> DataFrame:
    """The net of a node: a net of that very name, else of its base, else the net that the name map gives for the base; else null."""
    names = nets.select("lib_id", F.col("net").alias("__n")).distinct()
    df = df.withColumn("__b", T.pin_base(F.col(column)))
    df = df.join(names.withColumnRenamed("__n", column).withColumn("__exact", F.lit(True)), ["lib_id", column], "left")
    df = df.join(names.withColumnRenamed("__n", "__b").withColumn("__base", F.lit(True)), ["lib_id", "__b"], "left")
    found = F.when(F.col("__exact"), F.col(column)).when(F.col("__base"), F.col("__b"))
    if name_map is not None:
        third = name_map.join(names.withColumnRenamed("__n", "name"), ["lib_id", "name"]).select("lib_id", F.col("id").alias("__b"), F.col("name").alias("__third"))
        df = df.join(third, ["lib_id", "__b"], "left")
        found = F.coalesce(found, F.col("__third"))
    return df.withColumn(out, found).drop("__b", "__exact", "__base", "__third")


def resolve_ends(rows: DataFrame, nets: DataFrame, name_map: DataFrame | None, plain: bool = False) -> DataFrame:
    """rows (lib_id, owner, n1, n2 and others) with the nets a and b of their nodes, null for nodes of no net.

    Nearly all files are plain: no net's own name holds a colon, rows run from a node of their section's owner to net:pin of another
    net, and no right end is an id that only the name map knows. A node can then only be its base's, so rows are joined to
    the nets once, by the right end's base. Rows of other files go through all three ways of nodes_to_nets.
    """
    if not plain:
        return nodes_to_nets(nodes_to_nets(rows, nets, name_map, "n1", "a"), nets, name_map, "n2", "b")
    names = nets.select("lib_id", F.col("net").alias("__base")).distinct().withColumn("b", F.col("__base"))
    own = rows.withColumn("a", F.col("owner")).withColumn("__base", T.pin_base(F.col("n2")))
    return own.join(names, ["lib_id", "__base"], "left").drop("__base")


def resolve_coupling(nets: DataFrame, libraries: DataFrame, name_map: DataFrame | None = None, plain: bool = False) -> DataFrame:
    """(lib_id, net1, net2, cap_pf) with net1 < net2. Entries of one section add up; of two sections that list a pair, that of the least owner counts.

    A left end that is no net's counts as the section's owner, a right end that is none drops the entry. plain: as resolve_ends has it.
    """
    rows = nets.select("lib_id", F.col("net").alias("owner"), F.explode("raw_ccaps").alias("c")).select("lib_id", "owner", "c.n1", "c.n2", "c.c")
    rows = resolve_ends(rows, nets, name_map, plain).withColumn("a", F.coalesce("a", "owner")).where("b is not null and a <> b")
    met = rows.select("lib_id", "owner", F.least("a", "b").alias("net1"), F.greatest("a", "b").alias("net2"), "c")
    # both sums below find a pair's rows together
    per = met.repartition("lib_id", "net1", "net2").groupBy("lib_id", "net1", "net2", "owner").agg(F.sum("c").alias("c"))
    least = per.groupBy("lib_id", "net1", "net2").agg(F.min_by("c", "owner").alias("c"))
    units = F.broadcast(libraries.select("lib_id", "c_unit", "c_scale"))  # a row for each library
    cap = U.convert_capacitance(F.col("c") * F.col("c_scale"), F.col("c_unit"))
    return least.join(units, "lib_id").select("lib_id", "net1", "net2", cap.alias("cap_pf"))


def regroup(pairs: DataFrame) -> DataFrame:
    """One row for each unordered pair, values added."""
    return pairs.groupBy(F.least("net1", "net2").alias("net1"), F.greatest("net1", "net2").alias("net2")).agg(F.sum("cap_pf").alias("cap_pf"))
