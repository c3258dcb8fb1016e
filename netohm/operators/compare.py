"""Comparison of two libraries: totals, driver-to-sink resistances and coupling pairs."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netohm.functions import stats
from netohm.functions import units as U
from netohm.operators.coupling import regroup
from netohm.sources.shared import kept
from netohm.sources.spef import SpefLibrary


@dataclass(frozen=True)
class Comparison:
    """cap (net, c1, c2), res (net, driver, sink, r1, r2), ccap (net1, net2, c1, c2); missing sections are None."""

    cap: DataFrame | None = None
    res: DataFrame | None = None
    ccap: DataFrame | None = None

    def with_section(self, **section: DataFrame) -> Comparison:
        return replace(self, **section)

    def summary(self) -> DataFrame:
        """One row of counts and correlations; a missing section counts 0."""
        out = None
        for name, df, x, y in (("cap", self.cap, "c1", "c2"), ("res", self.res, "r1", "r2"), ("ccap", self.ccap, "c1", "c2")):
            if df is None:
                continue
            row = stats.pearson(df, x, y, f"{name}_count", f"{name}_correlation")
            out = row if out is None else out.join(F.broadcast(row))  # one row each
        return out


def summary_text(summary: DataFrame) -> list[str]:
    """Printable lines; N/A for the correlation of an empty section."""
    row = summary.first().asDict()
    return [
        f"{n}: {row[f'{n}_count']} rows, correlation " + (f"{row[f'{n}_correlation']:.6f}" if row[f"{n}_count"] else "N/A") for n in ("cap", "res", "ccap") if f"{n}_count" in row
    ]


def compare_caps(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("net", F.col("total_cap_pf").alias("c1")).join(b.select("net", F.col("total_cap_pf").alias("c2")), "net")


def compare_resistances(a: DataFrame, b: DataFrame) -> DataFrame:
    """The driver is that of the first library."""
    return a.select("net", "driver", "sink", F.col("r").alias("r1")).join(b.select("net", "sink", F.col("r").alias("r2")), ["net", "sink"]).select("net", "driver", "sink", "r1", "r2")


def compare_coupling(a: DataFrame, b: DataFrame) -> DataFrame:
    return regroup(a).withColumnRenamed("cap_pf", "c1").join(regroup(b).withColumnRenamed("cap_pf", "c2"), ["net1", "net2"])


def only_in(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti").orderBy(*keys)


def in_ohm(resistances: DataFrame, libraries: DataFrame) -> DataFrame:
    r = resistances.join(libraries.select("lib_id", "r_unit", "r_scale"), "lib_id")
    return r.withColumn("r", U.convert_resistance(F.col("r") * F.col("r_scale"), F.col("r_unit"))).drop("r_unit", "r_scale")


def compare(a: SpefLibrary, b: SpefLibrary, method: str = "dijkstra") -> Comparison:
    """All sections, worked out once as tables in the shared folder."""
    res = [in_ohm(x.resistances(method), x.libraries) for x in (a, b)]
    parts = {"cap": compare_caps(a.nets, b.nets), "res": compare_resistances(*res), "ccap": compare_coupling(a.coupling_caps, b.coupling_caps)}
    return Comparison(**{k: kept(df, k) for k, df in parts.items()})


def coupling_report(a: SpefLibrary, b: SpefLibrary) -> tuple[DataFrame, DataFrame]:
    """Pairs of one library only, both ways."""
    keys = ["net1", "net2"]
    return only_in(regroup(a.coupling_caps), regroup(b.coupling_caps), keys), only_in(regroup(b.coupling_caps), regroup(a.coupling_caps), keys)


def with_coupling_pct(ccap: DataFrame, totals: DataFrame) -> DataFrame:
    """ccap with pct1 and pct2: coupling as a share of the larger total of both nets; totals: net, c1, c2 in pF. 0 without totals."""
    for n in ("1", "2"):
        t = totals.select(F.col("net").alias(f"net{n}"), F.col("c1").alias(f"t1_{n}"), F.col("c2").alias(f"t2_{n}"))
        ccap = ccap.join(t, f"net{n}", "left")

    def pct(c: str) -> Column:
        top = F.greatest(F.coalesce(f"t{c}_1", F.lit(0.0)), F.coalesce(f"t{c}_2", F.lit(0.0)))
        return F.when(top > 0, 100 * F.col(f"c{c}") / top).otherwise(F.lit(0.0))

    return ccap.select("net1", "net2", "c1", "c2", pct("1").alias("pct1"), pct("2").alias("pct2"))


def nearest_point(df: DataFrame, x: str, y: str, at: tuple[float, float], keys: list[str], radius: float | None = None) -> DataFrame:
    """The row next to a place by a look at all rows; ties go to the least keys. For many look-ups there is operators.nearest."""
    d2 = (F.col(x) - at[0]) ** 2 + (F.col(y) - at[1]) ** 2
    out = df.withColumn("d2", d2)
    if radius is not None:
        out = out.where(F.col("d2") <= radius * radius)
    return out.orderBy("d2", *keys).limit(1)
