"""Range filters of comparison rows. Bounds include their ends; a bound applies only to rows that have the field."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CompareFilter:
    fanout_min: int | None = None
    fanout_max: int | None = None
    c_min: float | None = None
    c_max: float | None = None
    coupling_cap_min: float | None = None
    coupling_cap_max: float | None = None
    coupling_pct_min: float | None = None
    coupling_pct_max: float | None = None
    r_min: float | None = None
    r_max: float | None = None

    @classmethod
    def parse(cls, **texts: str) -> CompareFilter:
        """From text fields; blank means no bound, and what is no number raises ValueError."""
        names = {f.name for f in fields(cls)}
        if unknown := set(texts) - names:
            raise ValueError(f"unknown bounds: {sorted(unknown)}")
        return cls(**{k: (int if k.startswith("fanout") else float)(v) for k, v in texts.items() if v.strip()})


def _between(df: DataFrame, column: str, low, high) -> DataFrame:
    c = F.col(column)
    for bound, ok in ((low, lambda b: c >= b), (high, lambda b: c <= b)):
        if bound is not None:
            df = df.where(c.isNull() | ok(bound))
    return df


def fanout(nets: DataFrame) -> DataFrame:
    return nets.select("net", F.size("sinks").alias("fanout"))


def _with_fanout(df: DataFrame, nets: DataFrame | None, f: CompareFilter) -> DataFrame:
    if nets is None or (f.fanout_min is None and f.fanout_max is None):
        return df
    return _between(df.join(fanout(nets), "net", "left"), "fanout", f.fanout_min, f.fanout_max).drop("fanout")


def filter_caps(cap: DataFrame, f: CompareFilter, nets: DataFrame | None = None) -> DataFrame:
    return _with_fanout(_between(cap, "c1", f.c_min, f.c_max), nets, f)


def filter_resistances(res: DataFrame, f: CompareFilter, nets: DataFrame | None = None) -> DataFrame:
    return _with_fanout(_between(res, "r1", f.r_min, f.r_max), nets, f)


def filter_coupling(ccap: DataFrame, f: CompareFilter) -> DataFrame:
    """ccap with pct1, as with_coupling_pct gives it."""
    return _between(_between(ccap, "c1", f.coupling_cap_min, f.coupling_cap_max), "pct1", f.coupling_pct_min, f.coupling_pct_max)
