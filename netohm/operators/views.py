"""What a correlation plot shows, as DataFrames: points with their side of the diagonal, a row of statistics, a histogram, and the detail of a point."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netohm.functions import stats
from netohm.functions import text as T
from netohm.operators.compare import Comparison, with_coupling_pct
from netohm.operators.filters import CompareFilter, fanout, filter_caps, filter_coupling, filter_resistances


@dataclass(frozen=True)
class View:
    """points: rows with delta, ratio (text, inf where the first is 0) and side. stats: one row of n and corr after filtering, n_all and corr_all before it, lo and hi of the axes."""

    points: DataFrame
    stats: DataFrame
    histogram: DataFrame | None = None


def _view(every: DataFrame, kept: DataFrame, x: str, y: str) -> View:
    a, b = F.col(x), F.col(y)
    points = kept.select("*", (b - a).alias("delta"), T.ratio(a, b).alias("ratio"), stats.side(x, y).alias("side"))
    row = stats.pearson(kept, x, y)
    for other in (stats.pearson(every, x, y, "n_all", "corr_all"), stats.axis_range(kept, x, y)):
        row = row.join(F.broadcast(other))  # one row each
    return View(points, row)


def total_views(c: Comparison, f: CompareFilter | None = None, nets: DataFrame | None = None) -> dict[str, View]:
    """Views of totals (cap) and of driver-to-sink resistances (res); nets (net, sinks) add the fanout."""
    f = f or CompareFilter()
    out = {}
    for name, df, keep, x, y in (("cap", c.cap, filter_caps, "c1", "c2"), ("res", c.res, filter_resistances, "r1", "r2")):
        if df is not None:
            rows = keep(df, f, nets)
            out[name] = _view(df, rows if nets is None else rows.join(fanout(nets), "net", "left"), x, y)
    return out


def coupling_view(c: Comparison, f: CompareFilter | None = None, n: int = 100, metric: str = "stddev") -> View:
    """View of coupling pairs with their percentages (of totals, where c has them) and the histogram of absolute differences."""
    totals = c.cap if c.cap is not None else c.ccap.sparkSession.createDataFrame([], "net string, c1 double, c2 double")
    every = with_coupling_pct(c.ccap, totals)
    rows = filter_coupling(every, f or CompareFilter())
    view = _view(every, rows, "c1", "c2")
    return View(view.points, view.stats, stats.diff_histogram(rows.select(stats.abs_diff("c1", "c2").alias("x")), "x", n, metric))


def view(c: Comparison, which: str, f: CompareFilter | None = None, nets: DataFrame | None = None) -> dict[str, View]:
    """which: total_cap or coupling_cap."""
    if which == "total_cap":
        return total_views(c, f, nets)
    if which == "coupling_cap":
        return {"ccap": coupling_view(c, f)}
    raise ValueError(f"no such view: {which}")


def detail(points: DataFrame) -> Column:
    """The lines of text that describe a point, by the columns that points has."""
    have = set(points.columns)
    kind, x, y = ("R", "r1", "r2") if "r1" in have else ("Cc", "c1", "c2") if "net1" in have else ("C", "c1", "c2")
    a, b = F.col(x), F.col(y)
    ratio = F.when(a == 0, F.lit("inf")).otherwise(F.format_string("%.4f", F.try_divide(b, a)))
    parts = [(n, F.col(n)) for n in ("net", "net1", "net2", "driver", "sink") if n in have]
    parts += [(f"{kind}_ref", T.hover_number(a)), (f"{kind}_fit", T.hover_number(b)), ("delta", T.hover_number(b - a)), ("ratio", ratio)]
    parts += [(f"Cc% {n}", F.concat(F.format_string("%.4f", F.col(c)), F.lit("%"))) for n, c in (("ref", "pct1"), ("fit", "pct2")) if c in have]
    parts += [("fanout", F.col("fanout").cast("string"))] if "fanout" in have else []
    return F.concat_ws("\n", *[F.concat(F.lit(f"{n}: "), v) for n, v in parts])
