"""Registered queries over the derived library and the same in SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netohm.functions import stats
from netohm.functions import text as T
from netohm.functions import units as U
from netohm.operators import compare as C
from netohm.operators import filters, nearest, resistance, rewrite, views
from netohm.plans import derived as D
from netohm.sources import datafiles
from netohm.sources.shared import passing, scratch
from netohm.sources.spef import read_each, read_spef

#: x, y and radius of look-ups.
PLACES = ((0.0, 0.0, 0.01), (0.2, 0.2, 0.05), (0.3, 0.05, 0.2), (9.0, 9.0, 1.0), (0.9, 0.9, 5.0))
MILLI = lambda c: F.floor(F.col(c) * 1e6 + 0.5) / 1e6  # noqa: E731  six decimals, the same in SQL


def cap_rows(s: SparkSession, d: str) -> DataFrame:
    return C.compare_caps(D.caps1(s, d), D.caps2(s, d))


def cap_compare(s, d):
    return cap_rows(s, d).select("net", "c1", MILLI("c2").alias("c2"), (F.floor((F.col("c2") - F.col("c1")) * 1e6 + 0.5) / 1e6).alias("delta"))


def cap_correlation(s, d):
    return stats.pearson(cap_rows(s, d), "c1", "c2").select("n", MILLI("corr").alias("corr"))


def cap_only_in_lib1(s, d):
    return C.only_in(D.caps1(s, d), D.caps2(s, d), ["net"])


def common_nets(s, d):
    return D.caps1(s, d).select("net").intersect(D.caps2(s, d).select("net"))


def _res(s, d, second=False, method="dijkstra"):
    return resistance.driver_sink_resistances(D.nets(s, d, second), method).select("net", "driver", "sink", "r")


def res_shortest_path(s, d):
    return _res(s, d).select("net", "sink", MILLI("r").alias("r"))


def res_equivalent(s, d):
    return _res(s, d, method="equivalent").select("net", "sink", MILLI("r").alias("r"))


def res_rows(s, d):
    return C.compare_resistances(_res(s, d), _res(s, d, True))


def res_compare(s, d):
    return res_rows(s, d).select("net", "driver", "sink", MILLI("r1").alias("r1"), MILLI("r2").alias("r2"))


def res_correlation(s, d):
    return stats.pearson(res_rows(s, d), "r1", "r2").select("n", MILLI("corr").alias("corr"))


def coupling_resolve(s, d):
    return D.library(s, d).coupling_caps.select("net1", "net2", MILLI("cap_pf").alias("cap_pf"))


def ccap_rows(s, d):
    return C.compare_coupling(D.library(s, d).coupling_caps, D.library(s, d, True).coupling_caps)


def coupling_compare(s, d):
    return ccap_rows(s, d).select("net1", "net2", MILLI("c1").alias("c1"), MILLI("c2").alias("c2"))


def coupling_only(s, d):
    return C.only_in(D.library(s, d).coupling_caps, D.library(s, d, True).coupling_caps, ["net1", "net2"])


def pct_rows(s, d):
    return C.with_coupling_pct(ccap_rows(s, d), cap_rows(s, d))


def coupling_pct(s, d):
    return pct_rows(s, d).select("net1", "net2", MILLI("pct1").alias("pct1"), MILLI("pct2").alias("pct2"))


def coupling_filter(s, d):
    f = filters.CompareFilter(coupling_cap_min=0.01, coupling_pct_max=10.0)
    return filters.filter_coupling(pct_rows(s, d), f).select("net1", "net2", MILLI("c1").alias("c1"))


def fanout_filter(s, d):
    f = filters.CompareFilter(fanout_min=2, fanout_max=4)
    return filters.filter_caps(cap_rows(s, d), f, D.nets(s, d)).select("net", "c1")


def range_filter(s, d):
    f = filters.CompareFilter.parse(r_min="10", r_max="40.5")
    return filters.filter_resistances(res_rows(s, d), f).select("net", "sink", MILLI("r1").alias("r1"))


def _diffs(s, d):
    return cap_rows(s, d).select(MILLI("c1").alias("c1"), MILLI("c2").alias("c2")).select(stats.abs_diff("c1", "c2").alias("x"))


def diff_stats(s, d):
    r = stats.diff_stats(_diffs(s, d), "x")
    return r.select("n", *[MILLI(c).alias(c) for c in ("mean", "stddev", "rmse", "min", "max")])


def diff_histogram(s, d):
    return stats.diff_histogram(_diffs(s, d), "x").select("bin", MILLI("lo").alias("lo"), MILLI("hi").alias("hi"), "n", "band")


def pct_histogram(s, d):
    rows = pct_rows(s, d).select(MILLI("pct1").alias("x"))
    return stats.bins(rows, "x", 80).select("bin", MILLI("lo").alias("lo"), MILLI("hi").alias("hi"), "n")


def axis_range(s, d):
    return stats.axis_range(cap_rows(s, d), "c1", "c2").select(MILLI("lo").alias("lo"), MILLI("hi").alias("hi"))


def diagonal_side(s, d):
    return cap_rows(s, d).select(stats.side("c1", "c2").alias("side")).groupBy("side").agg(F.count("*").alias("n"))


def _agg(how):
    def run(s, d):
        r = resistance.driver_sink_resistances(D.nets(s, d))
        return resistance.per_net(r, how).select("net", MILLI("r").alias("r"))

    return run


def unit_normalise(s, d):
    o = D.table(s, d, "orders").select("o_orderkey", "o_totalprice")
    unit = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % len(names) + 1).cast("int"))
    v = F.col("o_totalprice")
    c, r = unit("PF", "nF", "ff", "F", "zz"), unit("OHM", "kohm", "MOHM", "zz")
    return o.select(
        "o_orderkey", U.convert_capacitance(v, c).alias("pf"), U.convert_resistance(v, r).alias("ohm"), MILLI_OF(U.capacitance_from_pf(v, c)).alias("from_pf"), MILLI_OF(U.resistance_from_ohm(v, r)).alias("from_ohm")
    )


def MILLI_OF(x):
    return F.floor(x * 1e6 + 0.5) / 1e6


def ratio_csv(s, d):
    rows = datafiles.csv_rows(cap_rows(s, d), "c1", "c2", "C")
    return rows.select("net", MILLI("C_tool1").alias("C_tool1"), MILLI_OF(F.col("ratio").cast("double")).alias("ratio"))


def nearest_point(s, d):
    return nearest.grid(cap_rows(s, d), "c1", "c2", ["net"]).nearest((0.15, 0.15)).select("net", MILLI("c1").alias("c1"), MILLI("c2").alias("c2"))


def nearest_in_radius(s, d):
    """Looks from the corners, the middle and far off, each within a radius."""
    g = nearest.grid(cap_rows(s, d), "c1", "c2", ["net"])
    found = [g.nearest((x, y), r).select(F.lit(k).alias("k"), "net", MILLI("c1").alias("c1")) for k, (x, y, r) in enumerate(PLACES)]
    return functools.reduce(DataFrame.unionByName, found)


def _file(s, d, star=False):
    path = scratch(s, "spef")
    D.write_spef(D.library(s, d, star=star), path, packed=True)
    return path


def _parsed(s, d):
    return read_spef(s, _file(s, d), "lib1")


def spef_roundtrip_nets(s, d):
    return _parsed(s, d).nets.select("net", MILLI("total_cap_pf").alias("total_cap_pf"), "driver", F.size("sinks").cast("long").alias("fanout"))


def spef_roundtrip_pins(s, d):
    return _parsed(s, d).nets.select("net", F.posexplode("sinks").alias("k", "sink")).select("net", F.col("k").cast("long").alias("k"), "sink")


def spef_roundtrip_edges(s, d):
    return _parsed(s, d).nets.select("net", F.explode("edges").alias("e")).groupBy("net").agg(F.count("*").alias("n"), MILLI_OF(F.sum("e.r")).alias("r"))


def spef_roundtrip_ccaps(s, d):
    return _parsed(s, d).coupling_caps.select("net1", "net2", MILLI("cap_pf").alias("cap_pf"))


def datafile_roundtrip(s, d):
    path = scratch(s, "cap")
    datafiles.write_data(cap_rows(s, d).select("net", "c1", MILLI("c2").alias("c2")), path, datafiles.CAP)
    return datafiles.read_cap_data(s, path)


def shuffle_invariance(s, d):
    out = scratch(s, "shuffled")
    with passing(s):
        blocks, in_order = rewrite.shuffle_blocks(s, _file(s, d), 7)
        rewrite.write_blocks(blocks, out, in_order, packed=True)
    return read_spef(s, out, "lib1").nets.select("net", MILLI("total_cap_pf").alias("total_cap_pf"), F.size("sinks").cast("long").alias("fanout"))


def _rewritten(s, d, star=False, **targets):
    out = scratch(s, "backmarked")
    rewrite.write_blocks(lambda: rewrite.backmark_blocks(s, _file(s, d, star), **targets), out, packed=True)
    return out


def _backmarked(s, d, star=False, **targets):
    return read_spef(s, _rewritten(s, d, star, **targets), "lib1")


def backmark_cap(s, d):
    want = D.caps2(s, d).select("net", F.col("total_cap_pf").alias("value"))
    return _backmarked(s, d, cap=want).nets.select("net", F.col("total_cap_pf").alias("c")).join(D.caps2(s, d).select("net"), "net", "left_semi").select("net", MILLI("c").alias("c"))


def backmark_ccap(s, d):
    want = ccap_rows(s, d).select("net1", "net2", MILLI("c2").alias("value"))
    lib = _backmarked(s, d, ccap=want)
    return lib.coupling_caps.join(want.select("net1", "net2"), ["net1", "net2"], "left_semi").select("net1", "net2", MILLI("cap_pf").alias("cap_pf"))


def backmark_res(s, d):
    want = resistance.driver_sink_resistances(D.nets(s, d, True, star=True)).select("net", "sink", F.col("r").alias("value"))
    lib = _backmarked(s, d, star=True, res=want)
    return resistance.driver_sink_resistances(lib.nets).select("net", "sink", MILLI("r").alias("r"))


def compare_summary(s, d):
    """The whole comparison of two libraries: counts and correlations of totals, resistances and coupling pairs."""
    row = C.compare(D.library(s, d), D.library(s, d, True)).summary()
    return row.select(*[x for n in ("cap", "res", "ccap") for x in (f"{n}_count", MILLI(f"{n}_correlation").alias(f"{n}_correlation"))])


def coupling_only_both_ways(s, d):
    one, two = C.coupling_report(D.library(s, d), D.library(s, d, True))
    tag = lambda df, k: df.select(F.lit(k).alias("lib"), "net1", "net2")
    return tag(one, 1).unionByName(tag(two, 2))


def total_range_filter(s, d):
    """Totals within a range, and pairs of an open one."""
    caps = filters.filter_caps(cap_rows(s, d), filters.CompareFilter(c_min=0.05, c_max=0.2)).select(F.lit("cap").alias("kind"), "net", MILLI("c1").alias("c1"))
    pairs = filters.filter_coupling(pct_rows(s, d), filters.CompareFilter(coupling_cap_min=0.02)).select(F.lit("ccap").alias("kind"), F.concat_ws(" ", "net1", "net2").alias("net"), MILLI("c1").alias("c1"))
    return caps.unionByName(pairs)


def view_stats(s, d):
    """The row of statistics of a filtered view of totals, and its points by side."""
    view = views.total_views(C.Comparison(cap=cap_rows(s, d)), filters.CompareFilter(c_max=0.2))["cap"]
    sides = view.points.groupBy("side").agg(F.count("*").alias("k")).groupBy().pivot("side", ["red", "blue"]).agg(F.first("k"))
    return view.stats.join(sides).select("n", "n_all", *[MILLI(c).alias(c) for c in ("corr", "corr_all", "lo", "hi")], "red", "blue")  # one row each


def short_numbers(s, d):
    v = F.col("o_totalprice") / F.element_at(F.array(*map(F.lit, (700000007.1234567, 700000.1234567, 7000.1234567, 7.1234567))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return D.table(s, d, "orders").select("o_orderkey", T.hover_number(v).alias("hover"), T.stat_number(v).alias("stat"))


def res_file_roundtrip(s, d):
    path = scratch(s, "res")
    datafiles.write_data(res_rows(s, d), path, datafiles.RES)
    return datafiles.read_res_data(s, path).select("net", "driver", "sink", MILLI("r1").alias("r1"), MILLI("r2").alias("r2"))


def ccap_file_roundtrip(s, d):
    path = scratch(s, "ccap")
    datafiles.write_data(ccap_rows(s, d), path, datafiles.CCAP)
    return datafiles.read_ccap_data(s, path).select("net1", "net2", MILLI("c1").alias("c1"), MILLI("c2").alias("c2"))


def cap_target_file(s, d):
    path = scratch(s, "targets")
    datafiles.write_data(cap_rows(s, d), path, datafiles.CAP)
    return datafiles.read_cap_targets(s, path).select("net", MILLI("value").alias("value"))


def res_target_file(s, d):
    path = scratch(s, "targets")
    datafiles.write_data(res_rows(s, d), path, datafiles.RES)
    return datafiles.read_res_targets(s, path).select("net", "sink", MILLI("value").alias("value"))


def ccap_target_file(s, d):
    """Targets with their nets the other way round."""
    path = scratch(s, "targets")
    datafiles.write_data(ccap_rows(s, d).select(F.col("net2").alias("net1"), F.col("net1").alias("net2"), "c1", "c2"), path, datafiles.CCAP)
    return datafiles.read_ccap_targets(s, path).select("net1", "net2", MILLI("value").alias("value"))


def csv_files(s, d):
    """Both CSV files, written and read again."""
    prefix = scratch(s, "csv")
    datafiles.write_csvs(C.Comparison(cap=cap_rows(s, d), res=res_rows(s, d)), prefix, "avg")
    parts = []
    for name, kind in (("caps", "C"), ("res_avg", "R_avg")):
        rows = s.read.csv(f"{prefix}_{name}.csv", header=True)
        parts.append(rows.select(F.lit(name).alias("file"), "net", *[MILLI_OF(F.col(c).cast("double")).alias(n) for c, n in ((f"{kind}_tool1", "tool1"), (f"{kind}_tool2", "tool2"), ("ratio", "ratio"), ("delta", "delta"))]))
    return parts[0].unionByName(parts[1])


def repeated_nets(s, d):
    """A file that lists every third net once more, with another total, driver and sink: the last total and the first driver count, sinks add up."""
    lib = D.library(s, d)
    star = F.concat(F.lit("*"), F.col("pos").cast("string"))
    lines = F.array(F.concat_ws(" ", F.lit("*D_NET"), star, (F.col("total_cap") * 2).cast("string")), F.lit("*CONN"), F.concat(F.lit("*I "), star, F.lit(":late O")), F.concat(F.lit("*I "), star, F.lit(":more I")), F.lit("*END"))
    again = lib.nets.where(F.col("pos") % 3 == 0).select((F.col("pos") + (1 << 40)).alias("k1"), F.lit(0).alias("k2"), F.array_join(lines, "\n").alias("value"))
    path = scratch(s, "spef")
    D.write_lines_of(D.spef_lines(lib).unionByName(again), path, packed=True)
    return read_spef(s, path, "lib1").nets.select("net", MILLI("total_cap_pf").alias("total_cap_pf"), "driver", F.size("sinks").cast("long").alias("fanout"))


def backmark_totals_and_pairs(s, d):
    """Totals and coupling pairs together: the ground capacitors take what the pairs leave of the new total."""
    caps, pairs = D.caps2(s, d).select("net", F.col("total_cap_pf").alias("value")), ccap_rows(s, d).select("net1", "net2", F.col("c2").alias("value"))
    out = _rewritten(s, d, cap=caps, ccap=pairs)
    ground = F.regexp_extract("block", r"\*CAP\n1 \S+ (\S+)", 1).cast("double")
    blocks = read_spef(s, out, "lib1", text=True).blocks.select("net", "total_cap", ground.alias("g"))
    return blocks.select("net", MILLI("total_cap").alias("total_cap"), MILLI("g").alias("ground"))


def backmark_chain(s, d):
    """Resistance targets on chains, whose sinks share segments: the last segment takes what its target leaves, the others the average ratio."""
    want = resistance.driver_sink_resistances(D.nets(s, d, True)).select("net", "sink", F.col("r").alias("value"))
    edges = _backmarked(s, d, res=want).nets.select("net", F.explode("edges").alias("e"))
    return edges.groupBy("net").agg(F.count("*").alias("n"), (F.floor(F.sum("e.r") * 1e4 + 0.505) / 1e4).alias("r"))  # sums of values with six decimals never lie on this border


def damaged_blocks(s, d):
    """A file in which nets of every fifth order have no total, read beside a file that is missing."""
    lib = D.library(s, d)
    lines = D.spef_lines(lib)
    broken = F.when((F.col("k1") >= 0) & (F.col("k1") % 5 == 0), F.regexp_replace("value", r"^(\*D_NET \S+)[^\n]*", "$1")).otherwise(F.col("value"))
    path = scratch(s, "spef")
    D.write_lines_of(lines.withColumn("value", broken), path, packed=True)
    libraries, report = read_each(s, [path, path + "-missing"])
    return report.select(F.when(F.col("error").isNull(), F.lit("read")).otherwise(F.lit("failed")).alias("state"), F.coalesce("nets", F.lit(0)).alias("nets"), F.coalesce("damaged", F.lit(0)).alias("damaged"))


QUERIES = {
    f.__name__: f
    for f in (
        cap_compare, cap_correlation, cap_only_in_lib1, common_nets, res_shortest_path, res_equivalent, res_compare, res_correlation, coupling_resolve, coupling_compare, coupling_only, coupling_pct,
        coupling_filter, fanout_filter, range_filter, diff_stats, diff_histogram, pct_histogram, axis_range, diagonal_side, unit_normalise, ratio_csv, nearest_point, spef_roundtrip_nets, spef_roundtrip_pins,
        spef_roundtrip_edges, spef_roundtrip_ccaps, datafile_roundtrip, shuffle_invariance, backmark_cap, backmark_ccap, backmark_res,
        nearest_in_radius, compare_summary, coupling_only_both_ways, total_range_filter, view_stats, short_numbers, res_file_roundtrip, ccap_file_roundtrip, cap_target_file, res_target_file, ccap_target_file,
        csv_files, repeated_nets, backmark_totals_and_pairs, backmark_chain, damaged_blocks,
    )
} | {f"r_agg_{how}": _agg(how) for how in ("max", "avg", "total")}

_M = "floor(({}) * 1e6 + 0.5) / 1e6"
_LIBS = """
c1 AS (SELECT 'net_' || o_orderkey AS net, o_totalprice / 1e6 AS c1 FROM orders),
c2 AS (SELECT 'net_' || l_orderkey AS net, sum(l_extendedprice * (1 - l_discount)) / 1e6 AS c2 FROM lineitem GROUP BY ALL),
cap AS (SELECT net, c1, c2 FROM c1 JOIN c2 USING (net))"""
_RES = """
seg AS (SELECT l_orderkey AS k, l_linenumber AS ln, min(l_quantity) AS m1, min(l_quantity * (1 + l_discount)) AS m2, 1 / sum(1 / l_quantity) AS p1 FROM lineitem GROUP BY ALL),
res AS (SELECT 'net_' || k AS net, 'net_' || k || ':d' AS driver, 'net_' || k || ':s' || ln AS sink, sum(m1) OVER w AS r1, sum(m2) OVER w AS r2, sum(p1) OVER w AS e1 FROM seg WINDOW w AS (PARTITION BY k ORDER BY ln))"""
_CC = """
nx AS (SELECT o_orderkey AS a, o_totalprice AS pa, lead(o_orderkey) OVER w AS b, lead(o_totalprice) OVER w AS pb FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
cc1 AS (SELECT least('net_' || a, 'net_' || b) AS net1, greatest('net_' || a, 'net_' || b) AS net2, CASE WHEN 'net_' || a < 'net_' || b THEN pa ELSE pb END / 1e7 AS c1, a, b FROM nx WHERE b IS NOT NULL),
cc AS (SELECT net1, net2, c1, c1 * 1.1 AS c2 FROM cc1 WHERE a IN (SELECT l_orderkey FROM lineitem) AND b IN (SELECT l_orderkey FROM lineitem)),
pct AS (SELECT cc.*, CASE WHEN greatest(coalesce(x.c1, 0), coalesce(y.c1, 0)) > 0 THEN 100 * cc.c1 / greatest(coalesce(x.c1, 0), coalesce(y.c1, 0)) ELSE 0 END AS pct1,
  CASE WHEN greatest(coalesce(x.c2, 0), coalesce(y.c2, 0)) > 0 THEN 100 * cc.c2 / greatest(coalesce(x.c2, 0), coalesce(y.c2, 0)) ELSE 0 END AS pct2
  FROM cc LEFT JOIN cap x ON cc.net1 = x.net LEFT JOIN cap y ON cc.net2 = y.net)"""


def _m(x: str, name: str | None = None) -> str:
    return f"{_M.format(x)} AS {name or x}"


def _corr(rows: str, x: str, y: str) -> str:
    return f"SELECT count(*) AS n, floor(coalesce(CASE WHEN count(*) >= 2 AND stddev_pop({x}) >= 1e-15 AND stddev_pop({y}) >= 1e-15 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END, 0) * 1e6 + 0.5) / 1e6 AS corr FROM {rows}"


def _bins(rows: str, n: int) -> str:
    """Counts by edges, as the histogram's definition has them."""
    return f"""
b0 AS (SELECT min(x) AS a0, max(x) AS z0 FROM ({rows})),
b AS (SELECT CASE WHEN a0 = z0 THEN a0 - 0.5 ELSE a0 END AS a, CASE WHEN a0 = z0 THEN z0 + 0.5 ELSE z0 END AS z FROM b0),
e AS (SELECT CAST(i AS INTEGER) AS bin, i * ((z - a) / {n}) + a AS lo, CASE WHEN i + 1 = {n} THEN z ELSE (i + 1) * ((z - a) / {n}) + a END AS hi FROM b, range({n}) t(i)),
h AS (SELECT bin, lo, hi, (SELECT count(*) FROM ({rows}) v WHERE v.x >= e.lo AND (v.x < e.hi OR (e.bin = {n} - 1 AND v.x <= e.hi))) AS n FROM e)"""


_DIFFS = f"SELECT abs({_M.format('c1')} - {_M.format('c2')}) AS x FROM cap"
_EDGES = "SELECT 'net_' || l_orderkey AS net, count(*) AS n, floor(sum(l_quantity) * 1e6 + 0.5) / 1e6 AS r FROM lineitem GROUP BY ALL"
_FAN = "fan AS (SELECT 'net_' || l_orderkey AS net, count(DISTINCT l_linenumber) AS fanout FROM lineitem GROUP BY ALL)"

SQL = {
    "cap_compare": f"WITH {_LIBS} SELECT net, c1, {_m('c2')}, {_m('c2 - c1', 'delta')} FROM cap",
    "cap_correlation": f"WITH {_LIBS} {_corr('cap', 'c1', 'c2')}",
    "cap_only_in_lib1": f"WITH {_LIBS} SELECT net FROM c1 WHERE NOT EXISTS (SELECT 1 FROM c2 WHERE c2.net = c1.net)",
    "common_nets": f"WITH {_LIBS} SELECT net FROM cap",
    "res_shortest_path": f"WITH {_RES} SELECT net, sink, {_m('r1', 'r')} FROM res",
    "res_equivalent": f"WITH {_RES} SELECT net, sink, {_m('e1', 'r')} FROM res",
    "res_compare": f"WITH {_RES} SELECT net, driver, sink, {_m('r1')}, {_m('r2')} FROM res",
    "res_correlation": f"WITH {_RES} {_corr('res', 'r1', 'r2')}",
    "coupling_resolve": f"WITH {_LIBS}, {_CC} SELECT net1, net2, {_m('c1', 'cap_pf')} FROM cc1",
    "coupling_compare": f"WITH {_LIBS}, {_CC} SELECT net1, net2, {_m('c1')}, {_m('c2')} FROM cc",
    "coupling_only": f"WITH {_LIBS}, {_CC} SELECT net1, net2 FROM cc1 EXCEPT SELECT net1, net2 FROM cc",
    "coupling_pct": f"WITH {_LIBS}, {_CC} SELECT net1, net2, {_m('pct1')}, {_m('pct2')} FROM pct",
    "coupling_filter": f"WITH {_LIBS}, {_CC} SELECT net1, net2, {_m('c1')} FROM pct WHERE c1 >= 0.01 AND pct1 <= 10",
    "fanout_filter": f"WITH {_LIBS}, {_FAN} SELECT net, c1 FROM cap JOIN fan USING (net) WHERE fanout BETWEEN 2 AND 4",
    "range_filter": f"WITH {_RES} SELECT net, sink, {_m('r1')} FROM res WHERE r1 BETWEEN 10 AND 40.5",
    "diff_stats": f"WITH {_LIBS}, v AS ({_DIFFS}) SELECT count(*) AS n, {_m('avg(x)', 'mean')}, {_m('coalesce(stddev_samp(x), 0)', 'stddev')}, {_m('sqrt(avg(x * x))', 'rmse')}, {_m('min(x)', 'min')}, {_m('max(x)', 'max')} FROM v",
    "diff_histogram": f"""WITH {_LIBS}, v AS ({_DIFFS}), {_bins('SELECT x FROM v', 100)}, s AS (SELECT avg(x) AS mu, coalesce(stddev_samp(x), 0) AS sd FROM v)
SELECT bin, {_m('lo')}, {_m('hi')}, n, CASE WHEN sd = 0 OR abs((lo + hi) / 2 - mu) <= sd THEN '1s' WHEN abs((lo + hi) / 2 - mu) <= 2 * sd THEN '2s' WHEN abs((lo + hi) / 2 - mu) <= 3 * sd THEN '3s' ELSE 'beyond' END AS band FROM h, s""",
    "pct_histogram": f"WITH {_LIBS}, {_CC}, v AS (SELECT {_M.format('pct1')} AS x FROM pct), {_bins('SELECT x FROM v', 80)} SELECT bin, {_m('lo')}, {_m('hi')}, n FROM h",
    "axis_range": f"WITH {_LIBS}, m AS (SELECT min(least(c1, c2)) AS a, max(greatest(c1, c2)) AS b FROM cap) SELECT {_m('a - 0.05 * CASE WHEN a = b THEN 1 ELSE b - a END', 'lo')}, {_m('b + 0.05 * CASE WHEN a = b THEN 1 ELSE b - a END', 'hi')} FROM m",
    "diagonal_side": f"WITH {_LIBS} SELECT CASE WHEN c2 > c1 THEN 'red' ELSE 'blue' END AS side, count(*) AS n FROM cap GROUP BY ALL",
    "unit_normalise": f"""SELECT o_orderkey, o_totalprice * CASE o_orderkey % 5 WHEN 1 THEN 1e3 WHEN 2 THEN 1e-3 WHEN 3 THEN 1e12 ELSE 1 END AS pf, o_totalprice * CASE o_orderkey % 4 WHEN 1 THEN 1e3 WHEN 2 THEN 1e6 ELSE 1 END AS ohm,
{_m('o_totalprice / CASE o_orderkey % 5 WHEN 1 THEN 1e3 WHEN 2 THEN 1e-3 WHEN 3 THEN 1e12 ELSE 1 END', 'from_pf')}, {_m('o_totalprice / CASE o_orderkey % 4 WHEN 1 THEN 1e3 WHEN 2 THEN 1e6 ELSE 1 END', 'from_ohm')} FROM orders""",
    "ratio_csv": f"WITH {_LIBS} SELECT net, {_m('c1', 'C_tool1')}, {_m('c2 / c1', 'ratio')} FROM cap",
    "nearest_point": f"WITH {_LIBS} SELECT net, {_m('c1')}, {_m('c2')} FROM cap ORDER BY (c1 - 0.15) * (c1 - 0.15) + (c2 - 0.15) * (c2 - 0.15), net LIMIT 1",
    "spef_roundtrip_nets": f"WITH {_LIBS}, {_FAN} SELECT net, {_m('c1', 'total_cap_pf')}, CASE WHEN fanout IS NULL THEN '' ELSE net || ':d' END AS driver, coalesce(fanout, 0) AS fanout FROM c1 LEFT JOIN fan USING (net)",
    "spef_roundtrip_pins": "SELECT 'net_' || k AS net, row_number() OVER (PARTITION BY k ORDER BY ln) - 1 AS k, 'net_' || k || ':s' || ln AS sink FROM (SELECT DISTINCT l_orderkey AS k, l_linenumber AS ln FROM lineitem)",
    "spef_roundtrip_edges": _EDGES,
    "spef_roundtrip_ccaps": f"WITH {_LIBS}, {_CC} SELECT net1, net2, {_m('c1', 'cap_pf')} FROM cc1",
    "datafile_roundtrip": f"WITH {_LIBS} SELECT net, c1, {_m('c2')} FROM cap",
    "shuffle_invariance": f"WITH {_LIBS}, {_FAN} SELECT net, {_m('c1', 'total_cap_pf')}, coalesce(fanout, 0) AS fanout FROM c1 LEFT JOIN fan USING (net)",
    "backmark_cap": f"WITH {_LIBS} SELECT net, {_m('c2', 'c')} FROM cap",
    "backmark_ccap": f"WITH {_LIBS}, {_CC} SELECT net1, net2, {_m('c2', 'cap_pf')} FROM cc",
    "backmark_res": f"SELECT 'net_' || l_orderkey AS net, 'net_' || l_orderkey || ':s' || l_linenumber AS sink, {_m('min(l_quantity * (1 + l_discount))', 'r')} FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "nearest_in_radius": f"WITH {_LIBS}, p(k, x, y, r) AS (VALUES {', '.join(f'({k}, {x}, {y}, {r})' for k, (x, y, r) in enumerate(PLACES))}), n AS (SELECT k, net, c1, row_number() OVER (PARTITION BY k ORDER BY (c1 - x) ** 2 + (c2 - y) ** 2, net) AS i FROM p JOIN cap ON (c1 - x) ** 2 + (c2 - y) ** 2 <= r * r) SELECT k, net, {_m('c1')} FROM n WHERE i = 1",
    "compare_summary": f"WITH {_LIBS}, {_RES}, {_CC}, "
    + ", ".join(f"{t} AS ({_corr(rows, x, y)})" for t, rows, x, y in (("a", "cap", "c1", "c2"), ("b", "res", "r1", "r2"), ("c", "cc", "c1", "c2")))
    + " SELECT a.n AS cap_count, a.corr AS cap_correlation, b.n AS res_count, b.corr AS res_correlation, c.n AS ccap_count, c.corr AS ccap_correlation FROM a, b, c",
    "coupling_only_both_ways": f"WITH {_LIBS}, {_CC} SELECT 1 AS lib, net1, net2 FROM (SELECT net1, net2 FROM cc1 EXCEPT SELECT net1, net2 FROM cc) UNION ALL SELECT 2, net1, net2 FROM (SELECT net1, net2 FROM cc EXCEPT SELECT net1, net2 FROM cc1)",
    "total_range_filter": f"WITH {_LIBS}, {_CC} SELECT 'cap' AS kind, net, {_m('c1')} FROM cap WHERE c1 BETWEEN 0.05 AND 0.2 UNION ALL SELECT 'ccap', net1 || ' ' || net2, {_m('c1')} FROM cc WHERE c1 >= 0.02",
    "view_stats": f"""WITH {_LIBS}, f AS (SELECT * FROM cap WHERE c1 <= 0.2), a AS ({_corr('f', 'c1', 'c2')}), b AS ({_corr('cap', 'c1', 'c2')}), m AS (SELECT min(least(c1, c2)) AS u, max(greatest(c1, c2)) AS v FROM f)
SELECT a.n, b.n AS n_all, a.corr, b.corr AS corr_all, {_m('u - 0.05 * (v - u)', 'lo')}, {_m('v + 0.05 * (v - u)', 'hi')}, (SELECT count(*) FROM f WHERE c2 > c1) AS red, (SELECT count(*) FROM f WHERE c2 <= c1) AS blue FROM a, b, m""",
    "short_numbers": r"""WITH v AS (SELECT o_orderkey, o_totalprice / CAST(CASE o_orderkey % 4 WHEN 0 THEN 700000007.1234567 WHEN 1 THEN 700000.1234567 WHEN 2 THEN 7000.1234567 ELSE 7.1234567 END AS DOUBLE) AS v FROM orders)
SELECT o_orderkey, CASE WHEN v < 1e-3 THEN printf('%.4e', v) WHEN v < 1 THEN printf('%.6f', v) WHEN v < 1000 THEN printf('%.4f', v) WHEN v < 9999.5 THEN printf('%.0f', v) ELSE regexp_replace(printf('%.3e', v), '\.?0+e', 'e') END AS hover,
CASE WHEN v >= 1e-3 THEN printf('%.4f', v) ELSE printf('%.4e', v) END AS stat FROM v""",
    "res_file_roundtrip": f"WITH {_RES} SELECT net, driver, sink, {_m('r1')}, {_m('r2')} FROM res",
    "ccap_file_roundtrip": f"WITH {_LIBS}, {_CC} SELECT net1, net2, {_m('c1')}, {_m('c2')} FROM cc",
    "cap_target_file": f"WITH {_LIBS} SELECT net, {_m('c2', 'value')} FROM cap",
    "res_target_file": f"WITH {_RES} SELECT net, sink, {_m('r2', 'value')} FROM res",
    "ccap_target_file": f"WITH {_LIBS}, {_CC} SELECT net1, net2, {_m('c2', 'value')} FROM cc",
    "csv_files": f"WITH {_LIBS}, {_RES} SELECT 'caps' AS file, net, {_m('c1', 'tool1')}, {_m('c2', 'tool2')}, {_m('c2 / c1', 'ratio')}, {_m('c2 - c1', 'delta')} FROM cap UNION ALL SELECT 'res_avg', net, {_m('r1')}, {_m('r2')}, {_m('r2 / r1', 'ratio')}, {_m('r2 - r1', 'delta')} FROM res",
    "repeated_nets": f"""WITH {_LIBS}, {_FAN}, x AS (SELECT *, CAST(substr(net, 5) AS BIGINT) % 3 = 0 AS twice FROM c1 LEFT JOIN fan USING (net))
SELECT net, {_m('CASE WHEN twice THEN 2 * c1 ELSE c1 END', 'total_cap_pf')}, CASE WHEN fanout IS NOT NULL THEN net || ':d' WHEN twice THEN net || ':late' ELSE '' END AS driver, coalesce(fanout, 0) + CASE WHEN twice THEN 1 ELSE 0 END AS fanout FROM x""",
    "backmark_totals_and_pairs": f"""WITH {_LIBS}, {_CC}, own AS (SELECT 'net_' || a AS net, 'net_' || b AS other, pa AS p FROM nx WHERE b IS NOT NULL UNION ALL SELECT 'net_' || b, 'net_' || a, pb FROM nx WHERE b IS NOT NULL),
s AS (SELECT own.net, sum(coalesce(cc.c2, own.p / 1e7)) AS coupled FROM own LEFT JOIN cc ON least(own.net, own.other) = cc.net1 AND greatest(own.net, own.other) = cc.net2 GROUP BY ALL),
g AS (SELECT net, c1, c2, CASE WHEN c2 IS NULL THEN c1 / 2 ELSE c2 - coalesce(coupled, 0) END AS g FROM c1 LEFT JOIN c2 USING (net) LEFT JOIN s USING (net))
SELECT net, {_m('coalesce(c2, c1)', 'total_cap')}, {_m("CASE WHEN abs(g) < 1e-4 THEN g ELSE CAST(printf('%.6f', g) AS DOUBLE) END", 'ground')} FROM g""",
    "backmark_chain": f"""WITH {_RES}, x AS (SELECT res.*, r2 / r1 AS q, row_number() OVER (PARTITION BY net ORDER BY sink DESC) AS back FROM res), v AS (SELECT net, avg(q) AS mean FROM x GROUP BY net),
s AS (SELECT x.net, sink, mean, CASE WHEN back > 1 OR r2 - (r1 - m1) * mean <= 0 THEN mean ELSE (r1 * q - (r1 - m1) * mean) / m1 END AS scale FROM x JOIN v USING (net) JOIN seg ON 'net_' || k = x.net AND sink = x.net || ':s' || ln)
SELECT 'net_' || l_orderkey AS net, count(*) AS n, floor(sum(round(l_quantity * scale, 6)) * 1e4 + 0.505) / 1e4 AS r FROM lineitem JOIN s ON net = 'net_' || l_orderkey AND sink = 'net_' || l_orderkey || ':s' || l_linenumber GROUP BY ALL""",
    "damaged_blocks": "SELECT 'read' AS state, count(*) FILTER (o_orderkey % 5 <> 0) AS nets, count(*) FILTER (o_orderkey % 5 = 0) AS damaged FROM orders UNION ALL SELECT 'failed', 0, 0",
} | {f"r_agg_{how}": f"WITH {_RES} SELECT net, floor({fn}(r1) * 1e6 + 0.5) / 1e6 AS r FROM res GROUP BY ALL" for how, fn in (("max", "max"), ("avg", "avg"), ("total", "sum"))}
