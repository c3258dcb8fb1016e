import math

import pytest
from pyspark.sql import functions as F

from netohm.functions import stats
from netohm.functions import text as T
from netohm.functions import units as U
from netohm.operators import compare as C
from netohm.operators import resistance as R
from netohm.operators import rewrite
from netohm.operators.filters import CompareFilter
from netohm.sources import datafiles
from netohm.sources.spef import collect_spef_paths, read_spef, unique_name

SPEF = """*SPEF "IEEE 1481-1999"
*C_UNIT 1 FF // femto
*R_UNIT 1 KOHM
*NAME_MAP
*1 a\\[0\\]
*2 "b"
*1 again
*PORTS
*D_NET *1 12.5
*CONN
*P drv O
*I *1:d O
*I *1:s I
*I *1:late O
*CAP
1 *1:s 2
2 *1:s *2:x 1.5pF
3 *1:s *2:y 0.5
4 *1:s ghost 9
*RES
1 *1:d *1:m 1
2 *1:m *1:s 2 // tail
*END
1 *1:s *2:x 99
 *D_NET *2 7
*CONN
*I *2:x I
*CAP
1 *2:x *1:s 3
*END
*D_NETX junk
*D_NET lonely
"""


@pytest.fixture()
def spef(tmp_path):
    p = tmp_path / "x.spef"
    p.write_text(SPEF)
    return str(p)


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("token,value", [("1.5pF", 1.5), ("pF1.5", 1.5), ("abc", 0.0), (".5", 0.5), ("-2.", -2.0), ("1e-3", 1e-3), ("1e", 1.0)])
def test_numbers(spark, token, value):
    assert one(spark, T.parse_number(F.lit(token))) == value


def test_text(spark):
    assert one(spark, T.format_number(F.lit(0.0))) == "0"
    assert one(spark, T.format_number(F.lit(1.50))) == "1.5"
    assert one(spark, T.format_number(F.lit(0.00001))) == "1.000000e-05"
    assert one(spark, T.strip_quotes(F.lit('"a"'))) == "a"
    assert one(spark, T.ratio(F.lit(0.0), F.lit(1.0))) == "inf"
    assert one(spark, T.split_tokens(F.lit(" a\tb  c "), 2)) == ["a", "b"]


def test_units(spark):
    assert one(spark, U.convert_capacitance(F.lit(2.0), F.lit("FF"))) == pytest.approx(2e-3)
    assert one(spark, U.convert_resistance(F.lit(2.0), F.lit("MOHM"))) == 2e6
    assert one(spark, U.convert_resistance(F.lit(2.0), F.lit("Mohm"))) == 2.0


def test_parse(spark, spef):
    lib = read_spef(spark, spef)
    nets = {r["net"]: r for r in lib.nets.collect()}
    assert set(nets) == {"a[0]", "b"}
    a = nets["a[0]"]
    assert (a["total_cap"], a["driver"], a["sinks"]) == (12.5, "a[0]:d", ["drv", "a[0]:s"])
    assert a["total_cap_pf"] == pytest.approx(0.0125)
    assert [(e["n1"], e["n2"], e["r"]) for e in a["edges"]] == [("a[0]:d", "a[0]:m", 1.0), ("a[0]:m", "a[0]:s", 2.0)]
    assert [tuple(r) for r in lib.coupling_caps.select("net1", "net2", "cap_pf").collect()] == [("a[0]", "b", pytest.approx(0.002))]
    assert {(r["r_unit"], r["c_unit"]) for r in lib.libraries.collect()} == {("KOHM", "FF")}


def test_shuffle_keeps_the_library(spark, spef, tmp_path):
    out = str(tmp_path / "out")
    lines = rewrite.shuffle_ids(spark, spef, 3)
    assert lines.where(rewrite.changed(lines)).count() > 0
    rewrite.write_blocks(*rewrite.shuffle_blocks(spark, spef, 3)[:1], out)
    cols = ("net", "total_cap", "driver", "sinks")
    assert sorted(map(tuple, read_spef(spark, out).nets.select(*cols).collect())) == sorted(map(tuple, read_spef(spark, spef).nets.select(*cols).collect()))


def test_backmark(spark, spef, tmp_path):
    out = str(tmp_path / "out")
    cap = spark.createDataFrame([("a[0]", 0.025)], "net string, value double")
    res = spark.createDataFrame([("a[0]", "a[0]:s", 6000.0)], "net string, sink string, value double")
    rewrite.write_blocks(rewrite.backmark_blocks(spark, spef, cap=cap, res=res), out)
    lib = read_spef(spark, out)
    assert {r["net"]: r["total_cap"] for r in lib.nets.collect()} == {"a[0]": 25.0, "b": 7.0}
    r = {x["sink"]: x["r"] for x in C.in_ohm(R.driver_sink_resistances(lib.nets), lib.libraries).collect()}
    assert r["a[0]:s"] == pytest.approx(6000)


def e(*rows):
    return [{"n1": a, "n2": b, "r": r} for a, b, r in rows]


def test_graphs():
    bridge = e(("d", "a", 1.0), ("d", "b", 1.0), ("a", "s", 1.0), ("b", "s", 1.0), ("a", "b", 5.0))
    assert R.equivalent_resistance(bridge, "d", "s") == pytest.approx(1.0)
    assert R.net_resistances("d", ["s"], bridge) == {"s": 2.0}
    assert R.net_resistances("d", ["s", "x", "d"], e(("d", "s", 2.0), ("d", "s", 2.0), ("y", "x", 1.0)), "equivalent") == {"s": pytest.approx(1.0)}
    assert R.net_resistances("U1:Z", ["s"], e(("U1:1", "s", 3.0), ("U1:2", "t", 1.0))) == {"s": 3.0}
    assert R.net_resistances("d", ["s"], e(("d", "m", 0.0), ("m", "s", 1.0))) == {"s": 1.0}
    assert R.net_resistances("d", ["s"], e(("d", "m", 0.0), ("m", "s", 1.0)), "equivalent") == {}
    assert dict(((a, b), s) for a, b, s in R.segment_scales("d", ["s", "t"], e(("d", "s", 1.0), ("d", "t", 2.0)), {"s": 2.0, "t": 3.0}, 2.5)) == {("d", "s"): 2.0, ("d", "t"): 3.0}


@pytest.mark.parametrize("rows,corr", [([], 0.0), ([(1.0, 2.0)], 0.0), ([(1.0, 2.0), (1.0, 3.0)], 0.0), ([(1.0, 2.0), (2.0, 4.0)], 1.0), ([(1.0, float("nan")), (2.0, 1.0)], 0.0)])
def test_pearson(spark, rows, corr):
    assert stats.pearson(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()["corr"] == pytest.approx(corr)


def test_histogram(spark):
    rows = stats.bins(spark.createDataFrame([(float(i),) for i in range(11)], "x double"), "x", 10).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [1] * 9 + [2]
    flat = stats.diff_histogram(spark.createDataFrame([(2.0,)] * 3, "x double"), "x", 4).collect()
    assert sum(r["n"] for r in flat) == 3 and {r["band"] for r in flat} == {"1s"}
    assert math.isclose(stats.diff_stats(spark.createDataFrame([(3.0,)], "x double"), "x").first()["stddev"], 0.0)


def test_data_files(spark, tmp_path):
    p = tmp_path / "cap.data"
    p.write_text("net,c1,c2\na,1,2\nb 3 4\nc x 1\n")
    assert sorted(map(tuple, datafiles.read_cap_data(spark, str(p)).collect())) == [("a", 1.0, 2.0), ("b", 3.0, 4.0)]
    t = tmp_path / "t.data"
    t.write_text("# head\na 1 2\na 1 5\n")
    assert [tuple(r) for r in datafiles.read_cap_targets(spark, str(t)).collect()] == [("a", 5.0)]
    with pytest.warns(UserWarning):
        assert datafiles.read_ccap_data(spark, str(tmp_path / "none")).count() == 0


def test_small_parts(tmp_path):
    assert unique_name("a", {"a", "a_2"}) == "a_3"
    (tmp_path / "b.SPEF").write_text("")
    (tmp_path / "a.spef").write_text("")
    assert [x.rsplit("/", 1)[1] for x in collect_spef_paths([str(tmp_path), "missing"])] == ["a.spef", "b.SPEF"]
    assert CompareFilter.parse(r_min="0", c_max=" ") == CompareFilter(r_min=0.0)
    with pytest.raises(ValueError):
        CompareFilter.parse(r_min="x")
