"""Files end to end, plot views, the registry, rewriting and sparse resistances against dense ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netohm import cli
from netohm.functions import text as T
from netohm.operators import compare as C
from netohm.operators import resistance as R
from netohm.operators import nearest, rewrite, views
from netohm.operators.filters import CompareFilter
from netohm.plans import generator
from netohm.sources import datafiles
from netohm.sources.registry import Registry
from netohm.sources.shared import phase_table, phases
from netohm.sources.spef import read_each, read_spef, read_spefs
from netohm.streaming.data_stream import stream_caps

HEAD = "*C_UNIT 1 PF\n*R_UNIT 1 OHM\n*NAME_MAP\n*1 a\n*2 b\n*3 c\nend of section\n*9 lost\n*NAME_MAP\n*4 d\n*1 other\n*PORTS\n*5 I\n"


def net(i, total, ground, pairs=(), edges=(), sinks=()):
    rows = [f"*D_NET *{i} {total}", "*CONN", f"*I *{i}:d O", *(f"*I *{i}:{s} I" for s in sinks), "*CAP", f"1 *{i}:d {ground}"]
    rows += [f"{k} *{i}:d *{j}:d {c}" for k, (j, c) in enumerate(pairs, 2)]
    return "\n".join([*rows, "*RES", *(f"{k} *{i}:{x} *{i}:{y} {r}" for k, (x, y, r) in enumerate(edges, 1)), "*END"]) + "\n"


@pytest.fixture()
def two(tmp_path):
    chain, tree = [("d", "x", 1), ("x", "s", 2)], [("d", "x", 1.0), ("x", "s", 2.0), ("x", "t", 3.0)]
    one = HEAD + net(1, 5, 2, [(2, 1), (3, 2)], chain, ["s"]) + net(2, 3, 2, [(1, 1)], tree, ["s", "t"]) + net(3, 4, 2, [(1, 2)]) + net(2, 7, 1, [], [("t", "u", 4)], ["u"])
    other = HEAD + net(1, 6, 2, [(2, 2)], [("d", "s", 6)], ["s"]) + net(2, 2, 2, [(4, 1), (1, 2)], tree, ["s", "t"]) + net(4, 1, 1, [(2, 1)])
    (tmp_path / "one.spef").write_text(one)
    (tmp_path / "two.spef").write_text(other)
    return [str(tmp_path / "one.spef"), str(tmp_path / "two.spef")]


def test_header_sections_and_repeated_nets(spark, two):
    lib = read_spef(spark, two[0])
    assert {r["id"]: r["name"] for r in lib.name_map.collect()} == {"*1": "a", "*2": "b", "*3": "c", "*4": "d"}
    nets = {r["net"]: r for r in lib.nets.collect()}
    assert set(nets) == {"a", "b", "c"} and nets["b"]["total_cap"] == 7.0
    assert nets["b"]["sinks"] == ["b:s", "b:t", "b:u"] and [e["r"] for e in nets["b"]["edges"]] == [1.0, 2.0, 3.0, 4.0]


def test_names_by_broadcast_and_by_join(spark, two):
    from netohm.sources.spef import merge_nets, parse_blocks_of, parse_header, read_blocks, read_header

    libraries, names = parse_header(read_header(read_blocks(spark, two[0], "x", "header")))
    blocks = read_blocks(spark, two[0], "x", "nets")
    found = [sorted(map(str, merge_nets(parse_blocks_of(blocks, names, n), libraries)[0].select("net", "driver", "sinks", "edges", "raw_ccaps").collect())) for n in (0, 1, 100)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 3


def test_compare_two_files_and_command_line(spark, two, tmp_path, capsys):
    a, b = read_spefs(spark, two)
    c = C.compare(a, b)
    assert sorted(map(tuple, c.cap.collect())) == [("a", 5.0, 6.0), ("b", 7.0, 2.0)]
    assert sorted(map(tuple, c.res.collect())) == [("a", "a:d", "a:s", 3.0, 6.0), ("b", "b:d", "b:s", 3.0, 3.0), ("b", "b:d", "b:t", 4.0, 4.0)]
    assert sorted(map(tuple, c.ccap.collect())) == [("a", "b", 1.0, 2.0)]
    out = str(tmp_path / "out")
    assert cli.main([*two, "--csv-prefix", out, "--net-cap-data", f"{out}.cap", "--net-res-data", f"{out}.res", "--net-ccap-data", f"{out}.ccap"], spark) == 0
    said = capsys.readouterr().out
    assert "[ccap] net pairs only in spef1: 1\n[ccap][only_spef1] a c\n[ccap] net pairs only in spef2: 1\n[ccap][only_spef2] b d\n" in said
    assert "cap: 2 rows" in said and "res: 3 rows" in said and "ccap: 1 rows, correlation 0.000000" in said
    caps = {r["net"]: r for r in spark.read.csv(f"{out}_caps.csv", header=True).collect()}
    assert (caps["a"]["C_tool1"], caps["a"]["ratio"], caps["a"]["delta"]) == ("5.0", "1.2", "1.0")
    assert spark.read.csv(f"{out}_res_max.csv", header=True).columns == ["net", "R_max_tool1", "R_max_tool2", "ratio", "delta"]
    back = datafiles.load_comparison(spark, f"{out}.cap", f"{out}.res", f"{out}.ccap")
    assert all(sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect())) for x, y in ((back.cap, c.cap), (back.res, c.res), (back.ccap, c.ccap)))
    assert cli.main(["--net-cap-data", f"{out}.cap"], spark) == 0 and "cap: 2 rows" in capsys.readouterr().out
    assert cli.main([], spark) == 1
    replaced = back.with_section(ccap=None)
    assert C.summary_text(replaced.summary()) == C.summary_text(c.summary())[:2]


def test_data_files_of_every_kind(spark, tmp_path):
    p = tmp_path / "res.data"
    p.write_text("net,driver,sink,r1,r2\na d s 1 2\na,d,t,3,4x\nbad row\n")
    assert sorted(map(tuple, datafiles.read_res_data(spark, str(p)).collect())) == [("a", "d", "s", 1.0, 2.0), ("a", "d", "t", 3.0, 4.0)]
    q = tmp_path / "cc.data"
    q.write_text("# pairs\na b 1 2\n\nb,c,3,4\nx y z w\n")
    assert sorted(map(tuple, datafiles.read_ccap_data(spark, str(q)).collect())) == [("a", "b", 1.0, 2.0), ("b", "c", 3.0, 4.0)]
    t = tmp_path / "t.data"
    t.write_text("#\na d s 1 2\na d s 1 5\na d t 1 7\n")
    assert sorted(map(tuple, datafiles.read_res_targets(spark, str(t)).collect())) == [("a", "s", 5.0), ("a", "t", 7.0)]
    t.write_text("b a 1 2\na b 1 3\n")
    assert [tuple(r) for r in datafiles.read_ccap_targets(spark, str(t)).collect()] == [("a", "b", 3.0)]


def test_views(spark, two):
    c = C.compare(*read_spefs(spark, two))
    nets = spark.createDataFrame([("a", ["s"]), ("b", ["s", "t"])], "net string, sinks array<string>")
    cap = views.view(c, "total_cap", CompareFilter(c_min=6.0), nets)["cap"]
    s = cap.stats.first()
    assert (s["n"], s["n_all"], s["corr"], s["corr_all"]) == (1, 2, 0.0, pytest.approx(-1.0)) and (s["lo"], s["hi"]) == (1.75, 7.25)
    p = cap.points.select("net", "delta", "side", "fanout", views.detail(cap.points).alias("text")).first()
    assert (p["net"], p["delta"], p["side"], p["fanout"]) == ("b", -5.0, "blue", 2)
    assert p["text"] == "net: b\nC_ref: 7.0000\nC_fit: 2.0000\ndelta: -5.0000\nratio: 0.2857\nfanout: 2"
    cc = views.view(c, "coupling_cap")["ccap"]
    assert cc.histogram.agg(F.sum("n")).first()[0] == 1
    assert "Cc% ref: 14.2857%" in cc.points.select(views.detail(cc.points)).first()[0]
    res = views.total_views(c)["res"].points
    assert res.where("net = 'a'").select(views.detail(res)).first()[0] == "net: a\ndriver: a:d\nsink: a:s\nR_ref: 3.0000\nR_fit: 6.0000\ndelta: 3.0000\nratio: 2.0000"
    with pytest.raises(ValueError):
        views.view(c, "other")


@pytest.mark.parametrize("v,hover,stat", [(0.0, "0", "0"), (0.00012345, "1.2345e-04", "1.2345e-04"), (0.5, "0.500000", "0.5000"), (-12.5, "-12.5000", "-12.5000"), (1234.4, "1234", "1234.4000"), (120000.0, "1.2e+05", "120000.0000"), (1234567.0, "1.235e+06", "1234567.0000")])
def test_number_formats(spark, v, hover, stat):
    assert tuple(spark.range(1).select(T.hover_number(F.lit(v)), T.stat_number(F.lit(v))).first()) == (hover, stat)


def test_registry(spark, two):
    r = Registry(spark)
    assert r.pair is None and r.add(two[0]) == "one" and r.pair == ("one", "one")
    assert r.add(two[0]) == "one_2" and r.add(two[1], "fit") == "fit" and r.pair == ("one", "one_2")
    with pytest.raises(ValueError):
        r.add(two[0], "fit")
    r.choose(fit="fit")
    assert r.pair == ("one", "fit")
    r.remove("one")
    assert r.pair == ("one_2", "fit") and list(r.add_all(["/missing.spef"])) == ["/missing.spef"]


def test_backmark_with_totals_and_pairs(spark, two, tmp_path):
    text = open(two[0]).read().replace("2 *1:d *2:d 1", "  2 *1:d *2:d 1 // pair").replace("3 *1:d *3:d 2", "3 *1:d *3:d 9 2")
    (tmp_path / "in.spef").write_text(text)
    cap = spark.createDataFrame([("a", 10.0)], "net string, value double")
    pairs = spark.createDataFrame([("b", "a", 4.0)], "net1 string, net2 string, value double")
    rewrite.write_blocks(rewrite.backmark_blocks(spark, str(tmp_path / "in.spef"), cap=cap, ccap=pairs), str(tmp_path / "out"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    # ground: the new total without the target of one pair and the old value of the other
    assert "*D_NET *1 10" in lines and "1 *1:d 4" in lines and "  2 *1:d *2:d 4 // pair" in lines and "3 *1:d *3:d 9 2" in lines
    assert [x for x in lines if not x.startswith(("*D_NET *1", "1 *1:d", "  2 *1", "2 *2:d *1"))] == [x for x in text.split("\n") if x and not x.startswith(("*D_NET *1", "1 *1:d", "  2 *1", "2 *2:d *1"))]


def e(*rows):
    return [{"n1": a, "n2": b, "r": r} for a, b, r in rows]


def dense(edges, source):
    nodes = sorted({n for x in edges for n in (x["n1"], x["n2"])} - {source})
    at, lap = {n: i for i, n in enumerate(nodes)}, np.zeros((len(nodes), len(nodes)))
    for x in edges:
        i, j, c = at.get(x["n1"]), at.get(x["n2"]), 1 / x["r"]
        for k in (i, j):
            if k is not None:
                lap[k, k] += c
        if i is not None and j is not None:
            lap[i, j] -= c
            lap[j, i] -= c
    return dict(zip(nodes, np.diag(np.linalg.inv(lap))))


def test_equivalent_resistance_against_dense_inverse():
    r = random.Random(3)
    for n in (2, 5, 12, 40):
        edges = [(f"n{i}", f"n{r.randrange(i)}", r.uniform(0.1, 5)) for i in range(1, n)]
        edges += [(f"n{r.randrange(n)}", f"n{r.randrange(n)}", r.uniform(0.1, 5)) for _ in range(n)]
        edges = e(*[x for x in edges if x[0] != x[1]])
        want = dense(edges, "n0")
        assert R.equivalent(edges, "n0", list(want)) == {k: pytest.approx(v) for k, v in want.items()}
    long = e(*[(f"n{i}", f"n{i + 1}", 1.0) for i in range(20_000)])
    assert R.equivalent(long, "n0", ["n20000", "n7"]) == {"n20000": pytest.approx(20_000), "n7": pytest.approx(7)}


def test_segment_scales_on_shared_segments():
    chain = e(("d", "x", 1.0), ("x", "s", 2.0))
    assert R.segment_scales("d", ["s"], chain, {"s": 2.0}, 2.0) == [("d", "x", 2.0), ("s", "x", 2.0)]
    tree = e(("d", "x", 1.0), ("x", "s", 2.0), ("x", "t", 4.0))
    got = {(a, b): v for a, b, v in R.segment_scales("d", ["s", "t"], tree, {"s": 2.0, "t": 1.0}, 1.5)}
    # s: 3 * 2 - 1 * 1.5 over 2; t: 5 * 1 - 1 * 1.5 over 4; the shared segment takes the average
    assert got == {("d", "x"): 1.5, ("s", "x"): pytest.approx(2.25), ("t", "x"): pytest.approx(0.875)}
    # the sink on the way shares its segment with the one behind it: 3 * 9 - 1 * 5 over 2
    assert R.segment_scales("d", ["s", "t"], e(("d", "s", 1.0), ("s", "t", 2.0)), {"s": 0.1, "t": 9.0}, 5.0) == [("d", "s", 5.0), ("s", "t", 11.0)]


@pytest.mark.parametrize("connected", [True, False])
def test_generated_files(spark, tmp_path, connected):
    generator.write_generated(spark, str(tmp_path / "g"), 300, 5, connected)
    lib = read_spef(spark, str(tmp_path / "g"), "g")
    nets = {r["net"]: r for r in lib.nets.collect()}
    assert len(nets) == 300 and lib.coupling_caps.count() == 299 and lib.name_map.count() == 300
    assert all(n["driver"].startswith("drv_") and 1 <= len(n["sinks"]) <= 4 for n in nets.values())
    rows = R.driver_sink_resistances(lib.nets).count()
    assert rows == (sum(len(n["sinks"]) for n in nets.values()) if connected else 0)
    generator.write_generated(spark, str(tmp_path / "h"), 300, 5, connected)
    text = lambda d: sorted(r["value"] for r in spark.read.text(str(tmp_path / d)).collect())
    assert text("g") == text("h")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a 1 2\nbad\nb 3 x\nc 5 6 7\n")
    q = stream_caps(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("caps").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("caps").collect())) == [("a", 1.0, 2.0), ("c", 5.0, 6.0)]


def test_files_read_each_for_itself(spark, two, tmp_path, capsys):
    (tmp_path / "bad.spef").write_text(open(two[1]).read() + "*D_NET lonely\n*CONN\n*END\n")
    bad, gone = str(tmp_path / "bad.spef"), str(tmp_path / "gone.spef")
    libraries, report = read_each(spark, [gone, bad, two[0], bad])
    assert list(libraries) == ["bad", "one", "bad_2"] and {r["net"] for r in libraries["bad"].nets.collect()} == {"a", "b", "d"}
    got = {r["lib_id"]: r for r in report.collect()}
    assert got["gone"]["error"].startswith("FileNotFoundError") and got["bad"]["error"] is None
    assert [(n, got[n]["nets"], got[n]["damaged"]) for n in ("bad", "one", "gone")] == [("bad", 3, 1), ("one", 4, 0), ("gone", None, None)]
    assert cli.main([two[0], bad, "--phases"], spark) == 0
    said = capsys.readouterr().out
    assert f"[spef] {bad}: 1 damaged blocks left out" in said and "cap: 2 rows" in said
    assert "[phase] header: " in said and "4 nets" in said and "capacitors" in said


def test_phases(spark, two):
    with phases() as log:
        a, b = read_spefs(spark, two)
        C.compare(a, b)
    rows = phase_table(spark, log).collect()
    assert [r["phase"] for r in rows] == ["header", "nets", "header", "nets", "resistances_dijkstra", "resistances_dijkstra", "cap", "res", "ccap"]
    nets = [r for r in rows if r["phase"] == "nets"]
    assert [(r["rows"], r["nets"], r["sinks"], r["resistors"], r["capacitors"]) for r in nets] == [(4, 4, 4, 6, 4), (3, 3, 3, 4, 4)]
    assert [r["names"] for r in rows if r["phase"] == "header"] == [4, 4] and rows[-2]["rows"] == 3 and all(r["seconds"] > 0 for r in rows)
    kept_before = len(log)
    read_spef(spark, two[0])
    assert len(log) == kept_before


def test_graph_searches_run_once_for_a_library(spark, two):
    a, b = (read_spef(spark, p, text=True) for p in two)
    with phases() as log:
        C.compare(a, b)
        C.compare(b, a)
        res = spark.createDataFrame([("b", "b:s", 6.0)], "net string, sink string, value double")
        rewrite.backmark_blocks(spark, two[0], res=res, lib=a).collect()
        C.compare(a, b, "equivalent")
    assert [x["phase"] for x in log].count("resistances_dijkstra") == 2 and [x["phase"] for x in log].count("resistances_equivalent") == 2
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan(a.resistances()) and "MapInPandas" not in plan(C.in_ohm(a.resistances(), a.libraries))
    assert "MapInPandas" in plan(R.driver_sink_resistances(a.nets))


@pytest.mark.parametrize("per_cell", [1, 7, 10_000])
def test_nearest_points_by_grid(spark, per_cell):
    r = random.Random(per_cell)
    points = [(f"p{i}", r.choice([round(r.gauss(0, 1), 2), r.uniform(0, 90)]), round(r.gauss(0, 1), 2)) for i in range(400)]
    points += [("tie1", 3.0, 3.0), ("tie0", 3.0, 1.0), ("tie2", 3.0, 3.0), ("null", None, 1.0), ("nan", float("nan"), 1.0), ("inf", 1.0, float("inf"))]
    g = nearest.grid(spark.createDataFrame(points, "net string, c1 double, c2 double"), "c1", "c2", ["net"], per_cell)
    whole = points[:-3]
    for at in [(3.0, 2.0), (0.0, 0.0), (-50.0, 4.0), (45.5, 100.0), (r.uniform(0, 90), r.gauss(0, 1))]:
        for radius in (None, 0.3, 60.0):
            near = min(((x - at[0]) ** 2 + (y - at[1]) ** 2, n) for n, x, y in whole)
            got = [(x["d2"], x["net"]) for x in g.nearest(at, radius).collect()]
            assert got == ([near] if radius is None or near[0] <= radius * radius else [])
    if per_cell == 7:
        assert g.cells > 5 and g.around((0.0, 0.0), 0).count() < 200
        scan = g.around((80.0, 0.0), 1)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(gx" in scan and "GreaterThanOrEqual(gy" in scan
    assert nearest.grid(spark.createDataFrame([], "net string, c1 double, c2 double"), "c1", "c2", ["net"]).nearest((0.0, 0.0)).count() == 0
    same = nearest.grid(spark.createDataFrame([("b", 1.0, 1.0), ("a", 1.0, 1.0)], "net string, c1 double, c2 double"), "c1", "c2", ["net"], 1)
    assert same.nearest((5.0, 5.0)).first()["net"] == "a"
