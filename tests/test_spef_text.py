"""SPEF text: ranges of bytes, the parser of whole buffers against one of lines, node names, rewriting against one of lines, permuted ids."""

import io
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netohm.operators import rewrite
from netohm.operators.coupling import resolve_coupling
from netohm.operators.rewrite import Cycle
from netohm.plans import generator
from netohm.sources import spef, spef_source
from netohm.sources.spef import parse_header, read_blocks, read_header, read_spef
from netohm.sources.tokens import NET_COLUMNS, Names, number, parse_blocks, parse_header_text

ROLES = {("*I", "O"): "driver", ("*I", "I"): "sink", ("*I", "B"): "driver", ("*P", "O"): "sink", ("*P", "I"): "driver", ("*P", "B"): "driver"}


def words(line):
    return re.findall(r"[^ \t\r]+", line.split("//", 1)[0])


def parse_lines(text, names):
    """A block by its lines, one after the other; None without a total."""

    def whole(n, plain=True):
        if n[:1] == "*":
            base, colon, tail = n.partition(":")
            n = names.get(base, base) + colon + tail
        return n.replace("\\[", "[").replace("\\]", "]") if plain else n

    lines = text.split("\n")
    head = words(lines[0])
    if len(head) < 3:
        return None
    section, driver, sinks, wires = "", "", [], {"*RES": [], "*CAP": []}
    for t in map(words, lines[1:]):
        if not t:
            continue
        if t[0] == "*END":
            break
        if t[0] in ("*CONN", "*CAP", "*RES"):
            section = t[0]
        elif t[0] in ("*I", "*P"):
            role = ROLES.get((t[0], next((x[0] for x in t[2:6] if x[0] in "OBI"), ""))) if len(t) >= 3 else None
            if role == "sink":
                sinks.append(whole(t[1]))
            elif role and not driver:
                driver = whole(t[1])
        elif len(t) >= 4 and section in wires and t[0][0] != "*":
            wires[section].append((whole(t[1]), whole(t[2]), number(t[3])))
    return whole(head[1], False), number(head[2]), driver, sinks, wires["*RES"], wires["*CAP"]


SOME = ["*CONN", "*CAP", "*RES", "*END", "*I", "*P", "*N", "*1:a", "*2", "*3:b[0]", "*99999:x", "nd\\[3\\]", "1", "2", "3.5", "1.5pF", "abc", "-2e-3", "+4", ".5", "5.", "O", "I", "B", "*C", "// x", "//", "x//y", "\t", "\r", "é", "ENDX", "*ENDX", "pF-2.5e1"]


def random_block(r):
    lines = [" ".join(r.choice(SOME) for _ in range(r.randint(0, 7))) for _ in range(r.randint(0, 14))]
    if r.random() < 0.8:
        lines = ["*CONN", "*I *1:d O", "*I *1:s I", "*CAP", "1 *1:s 2", "2 *1:s *2:x 1.5pF", *lines]
    return r.choice(["", " ", "\t "]) + r.choice(["*D_NET *7 1.5 // c", "*D_NET *12345 2", "*D_NET lonely", "*D_NET\t*2\t.5 x y"]) + "\n" + "\n".join(lines)


@pytest.mark.parametrize("seed", range(3))
def test_buffers_against_lines(seed):
    r = random.Random(seed)
    names = {f"*{i}": f"net_{i}" for i in range(1, 50)} | {"*2": "x\\[1\\]"}
    blocks = [random_block(r) for _ in range(1500)]
    held, columns = parse_blocks(pa.array([*blocks, None, ""]).slice(0, 1500), Names(pa.array(list(names)), pa.array(list(names.values()))))
    got = [[c if not isinstance(c, list) else [tuple(x.values()) if isinstance(x, dict) else x for x in c] for c in row] for row in zip(*(c.to_pylist() for c in columns))]
    want = [parse_lines(b, names) for b in blocks]
    plain = [row.pop() for row in got]
    assert plain == [":" not in w[0] and all(a.split(":")[0] == w[0] and b[:1] != "*" for a, b, _ in w[5]) for w in want if w is not None]
    assert held.tolist() == [w is not None for w in want]
    assert repr(got) == repr([list(w) for w in want if w is not None])
    assert [len(c) for c in parse_blocks(pa.array([], pa.string()), Names(pa.array([], pa.string()), pa.array([], pa.string())))[1]] == [0] * len(NET_COLUMNS)


def test_numbers_of_any_spelling():
    assert [number(x) for x in ("pF-2.5e1", "x", "1.5pF", ".5", "5.", "+4", "1e-3")] == [-25.0, 0.0, 1.5, 0.5, 5.0, 4.0, 0.001]


def test_header_text():
    h = parse_header_text('*1 early\n*C_UNIT 1 FF // c\n*NAME_MAP\n*1 a\\[0\\]\n*2 "b"\n  *3 c d\n*PORTS\n*9 lost\n*NAME_MAP\n*4 "')
    assert list(zip(h.ids.to_pylist(), h.names.to_pylist(), h.open_.to_pylist())) == [("*1", "early", None), ("*1", "a[0]", True), ("*2", "b", True), ("*3", "c", True), ("*4", '"', True)]
    assert h.units == [(1, "*C_UNIT", "1", "FF")] and h.state is True and parse_header_text("").state is None


def test_ranges_hold_every_byte_once(monkeypatch):
    r = random.Random(3)
    for _ in range(800):
        monkeypatch.setattr(spef_source, "CHUNK", r.choice([1, 3, 7, 50, 1000]))
        monkeypatch.setattr(spef_source, "PIECE", r.choice([5, 20, 1000]))
        some = ["*1 a", "*NAME_MAP", "", "x" * r.randint(0, 30), "*D_NET *1 2", " \t*D_NET *2 1", "*D_NETX 2", "a *D_NET b", "*END"]
        text = ("\n".join(r.choice(some) for _ in range(r.randint(0, 25))) + r.choice(["", "\n"])).encode()
        starts = [m.start() for m in re.finditer(rb"(?m)^[ \t]*\*D_NET(?=[ \t])", text)]
        first, step = starts[0] if starts else len(text), r.choice([1, 2, 5, 17, 60, 1000])
        rows = {p: [x for a in range(0, len(text), step) for x in spef_source.rows_of(io.BytesIO(text), a, min(a + step, len(text)), p)] for p in ("all", "header", "nets")}
        nets, head = sorted(x for x in rows["all"] if not x[1]), sorted(x for x in rows["all"] if x[1] and x[0] < first)
        assert [x[0] for x in nets] == starts and b"".join(x[2] for x in head + nets) == text and rows["nets"] == nets
        assert sorted(x for x in rows["header"] if x[1] and x[0] < first) == head and min((x[0] for x in rows["header"] if not x[1]), default=len(text)) == first


def test_header_over_several_ranges_and_one_scan_each(spark, tmp_path):
    names = "".join(f"*{i} name_{i}\n" for i in range(1, 400))
    nets = "".join(f"*D_NET *{i} {i}\n*CONN\n*I *{i}:d O\n*END\n" for i in range(1, 400))
    (tmp_path / "a.spef").write_text("*C_UNIT 1 FF\n*NAME_MAP\n" + names + "*PORTS\n*7 I\n" + nets)
    path = str(tmp_path / "a.spef")
    for split in (64, 1000, 1 << 20):
        libraries, known = parse_header(read_header(read_blocks(spark, path, "x", "header", split)))
        assert {(r["id"], r["name"]) for r in known.collect()} == {(f"*{i}", f"name_{i}") for i in range(1, 400)}
        assert libraries["x"] == ("NS", "FF", "OHM", "HENRY", 1.0, 1.0)
        assert read_blocks(spark, path, "x", "nets", split).count() == 399
        text = rewrite.header_text(spark, path, "x", "all").orderBy("pos").collect()
        assert "".join(r["block"] for r in text) == (tmp_path / "a.spef").read_text()
    assert max(len(r["block"]) for r in read_blocks(spark, path, "x", "header", 1000).collect()) <= 1100


def test_store_that_only_spark_reads(spark, tmp_path, monkeypatch):
    generator.write_generated(spark, str(tmp_path / "g"), 40, 5)
    key = lambda lib: sorted(map(str, lib.nets.drop("pos").collect()))
    want, names = key(read_spef(spark, f"file://{tmp_path}/g", "g")), sorted(map(tuple, read_spef(spark, str(tmp_path / "g"), "g").name_map.collect()))

    def unknown(path):
        raise pa.ArrowInvalid("Unrecognized filesystem type in URI")

    monkeypatch.setattr(spef.spef_source, "files_of", unknown)
    lib = read_spef(spark, f"file://{tmp_path}/g", "g")
    assert key(lib) == want and sorted(map(tuple, lib.name_map.collect())) == names


def test_damaged_blocks(spark, tmp_path):
    (tmp_path / "d.spef").write_text("*NAME_MAP\n*1 a\n*D_NET *1 2\n*END\n*D_NET lonely\n*CONN\n*D_NET *2 3\n")
    lib = read_spef(spark, str(tmp_path / "d.spef"))
    assert {r["net"] for r in lib.nets.collect()} == {"a", "*2"}
    assert [r["text"] for r in lib.damaged.collect()] == ["*D_NET lonely\n*CONN\n"]


# --- coupling ---


def three_ways(node, nets, names):
    base = node.split(":", 1)[0]
    return node if node in nets else base if base in nets else names.get(base) if names.get(base) in nets else None


@pytest.mark.parametrize("plain", [False, True])
def test_nodes_by_all_three_ways(spark, plain):
    r = random.Random(4)
    nets = ["a", "b", "c", "d"] + ([] if plain else ["e:1", "a:x"])
    names = {"*1": "a", "*2": "c", "*3": "gone", "c": "d"}
    nodes = ["a", "a:1", "a:x", "b:2", "e:1", "*1:z", "*2", "*3:y", "*4", "ghost", "c:c", "d"]
    right = [x for x in nodes if not (plain and x[0] == "*")]
    rows = [("l", n, [{"n1": f"{n}:p" if plain else r.choice([f"{n}:p", *nodes]), "n2": r.choice(right), "c": float(r.randint(1, 9))} for _ in range(25)]) for n in nets]
    df = spark.createDataFrame(rows, "lib_id string, net string, raw_ccaps array<struct<n1:string,n2:string,c:double>>")
    known = spark.createDataFrame([("l", k, v) for k, v in names.items()], "lib_id string, id string, name string")
    units = spark.createDataFrame([("l", "PF", 1.0)], "lib_id string, c_unit string, c_scale double")
    sums = {}
    for _, owner, entries in rows:
        for x in entries:
            a, b = three_ways(x["n1"], nets, names) or owner, three_ways(x["n2"], nets, names)
            if b is not None and a != b:
                key = (min(a, b), max(a, b))
                sums.setdefault(key, {})[owner] = sums.setdefault(key, {}).get(owner, 0) + x["c"]
    want = sorted((*k, v[min(v)]) for k, v in sums.items())
    got = resolve_coupling(df, units, known, plain).select("net1", "net2", "cap_pf")
    assert sorted(map(tuple, got.collect())) == want


def test_coupling_rows_are_dealt_twice(spark, tmp_path):
    generator.write_generated(spark, str(tmp_path / "g"), 200, 5)
    lib = read_spef(spark, str(tmp_path / "g"), "g")
    assert lib.plain
    plan = lib.coupling_caps
    lines = plan._jdf.queryExecution().executedPlan().toString().split("\n")
    assert sum("Exchange hashpartitioning" in x and "net1" in x for x in lines) == 1
    assert sum("Exchange hashpartitioning" in x and ("__base" in x or "SHUFFLE_MERGE" in x) for x in lines) <= 2  # rows and names


# --- rewriting ---


def test_backmark_keeps_all_other_text(spark, tmp_path):
    text = "*C_UNIT 1 PF\n\n*NAME_MAP\n*1 a\n*2 b\n\n \t*D_NET *1 4 // note\n*CONN\n*I *1:d O\n*CAP\n\n1 *1:d 1\n  2\t*1:d  *2:d\t3 // tail\n*9 x y\nx *1:d 3\n*RES\n1 *1:d *1:s 2\n*END\n*CAP\n1 *1:d 9\n*D_NET bad\n*D_NET *2 1\n*CAP\n1 *2:d 0\n*END"
    (tmp_path / "a.spef").write_text(text)
    target = lambda *r: spark.createDataFrame(list(r), "net string, value double")
    lines = rewrite.backmark(spark, str(tmp_path / "a.spef"), cap=target(("*1", 9.0), ("a", 7.0), ("a", 8.0), ("ghost", 1.0)).coalesce(1)).orderBy("pos", "ln").collect()
    assert [r["raw"] for r in lines] == text.split("\n")
    new = {r["raw"]: r["line"] for r in lines if r["raw"] != r["line"]}
    assert new == {" \t*D_NET *1 4 // note": "*D_NET *1 8", "1 *1:d 1": "1 *1:d 2", "  2\t*1:d  *2:d\t3 // tail": "  2 *1:d *2:d 6 // tail"}
    rewrite.write_blocks(rewrite.backmark_blocks(spark, str(tmp_path / "a.spef")), str(tmp_path / "same"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "same").glob("part-*"))) == text + "\n"


def test_backmark_of_a_chain_and_of_repeated_nets(spark, tmp_path):
    chain = "*D_NET *1 4\n*CONN\n*I *1:d O\n*I *1:s I\n*I *1:t I\n*CAP\n1 *1:d 1\n2 *1:s *2:d 1\n*RES\n1 *1:d *1:s 2\n2 *1:t *1:s 4\n*END\n"
    again = "*D_NET *1 6\n*CONN\n*I *1:u I\n*CAP\n1 *1:u 3\n2 *1:u *2:d 3\n*RES\n1 *1:t *1:u 1\n*END\n"
    (tmp_path / "a.spef").write_text("*NAME_MAP\n*1 a\n*2 b\n" + chain + "*D_NET *2 1\n*END\n" + again)
    res = spark.createDataFrame([("a", "a:s", 4.0), ("a", "a:t", 12.0), ("a", "a:u", 14.0)], "net string, sink string, value double")
    cap = spark.createDataFrame([("a", 12.0)], "net string, value double")
    ccap = spark.createDataFrame([("b", "a", 8.0)], "net1 string, net2 string, value double")
    rewrite.write_blocks(rewrite.backmark_blocks(spark, str(tmp_path / "a.spef"), cap, res, ccap), str(tmp_path / "out"))
    lib = read_spef(spark, str(tmp_path / "out"), "o")
    a = lib.nets.where("net = 'a'").first()
    # all ratios are 2, so every segment doubles; pairs of both blocks share the target 8 as 2 and 6, and ground takes the other 4 as 1 and 3
    assert a["total_cap"] == 12.0 and [e["r"] for e in a["edges"]] == [4.0, 8.0, 2.0] and [c["c"] for c in a["raw_ccaps"]] == [2.0, 6.0]
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert "1 *1:d 1\n" in text and "1 *1:u 3\n" in text and text.count("*D_NET *1 12\n") == 2


# --- ids ---


@pytest.mark.parametrize("n", [2, 3, 17, 4000])
def test_cycles_move_every_id(n):
    r = np.random.default_rng(n)
    ids = np.unique(r.choice(10**12 if n == 17 else 9 * n, n, replace=False) + 1)
    buckets, maps = [], []
    for b in np.unique((ids - 1) // 32768 + 1):
        bits = np.zeros(32768, bool)
        bits[(ids[(ids - 1) // 32768 + 1 == b] - 1) % 32768] = True
        buckets.append(b)
        maps.append(np.packbits(bits, bitorder="little").tobytes())
    order = r.permutation(len(buckets))
    c = Cycle(np.array(buckets)[order], [maps[i] for i in order], 5)
    assert np.array_equal(c.select(c.rank(ids)), ids) and c.n == n
    to = c.moved(ids)
    assert np.array_equal(np.sort(to), ids) and not (to == ids).any()
    if n == 4000:  # in no obvious order, and by the key
        assert len(np.unique(np.diff(to))) > 1000 and not np.array_equal(to, Cycle(np.array(buckets), maps, 6).moved(ids))
    other = np.setdiff1d(np.arange(1, 200), ids)
    assert np.array_equal(c.moved(other), other) and c.rank(np.array([-1]))[0] == -1


@pytest.mark.parametrize("bitmaps", [0, 100])
@pytest.mark.parametrize("odd", [False, True])
def test_shuffle_of_text(spark, tmp_path, bitmaps, odd):
    head = "*NAME_MAP\n*1 a\n*2 b *3\n*30000000 c\n*8 unused // *2\n"
    text = head + "".join(f"*D_NET *{i} 1.5\n*CONN\n*I *{i}:x O\n*CAP\n1 *{i}:x *8:y 2\n\n2 **{j} *0{j} 1\n*END\n" for i, j in ((1, 2), (2, 30000000), (30000000, 1), ("07" if odd else 7, 5)))
    (tmp_path / "a.spef").write_text(text)
    blocks, in_order = rewrite.shuffle_blocks(spark, str(tmp_path / "a.spef"), 3, bitmaps)
    assert in_order == (bitmaps > 0 and not odd)
    rewrite.write_blocks(blocks, str(tmp_path / "out"), in_order)
    new = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    used = {"1", "2", "30000000", "07" if odd else "7"}
    old_ids, new_ids = re.findall(r"\*([0-9]+)", text), re.findall(r"\*([0-9]+)", new)
    to = dict(zip(old_ids, new_ids))
    assert re.sub(r"\*[0-9]+", "*", new) == re.sub(r"\*[0-9]+", "*", text) and new_ids == [to[x] for x in old_ids]
    assert all(to[x] != x for x in used) and {to[x] for x in used} == used and all(to[x] == x for x in to if x not in used)


def test_shuffle_of_less_than_two_ids(spark, tmp_path):
    (tmp_path / "a.spef").write_text("*NAME_MAP\n*1 a\n*D_NET *1 2\n*END\n")
    lines = rewrite.shuffle_ids(spark, str(tmp_path / "a.spef"), 3)
    assert lines.where(rewrite.changed(lines)).count() == 0 and lines.agg(F.count("*")).first()[0] == 4
