"""What queries leave on disk, and what they need of it."""

import re
import tempfile
import time
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from netohm.operators import rewrite
from netohm.plans import queries as Q
from netohm.sources import spef
from netohm.sources.shared import kept, passing, scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture
def shared(spark, tmp_path, monkeypatch):
    """Folders of scratch() that hold parts by now, by their names; those of before are left out."""
    monkeypatch.setattr(tempfile, "tempdir", str(tmp_path))
    at = Path(urlparse(scratch(spark, "probe")).path).parent
    top = tmp_path if tmp_path in at.parents else at  # below spark.checkpoint.dir, where that is set
    before = set(top.rglob("netohm-*"))

    def folders():
        found = [p for p in top.rglob("netohm-*-*") if p not in before and any(p.glob("part-*"))]
        names = {re.sub(r"^netohm-[0-9a-f]{32}-", "", p.name): p for p in found}
        assert len(names) == len(found)
        return names

    return folders


def shuffles(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {str(blocks.apply(i)) for i in range(blocks.size()) if "shuffle" in str(blocks.apply(i))}


@pytest.mark.parametrize("name", ["backmark_chain", "backmark_totals_and_pairs", "backmark_ccap", "backmark_res", "backmark_cap", "shuffle_invariance"])
def test_only_the_last_file_and_its_tables_stay(spark, shared, name):
    assert Q.QUERIES[name](spark, SF).count() > 0
    assert sorted(shared()) == sorted(["header", "nets", "shuffled" if name == "shuffle_invariance" else "backmarked"])


@pytest.mark.parametrize("name", ["spef_roundtrip_pins", "repeated_nets", "damaged_blocks"])
def test_files_are_packed_and_their_lines_not_kept(spark, shared, name):
    assert Q.QUERIES[name](spark, SF).count() > 0
    assert sorted(shared()) == ["header", "nets", "spef"]
    parts = list(shared()["spef"].glob("part-*"))
    text = sum(len(r["block"].encode()) for r in spef.read_blocks(spark, str(shared()["spef"]), "x").select("block").collect())
    assert all(p.name.endswith(".gz") for p in parts) and sum(p.stat().st_size for p in parts) < text / 3


def test_tables_leave_no_shuffle_files(spark, shared):
    before = shuffles(spark)
    assert kept(spark.range(1000).repartition(3).groupBy(F.col("id") % 7).count(), "t").count() == 7
    ends = time.time() + 20
    while shuffles(spark) - before and time.time() < ends:  # they are deleted in the background
        time.sleep(0.2)
    # those of the count above, which is no write, may stay: one row for each of its tasks
    assert len([x for x in shuffles(spark) - before if x.endswith(".data")]) <= 1


def test_passing_keeps_the_last_for_the_outer_one(spark, shared):
    with passing(spark):
        with passing(spark, but_last=True):
            a, b = kept(spark.range(3), "a"), kept(spark.range(4), "b")
            assert sorted(shared()) == ["a", "b"] and a.count() == 3
        assert sorted(shared()) == ["b"] and b.count() == 4
        scratch(spark, "never written")
    assert sorted(shared()) == []
    with pytest.raises(ValueError), passing(spark):
        kept(spark.range(3), "c")
        raise ValueError
    assert sorted(shared()) == []


def test_shuffle_with_id_0_goes_without_a_join(spark, tmp_path):
    text = "*NAME_MAP\n" + "".join(f"*{i} n{i}\n" for i in range(5)) + "".join(f"*D_NET *{i} 1.5\n*CONN\n*I *{i}:x O\n*CAP\n1 *{i}:x *{(i + 1) % 5}:y 2\n2 *{i}:x *00:y 2\n*END\n" for i in range(5))
    (tmp_path / "a.spef").write_text(text)
    blocks, in_order = rewrite.shuffle_blocks(spark, str(tmp_path / "a.spef"), 3)
    assert in_order
    new = "".join(r["new"] for r in blocks.orderBy("pos").collect())
    old_ids, new_ids = re.findall(r"\*([0-9]+)", text), re.findall(r"\*([0-9]+)", new)
    to = dict(zip(old_ids, new_ids))
    assert new_ids == [to[x] for x in old_ids] and to.pop("00") == "00"
    assert sorted(to) == sorted(to.values()) == list("01234") and all(k != v for k, v in to.items())


def test_names_meet_packs_of_blocks(spark, tmp_path, monkeypatch):
    names = "".join(f"*{i} net{i}/x[{i}]\n" for i in range(40)) + "*a other\n"
    nets = "".join(f"*D_NET *{i} {i}.5\n*CONN\n*I *{i}:d O\n*I *{i}:s I\n*CAP\n1 *{i}:s *{(i * 7) % 40}:s 2\n*RES\n1 *{i}:d *{i}:s 3\n*END\n" for i in range(40))
    (tmp_path / "a.spef").write_text(f"*C_UNIT 1 PF\n*NAME_MAP\n{names}{nets}*D_NET *a 2\n*END\n*D_NET *77\n*END\n*D_NET *99 1 \n*END")
    path = str(tmp_path / "a.spef")
    _, found = spef.parse_header(spef.read_header(spef.read_blocks(spark, path, "x", "header")))
    rows = lambda **how: sorted(map(str, spef.parse_blocks_of(spef.read_blocks(spark, path, "x", "nets"), found, text=True, **how).collect()))
    want = rows()
    assert len(want) == 43 and any("net7/x[7]:s" in x for x in want)
    for pack in (1, 500, 1 << 20):
        monkeypatch.setattr(spef, "PACK", pack)
        assert rows(broadcast_names=0) == want


def test_targets_of_repeated_nets_ids_and_foreign_nodes(spark, tmp_path):
    """Names that start with their net's, that don't, and that start with the marks of short names."""
    block = lambda net, total: f"*D_NET {net} {total}\n*CONN\n*I {net}:d O\n*I {net}x:s I\n*I =q:s I\n*CAP\n1 {net}:d 1\n*RES\n1 {net}:d {net}x:s 2\n2 {net}:d =q:s 4\n*END\n"
    (tmp_path / "a.spef").write_text("*NAME_MAP\n*1 n\n" + block("*1", 3) + block("-m", 5))
    res = spark.createDataFrame([("*1", "nx:s", 1.0), ("*1", "nx:s", 6.0), ("n", "=q:s", 2.0), ("-m", "-mx:s", 1.0), ("ghost", "g:s", 1.0)], "net string, sink string, value double").coalesce(1)
    new = "".join(r["new"] for r in rewrite.backmark_blocks(spark, str(tmp_path / "a.spef"), res=res).orderBy("pos").collect())
    wires = [x.split() for x in new.split("\n") if re.match(r"\d ", x) and len(x.split()) == 4]
    # *1x is an id of its own that no name map knows, so that sink stays as it is written
    assert [w[1:] for w in wires] == [["*1:d", "*1x:s", wires[0][3]], ["*1:d", "=q:s", "2"], ["-m:d", "-mx:s", "1"], ["-m:d", "=q:s", wires[3][3]]]
