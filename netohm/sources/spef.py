"""SPEF files as DataFrames. Files are read in ranges of bytes that hold whole nets, the header in pieces cut at lines.

nets: lib_id, pos, net, total_cap, total_cap_pf, driver, sinks, edges (n1, n2, r), raw_ccaps (n1, n2, c)

Header text is read once for units and name map, net blocks once for nets: they are parsed as Arrow batches, a buffer of text
at a time; ids become names there, and the result is kept as a table in the shared folder. Stores that only Spark reaches
are read by its text source instead; there a file's header is one record of at most 2 GB.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netohm.functions import text as T
from netohm.functions import units as U
from netohm.sources import spef_source
from netohm.sources.shared import kept, measured, ship
from netohm.sources.tokens import NET_COLUMNS, Names, number, parse_blocks, parse_header_text

#: Name maps up to this many names (some 100 bytes each) go to all tasks.
BROADCAST_NAMES = 300_000
POS = "struct<file:string,at:bigint,row:bigint,k:int>"
DEFAULT_UNITS = ("NS", "PF", "OHM", "HENRY")
LIB_KEYS = ("t_unit", "c_unit", "r_unit", "l_unit", "c_scale", "r_scale")


@dataclass(frozen=True)
class SpefLibrary:
    """One parsed library: a row of units, the name map, nets and coupling capacitors in pF.

    blocks has a row for each *D_NET block, before nets that are listed twice merge: pos, NET_COLUMNS and, where read_spef kept it, its
    text; net is null for damaged ones.
    """

    libraries: DataFrame
    name_map: DataFrame
    nets: DataFrame
    coupling_caps: DataFrame | None = None
    blocks: DataFrame | None = None
    #: As operators.coupling.resolve_ends has it.
    plain: bool = False
    _resistances: dict[str, DataFrame] = field(default_factory=dict, repr=False, compare=False)

    def resistances(self, method: str = "dijkstra") -> DataFrame:
        """driver_sink_resistances() of the nets, worked out once for each method and kept as a table: all that use this library share it."""
        if method not in self._resistances:
            from netohm.operators.resistance import driver_sink_resistances

            self._resistances[method] = kept(driver_sink_resistances(self.nets, method), f"resistances_{method}")
        return self._resistances[method]

    @property
    def damaged(self) -> DataFrame:
        """lib_id, pos and text (its first 200 characters) of the blocks without a net and a total, which nets leaves out."""
        return self.blocks.where("net is null").select("lib_id", "pos", F.substring("block", 1, 200).alias("text"))


def collect_spef_paths(inputs: list[str]) -> list[str]:
    """Files, and the .spef files of folders by name, not of their subfolders; missing ones are dropped."""
    out: list[str] = []
    for x in inputs:
        if os.path.isdir(x):
            out += sorted(os.path.join(x, f) for f in os.listdir(x) if f.lower().endswith(".spef"))
        elif os.path.isfile(x):
            out.append(x)
    return out


def unique_name(base: str, taken: set[str]) -> str:
    """base, or base_2, base_3 and so on if that is taken."""
    name, k = base, 2
    while name in taken:
        name, k = f"{base}_{k}", k + 1
    return name


def _by_text(spark: SparkSession, path: str) -> DataFrame:
    """Rows as the data source has them, by Spark's own reader; pos of a file's header is its least."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    raw = spark.read.option("lineSep", "\n*D_NET ").text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("at"), row.alias("row"))
    parts = raw.select("file", "at", "row", F.posexplode(F.split(F.regexp_replace("value", r"(?m)^[ \t]*\*D_NET(?=[ \t])", "\u0001"), "\u0001")).alias("k", "block"))
    # the first record of a file is header text up to its first mark; others start behind a mark that the reader took
    opens = (F.col("at") == 0) & (F.col("k") == 0) & (F.col("block").rlike(r'^\s*(\*[A-Za-z]|//|")') | ~F.col("block").rlike(r"^[ \t]*\S+[ \t]+\S"))
    return parts.select("file", "at", "row", "k", opens.alias("is_header"), F.when(opens, F.col("block")).otherwise(F.concat(F.lit("*D_NET "), F.ltrim("block"))).alias("block"))


def read_blocks(spark: SparkSession, path: str, lib_id: str, part: str = "all", split: int | None = None) -> DataFrame:
    """lib_id, pos, is_header, block: pieces of header text and the text of each net, from its *D_NET line on; by pos in file order.

    part: all, nets, or header (which adds an empty row at the first net of each range). Header text behind a file's first net is what
    a range holds of a net that began before it: first_nets() tells.
    """
    ship(spark)
    try:
        spef_source.files_of(path)
    except (pa.ArrowInvalid, NotImplementedError) as e:  # no such scheme in pyarrow
        if "://" not in path:
            raise
        rows = _by_text(spark, path)
        rows = rows.where("is_header" if part == "header" else "not is_header") if part != "all" else rows
    else:
        spark.dataSource.register(spef_source.SpefSource)
        source = spark.read.format(spef_source.NAME).option("path", path).option("part", part).option("parallelism", spark.sparkContext.defaultParallelism)
        rows = (source.option("split", split) if split else source).load().select("*", F.lit(0).cast("long").alias("row"), F.lit(0).alias("k"))
    return rows.select(F.lit(lib_id).alias("lib_id"), F.struct("file", "at", "row", "k").alias("pos"), "is_header", "block")


def first_nets(blocks: DataFrame) -> DataFrame:
    """file and the place of its first net: a row for each file."""
    return blocks.where("not is_header").groupBy(F.col("pos.file").alias("file")).agg(F.min("pos.at").alias("first_net"))


HEADER_ROW = f"lib_id string, pos {POS[:-1]},ln:int>, kind string, open boolean, a string, b string, c string"


def _header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of header text: name (id, value; open is null for a section that an earlier piece has to open), unit, state (at the end of the piece), and net (where one starts)."""
    for batch in batches:
        for lib, pos, is_header, text in zip(*(batch.column(c).to_pylist() for c in ("lib_id", "pos", "is_header", "block"))):
            if is_header:
                h = parse_header_text(text)
                n, units = len(h.ids), list(zip(*h.units)) if h.units else ((),) * 4
                kinds, lines = ["unit"] * len(units[0]) + ["state"], np.append(h.line, [*units[0], 0])
                text_ = lambda x: pa.array([*x, None], pa.string())
                a, b, c = pa.concat_arrays([h.ids, text_(units[1])]), pa.concat_arrays([h.names, text_(units[2])]), pa.concat_arrays([pa.nulls(n, pa.string()), text_(units[3])])
                opens = pa.concat_arrays([h.open_, pa.array([*[None] * len(units[0]), h.state], pa.bool_())])
            else:
                n, kinds, lines, opens, a, b, c = 0, ["net"], np.zeros(1), pa.nulls(1, pa.bool_()), *(pa.nulls(1, pa.string()),) * 3
            m = n + len(kinds)
            same = [pa.repeat(pa.scalar(pos[f], t), m) for f, t in (("file", pa.string()), ("at", pa.int64()), ("row", pa.int64()), ("k", pa.int32()))]
            place = pa.StructArray.from_arrays([*same, pa.array(lines.astype(np.int32))], names=["file", "at", "row", "k", "ln"])
            flat = [pa.repeat(pa.scalar(lib, pa.string()), m), place, pa.concat_arrays([pa.repeat("name", n), pa.array(kinds)]), opens, a, b, c]
            yield pa.RecordBatch.from_arrays(flat, names=["lib_id", "pos", "kind", "open", "a", "b", "c"])


def read_header(blocks: DataFrame) -> DataFrame:
    """Rows of header text, as _header gives them, and of the first nets behind it."""
    return blocks.select("lib_id", "pos", "is_header", "block").mapInArrow(_header, HEADER_ROW)


def parse_header(rows: DataFrame) -> tuple[dict[str, tuple], DataFrame]:
    """(LIB_KEYS of each library, name_map) of header rows. Every *NAME_MAP section counts up to its first line that is no entry; of equal ids the first.

    The driver sees all rows but those of names: some for each range of bytes and piece of header text.
    """
    spark, place = rows.sparkSession, ["lib_id", "file", "at", "row", "k"]
    rest = rows.where("kind <> 'name'").select("lib_id", "pos.*", "kind", "open", "a", "b", "c").collect()
    first_net: dict[tuple, int] = {}
    for r in rest:
        if r["kind"] == "net":
            first_net[r["lib_id"], r["file"]] = min(r["at"], first_net.get((r["lib_id"], r["file"]), r["at"]))
    rest = sorted((r for r in rest if r["kind"] != "net" and r["at"] < first_net.get((r["lib_id"], r["file"]), 1 << 62)), key=lambda r: tuple(r[c] for c in (*place, "ln")))
    units: dict[str, dict] = {}
    pieces, state = [], {}
    for r in rest:
        of = units.setdefault(r["lib_id"], {})
        if r["kind"] == "unit":
            of[r["a"]] = (r["b"], r["c"])
        else:
            pieces.append((*(r[c] for c in place), state.get(r["lib_id"], False)))
            if r["open"] is not None:
                state[r["lib_id"]] = r["open"]
    libraries = {lib: (*(u.get(f"*{k}_UNIT", ("1", d))[1] for k, d in zip("TCRL", DEFAULT_UNITS)), *(number(u.get(f"*{k}_UNIT", ("1",))[0]) or 1.0 for k in "CR")) for lib, u in units.items()}
    names = rows.where("kind = 'name'").select("lib_id", "pos", "open", F.col("a").alias("id"), F.col("b").alias("name"))
    if len(pieces) == 1:  # ids of one piece differ
        is_it = [F.col(f"pos.{c}") == x for c, x in zip(place[1:], pieces[0][1:5])]
        return libraries, names.where(reduce(Column.__and__, is_it, F.col("open"))).select("lib_id", "id", "name")
    held = F.broadcast(spark.createDataFrame(pieces, "lib_id string, file string, at long, row long, k int, inherited boolean"))  # a row for each piece
    names = names.select("lib_id", "pos.file", "pos.at", "pos.row", "pos.k", "pos", "open", "id", "name").join(held, place).where(F.coalesce("open", "inherited"))
    return libraries, names.groupBy("lib_id", "id").agg(F.min_by("name", "pos").alias("name"))


def resolve(df: DataFrame, name_map: DataFrame, *columns: str, escaped: bool = True) -> DataFrame:
    """Replace *id[:suffix] by name[:suffix]; unknown ids stay. Escaped brackets lose their mark."""
    for c in columns:
        names = name_map.select("lib_id", F.col("id").alias("__id"), F.col("name").alias("__name"))
        left = df.withColumn("__id", F.when(F.col(c).startswith("*"), T.pin_base(F.col(c))))
        joined = left.join(names, ["lib_id", "__id"], "left")
        tail = F.substring(F.col(c), F.length("__id") + 1, F.length(c))
        done = F.coalesce(F.concat("__name", tail), F.col(c))
        df = joined.withColumn(c, T.unescape(done) if escaped else done).drop("__id", "__name")
    return df


BLOCK = "net string, total_cap double, driver string, sinks array<string>, edges array<struct<n1:string,n2:string,r:double>>, raw_ccaps array<struct<n1:string,n2:string,c:double>>, plain boolean"


#: Bytes of block text that meet their names together.
PACK = 1 << 20
_IDS = re.compile(rb"\*\d[^\s:]*")
_NET_IDS = re.compile(rb"(?m)^\s*\*D_NET[ \t]+(\*[^\s:]+)")


def _packed(body: bool):
    """Blocks in packs of some PACK bytes, each a row: key (its first pos), and its blocks as compressed Arrow data, or else the ids that they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = max(1, b.num_rows * PACK // max(b.column("block").nbytes, 1))
            for a in range(0, b.num_rows, size):
                part = b.slice(a, size)
                if body:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_batch(part)
                    value = pa.array([sink.getvalue().to_pybytes()], pa.binary())
                else:
                    text = "\n".join(part.column("block").to_pylist()).encode()
                    value = pa.array([[x.decode() for x in {*_IDS.findall(text), *_NET_IDS.findall(text)}]], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column("lib_id").slice(0, 1), part.column("pos").slice(0, 1), value], names=["lib_id", "key", "body" if body else "ids"])

    return run


def _parsed(b: pa.RecordBatch, known: Names, text: bool) -> pa.RecordBatch:
    held, columns = parse_blocks(b.column("block"), known)
    if not held.all():  # damaged blocks get nulls
        at = pa.array(np.where(held, np.cumsum(held) - 1, -1), mask=~held)
        columns = [c.take(at) for c in columns]
    block = b.column("block") if text else pc.if_else(pa.array(held), pa.scalar(None, pa.string()), b.column("block"))
    return pa.RecordBatch.from_arrays([b.column("lib_id"), b.column("pos"), *columns, block], names=["lib_id", "pos", *NET_COLUMNS, "block"])


def _parse(names, text: bool):
    """names: a broadcast name map, or None where rows are packs with their own as the column names. text: keep the text of blocks that can be parsed, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if names is not None:
                yield _parsed(b, names.value, text)
                continue
            for i in range(b.num_rows):
                own = b.column("names").slice(i, 1).flatten()
                for part in pa.ipc.open_stream(b.column("body")[i].as_buffer()):
                    yield _parsed(part, Names(own.field("id"), own.field("name")), text)

    return run


def parse_blocks_of(blocks: DataFrame, name_map: DataFrame, broadcast_names: int = BROADCAST_NAMES, text: bool = False, most_names: int | None = None) -> DataFrame:
    """A row for each net block, as SpefLibrary.blocks has them, kept as a table.

    Up to broadcast_names names go to all tasks; more of them meet packs of blocks in a join on the ids that each pack holds. For that blocks are
    read twice, so they have to come in the same order each time, as those of read_blocks() do. most_names, if known, is a bound of the names.
    """
    spark = blocks.sparkSession
    rows, names = blocks.where("not is_header").select("lib_id", "pos", "block"), None
    listed = name_map.select("id", "name")
    listed = (listed if (most_names or broadcast_names + 1) <= broadcast_names else listed.limit(broadcast_names + 1)).toArrow().combine_chunks()
    if listed.num_rows <= broadcast_names:
        names = spark.sparkContext.broadcast(Names(*(pa.concat_arrays(listed.column(c).chunks) if listed.num_rows else pa.array([], pa.string()) for c in ("id", "name"))))
    else:
        key = f"lib_id string, key {POS}"
        ids = rows.mapInArrow(_packed(False), f"{key}, ids array<string>").select("lib_id", "key", F.explode("ids").alias("id"))
        met = ids.join(name_map, ["lib_id", "id"]).groupBy("lib_id", "key").agg(F.collect_list(F.struct("id", "name")).alias("names"))
        rows = rows.mapInArrow(_packed(True), f"{key}, body binary").join(met, ["lib_id", "key"], "left")
    found = rows.mapInArrow(_parse(names, text), f"lib_id string, pos {POS}, {BLOCK}, block string")
    total = lambda c: F.sum(F.size(c).cast("long"))
    return measured(found, "nets", nets=F.count("net"), sinks=total("sinks"), resistors=total("edges"), capacitors=total("raw_ccaps"))[0]


def merge_nets(blocks: DataFrame, libraries: dict[str, tuple]) -> tuple[DataFrame, bool]:
    """(nets, whether all are plain) of parsed blocks. Nets listed twice merge: the last total, the first driver, all sinks and resistors in file order."""
    named = blocks.where("net is not null").drop("block", "plain")
    times = blocks.where("net is not null").groupBy("lib_id", "net").agg(F.count("*").alias("n"), F.bool_and("plain").alias("plain"))
    most = times.agg(F.max("n").alias("n"), F.bool_and("plain").alias("plain")).first()
    nets = named
    if (most["n"] or 0) > 1:
        twice = times.where("n > 1").select("lib_id", "net")
        again = named.join(twice, ["lib_id", "net"], "left_semi").groupBy("lib_id", "net").agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in named.columns if c not in ("lib_id", "pos", "net")]))).alias("x"))
        flat = lambda c: F.flatten(F.transform("x", lambda r: r[c])).alias(c)
        merged = again.select(
            "lib_id", F.get("x", F.lit(0))["pos"].alias("pos"), "net", F.element_at("x", -1)["total_cap"].alias("total_cap"),
            F.coalesce(F.get(F.filter(F.transform("x", lambda r: r["driver"]), lambda d: d != ""), F.lit(0)), F.lit("")).alias("driver"), flat("sinks"), flat("edges"), flat("raw_ccaps"),
        )
        nets = named.join(twice, ["lib_id", "net"], "left_anti").select(merged.columns).unionByName(merged)
    total = F.lit(None).cast("double")
    for lib, u in libraries.items():
        unit, scale = u[LIB_KEYS.index("c_unit")], u[LIB_KEYS.index("c_scale")]
        total = F.when(F.col("lib_id") == lib, U.convert_capacitance(F.col("total_cap") * scale, F.lit(unit))).otherwise(total)
    return nets.select("lib_id", "pos", "net", "total_cap", total.alias("total_cap_pf"), "driver", "sinks", "edges", "raw_ccaps"), most["plain"] is not False


def read_spef(spark: SparkSession, path: str, lib_id: str | None = None, text: bool = False) -> SpefLibrary:
    """A SPEF file, or a folder of part files, as a library with resolved coupling. It is parsed here, once. text: keep the text of its blocks."""
    from netohm.operators.coupling import resolve_coupling

    lib_id = lib_id or os.path.splitext(os.path.basename(path))[0]
    header, figures = measured(read_header(read_blocks(spark, path, lib_id, "header")), "header", names=F.count_if(F.col("kind") == "name"))
    found, name_map = parse_header(header)
    units = {lib_id: found.get(lib_id, (*DEFAULT_UNITS, 1.0, 1.0))}  # a file without a header has default units
    libraries = spark.createDataFrame([(lib_id, *units[lib_id])], "lib_id string, t_unit string, c_unit string, r_unit string, l_unit string, c_scale double, r_scale double")
    blocks = parse_blocks_of(read_blocks(spark, path, lib_id, "nets"), name_map, text=text, most_names=figures["names"])
    nets, plain = merge_nets(blocks, units)
    return SpefLibrary(libraries, name_map, nets, resolve_coupling(nets, libraries, name_map, plain), blocks, plain)


def _named(paths: list[str]) -> list[tuple[str, str]]:
    """(path, name) with unique names."""
    taken: set[str] = set()
    out = []
    for p in paths:
        out.append((p, unique_name(os.path.splitext(os.path.basename(p))[0], taken)))
        taken.add(out[-1][1])
    return out


def read_spefs(spark: SparkSession, paths: list[str]) -> list[SpefLibrary]:
    """Libraries of several files, in their order, with unique names; the first error ends it."""
    return [read_spef(spark, p, name) for p, name in _named(paths)]


def read_each(spark: SparkSession, paths: list[str]) -> tuple[dict[str, SpefLibrary], DataFrame]:
    """(libraries by name, report): each file for itself, so that one that fails leaves the others.

    report: lib_id, path, nets, damaged (blocks without a net and a total), error; a row for each file, error is null for those that were read.
    """
    libraries, rows = {}, []
    for p, name in _named(paths):
        try:
            lib = libraries[name] = read_spef(spark, p, name)
            got = lib.blocks.agg(F.count_if(F.col("net").isNotNull()).alias("nets"), F.count_if(F.col("net").isNull()).alias("damaged")).first()
            rows.append((name, p, got["nets"], got["damaged"], None))
        except Exception as e:  # noqa: BLE001  a file that fails is reported, the others stay
            rows.append((name, p, None, None, f"{type(e).__name__}: {e}"[:1000]))
    return libraries, spark.createDataFrame(rows, "lib_id string, path string, nets long, damaged long, error string")
