"""Command line: backmark, shuffle, compare two SPEF files, or summarise data files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from netohm.operators import rewrite
from netohm.operators.compare import compare, coupling_report, summary_text
from netohm.sources import datafiles
from netohm.sources.shared import phases
from netohm.sources.spef import collect_spef_paths, read_each


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="netohm", description=__doc__)
    p.add_argument("spef", nargs="*")
    p.add_argument("--csv-prefix")
    p.add_argument("--r-agg", choices=("max", "avg", "total"), default="max")
    p.add_argument("--net-cap-data")
    p.add_argument("--net-res-data")
    p.add_argument("--net-ccap-data")
    p.add_argument("--backmark", action="store_true")
    p.add_argument("--shuffle", action="store_true")
    p.add_argument("--seed", type=int, default=-1)
    p.add_argument("--output", "-o")
    p.add_argument("--res-method", choices=("dijkstra", "equivalent"), default="dijkstra")
    p.add_argument("--phases", action="store_true", help="print seconds and figures of each phase")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    with phases() as log:
        code = _main(args, spark)
    if "--phases" in (args or []):
        for x in log:
            print(f"[phase] {x['phase']}: {x['seconds']:.2f} s, " + ", ".join(f"{v} {k}" for k, v in x.items() if k not in ("phase", "seconds")))
    return code


def _main(args: list[str] | None, spark: SparkSession | None) -> int:
    p = parser()
    a = p.parse_args(args)
    paths = collect_spef_paths(a.spef)
    spark = spark or SparkSession.builder.appName("netohm").getOrCreate()
    if a.backmark or a.shuffle:
        if not paths or not a.output:
            p.error("a SPEF file and --output are needed")
        if a.backmark:
            read = lambda f, path: f(spark, path) if path else None
            blocks, in_order = rewrite.backmark_blocks(
                spark, paths[0], read(datafiles.read_cap_targets, a.net_cap_data), read(datafiles.read_res_targets, a.net_res_data), read(datafiles.read_ccap_targets, a.net_ccap_data), a.res_method
            ), False
        else:
            blocks, in_order = rewrite.shuffle_blocks(spark, paths[0], a.seed)
        rewrite.write_blocks(blocks, a.output, in_order)
        return 0
    if len(paths) >= 2:
        libraries, report = read_each(spark, paths[:2])
        for r in report.where("error is not null or damaged > 0").collect():  # two rows at most
            print(f"[spef] {r['path']}: {r['error'] or str(r['damaged']) + ' damaged blocks left out'}")
        if len(libraries) < 2:
            for name, lib in libraries.items():
                print(f"[spef] {name}: {lib.nets.count()} nets, {lib.coupling_caps.count()} coupling pairs")
            return 1
        one, two = libraries.values()
        c = compare(one, two, a.res_method)
        for df, path, columns in ((c.cap, a.net_cap_data, datafiles.CAP), (c.res, a.net_res_data, datafiles.RES), (c.ccap, a.net_ccap_data, datafiles.CCAP)):
            if path:
                datafiles.write_data(df, path, columns)
        for k, pairs in enumerate(coupling_report(one, two), 1):  # sorted; the lines come part by part
            print(f"[ccap] net pairs only in spef{k}: {pairs.count()}")
            for r in pairs.toLocalIterator():
                print(f"[ccap][only_spef{k}] {r['net1']} {r['net2']}")
    elif a.net_cap_data or a.net_res_data or a.net_ccap_data:
        c = datafiles.load_comparison(spark, a.net_cap_data, a.net_res_data, a.net_ccap_data)
    else:
        p.print_help()
        return 1
    if a.csv_prefix:
        datafiles.write_csvs(c, a.csv_prefix, a.r_agg)
    print("\n".join(summary_text(c.summary())))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
