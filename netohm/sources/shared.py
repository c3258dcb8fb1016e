"""Tables and folders that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import threading
import time
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_LOG = threading.local()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; below a temporary one only where that is unset (tests in local mode)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="netohm-")
    path = f"{base.rstrip('/')}/netohm-{uuid.uuid4().hex}-{name}"
    if made := getattr(_LOG, "passing", None):
        made[-1].append(path)
    return path


@contextmanager
def passing(spark: SparkSession, but_last: bool = False) -> Iterator[None]:
    """Folders that this thread gets from scratch() meanwhile are deleted at the end; nothing that is read later may come from them.

    but_last: the last of them stays, up to the end of the passing() around this one if there is any.
    """
    stack = _LOG.passing = getattr(_LOG, "passing", [])
    stack.append([])
    try:
        yield
    finally:
        made = stack.pop()
        if but_last and made:
            last = made.pop()
            if stack:
                stack[-1].append(last)
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def unshuffled(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind, which else stay until the driver's garbage is collected."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def ship(spark: SparkSession) -> None:
    """Give executors this package, for clusters whose Python path lacks it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="netohm-"), "netohm_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


@contextmanager
def phases() -> Iterator[list[dict]]:
    """The tables that this thread makes meanwhile, one after the other: phase, seconds, rows and the figures that Spark observed while writing each."""
    before, _LOG.phases = getattr(_LOG, "phases", None), []
    try:
        yield _LOG.phases
    finally:
        _LOG.phases = before


def phase_table(spark: SparkSession, log: list[dict]) -> DataFrame:
    """A row for each phase; figures that a phase doesn't have are null."""
    names = ("phase", "seconds", "rows", "names", "nets", "sinks", "resistors", "capacitors")
    return spark.createDataFrame([tuple(p.get(n) for n in names) for p in log], "phase string, seconds double, " + ", ".join(f"{n} long" for n in names[2:]))


def measured(df: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, dict]:
    """df as a table in the shared folder, worked out once so that it survives lost executors; rows, and figures (aggregates) observed on the way."""
    spark = df.sparkSession
    ship(spark)
    path, seen = scratch(spark, name), Observation()
    began = time.time()
    with unshuffled(spark):
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in figures.items()]).write.option("compression", "zstd").parquet(path)
    got = {"rows": 0} | {k: v or 0 for k, v in seen.get.items()}
    log = getattr(_LOG, "phases", None)
    if log is not None:
        log.append({"phase": name, "seconds": time.time() - began, **got})
    return spark.read.schema(df.schema).parquet(path), got


def kept(df: DataFrame, name: str) -> DataFrame:
    """The table of measured()."""
    return measured(df, name)[0]


def write_text(rows: DataFrame, path: str, packed: bool = False) -> None:
    """Lines in part files, gzipped if packed, in place of what is there."""
    with unshuffled(rows.sparkSession):
        rows.write.mode("overwrite").text(path, compression="gzip" if packed else "none")
