"""Session helpers: shipping the package to executors and intermediate tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_MADE = threading.local()


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


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset (tests in local mode)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="netohm-work-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def write(df: DataFrame, name: str) -> str:
    """The path of df as a table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/netohm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    made = getattr(_MADE, "tables", None)
    if made is not None:
        made.append(path.rpartition("/")[0])
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts lineage and survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(write(df, name))


@contextmanager
def collected() -> Iterator[list[str]]:
    """The folders of the tables that this thread writes meanwhile."""
    before, _MADE.tables = getattr(_MADE, "tables", None), []
    try:
        yield _MADE.tables
    finally:
        _MADE.tables = before


def delete(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders of tables that no lazy result needs any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        p = jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
