"""Cutting a plan's lineage with tables in the folder that all executors share.

A table written here survives the loss of any executor, gives the optimiser true sizes for what follows, and keeps an
iterative plan from growing. ``spark.checkpoint.dir`` names the folder on a cluster; only where it is unset and all runs
in one process, as in tests, a temporary folder takes its place. An operator's own tables are dropped by ``Scratch`` when
it has written its result.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = tempfile.mkdtemp(prefix="tessel-")
        atexit.register(shutil.rmtree, _own[key], ignore_errors=True)
    return f"file://{_own[key]}"


def free_name(name: str, *frames: DataFrame) -> str:
    """``name``, or that with a number, such that none of the frames has a column called so."""
    taken = {c.lower() for df in frames for c in df.columns}
    return next(x for x in (name, *(f"{name}_{k}" for k in range(len(taken) + 1))) if x.lower() not in taken)


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once and read back."""
    return Kept(df).df


class Kept:
    """A written table that can be dropped before the session ends, for iterations that replace their own input."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/tessel-{uuid.uuid4().hex}"
        schema = df.schema
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables of one piece of work: all are dropped when it ends, but for those that ``keep`` wrote."""

    def __init__(self) -> None:
        self.tables: list[Kept] = []

    def cut(self, df: DataFrame) -> DataFrame:
        self.tables.append(Kept(df))
        return self.tables[-1].df

    def keep(self, df: DataFrame) -> DataFrame:
        """The rows of ``df``, which may read the other tables, in a table of its own."""
        return Kept(df).df

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *why) -> None:
        for table in self.tables:
            table.drop()
