"""Intermediate tables that cut the lineage of iterative jobs.

They are written as Parquet to the shared folder that the cluster names in ``spark.checkpoint.dir``, so that a lost executor costs no more
than the step at hand. Where that setting is missing (tests, a laptop) a temporary folder takes its place.

A result may still read its tables when the operator has returned it, so the one who reads the result ends their life: what is made within
``scope`` is deleted at its end. What is left then, or was made without a scope, goes when the driver ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: str | None = None
#: Folders that are there, by their path, with what deletes them; shared ones outlive a scope.
_live: dict[str, Callable[[], None]] = {}


@contextmanager
def scope() -> Iterator[None]:
    """Deletes at its end all intermediate tables that were made within; results have to be written or read before."""
    before = set(_live)
    try:
        yield
    finally:
        for path in [p for p in _live if p not in before]:
            _live[path]()


def _base(spark: SparkSession) -> str:
    global _local
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local is None:
        _local = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _local, True)
    return f"file://{_local}"


class Scratch:
    """A folder of intermediate tables of one job."""

    def __init__(self, spark: SparkSession, name: str, shared: bool = False):
        self.spark = spark
        self.path = f"{_base(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._known = shared  # a shared one isn't in any scope

    def keep(self, df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
        """``df`` written and read again; with ``by``, in one folder per value of that column."""
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{name}"
        writer = df.write
        if by:
            writer = writer.partitionBy(by)
        writer.parquet(path)
        if self._n == 1:
            at, fs = self._fs(self.path)
            fs.deleteOnExit(at)
        if not self._known:
            self._known = True
            _live[self.path] = self.drop
        schema = df.schema
        back = self.spark.read.schema(schema).parquet(path).select(*[F.col(f"`{c}`") for c in df.columns])
        back._scratch_path = path
        return back

    def child(self, name: str) -> Scratch:
        """A folder within this one that can be dropped by itself."""
        self._n += 1
        inner = Scratch(self.spark, name, shared=True)  # it goes with this one
        inner.path = f"{self.path}/{self._n:03d}-{name}"
        if not self._known:
            self._known = True
            _live[self.path] = self.drop
        return inner

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self, df: DataFrame | None = None, part: str = "") -> None:
        """Remove a table, one partition of it, or without a table all of this folder, once nothing reads it any more."""
        path = self.path if df is None else getattr(df, "_scratch_path", None)
        if path:
            at, fs = self._fs(f"{path}/{part}" if part else path)
            fs.delete(at, True)
        if df is None:
            _live.pop(self.path, None)
