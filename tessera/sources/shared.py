"""Tables that several queries on one folder share: built once a session, as long as the files they are made of stay the same."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import TypeVar

from pyspark.sql import SparkSession

from tessera.sources.scratch import Scratch

T = TypeVar("T")
_built: dict[tuple, tuple[tuple, object]] = {}


def _state(spark: SparkSession, folder: str, tables: Sequence[str]) -> tuple:
    """Name, size and time of all files of the tables."""
    out = []
    for table in tables:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}.parquet")
        for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at):
            out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return tuple(sorted(out))


def has(spark: SparkSession, folder: str, name: str, tables: Sequence[str]) -> bool:
    """Whether ``shared`` would give what was built before."""
    held = _built.get((spark.sparkContext.applicationId, folder, name))
    return held is not None and held[0] == _state(spark, folder, tables)


def shared(spark: SparkSession, folder: str, name: str, tables: Sequence[str], build: Callable[[Scratch], T]) -> T:
    """What ``build`` made of the tables of a folder; made again when their files have changed or the session is another one."""
    key, state = (spark.sparkContext.applicationId, folder, name), _state(spark, folder, tables)
    held = _built.get(key)
    if held is None or held[0] != state:
        held = _built[key] = (state, build(Scratch(spark, name, shared=True)))
    return held[1]
