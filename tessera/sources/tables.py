"""Tables of a data folder, and the current rows of versioned tables."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that count as white space around a key.
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small(spark: SparkSession, rows: Sequence[tuple], **columns: pa.DataType) -> DataFrame:
    """A table of few rows that the driver has; reading it takes no task."""
    values = list(zip(*rows)) if rows else [()] * len(columns)
    return spark.createDataFrame(pa.table({name: pa.array(v, kind) for (name, kind), v in zip(columns.items(), values, strict=True)}))


def key_of(col: Column | str) -> Column:
    """A key as it is compared: trimmed at both ends; null where nothing is left."""
    trimmed = F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(WHITE))
    return F.when(trimmed != "", trimmed)


def current_rows(df: DataFrame, key: str, columns: Sequence[str | Column], order: str = "ingested_at", arrival: str | None = None, copies: str | None = None) -> DataFrame:
    """The latest row of each key, as (key, columns..., order[, arrival][, copies]).

    Keys are compared trimmed; the result has the trimmed key. Rows whose key is null or blank name no record and are left out. Exact
    copies collapse; of different rows with the same latest time the one whose columns sort last is taken, so the result is the same in
    every run. A null time is older than any other. An empty table gives an empty result; other columns of ``df`` are ignored, so their
    names can't clash. With ``arrival`` the earliest time of the key is added under that name, with
    ``copies`` the number of its rows.

    It is an aggregate with a map-side combine, so a key with very many versions goes over the network once per input partition.
    """
    picked = [F.col(c) if isinstance(c, str) else c for c in columns]
    rows = df.select(key_of(key).alias("__key"), F.struct(F.col(order).alias("__order"), *picked).alias("__row")).where("__key is not null")
    aggregates = [F.max("__row").alias("__row")]
    if arrival:
        aggregates.append(F.min("__row.__order").alias(arrival))
    if copies:
        aggregates.append(F.count("*").alias(copies))
    latest = rows.groupBy("__key").agg(*aggregates)
    names = [f.name for f in latest.schema["__row"].dataType.fields[1:]]
    fields = [F.col(f"__row.`{n}`").alias(n) for n in names]
    return latest.select(F.col("__key").alias(key), *fields, F.col("__row.__order").alias(order), *[c for c in (arrival, copies) if c])
