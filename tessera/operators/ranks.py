"""Places and percentiles of groups of any size, numbered by several tasks.

A window over a group is one task; a group with a third of all rows would be a task with a third of all rows. Here rows are sorted by ranges
over the whole table, so a large group is spread, and each part starts from the count of the parts before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.scratch import Scratch


def _sorted_parts(rows: DataFrame, group: Sequence[str], order: Sequence[Column], scratch: Scratch) -> DataFrame:
    """The rows in ranges of (group, order), with the number of their range in ``_part``."""
    return scratch.keep(rows.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_part", F.spark_partition_id()), "ranges")


def positions(rows: DataFrame, group: Sequence[str], order: Sequence[Column], scratch: Scratch, name: str = "place") -> DataFrame:
    """Adds ``name``: the place of each row in its group, from 1, by ``order``, which has to be total. Null group keys are a group."""
    ranged = _sorted_parts(rows, group, order, scratch)
    counts = ranged.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part")  # one row per range
    starts = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), (F.sum("_n").over(before) - F.col("_n")).alias("_start"))
    within = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    numbered = ranged.withColumn("_within", within).join(starts, on)
    return numbered.select(*rows.columns, (F.col("_within") + F.col("_start")).alias(name))


def percentiles(rows: DataFrame, group: str, value: str, at: dict[str, tuple[str, float]], scratch: Scratch) -> DataFrame:
    """(group, one column per entry of ``at``): exact percentiles, (``linear``, q) interpolated or (``nearest``, q) by nearest rank.

    Equal values are counted first; the counts are summed up in ranges of values, so no task holds a group. Null and NaN values are left
    out; a group without values isn't listed.
    """
    counted = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(group, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    ranged = _sorted_parts(counted, [group], [F.col("_v")], scratch)
    sums = ranged.groupBy(group, "_part").agg(F.sum("_c").alias("_s"))
    starts = sums.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), (F.sum("_s").over(Window.partitionBy(group).orderBy("_part")) - F.col("_s")).alias("_start"), F.sum("_s").over(Window.partitionBy(group)).alias("_total"))
    run = F.sum("_c").over(Window.partitionBy(group, "_part").orderBy("_v")) - F.col("_c")
    placed = ranged.withColumn("_run", run).join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    placed = placed.select(F.col(group), "_v", (F.col("_run") + F.col("_start")).alias("_from"), (F.col("_run") + F.col("_start") + F.col("_c")).alias("_to"), "_total")

    def holds(rank: Column) -> Column:
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col("_v")))

    aggregates, outs = [F.max("_total").alias("_n")], []
    for i, (name, (kind, q)) in enumerate(at.items()):
        if kind == "nearest":
            aggregates.append(holds(F.greatest(F.ceil(F.col("_total") * q), F.lit(1)) - 1).alias(f"_lo{i}"))
            outs.append(F.col(f"_lo{i}").alias(name))
        else:
            place = (F.col("_total") - 1) * F.lit(q)
            aggregates += [holds(F.floor(place)).alias(f"_lo{i}"), holds(F.ceil(place)).alias(f"_hi{i}")]
            share = (F.col("_n") - 1) * F.lit(q)
            outs.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (share - F.floor(share))).alias(name))
    return placed.groupBy(group).agg(*aggregates).select(group, *outs)
