"""Filling containers of fixed capacity with whole items.

Items fall into reciprocal-capacity classes: class k holds the sizes of which just k fit into a container. A container of class k gets k
items of its class. What it leaves free is bounded but can be much, so each container is also given items of smaller classes that fit
there. Both are planned on the number of items of each size, of which there are at most as many as the capacity: the plan is a list of
container kinds with their sizes and number. Which item goes where follows from its rank among the items of its size, so that workers
fill containers independently of each other.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.scratch import Scratch

#: Parts into which the items of one size are dealt before they are numbered.
DEALT = 256


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Container kinds as (number of containers, [(size, items of that size in each)]), for sizes up to the capacity.

    Going from the largest size down, a container takes as many items of that size as its class says, or as are left, then of each smaller
    size as many as fit. A kind is used until one of its sizes is used up, so there are few kinds: their number grows with the number of
    sizes, not of items.
    """
    left = {s: n for s, n in counts.items() if n > 0 and 0 < s <= capacity}
    sizes = sorted(left)
    kinds = []
    while sizes:
        largest = sizes[-1]
        take = min(capacity // largest, left[largest])  # capacity // largest is the class of the size
        kind, room = [(largest, take)], capacity - largest * take
        i = len(sizes) - 2
        while room and i >= 0:
            i = min(i, bisect_right(sizes, room) - 1)
            if i < 0:
                break
            size = sizes[i]
            n = min(room // size, left[size])
            if n:
                kind.append((size, n))
                room -= n * size
            i -= 1
        times = min(left[s] // n for s, n in kind)
        for s, n in kind:
            left[s] -= n * times
            if not left[s]:
                sizes.remove(s)
        kinds.append((times, kind))
    return kinds


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, size, container, place): each item with its container, none split.

    Items larger than the capacity are alone in theirs. Null sizes and sizes under one go nowhere and are left out; repeated rows are
    items of their own. Only the number of items of each size, at most ``capacity`` rows, comes to the driver. An empty table gives an
    empty result.
    """
    spark = items.sparkSession
    scratch = Scratch(spark, "packing")
    deal = F.pmod(F.xxhash64("key", "size"), F.lit(DEALT)).cast("int")  # by what the item is, so any order of rows gives the same
    rows = items.select(F.col(key).alias("key"), F.col(size).cast("long").alias("size")).where("size > 0").withColumn("deal", deal)
    rows = scratch.keep(rows, "items")
    fitting = rows.where(F.col("size") <= capacity)
    dealt = scratch.keep(fitting.groupBy("size", "deal").count(), "dealt")
    counts = {r["size"]: r["n"] for r in dealt.groupBy("size").agg(F.sum("count").alias("n")).collect()}

    # One row per size and kind: the ranks of that size that the kind uses, and its first container.
    slots, used, first = [], dict.fromkeys(counts, 0), 0
    for times, kind in plan(counts, capacity):
        place = 0
        for s, n in kind:
            slots.append((s, used[s], used[s] + n * times, n, first, place))
            used[s] += n * times
            place += n
        first += times
    slot = spark.createDataFrame(slots, "s_size long, rank_from long, rank_to long, each long, first long, place_from long")

    starts = dealt.withColumn("start", F.sum("count").over(Window.partitionBy("size").orderBy("deal")) - F.col("count")).drop("count")
    rank = F.row_number().over(Window.partitionBy("size", "deal").orderBy("key")) - 1
    ranked = fitting.withColumn("n", rank).join(starts, ["size", "deal"]).select("key", "size", (F.col("n") + F.col("start")).alias("rank"))
    placed = ranked.join(F.broadcast(slot), (F.col("size") == F.col("s_size")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    # Neighbouring ranks share a container.
    within = F.col("rank") - F.col("rank_from")
    packed = placed.select("key", "size", (F.col("first") + F.floor(within / F.col("each"))).alias("container"), (F.col("place_from") + within % F.col("each")).alias("place"))

    over = scratch.keep(rows.where(F.col("size") > capacity), "over")
    over_starts = over.groupBy("deal").count()
    over_starts = over_starts.select("deal", (F.sum("count").over(Window.orderBy("deal")) - F.col("count") + F.lit(first)).alias("start"))
    alone = over.withColumn("n", F.row_number().over(Window.partitionBy("deal").orderBy("key")) - 1).join(F.broadcast(over_starts), "deal")
    alone = alone.select("key", "size", (F.col("n") + F.col("start")).alias("container"), F.lit(0).cast("long").alias("place"))
    return packed.unionByName(alone).withColumnRenamed("key", key)
