"""One ranking from several scores by a random walk over ranks.

From an item the walk picks a score, each with the same chance, and jumps to one of the items that the score ranks above it, or stays
where it is, all with the same chance. Now and then it starts afresh at any item (damping). Only orders count, so no score outweighs the
others by its range. The items are ranked by how much of its time the walk spends with them; as jumps go to whole stretches of a sorted
list, one step of the walk is a prefix sum over each list.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.scratch import Scratch

DAMPING = 0.85
#: The walk ends when no share changes by more than this part of the mean share, or after so many steps.
EXACT, STEPS = 1e-9, 200
#: A query with more rated rows than this is walked by all workers together instead of by one; the result is the same.
HOT_ROWS = 200_000
#: Ranks per block of the distributed prefix sums.
BLOCK = 4096


def stationary(ranks: np.ndarray) -> np.ndarray:
    """Shares of the walk; ``ranks`` has a row per score with the number of items above each item, ties sharing the same."""
    m, n = ranks.shape
    order = np.argsort(ranks, axis=1, kind="stable")
    above = np.take_along_axis(ranks, order, axis=1)
    last = np.zeros((m, n), dtype=np.int64)  # the place of the last item of each item's tie
    for s in range(m):
        last[s] = np.searchsorted(above[s], above[s], side="right") - 1
    pi = np.full(n, 1.0 / n)
    for _ in range(STEPS):
        flow = np.zeros(n)
        for s in range(m):
            out = pi[order[s]] / (above[s] + 1)  # to each item above, and to itself
            after = out[::-1].cumsum()[::-1]
            below = np.append(after, 0.0)[last[s] + 1]  # what comes from all items strictly below
            flow[order[s]] += below + out
        new = DAMPING * flow / m + (1 - DAMPING) / n
        done = np.abs(new - pi).max() <= EXACT / n
        pi = new
        if done:
            break
    return pi


def _walk_group(rows: pd.DataFrame) -> pd.DataFrame:
    items, at = np.unique(rows["item"].to_numpy(dtype=object), return_inverse=True)
    scores = rows["scorer"].to_numpy(dtype=object)
    ranks = []
    for s in dict.fromkeys(sorted(x for x in scores if x is not None)):
        mine = scores == s
        value = np.full(len(items), -np.inf)
        value[at[mine]] = rows["value"].to_numpy(dtype=float)[mine]
        value = np.where(np.isnan(value), -np.inf, value)
        ranks.append(len(items) - np.searchsorted(np.sort(value), value, side="right"))
    share = stationary(np.array(ranks)) if ranks else np.full(len(items), 1.0 / max(1, len(items)))
    return pd.DataFrame({"query": rows["query"].iloc[0], "item": items, "share": share, "n": len(items)})


def _walk_hot(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The same walk for queries with very many rows, by joins and blocked prefix sums; no task holds a list."""
    items = scratch.keep(rows.select("query", "item").distinct(), "items")
    sizes = items.groupBy("query").agg(F.count("*").alias("n"))
    scorers = rows.where("scorer is not null").select("query", "scorer").distinct()
    grid = items.join(scorers, "query").join(rows, ["query", "item", "scorer"], "left").withColumn("value", F.coalesce("value", F.lit(float("-inf"))))
    # Items of one value share a rank, so values are counted first; the number above each comes from blocks of sorted values.
    values = grid.groupBy("query", "scorer", "value").agg(F.count("*").alias("c")).repartitionByRange("query", "scorer", F.desc("value")).sortWithinPartitions("query", "scorer", F.desc("value")).withColumn("part", F.spark_partition_id())
    values = scratch.keep(values, "values")
    parts = values.groupBy("query", "scorer", "part").agg(F.sum("c").alias("pc"))
    parts = parts.withColumn("pstart", F.sum("pc").over(Window.partitionBy("query", "scorer").orderBy("part")) - F.col("pc")).drop("pc")
    inner = F.sum("c").over(Window.partitionBy("query", "scorer", "part").orderBy(F.desc("value"))) - F.col("c")
    ranked = values.withColumn("inner", inner).join(parts, ["query", "scorer", "part"]).select("query", "scorer", "value", (F.col("inner") + F.col("pstart")).alias("above"))
    grid = scratch.keep(grid.join(ranked, ["query", "scorer", "value"]).select("query", "item", "scorer", "above").withColumn("block", F.floor(F.col("above") / BLOCK)), "grid")
    m = scorers.groupBy("query").agg(F.count("*").alias("m"))
    base = scratch.keep(items.join(sizes, "query").join(m, "query", "left"), "base")
    pi = scratch.keep(base.select("query", "item", (1.0 / F.col("n")).alias("share")), "share")
    for _ in range(STEPS):
        flow = grid.join(pi, ["query", "item"]).withColumn("out", F.col("share") / (F.col("above") + 1))
        ties = flow.groupBy("query", "scorer", "block", "above").agg(F.sum("out").alias("t"))
        ties = scratch.keep(ties, "ties")
        blocks = ties.groupBy("query", "scorer", "block").agg(F.sum("t").alias("bt"))
        blocks = blocks.withColumn("later", F.sum("bt").over(Window.partitionBy("query", "scorer").orderBy(F.desc("block"))) - F.col("bt")).drop("bt")
        within = F.sum("t").over(Window.partitionBy("query", "scorer", "block").orderBy(F.desc("above"))) - F.col("t")
        below = ties.withColumn("within", within).join(blocks, ["query", "scorer", "block"]).select("query", "scorer", "above", (F.col("within") + F.col("later")).alias("below"))
        came = flow.join(below, ["query", "scorer", "above"]).groupBy("query", "item").agg(F.sum(F.col("below") + F.col("out")).alias("came"))
        new = base.join(pi, ["query", "item"]).join(came, ["query", "item"], "left")
        new = new.select("query", "item", (DAMPING * F.coalesce(F.col("came") / F.col("m"), 1.0 / F.col("n")) + (1 - DAMPING) / F.col("n")).alias("share"), F.col("share").alias("old"), "n")
        new = scratch.keep(new, "share")
        change = new.agg(F.max(F.abs(F.col("share") - F.col("old")) * F.col("n"))).first()[0]
        pi = new.select("query", "item", "share")
        if change is None or change <= EXACT:
            break
    return new.select("query", "item", "share", "n")


def fuse(rows: DataFrame, scorers: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(query, item, share, n): the share of each item in the walk of its query, and the number of items of the query.

    ``rows`` has (query, item, scorer, score, at), ``scorers`` (scorer, higher_is_better). Of several rows of a query, item and scorer the
    one with the latest ``at`` holds, of these the higher score. A null or NaN score, or none, is below all items that the scorer rated;
    all such items tie. Ties in the result are broken by the item. Rows without a query or item are left out; a scorer that isn't listed
    counts as higher-is-better, a null one only makes the item known. Empty tables give an empty result.
    """
    scratch = Scratch(rows.sparkSession, "fusion")
    kind = rows.schema["query"].dataType.simpleString()
    valid = F.when(~F.isnan("score"), F.col("score").cast("double"))
    latest = rows.where("query is not null and item is not null").groupBy("query", "item", "scorer").agg(F.max(F.struct("at", valid.alias("score"))).alias("r"))
    up = scorers.groupBy("scorer").agg(F.first("higher_is_better").alias("up"))
    signed = latest.join(F.broadcast(up), "scorer", "left").select("query", "item", "scorer", F.when(F.coalesce("up", F.lit(True)), F.col("r.score")).otherwise(-F.col("r.score")).alias("value"))
    signed = scratch.keep(signed, "latest")
    hot = signed.groupBy("query").count().where(F.col("count") > hot_rows).select("query")
    hot = scratch.keep(hot, "hot")
    shape = f"query {kind}, item string, share double, n long"
    if hot.isEmpty():
        shares = signed.groupBy("query").applyInPandas(_walk_group, shape)
    else:
        cool = signed.join(hot, "query", "left_anti").groupBy("query").applyInPandas(_walk_group, shape)
        shares = cool.unionByName(_walk_hot(signed.join(hot, "query"), scratch))
    return shares


def _minus() -> Column:
    return -F.round(F.col("share") * F.col("n"), 9)


def ranking(shares: DataFrame) -> DataFrame:
    """Adds ``place``, from 1, by share and then item.

    Shares are compared as multiples of the mean share to nine digits, the exactness of the walk, so that rounding makes no difference.
    All rows are sorted by ranges, so a query with very many items is numbered by several tasks.
    """
    scratch = Scratch(shares.sparkSession, "ranking")
    ordered = shares.withColumn("minus", _minus()).repartitionByRange("query", "minus", "item").withColumn("part", F.spark_partition_id())
    ordered = scratch.keep(ordered, "ordered")
    starts = ordered.groupBy("query", "part").agg(F.count("*").alias("c"))
    starts = starts.withColumn("start", F.sum("c").over(Window.partitionBy("query").orderBy("part")) - F.col("c")).drop("c")
    within = F.row_number().over(Window.partitionBy("query", "part").orderBy("minus", "item"))
    return ordered.withColumn("within", within).join(starts, ["query", "part"]).select("query", "item", "share", (F.col("within") + F.col("start")).alias("place"))


def first_places(shares: DataFrame) -> DataFrame:
    """(query, item) of the first place of each query; an aggregate, so it needs no list in one task."""
    best = F.min(F.struct(_minus().alias("minus"), "item")).alias("best")
    return shares.groupBy("query").agg(best).select("query", F.col("best.item").alias("item"))
