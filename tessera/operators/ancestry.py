"""What is above and below stated nodes, within a bounded number of levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.scratch import Scratch
from tessera.sources.tables import key_of

#: How far up the nearest reference may be, and how far down and how many nodes a preview goes; characters of a preview's text.
LEVELS_UP, LEVELS_DOWN, MOST_BELOW, PREVIEW = 16, 8, 256, 180
REFERENCED = ("clause", "subclause", "annex", "table")


def nearest_refs(nodes: DataFrame, wanted: Column) -> DataFrame:
    """(node_id, parent_ref): for each of the nodes (node_id, parent_node_id, node_type, ref) that are ``wanted`` the reference of the nearest
    clause, subclause, annex or table above it, at most 16 levels up; a blank reference is none.

    Only nodes that have children climb, by doubling: after k rounds each knows the nearest reference among itself and the 2^k - 1 nodes
    above it, so four rounds make sixteen levels. A node that has its reference or has reached the top joins no further.
    """
    scratch = Scratch(nodes.sparkSession, "nearest")
    n = scratch.keep(nodes.select("node_id", key_of("parent_node_id").alias("p"), "node_type", "ref", F.coalesce(wanted, F.lit(False)).alias("wanted")), "nodes")
    parents = n.where("p is not null").select(F.col("p").alias("node_id")).distinct()
    fits = F.coalesce(F.col("node_type").isin(*REFERENCED), F.lit(False)) & key_of("ref").isNotNull()
    state = scratch.keep(n.join(parents, "node_id", "left_semi").select("node_id", F.when(~fits, F.col("p")).alias("far"), F.when(fits, F.col("ref")).alias("found")), "state")
    for _ in range(LEVELS_UP.bit_length() - 1):
        ahead = state.select(F.col("node_id").alias("a_id"), F.col("far").alias("a_far"), F.col("found").alias("a_found"))
        going = state.where("far is not null").join(ahead, F.col("far") == F.col("a_id"), "left").select("node_id", F.when(F.col("a_found").isNull(), F.col("a_far")).alias("far"), F.col("a_found").alias("found"))
        after = scratch.keep(state.where("far is null").unionByName(going), "state")
        scratch.drop(state)
        state = after
    asked = n.where("wanted").select("node_id", "p")
    held = asked.where("p is not null").join(state.select(F.col("node_id").alias("s_id"), "found"), F.col("p") == F.col("s_id"), "left").select("node_id", F.col("found").alias("parent_ref"))
    return held.unionByName(asked.where("p is null").select("node_id", F.lit(None).cast("string").alias("parent_ref")))


def previews(nodes: DataFrame, roots: DataFrame, carry: list[str]) -> DataFrame:
    """(node_id, descendant, order_index, carry..., depth, place): for each root (node_id) the first 256 nodes below it, at most eight
    levels down, by depth, order (null first) and key.

    Each level is one join, kept as a table. As the order is by depth first, a root that has its 256 goes no deeper. A cycle ends with the
    last level.
    """
    scratch = Scratch(nodes.sparkSession, "previews")
    down = scratch.keep(nodes.select(key_of("parent_node_id").alias("p"), F.col("node_id").alias("d_id"), "order_index", *carry).where("p is not null"), "down")
    at = scratch.keep(roots.select("node_id", F.col("node_id").alias("at")).distinct(), "roots")
    place = F.row_number().over(Window.partitionBy("node_id").orderBy(F.asc_nulls_first("order_index"), "d_id"))
    levels: list[DataFrame] = []
    full = None
    for depth in range(1, LEVELS_DOWN + 1):
        level = at.join(down, F.col("at") == F.col("p")).select("node_id", "d_id", "order_index", *carry)
        level = scratch.keep(level, "level")
        if level.isEmpty():
            break
        levels.append(level.withColumn("within", place).where(F.col("within") <= MOST_BELOW).drop("within").withColumn("depth", F.lit(depth).cast("long")))
        counts = level.groupBy("node_id").count()
        full = counts if full is None else full.unionByName(counts)
        filled = full.groupBy("node_id").agg(F.sum("count").alias("n")).where(F.col("n") >= MOST_BELOW).select("node_id")
        at = level.select("node_id", F.col("d_id").alias("at")).join(filled, "node_id", "left_anti")
    if not levels:
        levels = [down.limit(0).select(F.col("p").alias("node_id"), "d_id", "order_index", *carry, F.lit(0).cast("long").alias("depth"))]
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found.withColumnRenamed("d_id", "descendant").withColumn("place", F.row_number().over(Window.partitionBy("node_id").orderBy("depth", F.asc_nulls_first("order_index"), "descendant"))).where(F.col("place") <= MOST_BELOW)
