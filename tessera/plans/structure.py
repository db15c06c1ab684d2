"""Queries on the node trees and on references between records (problems 1 and 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.hierarchy import SEPARATOR, descendants, hierarchy
from tessera.operators.orphans import Table, orphan_counts, orphans
from tessera.sources.tables import current_rows, read


def node_label() -> Column:
    """What a node contributes to a path."""
    return F.concat(F.coalesce("node_type", F.lit("")), F.lit(":"), F.coalesce("ref", "heading", F.lit("unlabeled")))


def _tree(spark: SparkSession, folder: str, intervals: bool) -> DataFrame:
    stored = F.when(F.col("ancestor_path").isNotNull(), F.struct(F.xxhash64("ancestor_path").alias("a"), F.hash("ancestor_path").alias("b"), F.length("ancestor_path").alias("n"))).alias("stored")
    nodes = current_rows(read(spark, folder, "nodes"), "node_id", ["parent_node_id", node_label().alias("label"), stored])
    return hierarchy(nodes, "node_id", "parent_node_id", F.col("label"), carry=["stored"], intervals=intervals)


def p1_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Every current node with status, top node, depth, path and the interval of its descendants."""
    return _tree(spark, folder, True).drop("stored")


def p1_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every current node with each node below it and the distance."""
    return descendants(_tree(spark, folder, True), "node_id")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes caught in or below a cycle, and rooted nodes whose stored path isn't the path of their links.

    The stored path is carried as two hashes and its length, so that the long strings move only once. A node whose stored path is null
    is no case.
    """
    tree = _tree(spark, folder, False)
    same = (F.col("stored.a") == F.xxhash64("path")) & (F.col("stored.b") == F.hash("path")) & (F.col("stored.n") == F.length("path"))
    return tree.where((F.col("status") == "cycle") | ((F.col("status") == "rooted") & F.col("stored").isNotNull() & ~same)).select("node_id", F.col("top_node").alias("top_node_id"))


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"


def key_sql(col: str) -> str:
    return f"nullif(trim({col}, {_WHITE}), '')"


def current_sql(table: str, key: str) -> str:
    return f"(SELECT * FROM (SELECT *, {key_sql(key)} AS k, row_number() OVER (PARTITION BY {key_sql(key)} ORDER BY ingested_at DESC) AS rn, min(ingested_at) OVER (PARTITION BY {key_sql(key)}) AS arrival FROM {table} WHERE {key_sql(key)} IS NOT NULL) WHERE rn = 1)"


_WALK = f"""
WITH RECURSIVE cur AS MATERIALIZED (
  SELECT k, {key_sql('parent_node_id')} AS p, coalesce(node_type, '') || ':' || coalesce(ref, heading, 'unlabeled') AS label, ancestor_path
  FROM {current_sql('nodes', 'node_id')}),
down AS (
  SELECT k, k AS top, label AS path, 0 AS depth, p IS NOT NULL AS dangles FROM cur WHERE p IS NULL OR p NOT IN (SELECT k FROM cur)
  UNION ALL
  SELECT c.k, d.top, d.path || '{SEPARATOR}' || c.label, d.depth + 1, d.dangles FROM down d JOIN cur c ON c.p = d.k),
lost AS MATERIALIZED (SELECT k, p FROM cur WHERE k NOT IN (SELECT k FROM down)),
reach AS (
  SELECT k AS start, p AS here FROM lost
  UNION
  SELECT r.start, l.p FROM reach r JOIN lost l ON l.k = r.here),
on_cycle AS MATERIALIZED (SELECT start AS k FROM reach WHERE start = here),
caught AS (SELECT r.start AS k, min(r.here) AS top FROM reach r JOIN on_cycle o ON o.k = r.here GROUP BY 1)
"""

P1_FOUND_SQL = _WALK + """
SELECT k AS node_id, top AS top_node_id FROM caught
UNION ALL
SELECT d.k, d.top FROM down d JOIN cur c ON c.k = d.k WHERE NOT d.dangles AND c.ancestor_path IS NOT NULL AND c.ancestor_path <> d.path
"""

P1_DESCENDANTS_SQL = _WALK + """
, pairs AS (
  SELECT k AS node_id, k AS descendant, 0 AS distance FROM down
  UNION ALL
  SELECT x.node_id, c.k, x.distance + 1 FROM pairs x JOIN cur c ON c.p = x.descendant)
SELECT node_id, descendant, CAST(distance AS BIGINT) AS distance FROM pairs WHERE distance > 0
"""


def _referring(spark: SparkSession, folder: str) -> tuple[list[tuple[Table, DataFrame]], DataFrame]:
    nodes = Table("nodes", "node_id", [("parent_node_id", "nodes"), ("doc_id", "docs"), ("table_node_id", "nodes")])
    chunks = Table("chunks", "chunk_id", [("origin_node_id", "nodes")])
    docs = Table("docs", "doc_id")
    return [(t, read(spark, folder, t.name)) for t in (nodes, chunks, docs)], read(spark, folder, "removals")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """References in current rows to records that are missing, removed or late."""
    return orphans(*_referring(spark, folder)).select("table_name", "field_name", "record_key")


def p4_orphans_by_month(spark: SparkSession, folder: str) -> DataFrame:
    """Their number per table, field, reason and month of the referring row, from counts per key and month."""
    return orphan_counts(*_referring(spark, folder))


_ORPHANS = f"""
WITH gone AS (SELECT table_name, {key_sql('record_key')} AS k, max(removed_at) AS removed_at FROM removals GROUP BY ALL),
n AS MATERIALIZED (SELECT c.*, coalesce(g.removed_at >= c.ingested_at, false) AS removed FROM {current_sql('nodes', 'node_id')} c LEFT JOIN gone g ON g.table_name = 'nodes' AND g.k = c.k),
d AS MATERIALIZED (SELECT c.*, coalesce(g.removed_at >= c.ingested_at, false) AS removed FROM {current_sql('docs', 'doc_id')} c LEFT JOIN gone g ON g.table_name = 'docs' AND g.k = c.k),
h AS MATERIALIZED (SELECT c.*, coalesce(g.removed_at >= c.ingested_at, false) AS removed FROM {current_sql('chunks', 'chunk_id')} c LEFT JOIN gone g ON g.table_name = 'chunks' AND g.k = c.k),
target AS (SELECT 'nodes' AS target_table, k, arrival, removed FROM n UNION ALL SELECT 'docs', k, arrival, removed FROM d),
ref AS (
  SELECT 'nodes' AS table_name, 'parent_node_id' AS field_name, k AS record_key, ingested_at, 'nodes' AS target_table, {key_sql('parent_node_id')} AS target_key FROM n WHERE NOT removed
  UNION ALL SELECT 'nodes', 'doc_id', k, ingested_at, 'docs', {key_sql('doc_id')} FROM n WHERE NOT removed
  UNION ALL SELECT 'nodes', 'table_node_id', k, ingested_at, 'nodes', {key_sql('table_node_id')} FROM n WHERE NOT removed
  UNION ALL SELECT 'chunks', 'origin_node_id', k, ingested_at, 'nodes', {key_sql('origin_node_id')} FROM h WHERE NOT removed),
bad AS (
  SELECT r.*, CASE WHEN t.k IS NULL THEN 'missing' WHEN t.removed THEN 'removed' WHEN t.arrival > r.ingested_at THEN 'late' END AS reason
  FROM ref r LEFT JOIN target t ON t.target_table = r.target_table AND t.k = r.target_key WHERE r.target_key IS NOT NULL)
"""

P4_FOUND_SQL = _ORPHANS + "SELECT table_name, field_name, record_key FROM bad WHERE reason IS NOT NULL"
P4_MONTH_SQL = _ORPHANS + "SELECT table_name, field_name, reason, strftime(ingested_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS orphans FROM bad WHERE reason IS NOT NULL GROUP BY ALL"

QUERIES = {
    "p1_found": (p1_found, P1_FOUND_SQL),
    "p1_hierarchy": (p1_hierarchy, None),
    "p1_descendants": (p1_descendants, P1_DESCENDANTS_SQL),
    "p4_found": (p4_found, P4_FOUND_SQL),
    "p4_orphans_by_month": (p4_orphans_by_month, P4_MONTH_SQL),
}
