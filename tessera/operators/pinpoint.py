"""Passages, rows and cells of a chunk that answer a query, best first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as X
from tessera.sources.scratch import Scratch
from tessera.sources.tables import key_of

LEAST_BYTES = 24


def sentence_units(chunks: DataFrame) -> DataFrame:
    """(chunk_id, unit_id, unit_type, text): sentences of at least 24 bytes, cut at . ! ? ; and line ends. What follows the last mark is
    left out, unless no sentence is long enough: then the whole text is one. Null and blank texts have none."""
    pieces = chunks.where("text is not null").select("chunk_id", F.posexplode(F.split("text", r"(?<=[.!?;\n])")).alias("n", "piece"))
    ended = pieces.where(F.col("piece").rlike(r"[.!?;\n]$")).select("chunk_id", "n", X.collapse(F.col("piece")).alias("text")).where(F.octet_length("text") >= LEAST_BYTES)
    place = F.row_number().over(Window.partitionBy("chunk_id").orderBy("n")) - 1
    ended = ended.withColumn("at", place).drop("n")
    rest = chunks.where("text is not null").select("chunk_id", X.collapse(F.col("text")).alias("text"), F.lit(0).alias("at")).where(F.octet_length("text") >= LEAST_BYTES)
    units = ended.unionByName(rest.join(ended.select("chunk_id").distinct(), "chunk_id", "left_anti"))
    return units.select("chunk_id", _numbered("chunk_id", "sentence", F.col("at") + 1).alias("unit_id"), F.lit("sentence_window").alias("unit_type"), "text", F.lit(None).cast("long").alias("row_idx"), F.lit(None).cast("long").alias("col_idx"), F.lit(None).cast("string").alias("anchor"))


def table_units(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """All rows and cells of the table node that a chunk comes from."""
    cells = nodes.where("node_type in ('table_row', 'table_cell') and text is not null").select(key_of("table_node_id").alias("t"), "node_id", "node_type", "text", "row_idx", "col_idx", "citation_anchor_id")
    tables = chunks.select("chunk_id", key_of("origin_node_id").alias("o")).where("o is not null")
    held = tables.join(cells, F.col("o") == F.col("t"))
    return held.select("chunk_id", F.col("node_id").alias("unit_id"), F.col("node_type").alias("unit_type"), X.collapse(F.col("text")).alias("text"), "row_idx", "col_idx", F.col("citation_anchor_id").alias("anchor"))


def _numbered(chunk: str, kind: str, at: Column) -> Column:
    digits = at.cast("string")
    return F.concat_ws(":", F.col(chunk), F.lit(kind), F.when(F.length(digits) >= 3, digits).otherwise(F.lpad(digits, 3, "0")))


def markdown_units(chunks: DataFrame) -> DataFrame:
    """The lines of a chunk's Markdown table, its rule included, as rows."""
    lines = F.filter(F.transform(F.split("table_md", "\n"), lambda x: X.collapse(x)), lambda x: F.startswith(x, F.lit("|")))
    rows = chunks.where("table_md is not null").select("chunk_id", "citation_anchor_id", F.posexplode(lines).alias("at", "text")).withColumn("row_idx", (F.col("at") + 1).cast("long"))
    return rows.select("chunk_id", _numbered("chunk_id", "table_md_row", F.col("row_idx")).alias("unit_id"), F.lit("table_row").alias("unit_type"), "text", "row_idx", F.lit(None).cast("long").alias("col_idx"), F.col("citation_anchor_id").alias("anchor"))


def fallback_units(chunks: DataFrame) -> DataFrame:
    """The beginning of a chunk's text, for chunks that have nothing else to point at."""
    text = X.collapse(F.substring(F.coalesce("text", F.lit("")), 1, 420))
    return chunks.select("chunk_id", _numbered("chunk_id", "fallback", F.lit(1)).alias("unit_id"), F.lit("chunk_snippet").alias("unit_type"), text.alias("text"), F.lit(None).cast("long").alias("row_idx"), F.lit(None).cast("long").alias("col_idx"), F.col("citation_anchor_id").alias("anchor"))


def units_of(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(chunk_id, unit_id, unit_type, text, row_idx, col_idx, anchor): of each chunk the nodes of its table, else the rows of its Markdown,
    else its sentences, else its beginning."""
    scratch = Scratch(chunks.sparkSession, "units")
    out = scratch.keep(table_units(chunks, nodes), "tables")
    for make in (markdown_units, sentence_units, fallback_units):
        rest = chunks.join(out.select("chunk_id").distinct(), "chunk_id", "left_anti")
        out = scratch.keep(out.unionByName(make(rest)), "units")
    return out


def _family(anchor: Column) -> Column:
    parts = F.split(anchor, ":")
    return F.concat_ws(":", F.btrim(parts[0]), F.btrim(F.try_element_at(parts, F.lit(2))))


def pinpoint(hits: DataFrame, chunks: DataFrame, nodes: DataFrame, queries: DataFrame, units_per_chunk: int = 3) -> DataFrame:
    """(query_id, chunk_id, unit_id, unit_type, score, place, text): the best units of each hit (query_id, chunk_id).

    The score is 0.7 of the share of the query's words in the unit, 0.2 if it holds the query, 0.1 if it has half of the words, and
    amounts for rows and cells where the query speaks of tables, for a foreign anchor, for long units and for a mere beginning.
    """
    wanted = chunks.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
    units = units_of(wanted, nodes)
    parents = wanted.select("chunk_id", F.col("citation_anchor_id").alias("parent"))
    asked = queries.select("query_id", X.alnum_tokens(F.col("query_text"), 2, X.PINPOINT_STOPWORDS, digits=True).alias("tokens"), F.lower(X.collapse(F.col("query_text"))).alias("phrase"))
    j = hits.select("query_id", "chunk_id").join(units, "chunk_id").join(parents, "chunk_id").join(asked, "query_id")
    unit_tokens = X.alnum_tokens(F.col("text"), 2, X.PINPOINT_STOPWORDS, digits=True)
    overlap = F.when((F.size("tokens") > 0) & (F.size(unit_tokens) > 0), F.size(F.array_intersect("tokens", unit_tokens)) / F.size("tokens")).otherwise(0.0)
    phrase = F.when((F.octet_length("phrase") >= 8) & F.contains(F.lower("text"), F.col("phrase")), 1.0).otherwise(0.0)
    names_table = F.col("phrase").rlike("^table [0-9]+$")
    of_tables = F.contains(F.col("phrase"), F.lit("table")) | F.contains(F.col("phrase"), F.lit(" row ")) | F.contains(F.col("phrase"), F.lit(" cell "))

    def by_type(row: float, cell: float, sentence: float) -> Column:
        return F.when(F.col("unit_type") == "table_row", row).when(F.col("unit_type") == "table_cell", cell).otherwise(sentence)

    table_part = F.when(names_table, by_type(0.45, 0.20, -0.50)).when(of_tables, by_type(0.22, 0.12, -0.15)).otherwise(0.0)
    blank = (F.btrim(F.coalesce("anchor", F.lit(""))) == "") | (F.btrim(F.coalesce("parent", F.lit(""))) == "")
    foreign = F.when(blank | (F.col("anchor") == F.col("parent")) | (_family(F.col("anchor")) == _family(F.col("parent"))), 0.0).otherwise(-0.20)
    size = F.when(F.octet_length("text") > 1200, -0.04).when(F.octet_length("text") > 700, -0.02).otherwise(0.0)
    j = j.withColumn("overlap", overlap)
    score = F.round(F.col("overlap") * 0.70 + phrase * 0.20 + F.when(F.col("overlap") >= 0.5, 0.10).otherwise(0.0) + table_part + foreign + size + F.when(F.col("unit_type") == "chunk_snippet", -0.05).otherwise(0.0), 6)
    priority = F.when(names_table, by_type(4, 3, 1)).when(of_tables, by_type(4, 3, 2)).otherwise(by_type(2, 1, 3))
    order = Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("score"), F.desc("priority"), F.asc_nulls_last("row_idx"), F.asc_nulls_last("col_idx"), "unit_id")
    scored = j.withColumns({"score": score, "priority": priority}).withColumn("place", F.row_number().over(order))
    return scored.where(F.col("place") <= units_per_chunk).select("query_id", "chunk_id", "unit_id", "unit_type", "score", "place", "text")
