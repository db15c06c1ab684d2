"""Queries of parsing, inventory, upserts and staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import parsing
from tessera.operators.retrieval import payload
from tessera.plans.search_queries import CORPUS_SQL, PAYLOAD, corpus, with_sql
from tessera.plans.structure import current_sql
from tessera.plans.text_queries import cur
from tessera.sources import files
from tessera.sources.tables import current_rows, read
from tessera.streaming import jobs


def parsed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """All extractions parsed into structured chunks, long ones in parts."""
    return parsing.structured_chunks(read(spark, folder, "extracted_pages"))


def parsed_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs, list items, notes and table rows of all chunks."""
    return parsing.blocks(corpus(spark, folder))


def inventory_names(spark: SparkSession, folder: str) -> DataFrame:
    """Part and year that the file names of all documents state, and whether they agree with the table."""
    d = cur(spark, folder, "docs", ["filename", "part", "year"])
    part, year = files.part_year(F.col("filename"))
    return d.select("doc_id", F.coalesce(part, F.lit(-1)).alias("name_part"), F.coalesce(year, F.lit(-1)).alias("name_year"), F.coalesce((part == F.col("part")) & (year == F.col("year")), F.lit(False)).alias("agrees"))


INVENTORY_SQL = rf"WITH d AS (SELECT k, part, year, TRY_CAST(nullif(regexp_extract(filename, '-(\d+);(\d{{4}})', 1), '') AS INT) AS np, TRY_CAST(nullif(regexp_extract(filename, '-(\d+);(\d{{4}})', 2), '') AS INT) AS ny FROM {current_sql('docs', 'doc_id')}) SELECT k AS doc_id, coalesce(np, -1) AS name_part, coalesce(ny, -1) AS name_year, coalesce(np = part AND ny = year, false) AS agrees FROM d"


def embed_staleness(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks whose embedding has to be made again if embeddings were made of the earliest rows."""
    c = corpus(spark, folder)
    now = c.select("chunk_id", F.sha2(payload(F.col("type"), F.col("ref"), F.col("heading"), F.col("text"), F.col("table_md")), 256).alias("payload_hash")).where("payload_hash is not null")
    first = read(spark, folder, "chunks").withColumn("minus", -F.unix_micros("ingested_at"))
    old = current_rows(first, "chunk_id", ["type", "ref", "heading", "text", "table_md"], order="minus")
    stored = old.select("chunk_id", F.sha2(payload(F.col("type"), F.col("ref"), F.col("heading"), F.col("text"), F.col("table_md")), 256).alias("payload_hash"), F.lit(384).alias("dims")).where("payload_hash is not null")
    return files.stale_embeddings(now, stored, 384)


STALE_SQL = with_sql(
    CORPUS_SQL,
    f"now AS (SELECT chunk_id, sha256({PAYLOAD}) AS h FROM c), o AS (SELECT trim(chunk_id) AS chunk_id, type, ref, heading, text, table_md FROM (SELECT *, row_number() OVER (PARTITION BY trim(chunk_id) ORDER BY ingested_at) AS rn FROM chunks) WHERE rn = 1), old AS (SELECT chunk_id, sha256({PAYLOAD}) AS h FROM o)",
    select="SELECT now.chunk_id, CASE WHEN old.h IS NULL THEN 'missing' ELSE 'changed' END AS reason FROM now LEFT JOIN old USING (chunk_id) WHERE now.h IS NOT NULL AND (old.h IS NULL OR now.h <> old.h)",
)


def docs_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The documents with the rows of the latest year in place of earlier ones of the same key."""
    d = cur(spark, folder, "docs", ["filename", "part", "year", "title"]).drop("ingested_at")
    return files.upsert(d, d.where("year = 2024").withColumn("title", F.upper("title")), ["doc_id"]).select("doc_id", "filename", "title")


UPSERT_SQL = f"SELECT k AS doc_id, filename, CASE WHEN year = 2024 THEN upper(title) ELSE title END AS title FROM {current_sql('docs', 'doc_id')}"


def target_coverage(spark: SparkSession, folder: str, held: dict[str, DataFrame] | None = None) -> DataFrame:
    """Documents named by nodes or known as documents but not both."""
    nodes = cur(spark, folder, "nodes", ["doc_id", "node_type"], held).where("node_type = 'document'").select(F.btrim("doc_id").alias("target_id")).where("target_id != ''")
    return files.target_coverage(cur(spark, folder, "docs", [], held).select(F.col("doc_id").alias("target_id")), nodes)


COVERAGE_SQL = f"WITH t AS (SELECT k AS target_id FROM {current_sql('docs', 'doc_id')}), f AS (SELECT trim(doc_id) AS target_id, count(*) AS n FROM {current_sql('nodes', 'node_id')} WHERE node_type = 'document' AND trim(doc_id) <> '' GROUP BY 1) SELECT coalesce(t.target_id, f.target_id) AS target_id, CASE WHEN n IS NULL THEN 'missing' WHEN t.target_id IS NULL THEN 'unexpected' ELSE 'duplicate' END AS problem FROM t FULL JOIN f ON t.target_id = f.target_id WHERE n IS NULL OR t.target_id IS NULL OR n > 1"


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Ten-minute counts of the events."""
    out = jobs.windowed_counts(read(spark, folder, "events"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


EVENTS_SQL = "SELECT strftime(time_bucket(INTERVAL 10 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"

QUERIES = {
    "parsed_chunks": (parsed_chunks, None),
    "parsed_blocks": (parsed_blocks, None),
    "inventory_names": (inventory_names, INVENTORY_SQL),
    "embed_staleness": (embed_staleness, STALE_SQL),
    "docs_upsert": (docs_upsert, UPSERT_SQL),
    "target_coverage": (target_coverage, COVERAGE_SQL),
    "event_windows": (event_windows, EVENTS_SQL),
}
