"""Queries of the scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.plans.structure import current_sql
from tessera.sources.tables import current_rows, read

SERIES = "RDS"
WS = r"[\s\p{Z}]+"


def cur(spark: SparkSession, folder: str, table: str, columns: list[str], held: dict[str, DataFrame] | None = None, copies: str | None = None) -> DataFrame:
    """The current rows of a table, with ``copies`` the number of rows of each under that name. ``held`` has those that a caller made once for several queries, by the table's name."""
    key = {"nodes": "node_id", "chunks": "chunk_id", "docs": "doc_id"}[table]
    if held and table in held:
        return held[table].select(key, *columns, "ingested_at")
    return current_rows(read(spark, folder, table), key, columns, *(["ingested_at", None, copies] if copies else []))


def text_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    """Sanitised references, normal markers with style, number and letter, and citation anchors of all nodes."""
    n = cur(spark, folder, "nodes", ["doc_id", "node_type", "ref", "anchor_type", "anchor_label_raw", "anchor_order"])
    label = X.marker_label(F.col("anchor_label_raw"))
    return n.select(
        "node_id",
        X.sanitise_id(F.col("ref")).alias("ref_id"),
        label.alias("marker"),
        X.marker_style(label).alias("style"),
        F.coalesce(X.marker_number(label), F.lit(-1)).alias("number"),
        X.marker_suffix(label).alias("suffix"),
        X.citation_anchor(F.col("doc_id"), F.col("ref"), F.coalesce("anchor_type", F.lit("none")), F.col("anchor_label_raw"), F.col("anchor_order")).alias("anchor"),
    )


_SAN = "trim(lower(regexp_replace({0}, '[^A-Za-z0-9]+', '_', 'g')), '_')"
_BARE = r"regexp_replace(regexp_replace(trim(anchor_label_raw), '[).:;]+$', ''), '[–—]', '-', 'g')"
TEXT_IDENTIFIERS_SQL = rf"""
WITH m AS (SELECT *, {_BARE} AS bare FROM {current_sql('nodes', 'node_id')}),
l AS (SELECT *, CASE WHEN trim(anchor_label_raw) = '' THEN '-' WHEN bare IN ('-', '*', '•') THEN '-' WHEN upper(bare) = 'NOTE' THEN 'NOTE'
  WHEN regexp_matches(upper(bare), '^NOTE\s+[0-9]+\s*$') THEN 'NOTE ' || regexp_extract(upper(bare), '^NOTE\s+([0-9]+)\s*$', 1) ELSE lower(bare) END AS marker FROM m)
SELECT k AS node_id, {_SAN.format('ref')} AS ref_id, marker,
  CASE WHEN marker = '-' THEN 'bullet' WHEN regexp_matches(marker, '^[0-9]+$') THEN 'numeric' WHEN regexp_matches(marker, '^[a-z]$') THEN 'alpha'
    WHEN regexp_matches(marker, '^[ivxlcdm]{{2,}}$') THEN 'roman' WHEN regexp_matches(marker, '^[0-9]+[a-z]?$') THEN 'alnum' ELSE 'symbol' END AS style,
  coalesce(TRY_CAST(nullif(regexp_extract(marker, '^([0-9]{{1,18}})[a-z]?$', 1), '') AS BIGINT), -1) AS number,
  nullif(regexp_extract(marker, '^[0-9]+([a-z])$', 1), '') AS suffix,
  concat_ws(':', doc_id, {_SAN.format('ref')}, {_SAN.format("coalesce(anchor_type, 'none')")}, coalesce(CASE WHEN trim(anchor_label_raw) <> '' THEN {_SAN.format('anchor_label_raw')} END, CAST(anchor_order AS VARCHAR), 'root')) AS anchor
FROM l
"""


def text_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Collapsed text, word and character counts, depth, path and banner test of all nodes."""
    n = cur(spark, folder, "nodes", ["node_type", "ref", "text", "page_pdf_start", "page_pdf_end"])
    kind = F.when(F.col("node_type") == "subclause", "clause").otherwise(F.col("node_type"))
    return n.select(
        "node_id",
        F.md5(X.collapse(F.col("text"))).alias("collapsed"),
        F.coalesce(X.word_count(F.col("text")), F.lit(-1)).alias("words"),
        F.coalesce(X.visible_chars(F.col("text")).cast("long"), F.lit(-1)).alias("visible"),
        F.coalesce(X.list_depth(F.col("text")), F.lit(-1)).alias("depth"),
        X.ref_path(F.col("ref"), kind).alias("path"),
        X.clause_type(F.col("ref"), kind).alias("clause_type"),
        X.page_range(F.col("page_pdf_start"), F.col("page_pdf_end")).alias("pages"),
        X.is_licence_noise(F.col("text")).alias("banner"),
        F.sha2("text", 256).alias("sha"),
    )


TEXT_MEASURES_SQL = rf"""
WITH n AS (SELECT *, CASE WHEN node_type = 'subclause' THEN 'clause' ELSE node_type END AS kind, regexp_extract(text, '^(\s*)', 1) AS indent, lower(text) AS low FROM {current_sql('nodes', 'node_id')})
SELECT k AS node_id, md5(trim(regexp_replace(text, '{WS}', ' ', 'g'))) AS collapsed,
  coalesce(len(list_filter(regexp_split_to_array(text, '{WS}'), lambda w: w <> '')), -1) AS words,
  coalesce(length(regexp_replace(text, '{WS}', '', 'g')), -1) AS visible,
  coalesce(CASE WHEN text IS NOT NULL THEN least((length(indent) + 3 * (length(indent) - length(replace(indent, chr(9), '')))) // 2, 5) + 1 END, -1) AS depth,
  CASE WHEN kind = 'clause' THEN replace(ref, '.', ' > ') ELSE ref END AS path,
  CASE WHEN kind = 'clause' AND len(string_split(ref, '.')) > 2 THEN 'subclause' ELSE kind END AS clause_type,
  CASE WHEN page_pdf_start IS NULL AND page_pdf_end IS NULL THEN 'unknown' WHEN page_pdf_start IS NULL THEN CAST(page_pdf_end AS VARCHAR)
    WHEN page_pdf_end IS NULL OR page_pdf_start = page_pdf_end THEN CAST(page_pdf_start AS VARCHAR) ELSE page_pdf_start || '-' || page_pdf_end END AS pages,
  (contains(low, 'store order') AND contains(low, 'downloaded:')) OR ((contains(low, 'single user licence only') OR contains(low, 'single user license only')) AND contains(low, 'networking prohibited'))
    OR (contains(low, 'licensed to') AND contains(low, 'license #') AND contains(low, 'downloaded:')) AS banner,
  sha256(text) AS sha
FROM n
"""


def citation_render(spark: SparkSession, folder: str) -> DataFrame:
    """The printed citation and base reference of every chunk of a known document."""
    c = cur(spark, folder, "chunks", ["doc_id", "ref", "anchor_type", "anchor_label_norm", "page_pdf_start", "page_pdf_end"])
    d = cur(spark, folder, "docs", ["part", "year"])
    j = c.withColumn("doc_id", F.btrim("doc_id")).drop("ingested_at").join(d.drop("ingested_at"), "doc_id")
    return j.select("chunk_id", X.base_reference(F.col("ref")).alias("base"), X.citation(SERIES, F.col("part"), F.col("year"), F.col("ref"), F.col("anchor_type"), F.col("anchor_label_norm"), F.col("page_pdf_start"), F.col("page_pdf_end")).alias("citation"))


def _base_sql(ref: str) -> str:
    whens = " ".join(f"WHEN contains({ref}, '{w}') THEN string_split({ref}, '{w}')[1]" for w in (" item ", " note ", " para ", " row "))
    return f"CASE {whens} ELSE {ref} END"


PAGES_SQL = "CASE WHEN page_pdf_start IS NULL AND page_pdf_end IS NULL THEN 'unknown' WHEN page_pdf_start IS NULL THEN CAST(page_pdf_end AS VARCHAR) WHEN page_pdf_end IS NULL OR page_pdf_start = page_pdf_end THEN CAST(page_pdf_start AS VARCHAR) ELSE page_pdf_start || '-' || page_pdf_end END"
CITATION_RENDER_SQL = f"""
WITH j AS (SELECT c.*, d.part, d.year, CASE WHEN coalesce(c.ref, '') = '' THEN '(unreferenced chunk)' ELSE c.ref END AS name
  FROM {current_sql('chunks', 'chunk_id')} c JOIN {current_sql('docs', 'doc_id')} d ON d.k = trim(c.doc_id))
SELECT k AS chunk_id, {_base_sql('ref')} AS base,
  '{SERIES} ' || coalesce(CAST(part AS VARCHAR), '?') || ':' || coalesce(CAST(year AS VARCHAR), '?') || ', ' ||
  CASE WHEN anchor_type = 'marker' AND coalesce(anchor_label_norm, '') <> '' AND starts_with(anchor_label_norm, 'NOTE') THEN {_base_sql('name')} || ', ' || anchor_label_norm
    WHEN anchor_type = 'marker' AND coalesce(anchor_label_norm, '') <> '' THEN {_base_sql('name')} || '(' || anchor_label_norm || ')'
    WHEN anchor_type = 'paragraph' AND coalesce(anchor_label_norm, '') <> '' THEN {_base_sql('name')} || ', para ' || anchor_label_norm
    ELSE name END || ', PDF pages ' || {PAGES_SQL} AS citation
FROM j
"""


def intent_router(spark: SparkSession, folder: str) -> DataFrame:
    """Exact intent, signal tokens, pinpoint tokens and text to embed of every evaluation query."""
    q = read(spark, folder, "eval_queries")
    return q.select(
        "query_id",
        X.exact_intent(F.col("query_text")).alias("exact"),
        F.array_join(X.alnum_tokens(F.col("query_text"), 3, X.SIGNAL_STOPWORDS), "|").alias("signal"),
        F.array_join(X.alnum_tokens(F.col("query_text"), 2, X.PINPOINT_STOPWORDS, digits=True), "|").alias("pinpoint"),
        X.strip_opening(F.col("query_text")).alias("embedded"),
    )


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def tokens_sql(text: str, least: int, stop: list[str], digits: bool = False) -> str:
    keep = f"length(t) >= {least}" + (" OR regexp_matches(t, '^[0-9]+$')" if digits else "")
    return f"list_sort(list_distinct(list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda t: ({keep}) AND t NOT IN ({_list(stop)}))))"


_OPENINGS = " ".join(f"WHEN starts_with(lower(t), '{o}') AND trim(substr(t, {len(o) + 1})) <> '' THEN trim(substr(t, {len(o) + 1}))" for o in X.QUERY_OPENINGS)
INTENT_ROUTER_SQL = rf"""
WITH q AS (SELECT *, trim(regexp_replace(query_text, '{WS}', ' ', 'g')) AS t, lower(trim(query_text)) AS low FROM eval_queries)
SELECT query_id,
  CASE WHEN starts_with(low, 'table ') THEN regexp_matches(regexp_extract(low, '^\S+\s+(\S+)', 1), '^[0-9]+$')
    WHEN starts_with(low, 'annex ') THEN regexp_matches(regexp_extract(low, '^\S+\s+(\S+)', 1), '^[a-z]+$')
    ELSE regexp_matches(regexp_extract(low, '^(\S+)', 1), '^[0-9]+(\.[0-9]+)+$') END AS exact,
  array_to_string({tokens_sql('query_text', 3, X.SIGNAL_STOPWORDS)}, '|') AS signal,
  array_to_string({tokens_sql('query_text', 2, X.PINPOINT_STOPWORDS, True)}, '|') AS pinpoint,
  CASE {_OPENINGS} ELSE t END AS embedded
FROM q
"""


def printed_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The label printed on each page of each extraction, and its characters that aren't white space."""
    pages = read(spark, folder, "extracted_pages").select("extract_id", F.posexplode("pages").alias("at", "page"))
    return pages.select("extract_id", (F.col("at") + 1).cast("long").alias("page_pdf"), X.printed_label(F.col("page")).alias("label"), X.visible_chars(F.col("page")).cast("long").alias("visible"))


PRINTED_LABELS_SQL = rf"""
WITH p AS (SELECT extract_id, unnest(pages) AS page, generate_subscripts(pages, 1) AS page_pdf FROM extracted_pages),
l AS (SELECT *, string_split(regexp_replace(page, '\n$', ''), chr(10)) AS ls FROM p),
b AS (SELECT *, list_filter(list_transform(list_concat(list_reverse(ls)[1:5], ls[1:2]), lambda x: trim(regexp_replace(x, '[^A-Za-z0-9\s]', '', 'g'))),
  lambda x: regexp_matches(x, '(?i)^(page\s+[0-9ivxlcdm]+|[0-9]{{1,4}}|[ivxlcdm]{{1,8}})$')) AS found FROM l)
SELECT extract_id, CAST(page_pdf AS BIGINT) AS page_pdf, lower(regexp_replace(found[1], '(?i)^page\s+', '')) AS label, length(regexp_replace(page, '{WS}', '', 'g')) AS visible FROM b
"""

QUERIES = {"text_identifiers": (text_identifiers, TEXT_IDENTIFIERS_SQL), "text_measures": (text_measures, TEXT_MEASURES_SQL), "citation_render": (citation_render, CITATION_RENDER_SQL), "intent_router": (intent_router, INTENT_ROUTER_SQL), "printed_labels": (printed_labels, PRINTED_LABELS_SQL)}
