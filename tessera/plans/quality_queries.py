"""Queries of structure and quality measures over all current rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import quality as Q
from tessera.operators.ancestry import nearest_refs
from tessera.plans.search_queries import CORPUS_SQL, corpus
from tessera.plans.structure import current_sql, key_sql
from tessera.plans.text_queries import WS, cur
from tessera.sources.tables import key_of, read

NODE_FIELDS = ["parent_node_id", "node_type", "doc_id", "list_depth", "list_marker_style", "item_index", "table_node_id", "row_idx", "col_idx", "is_header", "row_span", "col_span"]
N = f"n AS MATERIALIZED (SELECT *, {key_sql('parent_node_id')} AS p FROM {current_sql('nodes', 'node_id')})"

def structural_invariants(spark: SparkSession, folder: str) -> DataFrame:
    return Q.structural_invariants(cur(spark, folder, "nodes", NODE_FIELDS))


_WRONG = "".join(f" UNION ALL SELECT 'invalid_{t}_parent', count(*)::DOUBLE FROM j WHERE node_type = '{t}' AND pk IS NOT NULL AND pt NOT IN ({', '.join(repr(a) for a in allowed)})" for t, allowed in Q.ALLOWED_PARENTS.items())
INVARIANTS_SQL = f"""WITH {N}, j AS (SELECT c.node_type, c.p, x.k AS pk, x.node_type AS pt FROM n c LEFT JOIN n x ON x.k = c.p WHERE c.p IS NOT NULL)
SELECT 'missing_parent' AS measure, count(*)::DOUBLE AS value FROM n WHERE node_type <> 'document' AND p IS NULL
UNION ALL SELECT 'dangling_parent', count(*)::DOUBLE FROM j WHERE pk IS NULL{_WRONG}"""


def table_cells(spark: SparkSession, folder: str, held: dict[str, DataFrame] | None = None) -> DataFrame:
    """(table_id, row_idx, col_idx, text) of the cells of all tables that are in a row; no text is an empty one."""
    n = cur(spark, folder, "nodes", ["node_type", "table_node_id", "row_idx", "col_idx", "text"], held).where("node_type = 'table_cell' and row_idx is not null")
    return n.select(key_of("table_node_id").alias("table_id"), "row_idx", "col_idx", F.coalesce("text", F.lit("")).alias("text")).where("table_id is not null")


def table_scorecard(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of sparse, overloaded, marked and described rows of all tables, and of their markers."""
    return Q.table_scorecard(table_cells(spark, folder))


SCORECARD_SQL = rf"""WITH c AS MATERIALIZED (SELECT {key_sql('table_node_id')} AS t, row_idx AS r, col_idx AS i, coalesce(text, '') AS x, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '{WS}'), lambda w: lower(regexp_replace(w, '[).:;]+$', ''))), lambda w: regexp_matches(w, '^[0-9]+[a-z]?$')) AS tk
  FROM {current_sql('nodes', 'node_id')} WHERE node_type = 'table_cell' AND row_idx IS NOT NULL AND {key_sql('table_node_id')} IS NOT NULL),
r AS (SELECT t, r, count(*) FILTER (trim(x) <> '') AS filled, len(list_distinct(flatten(list(tk)))) AS markers, coalesce(bool_or(regexp_matches(lower(regexp_replace(trim(x), '[).:;]+$', '')), '^[0-9]+[a-z]?$')) FILTER (i = 1), false) AS marked, coalesce(bool_or(regexp_matches(x, '[A-Za-z]')) FILTER (i = 2), false) AS described FROM c GROUP BY 1, 2),
s AS (SELECT DISTINCT t, k, regexp_extract(k, '^([0-9]+)', 1) AS num, nullif(regexp_extract(k, '([a-z])$', 1), '') AS l FROM (SELECT t, unnest(tk) AS k FROM c)),
m AS (SELECT count(*) AS n, coalesce(greatest(max(ascii(l)) - min(ascii(l)) + 1, nullif(count(DISTINCT l), 0)), 1) AS wanted FROM s GROUP BY t, num)
SELECT 'table_rows' AS measure, count(*)::DOUBLE AS value FROM r UNION ALL SELECT 'sparse_rows', count(*)::DOUBLE FROM r WHERE filled <= 1 UNION ALL SELECT 'overloaded_rows', count(*)::DOUBLE FROM r WHERE markers > 1
UNION ALL SELECT 'marker_rows', count(*)::DOUBLE FROM r WHERE marked UNION ALL SELECT 'described_rows', count(*)::DOUBLE FROM r WHERE marked AND described
UNION ALL SELECT 'markers_seen', coalesce(sum(n), 0)::DOUBLE FROM m UNION ALL SELECT 'markers_expected', coalesce(sum(wanted), 0)::DOUBLE FROM m"""


def list_semantics(spark: SparkSession, folder: str) -> DataFrame:
    return Q.list_semantics(cur(spark, folder, "nodes", NODE_FIELDS))


LIST_SQL = f"""WITH {N}, i AS (SELECT * FROM n WHERE node_type = 'list_item')
SELECT 'list_items' AS measure, count(*)::DOUBLE AS value FROM i
UNION ALL SELECT 'complete', count(*)::DOUBLE FROM i WHERE list_depth IS NOT NULL AND list_marker_style IS NOT NULL AND item_index IS NOT NULL
UNION ALL SELECT 'depth_violations', count(*)::DOUBLE FROM i JOIN n x ON x.k = i.p WHERE coalesce(i.list_depth, 1) > 1 AND (x.node_type <> 'list_item' OR x.list_depth IS NULL OR x.list_depth >= i.list_depth)"""


def table_semantics(spark: SparkSession, folder: str) -> DataFrame:
    return Q.table_semantics(cur(spark, folder, "nodes", NODE_FIELDS))


TABLE_SQL = f"""WITH {N}, c AS (SELECT * FROM n WHERE node_type = 'table_cell'), r AS (SELECT x.k, count(c.k) AS cells FROM n x LEFT JOIN c ON c.p = x.k WHERE x.node_type = 'table_row' GROUP BY 1)
SELECT 'cells' AS measure, count(*)::DOUBLE AS value FROM c
UNION ALL SELECT 'complete_cells', count(*)::DOUBLE FROM c WHERE table_node_id IS NOT NULL AND row_idx IS NOT NULL AND col_idx IS NOT NULL AND is_header IS NOT NULL AND row_span IS NOT NULL AND col_span IS NOT NULL
UNION ALL SELECT 'invalid_spans', count(*)::DOUBLE FROM c WHERE row_span < 1 OR col_span < 1
UNION ALL SELECT 'header_cells', count(*)::DOUBLE FROM c WHERE row_idx = 1
UNION ALL SELECT 'flagged_header_cells', count(*)::DOUBLE FROM c WHERE row_idx = 1 AND is_header IS NOT NULL
UNION ALL SELECT 'rows', count(*)::DOUBLE FROM r UNION ALL SELECT 'one_cell_rows', count(*)::DOUBLE FROM r WHERE cells = 1"""


def duplicate_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return Q.duplicate_keys(read(spark, folder, "chunks"), "chunk_id")


DUPLICATE_SQL = f"SELECT {key_sql('chunk_id')} AS key, count(*) AS copies FROM chunks WHERE {key_sql('chunk_id')} IS NOT NULL GROUP BY 1 HAVING count(*) > 1"


def _chunks(spark: SparkSession, folder: str, held: dict[str, DataFrame] | None = None) -> DataFrame:
    counted = [c for c in ("words", "copies") if held and c in held["chunks"].columns]
    return cur(spark, folder, "chunks", ["doc_id", "type", "ref", "heading", "chunk_seq", "text", "page_pdf_start", "page_pdf_end", "page_printed_start", "page_printed_end", *counted], held).withColumn("doc_id", F.btrim("doc_id"))


def sequence_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return Q.sequence_gaps(_chunks(spark, folder))


C = f"c AS MATERIALIZED (SELECT k AS chunk_id, trim(doc_id) AS doc_id, type, ref, heading, chunk_seq, text, page_pdf_start, page_pdf_end, page_printed_start, page_printed_end FROM {current_sql('chunks', 'chunk_id')})"
GAPS_SQL = f"WITH {C}, w AS (SELECT doc_id, lower(ref) AS ref, chunk_id, chunk_seq, coalesce(lag(chunk_seq) OVER (PARTITION BY doc_id, lower(ref) ORDER BY chunk_seq NULLS FIRST, chunk_id) + 1, 1) AS expected FROM c WHERE type = 'clause') SELECT * FROM w WHERE chunk_seq <> expected"


def overlap_words(spark: SparkSession, folder: str) -> DataFrame:
    return Q.overlap_words(_chunks(spark, folder))


OVERLAP_SQL = rf"""WITH {C}, b AS (SELECT doc_id, lower(ref) AS ref, chunk_id, chunk_seq, len(list_filter(regexp_split_to_array(text, '{WS}'), lambda w: w <> '')) AS size,
  list_filter(regexp_split_to_array(lower(CASE WHEN contains(text, chr(10) || chr(10)) THEN substr(text, strpos(text, chr(10) || chr(10)) + 2) ELSE text END), '{WS}'), lambda w: w <> '') AS words FROM c WHERE type = 'clause' AND text IS NOT NULL),
w AS (SELECT *, lag(words) OVER o AS prev, lag(size) OVER o AS prev_size, lag(chunk_seq) OVER o AS prev_seq FROM b WINDOW o AS (PARTITION BY doc_id, ref ORDER BY chunk_seq NULLS FIRST, chunk_id))
SELECT doc_id, ref, chunk_id, chunk_seq, coalesce(list_max(list_filter(range(1, least(100, len(words), len(prev)) + 1), lambda n: prev[len(prev) - n + 1:] = words[1:n])), 0) AS overlap
FROM w WHERE chunk_seq = prev_seq + 1 AND size >= 250 AND prev_size >= 250"""


def clause_split(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of how long clauses were cut."""
    return Q.clause_split(_chunks(spark, folder))


CLAUSE_SQL = rf"""WITH {C}, s AS (SELECT len(list_filter(regexp_split_to_array(text, '{WS}'), lambda w: w <> '')) AS n FROM c WHERE type = 'clause' AND text IS NOT NULL), o AS ({OVERLAP_SQL}), g AS ({GAPS_SQL})
SELECT 'longest_piece' AS measure, max(n)::DOUBLE AS value FROM s UNION ALL SELECT 'oversize', count(*)::DOUBLE FROM s WHERE n > 900 UNION ALL SELECT 'oversize_not_exempt', count(*)::DOUBLE FROM s WHERE n > 900
UNION ALL SELECT 'overlap_pairs', count(*)::DOUBLE FROM o UNION ALL SELECT 'overlap_compliant', count(*)::DOUBLE FROM o WHERE overlap BETWEEN 50 AND 100 UNION ALL SELECT 'sequence_violations', count(*)::DOUBLE FROM g"""


def repeated_edge_lines(spark: SparkSession, folder: str) -> DataFrame:
    return Q.repeated_edge_lines(read(spark, folder, "extracted_pages").select("extract_id", F.explode("pages").alias("page")))


EDGE_SQL = rf"""WITH p AS (SELECT extract_id, unnest(pages) AS page FROM extracted_pages),
l AS (SELECT extract_id, list_filter(list_transform(string_split(page, chr(10)), lambda x: lower(trim(regexp_replace(x, '{WS}', ' ', 'g')))), lambda x: x <> '') AS ls FROM p),
e AS (SELECT extract_id, 'header' AS edge, ls[1] AS line FROM l WHERE len(ls) > 0 UNION ALL SELECT extract_id, 'footer', ls[-1] FROM l WHERE len(ls) > 0)
SELECT extract_id, edge, line, count(*) AS pages FROM e WHERE strlen(line) <= 120 GROUP BY ALL HAVING count(*) >= 3"""


def judged_neighbourhood(spark: SparkSession, folder: str) -> DataFrame:
    """For every table chunk the 256 chunks of its document whose first page is nearest."""
    c = corpus(spark, folder)
    return Q.nearest_pages(c, c.where("type = 'table'").select(F.col("chunk_id").alias("seed"), "chunk_id", "doc_id", F.col("page_pdf_start").alias("page")))


NEAREST_SQL = f"WITH {CORPUS_SQL} SELECT s.chunk_id AS seed, c.chunk_id, row_number() OVER (PARTITION BY s.chunk_id ORDER BY c.chunk_id <> s.chunk_id, abs(coalesce(c.page_pdf_start, s.page_pdf_start, 0) - coalesce(s.page_pdf_start, 0)), c.chunk_id) AS place FROM c s JOIN c ON c.doc_id = s.doc_id WHERE s.type = 'table' QUALIFY place <= 256"


def _ranged() -> Column:
    return F.col("page_pdf_start").isNotNull() & (F.col("page_pdf_end") >= F.col("page_pdf_start"))


def _mapped() -> Column:
    return (F.btrim(F.coalesce("page_printed_start", F.lit(""))) != "") | (F.btrim(F.coalesce("page_printed_end", F.lit(""))) != "")


def range_counts() -> list[Column]:
    """Of chunks with a range of pages: how many, those with a printed page, and those whose printed pages run backwards."""
    low, high = F.expr("try_cast(page_printed_start as bigint)"), F.expr("try_cast(page_printed_end as bigint)")
    return [Q.count_if(_ranged()).alias("chunks"), Q.count_if(_ranged() & _mapped()).alias("mapped_chunks"), Q.count_if(_ranged() & (low > high)).alias("invalid_ranges")]


def printed_page_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Page labels and how chunks map to them; a chunk is mappable if a page with a label found lies in its range."""
    c = _chunks(spark, folder)
    return Q.unpivot(c.agg(*range_counts())).unionByName(page_labels(spark, folder, c))


def page_labels(spark: SparkSession, folder: str, chunks: DataFrame) -> DataFrame:
    """The measures of ``printed_page_metrics`` that look at pages."""
    pages = read(spark, folder, "page_provenance").select(F.btrim("doc_id").alias("doc_id"), "page_pdf", "printed_page_label", "printed_page_status", "backend").distinct()
    status = pages.agg(
        F.count("*").alias("pages"),
        Q.count_if(F.col("printed_page_status").isNotNull()).alias("with_status"),
        Q.count_if(F.col("printed_page_status") == "detected").alias("detected"),
        Q.count_if((F.col("printed_page_status") == "detected") & ~F.coalesce(X.is_printed_label(F.btrim("printed_page_label")), F.lit(False))).alias("invalid_labels"),
        Q.count_if(~F.col("backend").isin("text_layer", "ocr")).alias("unknown_backends"),
    )
    labelled = pages.where("printed_page_status = 'detected'").select("doc_id", F.col("page_pdf").alias("page")).distinct()
    spread = chunks.where(_ranged()).select("chunk_id", _mapped().alias("mapped"), "doc_id", F.explode(F.sequence("page_pdf_start", "page_pdf_end")).alias("page"))
    mappable = spread.join(labelled, ["doc_id", "page"], "left_semi").select("chunk_id", "mapped").distinct()
    return Q.unpivot(status).unionByName(Q.unpivot(mappable.agg(F.count("*").alias("mappable_chunks"), Q.count_if(F.col("mapped")).alias("mapped_mappable"))))


PRINTED_SQL = rf"""WITH {C}, p AS MATERIALIZED (SELECT DISTINCT trim(doc_id) AS doc_id, page_pdf, printed_page_label, printed_page_status, backend FROM page_provenance),
g AS (SELECT *, coalesce(trim(page_printed_start), '') <> '' OR coalesce(trim(page_printed_end), '') <> '' AS mapped,
  EXISTS (SELECT 1 FROM p WHERE p.doc_id = c.doc_id AND printed_page_status = 'detected' AND page_pdf BETWEEN page_pdf_start AND page_pdf_end) AS can FROM c WHERE page_pdf_start IS NOT NULL AND page_pdf_end >= page_pdf_start)
SELECT 'pages' AS measure, count(*)::DOUBLE AS value FROM p UNION ALL SELECT 'with_status', count(printed_page_status)::DOUBLE FROM p UNION ALL SELECT 'detected', count(*)::DOUBLE FROM p WHERE printed_page_status = 'detected'
UNION ALL SELECT 'invalid_labels', count(*)::DOUBLE FROM p WHERE printed_page_status = 'detected' AND NOT coalesce(regexp_matches(trim(printed_page_label), '^([0-9]+|[ivxlcdmIVXLCDM]+)$'), false)
UNION ALL SELECT 'unknown_backends', count(*)::DOUBLE FROM p WHERE backend NOT IN ('text_layer', 'ocr')
UNION ALL SELECT 'chunks', count(*)::DOUBLE FROM g UNION ALL SELECT 'mapped_chunks', count(*)::DOUBLE FROM g WHERE mapped UNION ALL SELECT 'mappable_chunks', count(*)::DOUBLE FROM g WHERE can
UNION ALL SELECT 'mapped_mappable', count(*)::DOUBLE FROM g WHERE can AND mapped UNION ALL SELECT 'invalid_ranges', count(*)::DOUBLE FROM g WHERE TRY_CAST(page_printed_start AS BIGINT) > TRY_CAST(page_printed_end AS BIGINT)"""


def label_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """First and last label found on the pages of each chunk."""
    c = _chunks(spark, folder).where("page_pdf_start is not null and page_pdf_end >= page_pdf_start")
    labels = read(spark, folder, "page_provenance").where("printed_page_label is not null").select(F.btrim("doc_id").alias("doc_id"), F.col("page_pdf").alias("page"), "printed_page_label")
    spread = c.select("chunk_id", "doc_id", F.explode(F.sequence("page_pdf_start", "page_pdf_end")).alias("page")).join(labels, ["doc_id", "page"])
    ends = F.struct("page", F.col("printed_page_label").alias("label"))
    return spread.groupBy("chunk_id").agg(F.min(ends)["label"].alias("first_label"), F.max(ends)["label"].alias("last_label"))


LABELS_SQL = f"WITH {C}, l AS (SELECT trim(doc_id) AS doc_id, page_pdf AS page, printed_page_label AS label FROM page_provenance WHERE printed_page_label IS NOT NULL), s AS (SELECT chunk_id, page, label FROM c JOIN l ON l.doc_id = c.doc_id AND page BETWEEN page_pdf_start AND page_pdf_end) SELECT chunk_id, arg_min(label, (page, label)) AS first_label, arg_max(label, (page, label)) AS last_label FROM s GROUP BY 1"


def freshness_by_part(spark: SparkSession, folder: str, held: dict[str, DataFrame] | None = None) -> DataFrame:
    """The latest document of each part, and how many days it lies behind the latest of all; parts more than a year behind are stale."""
    d = cur(spark, folder, "docs", ["part"], held).where("part is not null")
    per = d.groupBy("part").agg(F.max(F.struct("ingested_at", "doc_id")).alias("m"), F.count("*").alias("docs"))
    latest = per.agg(F.max("m.ingested_at").alias("latest"))  # one row
    return per.crossJoin(F.broadcast(latest)).select("part", F.col("m.doc_id").alias("doc_id"), "docs", (F.unix_timestamp("latest") - F.unix_timestamp("m.ingested_at") > 365 * 86400).alias("stale"))


FRESHNESS_SQL = f"WITH d AS (SELECT part, k, ingested_at FROM {current_sql('docs', 'doc_id')} WHERE part IS NOT NULL), p AS (SELECT part, arg_max(k, (ingested_at, k)) AS doc_id, count(*) AS docs, max(ingested_at) AS m FROM d GROUP BY 1) SELECT part, doc_id, docs, epoch((SELECT max(m) FROM p))::BIGINT - floor(epoch(m))::BIGINT > 365 * 86400 AS stale FROM p"


def replay_stability(spark: SparkSession, folder: str) -> DataFrame:
    """Per backend the share of pages whose character counts agree between the first and the last record of the page."""
    rows = read(spark, folder, "page_provenance").select("extract_id", "page_pdf", "backend", "generated_at", F.coalesce("text_char_count", F.lit(-1)).alias("t"), F.coalesce("ocr_char_count", F.lit(-1)).alias("o"))
    pages = rows.groupBy("extract_id", "page_pdf", "backend").agg(F.min(F.struct("generated_at", "t", "o")).alias("a"), F.max(F.struct("generated_at", "t", "o")).alias("b"))
    same = (F.col("a.t") == F.col("b.t")) & (F.col("a.o") == F.col("b.o"))
    return pages.groupBy("backend").agg(F.count("*").alias("pages"), F.round(F.avg(same.cast("double")), 6).alias("stable"))


REPLAY_SQL = "WITH r AS (SELECT extract_id, page_pdf, backend, generated_at AS g, coalesce(text_char_count, -1) AS t, coalesce(ocr_char_count, -1) AS o FROM page_provenance), p AS (SELECT backend, arg_min((t, o), (g, t, o)) = arg_max((t, o), (g, t, o)) AS same FROM r GROUP BY extract_id, page_pdf, backend) SELECT backend, count(*) AS pages, round(avg(same::INT::DOUBLE), 6) AS stable FROM p GROUP BY 1"


def nearest_ref(spark: SparkSession, folder: str) -> DataFrame:
    """For every table cell the nearest reference above it."""
    return nearest_refs(cur(spark, folder, "nodes", ["parent_node_id", "node_type", "ref"]), F.col("node_type") == "table_cell")


NEAREST_REF_SQL = f"""WITH RECURSIVE n AS MATERIALIZED (SELECT k, {key_sql('parent_node_id')} AS p, node_type, ref FROM {current_sql('nodes', 'node_id')}),
w AS (SELECT k AS node_id, p AS here, 1 AS d FROM n WHERE node_type = 'table_cell' UNION ALL SELECT w.node_id, n.p, d + 1 FROM w JOIN n ON n.k = w.here WHERE d < 16),
h AS (SELECT w.node_id, d, n.ref FROM w JOIN n ON n.k = w.here WHERE n.node_type IN ('clause', 'subclause', 'annex', 'table') AND {key_sql('n.ref')} IS NOT NULL)
SELECT c.k AS node_id, arg_min(h.ref, h.d) AS parent_ref FROM n c LEFT JOIN h ON h.node_id = c.k WHERE c.node_type = 'table_cell' GROUP BY 1"""

QUERIES = {
    "structural_invariants": (structural_invariants, INVARIANTS_SQL),
    "list_semantics": (list_semantics, LIST_SQL),
    "table_semantics": (table_semantics, TABLE_SQL),
    "table_scorecard": (table_scorecard, SCORECARD_SQL),
    "duplicate_chunks": (duplicate_chunks, DUPLICATE_SQL),
    "sequence_gaps": (sequence_gaps, GAPS_SQL),
    "overlap_words": (overlap_words, OVERLAP_SQL),
    "clause_split": (clause_split, CLAUSE_SQL),
    "repeated_edge_lines": (repeated_edge_lines, EDGE_SQL),
    "judged_neighbourhood": (judged_neighbourhood, NEAREST_SQL),
    "printed_page_metrics": (printed_page_metrics, PRINTED_SQL),
    "label_ranges": (label_ranges, LABELS_SQL),
    "freshness_by_part": (freshness_by_part, FRESHNESS_SQL),
    "replay_stability": (replay_stability, REPLAY_SQL),
    "nearest_ref": (nearest_ref, NEAREST_REF_SQL),
}
